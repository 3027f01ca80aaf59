import random

import numpy as np
import xxhash

from liftpanel.llm.graph import components
from liftpanel.llm.simhash_bktree import fingerprint, links, near_duplicates, shard_links
from tests.conftest import SMALL
from tests.llm.cases import bears_odd_tables, odd


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    distinct = np.array(sorted(parent), np.uint64)
    for p in parent:
        for q in distinct[np.bitwise_count(distinct ^ np.uint64(p)) <= radius].tolist():
            parent[root(p)] = root(q)
    return {p: root(p) for p in parent}


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_groups(set(prints))
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[roots[p]] = min(doc_id, least.get(roots[p], doc_id))
    return sorted(((i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def test_fingerprint_of_bytes():
    for text in ["", "One", "one TWO", "a b c", "a b c d a b c d", "É é ß\x0bx\x0cy\x1cz"]:
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_small_corpus_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    got = near_duplicates(odd(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected([(r[0], r[1]) for r in odd(spark).collect()])
    bears_odd_tables(spark, lambda d: near_duplicates(d).drop("group_fingerprint"))


def close_values(rng, n):
    centres, values = [rng.getrandbits(64) for _ in range(4)], set()
    while len(values) < n:
        x = rng.choice(centres + list(values))
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    return sorted(values)


def test_shards_find_every_link():
    rng = random.Random(4)
    for case in range(40):
        values = close_values(rng, rng.randint(2, 90))
        rng.shuffle(values)
        cut = len(values) if case % 2 else len(values) // 2
        first, second = values[:cut], values[cut:]
        parent = {v: v for v in values}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a in first:
            for b in second or first:
                if (a ^ b).bit_count() <= 2:
                    parent[root(a)] = root(b)
        smallest = {}
        for v in values:
            smallest[root(v)] = min(v, smallest.get(root(v), v))
        want = sorted((v, smallest[root(v)]) for v in values if v != smallest[root(v)])
        assert sorted(shard_links(first, second, 2, at_once=5)) == want


def test_tiles_of_crowded_groups_lose_no_link(spark):
    """A group of thousands in tiles of 50: a star for each shard, no pairs of the whole group."""
    values = close_values(random.Random(5), 2500)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups = []
    for size in (50, 10_000):
        found = links(table, shard_size=size)
        roots = {r["node"]: r["root"] for r in components(found).collect()}
        by_root = {}
        for v in signed:
            by_root.setdefault(roots.get(v, v), []).append(v)
        groups.append(sorted(map(sorted, by_root.values())))
    want = {}
    for v, root in plain_groups(values).items():
        want.setdefault(root, []).append(v - 2**64 if v >= 2**63 else v)
    assert groups[0] == groups[1] == sorted(map(sorted, want.values()))
    assert links(table, shard_size=10_000).count() < 3 * len(values)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (7, 6), (7, 6)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
