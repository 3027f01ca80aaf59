import random

import numpy as np

from liftpanel.llm import fast_sketches
from liftpanel.llm.fast_sketches import SIZE, near_duplicate_sets, shard_links, shingle_set, similar, sketch
from tests.llm.cases import SCHEMA, bears_odd_tables, prose


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_components(rows):
    """{id: (size, smallest id)} by all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), group in zip(rows, label, strict=True):
        least[group] = min(i, least.get(group, i))
    return {i: (len(s), least[group]) for (i, _), s, group in zip(rows, sets, label, strict=True)}


def family(rng, n, edits):
    """Copies of one text, each with up to ``edits`` other words."""
    words = prose(rng, 150).split()
    out = []
    for _ in range(n):
        new = list(words)
        for at in rng.sample(range(len(new)), rng.randint(0, edits)):
            new[at] = f"other{rng.randrange(10**6)}"
        out.append(" ".join(new))
    return out


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_families_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [t for edits in (1, 3, 6, 12) for t in family(rng, 25, edits)] + [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += ["", None, " \n", "one", "One", "two words", "two  Words"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain_components(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 40
    assert found(near_duplicate_sets(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_tiles_and_salts_change_nothing(spark, monkeypatch):
    """A bucket is larger than a shard, and its leader has more members than one copy of its set serves."""
    monkeypatch.setattr(fast_sketches, "SHARD_SETS", 8)
    monkeypatch.setattr(fast_sketches, "LED", 5)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 70, 7) + family(rng, 40, 2)))
    assert found(near_duplicate_sets(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_every_coordinate_fills_and_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 100, 5000):
        got = sketch(rng.integers(0, 2**63, n, np.uint64))
        assert len(got) == SIZE and (got >> np.uint64(32) < 2 * SIZE).all()
    errors = []
    for share in np.linspace(0.1, 0.9, 40):
        n, both = 300, int(300 * share)
        pool = rng.integers(0, 2**63, 2 * n - both, np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        errors.append((sketch(a) == sketch(b)).mean() - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shards_tie_what_all_pairs_tie():
    rng = random.Random(2)
    texts = family(rng, 60, 9) + [prose(rng, 100) for _ in range(60)]
    sets = [shingle_set(t.encode()) for t in texts]
    for side in (None, [i % 2 for i in range(len(sets))]):
        label, want = list(range(len(sets))), list(range(len(sets)))
        for a, b in shard_links(list(range(len(sets))), sets, side):
            label = [label[b] if x == label[a] else x for x in label]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if similar(a, b) and (side is None or side[i] != side[j]):
                    want = [want[j] if x == want[i] else x for x in want]
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def test_odd_tables(spark):
    bears_odd_tables(spark, near_duplicate_sets)
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "nobody else has this text"), (5, None), (6, None)]
    got = near_duplicate_sets(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 5, 3, False), (3, 5, 3, True), (None, 3, None, True), (5, 0, 5, True), (6, 0, 6, True)], key=repr)
