import hashlib
import random
import zlib

from liftpanel.llm import merkle_manifest
from liftpanel.llm.merkle_manifest import folded, height, manifest, reduced, steps
from tests.llm.cases import SCHEMA, bears_odd_tables, odd, prose


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row
    fields = [i, source, lang, n if n is None else n + more, text]
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def tree(nodes):
    """Levels, every one written out."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, at, end):
    """Siblings up to the top, and where ``end`` leads."""
    siblings = []
    for nodes in levels[:-1]:
        run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
        siblings += [x for k, x in enumerate(run) if k != at % 2]
        run[at % 2] = end
        end, at = h(*run), at // 2
    return siblings, end


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, out = {}, []
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for at, row in enumerate(groups[g]):
            changed = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            a, end = climb(trees[g], at, leaf(row, int(changed)))
            b, end = climb(top, k, end)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, h(*a, *b), end, end == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_against_trees_written_out(spark, monkeypatch):
    """Arrays of four slots: several rounds, groups of very different size, ids far apart and negative."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", 2)
    rng = random.Random(4)
    ids = rng.sample(range(-(2**62), 2**62, 12345), 60) + list(range(40)) + [2**40 + i for i in range(9)] + [-(2**63), 2**63 - 1]
    rows = [(i, prose(rng, 5), rng.choice(["en"] * 8 + ["de", "fr", None]), rng.choice(["web", None]), rng.choice([None, 1, 99])) for i in ids]
    rows += [(10**6, "alone", "ja", "s", 1)]
    got = manifest(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got) == plain(rows)
    verified = [r["verified"] for r in got.collect()]
    assert any(verified) and not all(verified)


def test_odd_tables(spark):
    bears_odd_tables(spark, manifest)
    assert rows_of(manifest(odd(spark))) == plain([tuple(r) for r in odd(spark).collect()])


def test_one_id_for_most_rows(spark):
    rows = [(7 if i % 3 else None, f"text {i % 50}", "en", "s", 1) for i in range(300)] + [(i, "x", "en", "s", 1) for i in range(20)]
    assert rows_of(manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_steps_lead_to_the_root():
    for n in (1, 2, 3, 5, 8, 13):
        levels = reduced([h(str(i)) for i in range(n)], height(n))
        assert len(levels[-1]) == 1
        assert all(folded(levels[0][i], steps(levels, i)) == levels[-1][0] for i in range(n))
