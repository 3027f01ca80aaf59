import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from liftpanel.llm.qgram_decontamination import LEAST, SEGMENT, SURE, Index, ShortItems, bound, budget, find_leaks, fold, folded_places, indexes
from tests.conftest import SMALL
from tests.llm.cases import bears_odd_tables, odd, prose


def distance_within(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    b = np.frombuffer(text, np.uint8)
    for i, c in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


@given(st.text("aÉß,. \n\tZ🙂é", max_size=40))
def test_folded_places(text):
    raw = text.encode()
    places = folded_places(raw)
    assert len(places) == len(fold(raw)) and (np.diff(places) > 0).all()
    assert all(raw[p] == f or 0 < f - raw[p] <= 32 for p, f in zip(places, fold(raw), strict=True))


def test_bound_is_met_by_every_budget():
    assert all(bound(n, budget(n)) >= 3 or budget(n) == 0 for n in range(LEAST, SEGMENT + 1))
    assert budget(SEGMENT) == 4 and bound(LEAST, 0) >= 1


def edited(rng, segment, edits):
    s = bytearray(segment)
    for _ in range(edits):
        at = rng.randrange(len(s))
        match rng.randrange(3):
            case 0:
                s[at] = rng.choice(b"qxjk")
            case 1:
                del s[at]
            case _:
                s.insert(at, rng.choice(b"qxjk"))
    return bytes(s)


def test_no_segment_within_the_budget_is_lost():
    rng = random.Random(9)
    items = [(i, fold(prose(rng, 40, rng.choice(["en", "de"])).encode())) for i in range(12)]
    index = Index(items)
    found = 0
    for case in range(600):
        segment = rng.randrange(len(index.segments))
        k = rng.randint(0, int(index.edits[segment]))
        noise = [fold(prose(rng, rng.randint(0, 30)).encode()) for _ in range(2)]
        text = noise[0] + edited(rng, index.segments[segment], k) + noise[1]
        hits = index.verified(text, index.bands(text))
        assert any(h[0] == index.owner[segment] for h in hits), (case, k)
        for item, start, end, edits in hits:
            assert min(distance_within(s, text[start:end]) for s, o in zip(index.segments, index.owner, strict=True) if o == item) <= edits
        found += len(hits)
    assert found


def test_passages_from_any_place_of_an_item():
    rng = random.Random(11)
    items = [(i, fold(prose(rng, 70).encode())[: 300 + i]) for i in range(3)]
    index = Index(items)
    for item, text in items:
        for size in (SURE, SURE + 7, 100):
            for at in range(len(text) - size + 1):
                noise = [fold(prose(rng, rng.randint(0, 12)).encode()) for _ in range(2)]
                around = noise[0] + text[at : at + size] + noise[1]
                assert item in {h[0] for h in index.verified(around, index.bands(around))}, (item, size, at)


def test_segments_at_a_place():
    rng = random.Random(12)
    index = Index([(i, fold(prose(rng, 80).encode())[:n]) for i, n in enumerate([24, 47, 48, 49, 79, 80, 81, 119, 120, 121, 300])])
    item = np.repeat(np.arange(11), index.sizes - 11)
    place = np.concatenate([np.arange(n - 11) for n in index.sizes])
    got = set(zip(*(x.tolist() for x in index.segments_at(item, place)), strict=True))
    want = {
        (row, s)
        for row, (i, p) in enumerate(zip(item.tolist(), place.tolist(), strict=True))
        for s in range(len(index.item))
        if index.item[s] == i and index.begin[s] <= p and p + 12 <= index.begin[s] + index.length[s]
    }
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text("aAbÉ ,", max_size=60), st.lists(st.text("aAbÉ,", min_size=1, max_size=6), max_size=5))
def test_short_items_between_bounds_of_words(text, items):
    raw = text.encode()
    folded, places = fold(raw), folded_places(raw).tolist()
    short = sorted({(i, fold(t.encode())) for i, t in enumerate(items) if fold(t.encode())})
    bounds = {0, len(folded)} | {i for i in range(1, len(folded)) if places[i] > places[i - 1] + 1}
    want = sorted((i, a, a + len(t), 0) for i, t in short for a in bounds if a + len(t) in bounds and folded[a : a + len(t)] == t)
    assert sorted(ShortItems(short).found(folded, folded_places(raw))) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 8))
def test_alignment_against_plain_distance(seed, edits):
    rng = random.Random(seed)
    segment = fold(prose(rng, 40).encode())[:SEGMENT]
    index = Index([(1, segment)])
    text = edited(rng, segment, edits)
    least = index.align(text, [(0, -8)])[0][0]
    want = distance_within(segment, text)
    # A band from diagonal -8 to 12 holds any alignment of up to 8 edits.
    assert least == want


def test_small_corpus_against_search_by_eye(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = find_leaks(docs, items).collect()
    whole = {i: fold(t.encode()) for i, t in items.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() if t for i, x in whole.items() if x in fold(t.encode())}
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        cut = fold(texts[r["doc_id"]][r["leak_start"] : r["leak_end"]].encode())
        index = Index([(r["item_id"], whole[r["item_id"]])])
        assert any(distance_within(s, cut) <= k for s, k in zip(index.segments, index.edits, strict=True))
    # Other benchmarks leak nowhere.
    rng = random.Random(1)
    other = spark.createDataFrame([(i, prose(rng, 40)) for i in range(20)], "item_id long, text string")
    assert find_leaks(docs, other).count() == 0


def test_blocks_find_the_same(spark):
    from liftpanel.llm.qgram_decontamination import leaks
    from pyspark.sql import functions as F

    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()}
    got, blocks = set(), 0
    for index in indexes(items, block_bytes=2000):
        blocks += 1
        got |= {(r["doc_id"], r["i"]) for r in docs.select("doc_id", F.explode(leaks(F.col("text"), index)).alias("x")).select("doc_id", F.col("x.item_id").alias("i")).collect()}
    assert blocks > 2 and got == want


def test_disguised_passage_and_short_items(spark):
    passage = "What is the boiling point of the element with atomic number seventy-nine, in degrees Celsius at one bar?"
    docs = spark.createDataFrame([(1, "x " + passage.upper().replace(" ", "\n ") + " y"), (2, passage.replace("boiling", "boilling")), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage), (5, passage), (6, None), (7, "short"), (8, "X, what"), (9, "noth"), (10, "?!"), (None, passage + " no")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, items).collect()}
    assert {k for k in got if k[1] == 5} == {(1, 5), (2, 5)} and not [k for k in got if k[1] == 7 or k[0] == 3]
    assert {k for k in got if k[1] in (8, 9, 10)} == {(1, 8)} and got[1, 8]["leak_start"] == 0 and got[1, 8]["leak_end"] == 6
    assert got[1, 5]["leak_start"] == 2 and got[2, 5]["edits"] == 1


def test_odd_tables(spark):
    rows = [r[1] for r in odd(spark).collect() if r[1] and 100 < len(r[1]) < 5000]
    items = spark.createDataFrame([(i, t[:300]) for i, t in enumerate(rows[:5])], "item_id long, text string")
    assert bears_odd_tables(spark, lambda d: find_leaks(d, items))
    assert find_leaks(odd(spark), items.limit(0)).count() == 0
