import hashlib
import random

import numpy as np
import pytest

from liftpanel.llm.fmindex_substrings import FMIndex, WaveletMatrix, last_level, remove_repeats, runs_of, shard_intervals, sliding_min
from tests.conftest import SMALL
from tests.llm.cases import bears_odd_tables, odd, prose



def plain(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for j in range(len(words) - window + 1):
            key = b" ".join(words[j : j + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, words in texts:
        gone = bytearray(len(words))
        for j in range(len(words) - window + 1):
            if i is not None and first[b" ".join(words[j : j + window])] < i:
                gone[j : j + window] = b"\x01" * window
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    for symbols in (1, 2, 3, 17, 300):
        sequence = rng.integers(0, symbols, 500)
        matrix = WaveletMatrix(sequence, symbols)
        symbol, at = rng.integers(0, symbols, 400), rng.integers(0, 501, 400)
        assert matrix.rank(symbol, at).tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbol, at, strict=True)]


def test_backward_search_counts_occurrences():
    rng = random.Random(2)
    streams = [np.array([rng.randint(1, 3) for _ in range(rng.randint(9, 40))]) for _ in range(8)]
    index = FMIndex(streams, np.arange(8), window=9)
    for _ in range(200):
        stream = rng.choice(streams)
        n = rng.randint(1, 9)
        at = rng.randint(0, len(stream) - n)
        low, high = np.array([0]), np.array([index.size])
        for symbol in stream[at : at + n][::-1]:
            low, high = index.extend(np.array([symbol]), low, high)
        pattern = stream[at : at + n].tolist()
        assert int(high[0] - low[0]) == sum(s[i : i + n].tolist() == pattern for s in streams for i in range(len(s) - n + 1))


def test_sliding_min():
    values = np.random.default_rng(3).integers(0, 99, 70)
    for width in (1, 2, 3, 7, 8, 43, 70):
        assert sliding_min(values, width).tolist() == [values[i : i + width].min() for i in range(71 - width)]


def test_equal_windows_meet_in_one_region_key():
    rng = random.Random(4)
    shared = prose(rng, 120)
    texts = [f"{prose(rng, 30)} {shared} {prose(rng, 30)}".encode() for _ in range(4)] + [b"", b"few words"]
    assert last_level(50) == 3 and last_level(9) == last_level(8) == 1
    of_key = []
    for level in range(4):
        minimizer = {}
        covered = {i: 0 for i in range(len(texts))}
        for row, start, n, m, _ in runs_of(texts, level=level):
            covered[row] += n
            words = texts[row].split()
            for j in range(start, start + n):
                minimizer.setdefault(b" ".join(words[j : j + 50]), set()).add(m)
        assert all(len(m) == 1 for m in minimizer.values())
        assert covered == {i: max(0, len(t.split()) - 49) for i, t in enumerate(texts)}
        of_key.append(len({k for m in minimizer.values() for k in m}))
    # Longer keys part more windows; the longest parts all.
    assert of_key == sorted(of_key) and of_key[3] == len(minimizer) > of_key[0]


def test_least_owner_of_every_window():
    rng = random.Random(5)
    for _ in range(30):
        window = rng.choice([2, 3, 5, 9, 33, 50])
        base = [str(rng.randrange(rng.choice([2, 5, 50]))).encode() for _ in range(300)]
        regions = []
        for _ in range(rng.randint(1, 9)):
            n = rng.randint(window, window + 60)
            at = rng.randrange(0, 300 - n)
            words = list(base[at : at + n])
            if rng.random() < 0.5:
                words[rng.randrange(n)] = b"zz"
            regions.append((b" ".join(words), rng.randrange(20)))
        least = {}
        for text, owner in regions:
            words = text.split()
            for j in range(len(words) - window + 1):
                key = tuple(words[j : j + window])
                least[key] = min(owner, least.get(key, owner))
        got = {}
        for i, start, n, owner in shard_intervals(regions, window):
            got.update({(i, j): owner for j in range(start, start + n)})
        want = {(i, j): least[tuple(t.split()[j : j + window])] for i, (t, _) in enumerate(regions) for j in range(len(t.split()) - window + 1)}
        assert got == want


@pytest.mark.parametrize("options", [{}, {"block_words": 1}, {"block_words": 2000}])
def test_small_corpus_against_all_windows(spark, options):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()], 50)
    assert sum(r[2] for r in want) > 0
    assert sorted(map(tuple, remove_repeats(docs, **options).collect()), key=repr) == want


def test_copies_near_copies_and_repetition(spark):
    rng = random.Random(6)
    base, line = prose(rng, 200).split(), prose(rng, 60)
    rows = [(i, " ".join(base[: 150 + i] + ["changed"] + base[i:])) for i in range(0, 60, 3)]
    rows += [(100 + i, f"{prose(rng, 20)}\n{line}\n{prose(rng, 20)}") for i in range(30)] + [(200, "a " * 600), (199, "a " * 70), (201, " ".join(base))]
    rows += [(None, " ".join(base)), (None, line), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 50)
    for options in ({}, {"block_words": 60}, {"block_words": 400}):
        assert sorted(map(tuple, remove_repeats(docs, **options).collect()), key=repr) == want


def test_shards_of_one_common_phrase_stay_within_their_words(spark, monkeypatch):
    """Eight common words in the midst of unlike texts are the minimizer of all windows around them."""
    from liftpanel.llm import fmindex_substrings as module

    rng = random.Random(7)
    phrase = " ".join(f"common{i}" for i in range(8))
    low = min(("seed%d " % i + phrase for i in range(300)), key=lambda p: min(m for *_, m, _ in runs_of([(p + " x" * 60).encode()])))
    twice = [f"{prose(rng, 45)} {low} {prose(rng, 45)}" for _ in range(8)]
    rows = [(i, f"{prose(rng, 45)} {low} {prose(rng, 45)}") for i in range(80)] + [(100 + i, twice[i % 8]) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 50)
    assert sum(r[2] for r in want) > 0
    levels = []
    narrowed = module._narrowed
    monkeypatch.setattr(module, "_narrowed", lambda regions, window, level: levels.append(level) or narrowed(regions, window, level))
    assert sorted(map(tuple, remove_repeats(docs, block_words=1500).collect()), key=repr) == want
    assert levels and levels[0] == 1


def test_odd_tables(spark):
    want = plain([(r[0], r[1]) for r in odd(spark).collect()], 50)
    assert sorted(map(tuple, remove_repeats(odd(spark)).collect()), key=repr) == want
    bears_odd_tables(spark, remove_repeats)
