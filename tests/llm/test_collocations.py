import random
import re
from collections import Counter
from fractions import Fraction

from liftpanel.llm import parsed_collocations
from liftpanel.llm.parsed_collocations import LONGEST, OVERLAP, chunks_of, collocations
from tests.llm.cases import SCHEMA, bears_odd_tables, prose


def plain(rows, least, top):
    """Every phrase counted where it stands."""
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", folded):
            words = tuple(w for w in re.split(r"[ \t]", piece) if w)
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, LONGEST + 1) for i in range(len(words) - k + 1))
    often = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    scored = []
    for (lang, words), a in often.items():
        if any(x == lang and len(w) > len(words) and v >= a and any(w[i : i + len(words)] == words for i in range(len(w))) for (x, w), v in often.items()):
            continue
        cuts = [(Fraction(1000 * a * n[lang], f[lang, words[:k]] * f[lang, words[k:]]).__floor__(), k) for k in range(1, len(words))]
        score, k = min(cuts)
        scored.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def texts(seed):
    rng = random.Random(seed)
    fixed = [prose(rng, k) for k in (2, 3, 4, 5, 7, 9)]
    rows = []
    for i in range(240):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else prose(rng, rng.randint(1, 8)) for _ in range(rng.randint(1, 12))]
        rows.append((i, "".join(p + rng.choice([" ", ". ", ", ", "\n", "\t", "!?"]) for p in parts), rng.choice(["en", "en", "de", None]), "s", 1))
    return rows + rows[:30] + [(None, None, "en", None, None), (1, "", None, None, 0), (2, "Äpfel ÄPFEL " * 40, "de", "s", 1)]


def test_against_plain_counts(spark):
    rows = texts(1)
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=12, top=25)
    want = plain(rows, 12, 25)
    assert len(want) > 40 and max(len(r[2].split()) for r in want) == LONGEST
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_marks_that_are_all_set_change_nothing(spark, monkeypatch):
    rows = texts(2)
    monkeypatch.setattr(parsed_collocations, "MARK_BITS", 7)
    monkeypatch.setattr(parsed_collocations, "HELD_BYTES", 500)
    got = collocations(spark.createDataFrame(rows, SCHEMA), least=10)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows, 10, 2000))


def test_chunks_hold_each_phrase_once():
    rng = random.Random(3)
    pieces = [prose(rng, rng.randint(1, 60)).encode().split() for _ in range(50)]
    want = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, LONGEST + 1) for i in range(len(p) - k + 1))
    got, cut = Counter(), 0
    for _, chunk, last in chunks_of(pieces, 4):
        words = chunk.split()
        cut += not last
        starts = len(words) if last else len(words) - OVERLAP
        got.update(tuple(words[i : i + k]) for k in range(1, LONGEST + 1) for i in range(starts) if i + k <= len(words))
    assert cut > 20 and got == want


def test_odd_tables(spark):
    bears_odd_tables(spark, lambda d: collocations(d, least=2))
