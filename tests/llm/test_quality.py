import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from liftpanel.llm import risk_quality
from liftpanel.llm.risk_quality import CUTOFFS, RULES, cutoffs, judge, measured
from tests.conftest import SMALL
from tests.llm.cases import bears_odd_tables, odd, prose

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def cases():
    rng = random.Random(2)
    texts = ["", None, " \n a b c a b c\n\nx\n x\nx\n\x0b", "a a a a a a", "a b " * 20, "x y z", "é é é 🙂 é é é", "a\x1cb a\x1cb a\x1cb a\x1cb"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(30)] + ["# $ % | < > & *\n# $ % | < > & *"]
    return list(enumerate(texts))


def test_counts_against_plain_python(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in cases()], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: plain(r["text"]) for r in docs.union(more).collect()}
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in measured(docs.union(more)).collect()} == rows
    # Nearly no bits of hash left: different windows collide, and are sorted by their words instead.
    monkeypatch.setattr(risk_quality, "PLACE_BITS", 61)
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in measured(more).collect()} == {-1 - i: plain(t) for i, t in cases()}


def tail(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def test_cutoffs_against_exact_tails(spark):
    rng = random.Random(6)
    rows = [(s, *(int(rng.expovariate(1 / scale)) for scale in (5, 20, 60, 40))) for s, n in (("en", 4000), ("de", 900), ("xx", 30)) for _ in range(n)]
    good = spark.createDataFrame(rows, f"stratum string, {', '.join(f'{r} long' for r in RULES)}")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoffs(good, 3, risk=0.08, level=0.05).collect()}
    want = {}
    for stratum in ("en", "de", "xx"):
        own = [r[1:] for r in rows if r[0] == stratum]
        for i, rule in enumerate(RULES):
            for cutoff in CUTOFFS:
                k = sum(v[i] > cutoff for v in own)
                if k > 0.02 * len(own) or tail(k, len(own), 0.02) > 0.05 / 12:
                    break
                want[stratum, rule] = cutoff
    assert got == want and any(s == "en" for s, _ in got) and not any(s == "xx" for s, _ in got)


def test_false_rejections_are_limited(spark):
    """Cutoffs from one half of the labels hold on the other; junk goes."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        junk = i % 10 == 0
        words = prose(rng, 60).split()
        rows.append((i, " ".join(w + "###" if junk else w for w in words), "en", int(not junk)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = table.where("doc_id % 2 = 0").select("doc_id", "quality")
    got = judge(table.drop("quality"), labels, risk=0.04).join(table.select("doc_id", "quality"), "doc_id").where("doc_id % 2 = 1")
    counts = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.04 * 1350 and counts.get((0, True), 0) == 0


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    bears_odd_tables(spark, lambda d: judge(d, labels))
    got = judge(odd(spark), labels.limit(0))
    assert got.count() == 35 and got.where(F.col("kept") != ~F.col("base_failed")).count() == 0
