"""Quality rules with controlled risk.

Column expressions only. Counts of words, symbols, repeated lines and repeated three-word windows are made
from each whole text. A few rules each reject a text whose measure lies above a cutoff. The cutoffs come from
labelled texts: for each stratum and rule, cutoffs are tried from the loosest to the strictest, and the last
one is taken for which an exact binomial test, at a level shared out over all strata and rules, shows that at
most ``risk`` shared out over the rules of the good texts are rejected. Going on stops at the first cutoff
that fails, so trying many costs nothing. Where labels are too few for that, a rule rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.llm.common import WORD, written

# Fixed values of the base: characters that count as symbols, least words, greatest share of repeated words.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, REPEAT_PERCENT = 50, 50
BLANK = r"[\x20\x09-\x0D]+"
RISK, LEVEL = 0.02, 0.05
#: Cutoffs in thousandths, loosest first.
CUTOFFS = [*range(1000, 200, -50), *range(200, 40, -20), *range(40, 0, -5)]
RULES = ("symbols", "lines", "repeats", "long_words")
#: Places of windows take the lower bits of a sort key, a hash the others.
PLACE_BITS = 24


def _words(text: Column) -> Column:
    trimmed = F.regexp_replace(text, rf"^{BLANK}|{BLANK}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK, -1))


def _covered(places: Column) -> Column:
    """Words in three-word windows that begin at these places, which ascend."""
    after = F.slice(places, 2, F.greatest(F.size(places), F.lit(1)))
    widths = F.zip_with(places, after, lambda a, b: F.coalesce(F.least(b - a, F.lit(3).cast("long")), F.lit(3).cast("long")))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda acc, w: acc + w)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the counts of each whole text. Null text has no words.

    Windows are sorted by hash, with their places in the lower bits of the same number; equal windows are then
    neighbours. Neighbours with one hash are compared word by word. Only if two different windows of a text have
    one hash are its windows sorted by their words instead.
    """
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), own.alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id",
        "stratum",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    word = lambda i: F.get("words", i.cast("int"))
    mask = (1 << PLACE_BITS) - 1
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0).cast("long"), F.col("n_words") - 3)).otherwise(F.array().cast("array<bigint>"))
    key = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i)
    rows = rows.withColumn("keys", F.sort_array(F.transform(starts, key)))
    rows = rows.withColumn("pairs", F.filter(F.zip_with("keys", F.slice("keys", 2, F.greatest(F.size("keys"), F.lit(1))), lambda a, b: F.when(a.bitwiseOR(F.lit(mask)) == b.bitwiseOR(F.lit(mask)), F.struct(a.bitwiseAND(F.lit(mask)).alias("a"), b.bitwiseAND(F.lit(mask)).alias("b")))), lambda p: p.isNotNull()))
    same = lambda p: (word(p["a"]) == word(p["b"])) & (word(p["a"] + 1) == word(p["b"] + 1)) & (word(p["a"] + 2) == word(p["b"] + 2))
    unsure = F.exists("pairs", lambda p: ~same(p)) | (F.col("n_words") > mask)
    quick = F.array_sort(F.array_union(F.transform("pairs", lambda p: p["a"]), F.transform("pairs", lambda p: p["b"])))
    by_words = F.array_sort(F.transform(starts, lambda i: F.struct(word(i).alias("x"), word(i + 1).alias("y"), word(i + 2).alias("z"), i.alias("i"))))
    rows = rows.withColumn("sorted", F.when(unsure, by_words))
    twins = F.filter(
        F.zip_with("sorted", F.slice("sorted", 2, F.greatest(F.size("sorted"), F.lit(1))), lambda a, b: F.when((a["x"] == b["x"]) & (a["y"] == b["y"]) & (a["z"] == b["z"]), F.array(a["i"], b["i"]))), lambda p: p.isNotNull()
    )
    places = F.when(unsure, F.array_sort(F.array_distinct(F.flatten(twins)))).otherwise(quick)
    return rows.withColumn("places", places).withColumn("n_repeat_words", _covered(F.col("places"))).drop("words", "keys", "pairs", "sorted", "places")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_measures() -> list[Column]:
    """In whole thousandths, from 0 up; null where there is nothing to measure, which no rule rejects."""
    part = lambda n, of: F.floor(1000 * F.col(n) / F.nullif(F.col(of), F.lit(0)))
    long_words = F.floor(10 * F.col("word_chars") / F.nullif(F.col("n_words"), F.lit(0)))
    return [m.alias(name) for m, name in zip((part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"), long_words), RULES, strict=True)]


def _log_tail(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the chance of at most ``k`` in ``n`` trials of chance ``p``, by a running sum of terms."""

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.log(p / (1 - p))
        high, low = F.greatest(acc["sum"], term), F.least(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    none = n * F.log(1 - p)
    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, F.struct(none.alias("term"), none.alias("sum")), step, lambda acc: acc["sum"])


def cutoffs(good: DataFrame, strata: int, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``stratum, rule, cutoff`` for the pairs that have one. ``good (stratum, *RULES)`` are texts labelled good,
    ``strata`` is the number of all strata, which share the level out. A null measure doesn't count."""
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("rule")
    values = good.select("stratum", rule).select("stratum", "rule.*").where("value is not null")
    # Of each value only the number of cutoffs that it exceeds matters, and those are the strictest ones.
    passed = F.size(F.filter(F.array(*map(F.lit, CUTOFFS)), lambda c: F.col("value") > c))
    counts = values.groupBy("stratum", "rule", F.coalesce(passed, F.lit(0)).alias("passed")).count()
    total = F.sum("count").over(Window.partitionBy("stratum", "rule")).alias("n")
    tried = F.posexplode(F.array(*map(F.lit, CUTOFFS))).alias("place", "cutoff")
    pairs = counts.select("stratum", "rule", "passed", "count", total).select("*", tried)
    rejected = F.sum(F.when(F.col("passed") >= len(CUTOFFS) - F.col("place"), F.col("count")).otherwise(0))
    tests = pairs.groupBy("stratum", "rule", "place", "cutoff").agg(F.first("n").alias("n"), rejected.alias("k"))
    bar = F.lit(math.log(level / (len(RULES) * max(1, strata))))
    p = F.lit(risk / len(RULES))
    shown = F.when(F.col("k") <= p * F.col("n"), _log_tail(F.col("k"), F.col("n"), p) <= bar).otherwise(False)
    so_far = F.min(F.when(shown, 1).otherwise(0)).over(Window.partitionBy("stratum", "rule").orderBy("place"))
    return tests.withColumn("ok", so_far).where("ok = 1").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` and ``rules``, those that reject.

    ``labels (doc_id, quality)``: quality 1 is good. Rows without an id carry no label; an id labelled twice
    counts as good only if all its labels say so. A null stratum is one of its own. Null texts have no words
    and fail the base. Without labels no rule rejects. Repeated rows give repeated rows, an empty table an
    empty one; further columns are not read.
    """
    # Texts are read once; labels meet the counts, not the texts. The table also keeps Spark from pushing
    # filters below the projections and repeating their expressions within each other.
    rows = written(measured(docs, id_col, text_col, stratum_col), "quality-counts").withColumn("base_failed", base_failed())
    good_ids = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = rows.where("not base_failed").join(good_ids, "doc_id", "left_semi").select("stratum", *rule_measures())
    strata = rows.select("stratum").distinct().count()
    chosen = cutoffs(good, strata, risk, level).groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    chosen = chosen.select("stratum", *[F.col(r).alias(f"{r}_cutoff") for r in RULES])
    judged = rows.select("*", *rule_measures()).join(chosen, "stratum", "left")
    rejecting = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in RULES])).alias("rules")
    counted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*counted, rejecting).select(*counted, (~F.col("base_failed") & (F.size("rules") == 0)).alias("kept"), F.array_join("rules", ",").alias("rules"))
