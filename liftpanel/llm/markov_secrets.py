"""Secrets in text: fixed rules, and character Markov models for what the rules have no words for.

Column expressions only. Three rules give the base spans. They are cut out of the runs of token characters, and
every rest of at least ``LEAST`` characters is compared under two first-order Markov models of its characters, one of
random strings and one of ordinary identifiers, by their log-likelihood ratio; a rest above ``EVIDENCE`` is
added, so a key that touches a base span is found as well. The models are trained on labelled samples: values that the rules found and random strings of several
alphabets count as random, the other words of a bounded sample of texts as ordinary. A model is a table of
``len(SYMBOLS) + 1`` squared whole numbers, thousandths of a nat, whatever the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base rules, with the group whose length counts and its least length.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
ADDED = "markov"
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
SAMPLE_ROWS, EVIDENCE = 400, 12_000
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
TEXT_SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string>"
TEXT_SPANS = f"array<{TEXT_SPAN}>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, state: Column, step, kind: str) -> Column:
    """What ``step(state, item) -> (state, array of outputs)`` puts out along an array, outputs of type ``kind``.

    An array that grows item by item is copied each time. So outputs grow inside blocks of the root of the number of
    items, and blocks are put together: n items cost n to the power of 1.5 small steps, not n squared.
    """
    none = F.array().cast(f"array<{kind}>")

    def inner(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inner)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def run(all_items: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_items))).cast("int"))
        last = F.floor((F.greatest(F.size(all_items), F.lit(1)) - 1) / width).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_items, b * width + 1, width))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return F.flatten(F.aggregate(blocks, start, outer)["outs"])

    return _let(items, run)


def _span(start: Column, rank: int, end: Column, kind: str, text: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), text.alias("text"))


def _matches(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of the leftmost matches that do not overlap, in code points, with their text. The text between matches
    and the matches themselves alternate, so places are running sums of lengths."""
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length).alias("value"),
    )
    none = F.array().cast(TEXT_SPANS)

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        start = at + part["gap"]
        end = start + F.coalesce(F.length(part["all"]), F.lit(0))
        return end, F.when(part["value"] >= least, F.array(_span(start, rank, end, kind, part["all"]))).otherwise(none)

    return F.when(text.rlike(pattern), scanned(parts, F.lit(0), step, TEXT_SPAN)).otherwise(none)


def _without_text(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "rank", "end", "kind")]))


def base_spans(text: Column) -> Column:
    """Spans of the three rules by start, then by rule. Null and empty texts have none."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[_without_text(_matches(own, pattern, group, least, kind, i)) for i, (kind, pattern, group, least) in enumerate(RULES)]))


def _text_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> str:
    """Log-likelihood ratios of all pairs of symbols, in thousandths and in order, joined by commas.

    The sample: the ``sample_rows`` texts whose hashed id comes first, whole, of texts with a base span, and as
    many whatever they hold. Rows without an id teach nothing. An empty corpus still has the generated random strings; ordinary words are then flat.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    with_match = reduce(lambda a, b: a | b, [F.col("text").rlike(pattern) for _, pattern, _, _ in RULES])

    def sampled(usable: DataFrame) -> DataFrame:
        # Ids are sorted, not texts; at most `sample_rows` of them are broadcast.
        chosen = usable.select("id", F.md5(F.col("id").cast("binary")).alias("order")).orderBy("order", "id").limit(sample_rows)
        return rows.join(F.broadcast(chosen.select("id").distinct()), "id")

    ordinary, secret = sampled(rows), sampled(rows.where(with_match))

    found = secret.select("text", F.explode(base_spans(F.col("text"))).alias("span"))
    values = found.select(F.regexp_extract(_text_of(F.col("text"), F.col("span")), r"([A-Za-z0-9+/_.=-]+)$", 1).alias("s"))
    spark = docs.sparkSession
    seeds = spark.range(sample_rows).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    kinds = [F.base64(F.unhex("h")), F.upper(F.conv(F.substring("h", 1, 15), 16, 36)), F.lower(F.conv(F.substring("h", 20, 15), 16, 36)), F.col("h")]
    made = seeds.select(F.explode(F.array(*kinds)).alias("s"))
    words = ordinary.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", "|".join(f"(?:{p})" for _, p, _, _ in RULES), " "), F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s"))

    def pairs(strings: DataFrame, label: int) -> DataFrame:
        near = F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i")
        code = lambda at: F.instr(F.lit(SYMBOLS), F.substring(F.col("s"), at, F.lit(1)))
        return strings.where(F.length("s") > 1).select("s", near).select(F.lit(label).alias("label"), code(F.col("i")).alias("a"), code(F.col("i") + 1).alias("b"))

    counts = pairs(values, 1).union(pairs(made, 1)).union(pairs(words, 0)).groupBy("label", "a", "b").count()
    grid = spark.range((len(SYMBOLS) + 1) ** 2).select((F.col("id") / (len(SYMBOLS) + 1)).cast("int").alias("a"), (F.col("id") % (len(SYMBOLS) + 1)).cast("int").alias("b"))
    by_label = counts.groupBy("a", "b").agg(*[F.sum(F.when(F.col("label") == i, F.col("count")).otherwise(0)).alias(f"n{i}") for i in (0, 1)])
    full = grid.join(by_label, ["a", "b"], "left").na.fill(0, ["n0", "n1"])
    per = Window.partitionBy("a")
    share = lambda n: (F.col(n) + F.lit(0.5)) / (F.sum(n).over(per) + F.lit(0.5) * (len(SYMBOLS) + 1))
    ratio = F.round(F.log(share("n1") / share("n0")) * 1000).cast("int")
    table = full.select("a", "b", ratio.alias("ratio")).orderBy("a", "b").collect()
    return ",".join(str(r["ratio"]) for r in table)


def _rests(text: Column, base: Column) -> Column:
    """What base spans leave of the runs of token characters, with its text, if it has ``LEAST`` characters.

    Runs and base spans are passed once, by their starts. The open run counts from ``at``, which every base span moves
    to its end; what lies between ``at`` and the next span or run is a rest.
    """
    spans = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(None).cast("string").alias("text")))
    beyond = F.length(text) + 1
    last = F.array(_span(beyond, len(RULES) + 1, beyond, "", F.lit("")))
    in_order = F.array_sort(F.concat(spans, _matches(text, CANDIDATE, 0, LEAST, ADDED, len(RULES)), last))
    none = F.array().cast(TEXT_SPANS)
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("covered"), F.lit(0).alias("start"), F.lit("").alias("text"))

    def step(run: Column, span: Column) -> tuple[Column, Column]:
        to = F.least(run["end"], span["start"])
        rest = _span(run["at"], len(RULES), to, ADDED, F.substring(run["text"], run["at"] - run["start"] + 1, to - run["at"]))
        is_base = span["rank"] < len(RULES)
        covered = F.when(is_base, F.greatest(run["covered"], span["end"])).otherwise(run["covered"])
        after = F.struct(
            F.when(is_base, F.greatest(run["at"], span["end"])).otherwise(F.greatest(run["covered"], span["start"])).alias("at"),
            F.when(is_base, run["end"]).otherwise(span["end"]).alias("end"),
            covered.alias("covered"),
            F.when(is_base, run["start"]).otherwise(span["start"]).alias("start"),
            F.when(is_base, run["text"]).otherwise(span["text"]).alias("text"),
        )
        return after, F.when(to - run["at"] >= LEAST, F.array(rest)).otherwise(none)

    return F.when(text.rlike(CANDIDATE), scanned(in_order, begin, step, TEXT_SPAN)).otherwise(none)


def added_spans(text: Column, base: Column, model: str) -> Column:
    """Rests of runs of token characters that look random."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    ratios = F.split(F.lit(model), ",").cast("array<int>")
    symbols = len(SYMBOLS) + 1

    def ratio(rest: Column) -> Column:
        codes = F.transform(F.split(rest, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
        start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("sum"))

        def step(acc: Column, code: Column) -> Column:
            more = F.when(acc["last"] < 0, 0).otherwise(F.element_at(ratios, acc["last"] * symbols + code + 1))
            return F.struct(code.alias("last"), (acc["sum"] + more).alias("sum"))

        return F.aggregate(codes, start, step, lambda acc: acc["sum"])

    return _without_text(F.filter(_rests(own, base), lambda rest: ratio(rest["text"]) >= EVIDENCE))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, base, spans`` for every row, the two as arrays of ``SPANS`` structs by start, then kind."""
    model = train(docs, id_col, text_col, sample_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("base", base_spans(F.col("text")))
    return own.withColumn("spans", F.array_sort(F.concat("base", added_spans(F.col("text"), F.col("base"), model))))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row.

    Null and empty texts have no spans: counts of 0, the digest of an empty list and an empty list. Repeated
    rows give repeated rows, an empty table an empty one; columns besides the two are not read.
    """
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind, *_ in RULES]
    digest = F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return with_spans(docs, id_col, text_col, sample_rows).select("doc_id", *counts, digest, listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or each run of spans that overlap, replaced by ``mark``."""

    def step(at: Column, span: Column) -> tuple[Column, Column]:
        fresh = F.array(F.substring(text, at + 1, span["start"] - at), F.lit(mark))
        return F.greatest(at, span["end"]), F.when(span["start"] >= at, fresh).otherwise(F.array().cast("array<string>"))

    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    whole = F.concat(F.array_join(scanned(spans, F.lit(0), step, "string"), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
