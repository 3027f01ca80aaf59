"""Stages of the corpus pipeline. Each takes all that the stage before it kept, and acts on what its operator finds."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftpanel.llm.bestfit_packing import pack
from liftpanel.llm.common import benchmark, fresh, held_out, marked, small_batches, written
from liftpanel.llm.ecoc_language import MODULUS, REMAINDER, fit, predicted
from liftpanel.llm.markov_secrets import added_spans, base_spans, redacted, train
from liftpanel.llm.minhash_groups import set_print_of, similar_groups
from liftpanel.llm.qgram_decontamination import ShortItems, indexes, leaks

#: Chunks that a Python worker remembers here: workers of earlier stages stay beside those of the packer for a while.
REMEMBERED = 100_000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told: rejected are texts that are null or have no letter, and ambiguous
    ones. Without anything to learn from, no text can be told and none is rejected but those."""
    small_batches(spark)
    model = fit(docs, ~held_out(F.col("doc_id"), MODULUS, REMAINDER))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(~predicted(F.col("text"), model)["rejected"])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles with a similarity of 0.8 or more, the row with the smallest id; of rows that repeat an id, one for each
    group. A group without any id keeps one row.

    Marks of few bits tell most rows that stay; only the others are moved to meet the list of those that leave.
    """
    small_batches(spark)
    groups = written(similar_groups(docs), "groups")
    leaving = groups.where("doc_id <> component_id").select("doc_id").distinct()
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    mark = fresh()
    both = marked(docs, leaving.union(repeated), mark)
    columns = docs.columns
    known = F.col("doc_id").isNotNull()
    stay = both.where(known & ~F.col(mark)).select(*columns)
    single = both.where(known & F.col(mark)).join(leaving.union(repeated).distinct(), "doc_id", "left_anti").select(*columns)

    group, print_, first = fresh(), fresh(), fresh()
    of_print = groups.select(F.col("fingerprint").alias(print_), F.col("component_id").alias(first), F.col("group_fingerprint").alias(group)).distinct()
    unclear = both.where(known & F.col(mark)).join(repeated, "doc_id", "left_semi").select(*columns).unionByName(both.where(~known).select(*columns))
    unclear = unclear.withColumn(print_, set_print_of(F.col("text"))).join(of_print, print_)
    unclear = unclear.where(F.col("doc_id").eqNullSafe(F.col(first))).dropDuplicates([group]).select(*docs.columns)
    return stay.unionByName(single).unionByName(unclear)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no passage of the benchmark; each row is judged by itself, also one that repeats an id.
    An item under ``LEAST`` folded bytes may be common words: a text that holds nothing else of the benchmark stays.
    Rows are written after each block of the benchmark but the last, so that a worker holds one index at a time."""
    small_batches(spark)
    for number, index in enumerate(indexes(benchmark(spark, sf_dir))):
        index.short = ShortItems([])
        if number:
            docs = written(docs, "clean")
        docs = docs.where(F.size(leaks(F.col("text"), index)) == 0)
    return docs


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; ``n_chars`` follows the text."""
    small_batches(spark)
    model, base, spans, text = train(docs), fresh(), fresh(), fresh()
    marked = docs.withColumn(base, base_spans(F.col("text")))
    marked = marked.withColumn(spans, F.array_sort(F.concat(base, added_spans(F.col("text"), F.col(base), model))))
    changed = marked.withColumn(text, redacted(F.col("text"), F.col(spans)))
    size = F.when(F.size(spans) > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    out = {"text": F.col(text), "n_chars": size}
    return changed.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in their training sequences."""
    small_batches(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"), remembered=REMEMBERED)
