"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftpanel.llm.bestfit_packing import pack
from liftpanel.llm.common import benchmark, documents, labels
from liftpanel.llm.deobfuscated_toxicity import score
from liftpanel.llm.ecoc_language import identify
from liftpanel.llm.fast_sketches import near_duplicate_sets
from liftpanel.llm.fmindex_substrings import remove_repeats
from liftpanel.llm.markov_secrets import find_secrets
from liftpanel.llm.merkle_manifest import manifest
from liftpanel.llm.offset_tokens import count_tokens
from liftpanel.llm.parsed_collocations import collocations
from liftpanel.llm.qgram_decontamination import find_leaks
from liftpanel.llm.risk_quality import judge
from liftpanel.llm.simhash_bktree import near_duplicates
from liftpanel.llm.tfidf_licenses import scan


def op1_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_offset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op3_tfidf_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders by source, language and hundreds of ids. They have no names; one whose
    notice is a tenth of its words or more speaks for its folder."""
    parts = ["source", "lang", F.floor(F.col("doc_id") / 100), "doc_id"]
    files = documents(spark, sf_dir).select(F.concat_ws("/", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("none")) for p in parts]).alias("path"), "text")
    found = scan(files, (F.col("n_notice") > 0) & (10 * F.col("n_notice") >= F.col("n_terms")))
    return found.withColumn("doc_id", F.regexp_extract("path", "([0-9]+)$", 1).try_cast("long"))


def op4_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op6_risk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op8_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op9_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op10_fmindex_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


def op12_fast_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(documents(spark, sf_dir))


def op13_parsed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bestfit_packing,
        op2_offset_tokens,
        op3_tfidf_licenses,
        op4_deobfuscated_toxicity,
        op5_markov_secrets,
        op6_risk_quality,
        op7_qgram_decontamination,
        op8_ecoc_language,
        op9_simhash_bktree,
        op10_fmindex_substrings,
        op11_merkle_manifest,
        op12_fast_sketches,
        op13_parsed_collocations,
    )
}
