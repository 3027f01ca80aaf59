"""The corpus pipeline: documents in, packed training sequences out.

Language identification, near-duplicate removal, benchmark decontamination, redaction of secrets, packing. What
a stage returns is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from liftpanel.llm.common import documents, written
from liftpanel.llm.stages import known_language, one_of_each_group, packed, without_benchmarks, without_secrets

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Classifiers, alignments and packing have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
