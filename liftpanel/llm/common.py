"""What the operators share: written tables, texts out of Arrow, state of a Python worker."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than these: blank and the five controls from tab to carriage return.
#: ``bytes.split()`` without arguments cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
MARKED_BITS = 26


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; the warehouse, which is shared too, where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/llm-work"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: later readers take the columns they
    need, and a lost executor costs a read. The table stays until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept out of learning. Rows without an id are not held out, and nobody learns from them."""
    return F.coalesce(bucket_of(doc_id, modulus) == remainder, F.lit(False))


def fresh() -> str:
    """A column name that no table has."""
    return f"c{uuid.uuid4().hex}"


def marked(rows: DataFrame, ids: DataFrame, into: str, bits: int = MARKED_BITS) -> DataFrame:
    """``rows`` with the column ``into``: true for every id in ``ids``, and for few others. The marks are bits
    of ``2 ** bits`` in words of 64, so at most ``2 ** (bits - 6)`` rows are broadcast, whatever ids there are.
    Both tables have ``doc_id``; a null id is marked if one is in ``ids``."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    bit = F.pmod(place, F.lit(64)).cast("int")
    word, found = fresh(), fresh()
    words = ids.select(F.shiftright(place, 6).alias(word), F.lit(1).cast("long").alias("one"), bit.alias("bit"))
    words = words.groupBy(word).agg(F.expr("bit_or(shiftleft(one, bit))").alias(found))
    joined = rows.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), word, "left")
    return joined.withColumn(into, F.coalesce(F.getbit(found, bit) == 1, F.lit(False))).drop(word, found)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def in_groups(texts: Iterator[bytes], most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lists of consecutive texts, each ended by the text that reaches ``most_bytes``."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most_bytes:
            yield group
            group, size = [], 0
    if group:
        yield group


def worker_state(owner: str) -> dict:
    """A memory that outlives a task: task functions travel by value, their own globals are new for each task.
    It belongs to one operator at a time; a task of another ``owner`` finds it empty."""
    module = sys.modules.setdefault("liftpanel_worker_state", types.ModuleType("liftpanel_worker_state"))
    if module.__dict__.get("owner") != owner:
        module.owner, module.memory = owner, {}
        pa.default_memory_pool().release_unused()
    return module.memory


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand rows to Python in batches of this many from now on: texts are long, and a batch is held in the JVM and in
    Python several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
