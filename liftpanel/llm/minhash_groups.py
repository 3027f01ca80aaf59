"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A link needs the true similarity, counted over all shingles; two methods propose. SimHash fingerprints of the five-word
sets go through the BK-trees of ``simhash_bktree``, and of each group that a tree ties all are compared with one. A similarity of 0.8 is 10 of 64 bits on
average, and blocks for such a radius have 5 bits, which is most of the corpus in a tree. What lies farther apart
is therefore proposed by MinHash as well: ``ROWS`` least hash values joined to a key, ``BANDS`` keys for each distinct set.
Sets that share a key meet in a shard, where no pair that the trees have tied is compared again. A pair of
similarity s shares no key with chance ``(1 - s ** ROWS) ** BANDS``: 8e-5 at 0.8, 3e-6 at 0.85. A shard has about
``shard_size`` sets and ``SHARD_SHINGLES`` shingles; a larger group is dealt into tiles, and every pair of tiles is a
shard of its own. In a shard only sets that share one of their rarest shingles are compared. Only sets that share a key with another one are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import marked, raw_texts, worker_state, written
from liftpanel.llm.fast_sketches import distances, shard_links
from liftpanel.llm.graph import components
from liftpanel.llm.simhash_bktree import RADIUS, majority, shingle_hashes
from liftpanel.llm.simhash_bktree import links as tree_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 18, 4
SHARD_SHINGLES = 4 << 20
_NUMBERS = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * ROWS), np.uint64)
XOR, FACTOR = _NUMBERS[0], _NUMBERS[1] | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle, one without a word has none."""
    return np.unique(shingle_hashes(text, SHINGLE).view(">u8").ravel().astype(np.uint64))


def simhash(own: np.ndarray) -> int:
    """The SimHash operator's fingerprint, of a set of shingles: equal sets have equal ones."""
    return majority(own.astype(">u8").view(np.uint8).reshape(-1, 8))


def set_print(own: np.ndarray) -> int:
    """One number for a set, 0 for the empty one."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def band_keys(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 1024):
        mixed = (own[start : start + 1024, None] ^ XOR) * FACTOR
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common)


def set_prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, fp, n, bits, keys`` for every row: print and size of its set, its SimHash and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("sets")
        for batch in batches:
            sets = [shingles(t) for t in raw_texts(batch.column(1))]
            prints, bits = (pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64)) for f in (set_print, simhash))
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), prints, pa.array([len(s) for s in sets], pa.int64()), bits, keys], ["doc_id", "fp", "n", "bits", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long, n long, bits long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``fp, shingles`` once for each print in ``wanted (fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("sets")
        for batch in batches:
            sets = [shingles(t) for t in raw_texts(batch.column(0))]
            prints = np.array([set_print(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    both = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, shingles binary")
    few = marked(both, wanted.select(F.col("fp").alias("doc_id")), "wanted").where("wanted")
    return few.select(F.col("doc_id").alias("fp"), "shingles").join(wanted, "fp", "left_semi").dropDuplicates(["fp"])


def tree_pairs(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``leader, fp``: what the BK-trees propose for the sets of ``distinct (fp, n, bits)``. Sets of one fingerprint are
    led by the smallest of them, and these by the one that a tree has tied them to."""
    full = distinct.where("n > 0").select("bits", "fp")
    heads = written(full.groupBy("bits").agg(F.min("fp").alias("head")), "heads")
    stars = tree_links(heads.select(F.col("bits").alias("fp")), radius).distinct()
    of_a, of_b = (heads.select(F.col("bits").alias(end), F.col("head").alias(name)) for end, name in (("a", "fp"), ("b", "leader")))
    tied = stars.join(of_a, "a").join(of_b, "b").select("leader", "fp")
    equal = full.join(heads, "bits").where("fp <> head").select(F.col("head").alias("leader"), "fp")
    return tied.unionByName(equal).distinct()


def links(docs: DataFrame, distinct: DataFrame, text_col: str, shard_size: int = 4096) -> DataFrame:
    """``a, b``: links between the sets of ``distinct (fp, n, bits, keys)``: those that the trees propose and the sets
    confirm, and stars of each shard's groups."""
    key = ["band", "bits", "x", "y"]
    members = distinct.where("n > 0").select("fp", "n", F.posexplode("keys").alias("band", "bits"))
    crowded = members.groupBy("band", "bits").agg(F.count("*").alias("count"), F.sum("n").alias("size")).where("count > 1")
    tiles = F.ceil(F.greatest(F.col("count") / shard_size, F.col("size") / SHARD_SHINGLES)).cast("int")
    met = members.join(crowded.select("band", "bits", tiles.alias("tiles")), ["band", "bits"])
    met = written(met.withColumn("own", F.pmod(F.xxhash64("fp", "band"), F.col("tiles")).cast("int")), "shared-keys")
    proposed = written(tree_pairs(distinct), "tree-pairs")
    ends = proposed.select("fp").union(proposed.select("leader"))
    sets = written(sets_of(docs, met.select("fp").union(ends).distinct(), text_col), "shingle-sets")
    far = distances(proposed, sets.withColumnRenamed("shingles", "own"))
    close = written(far.where(F.col("common") * 100 >= F.col("together") * round(100 * SIMILARITY)).select("leader", "fp"), "tree-links")
    tied = close.groupBy("fp").agg(F.min("leader").alias("leader"))
    sets = sets.join(tied, "fp", "left").select("fp", "shingles", F.coalesce("leader", "fp").alias("tied"))
    shards = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    shards = shards.select("band", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp").join(sets, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; a shard may go on in the next batch. In a pair of tiles only sets of different tiles meet."""
        current, prints, own, side, known = None, [], [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(prints) > 1 and (found := shard_links(prints, own, side if current[2] != current[3] else None, round(100 * SIMILARITY), known)):
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for *shard, tile, fp, leader, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    yield from close()
                    current, prints, own, side, known = shard, [], [], [], []
                prints.append(fp)
                known.append(leader)
                side.append(tile)
                own.append(np.frombuffer(raw, np.uint64))
        yield from close()

    rows = shards.select(*key, "own", "fp", "tied", "shingles")
    found = rows.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "a long, b long")
    return close.select(F.col("fp").alias("a"), F.col("leader").alias("b")).unionByName(found)


def _digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def set_print_of(text: Column) -> Column:
    """The 16 digits for a text column, as ``similar_groups`` gives them."""

    @F.pandas_udf("string")
    def digits(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{set_print(shingles(t.encode() if t is not None else b'')):016x}" for t in texts], dtype=object)

    return digits(text.cast("string"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, group_fingerprint`` for every row of ``docs``, as the SimHash operator
    returns them; ``fingerprint`` is the print of the set. Texts without a word are one group."""
    prints = written(set_prints(docs, id_col, text_col), "set-prints")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    distinct = prints.select("fp", "n", "bits", "keys").dropDuplicates(["fp"])
    roots = components(links(docs, distinct, text_col)).withColumnRenamed("node", "fp")
    linked = smallest.join(roots, "fp")
    of_root = linked.groupBy("root").agg(F.min("least_id").alias("group_id"))
    in_group = linked.join(of_root, "root").select("fp", "group_id", "root")
    labels = smallest.join(in_group, "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.select("doc_id", "fp").join(labels, "fp").select("doc_id", _digits(F.col("fp")).alias("fingerprint"), "component_id", _digits(F.col("root")).alias("group_fingerprint"))
