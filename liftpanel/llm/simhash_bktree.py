"""Near-duplicates by SimHash: fingerprints of 64 bits, linked by BK-trees.

A fingerprint is made inside one task from one whole text. Links need two fingerprints that differ in at
most ``radius`` bits. Cut into ``radius + 1`` blocks of bits, such a pair agrees in one block at least, so
every distinct fingerprint goes to one shard for each of its blocks and a shard's BK-tree holds the
fingerprints that agree in that block. Trees and their queries meet by a shuffle: together all shard trees
are as large as the corpus, so no single one is sent to every executor. A shard has at most ``shard_size``
nodes; a larger group is dealt into tiles, and every pair of tiles is a shard of its own. Shards return
their links as stars around their smallest fingerprint, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import raw_texts, written
from liftpanel.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Bit j of byte value v.
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Big-endian bytes of the hash of each word shingle, repeats included; no row without a word."""
    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    cuts = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in cuts]), np.uint8).reshape(n, 8)


def majority(hashes: np.ndarray) -> int:
    """The majority of each bit; 0 without a hash."""
    if not len(hashes):
        return 0
    cells = hashes + np.arange(8, dtype=np.int64) * 256
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), axis=1, bitorder="little").tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of the word shingles, repeats included; 0 without a word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long. Null text counts as empty. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t) for t in raw_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Each child hangs on the edge that bears its Hamming distance to its parent.

    Values are added one by one. For the search all edges lie in one array, sorted by node and distance, so the
    edges that may lead to a match are a slice, and many queries go down the tree side by side.
    """

    def __init__(self, values: list[int]) -> None:
        parents, distances = [], []
        edges: list[dict[int, int]] = []
        for node, value in enumerate(values):
            edges.append({})
            at = 0
            while node:
                distance = (value ^ values[at]).bit_count()
                if distance not in edges[at]:
                    edges[at][distance] = node
                    parents.append(at)
                    distances.append(distance)
                    break
                at = edges[at][distance]
        self.values = np.array(values, np.uint64)
        place = np.array(parents, np.int64) * 66 + np.array(distances, np.int64)
        self.child = np.argsort(place, kind="stable") + 1
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=66 * len(values)))])

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) in the radius; only edges that may lead to one are followed."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found = []
        while len(query):
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            low = self.begin[node * 66 + np.maximum(distance - radius, 0)]
            n = self.begin[node * 66 + np.minimum(distance + radius, 64) + 1] - low
            node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            query = np.repeat(query, n)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shard_links(first: list[int], second: list[int], radius: int, at_once: int = 256) -> list[tuple[int, int]]:
    """Links within ``first`` if ``second`` is empty, else those between the two, as stars (member, smallest)."""
    tree = BKTree(first)
    members = np.array(first + second, np.uint64)
    label = np.arange(len(members))
    for start in range(len(first) if second else 0, len(members), at_once):
        query, node = tree.within(members[start : start + at_once], radius)
        join(label, query + start, node)
    root = np.array(label)
    smallest = np.full(len(members), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, root, members)
    apart = members != smallest[root]
    return list(zip(members[apart].tolist(), smallest[root][apart].tolist(), strict=True))


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of all pairs one label; in ``label`` each node points to a root that points to itself."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        high, low = np.maximum(x, y)[differ], np.minimum(x, y)[differ]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def _blocks(fp: Column, radius: int) -> Column:
    """Structs (block, bits of that block); the widths differ by one bit at most."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    bits = [F.shiftrightunsigned(F.shiftleft(fp, 64 - high), 64 - high + low) for low, high in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.struct(F.lit(i).alias("block"), b.alias("bits")) for i, b in enumerate(bits)])


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = 8192) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp``, as stars of each shard's groups."""
    members = distinct.select("fp", F.inline(_blocks(F.col("fp"), radius)))
    group = ["block", "bits"]
    crowded = members.groupBy(group).count().where("count > 1")
    tiles = F.ceil(F.col("count") / shard_size).cast("int")
    own = F.pmod(F.xxhash64("fp", "block"), F.col("tiles")).cast("int")
    shards = (
        members.join(crowded, group)
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(*group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("own").alias("tile"), "fp")
    )
    key = [*group, "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; a shard may go on in the next batch."""
        current, sides = None, ([], [])
        out: list[tuple[int, int]] = []

        def close() -> None:
            if current is not None and len(sides[0]) + len(sides[1]) > 1:
                out.extend(shard_links(sides[0], sides[1], radius))

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(6)]
            values = columns[5].view(np.uint64).tolist()
            for *shard, tile, value in zip(*(c.tolist() for c in columns[:5]), values, strict=True):
                if shard != current:
                    close()
                    current, sides = shard, ([], [])
                sides[tile != shard[2]].append(value)
            if out:
                yield emit()
        close()
        if out:
            yield emit()

    return shards.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "a long, b long")


def _digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprint_of(text: Column) -> Column:
    """The 16 digits for a text column, as ``near_duplicates`` gives them."""

    @F.pandas_udf("string")
    def digits(texts: pd.Series) -> pd.Series:
        return pd.Series([f"{fingerprint(t.encode() if t is not None else b''):016x}" for t in texts], dtype=object)

    return digits(text.cast("string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, group_fingerprint`` for every row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits, ``component_id`` is the smallest id that can be reached over
    links, the own one included, ``group_fingerprint`` one fingerprint of the group. Texts without a word have fingerprint 0 and are linked like any other. A row
    without an id gets the smallest id of its group, null if none has one. Repeated rows give repeated rows,
    an empty table gives an empty one, and further columns are not looked at.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    smallest = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(smallest.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = smallest.join(roots, "fp")
    of_root = linked.groupBy("root").agg(F.min("least_id").alias("group_id"))
    in_group = linked.join(of_root, "root").select("fp", "group_id", "root")
    labels = smallest.join(in_group, "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(labels, "fp").select("doc_id", _digits(F.col("fp")).alias("fingerprint"), "component_id", _digits(F.col("root")).alias("group_fingerprint"))
