"""Merkle manifest of a dataset: one digest that vouches for every row, and a proof for each.

Leaves ascend by id within their group. Nothing is sorted for that: each task turns its ids into bitmaps, words of 64
ids with one bit for each, empty words left out; the words of a group are merged by OR. Counts of bits are summed up
in directories of three levels (``RADIX`` bits of the id each), so that a word knows how many ids of its group come
before it, and a row's place is that number plus the bits before its own. No directory window is longer than
``2 ** RADIX`` rows, whatever a group holds.

Places are coordinates: ``2 ** LEVELS`` neighbours form a keyed slot array, each leaf is put into its slot and the array
is reduced by ``LEVELS`` levels in one task. Tops of arrays are the leaves of the next round, until each group has
one node; the groups' nodes are reduced the same way. On the way down each array adds the siblings of its slots to
the proof of the array above.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.llm.common import bucket_of, written

LEVELS, RADIX = 12, 16
#: The fields of a row in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_MODULUS = 7
#: How a sibling stands to the node below it; a node without one is hashed alone.
LEFT, RIGHT, ALONE = "L", "R", "-"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, a colon and itself, ``-`` for null."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def group_key(lang: Column) -> Column:
    """Text that orders like the language, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _directory(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words (keys, word, n, …)`` with ``before``, the rows of its group before the word, and ``size``, those of the group."""
    shifts = [6, RADIX, 2 * RADIX, 3 * RADIX, 64]
    sums, tables = words.withColumnRenamed("word", "at6"), []
    for low, high in zip(shifts, shifts[1:], strict=False):
        own, parent = f"at{low}", f"at{high}"
        sums = sums.withColumn(parent, F.lit(0) if high == 64 else F.shiftright(own, high - low))
        inside = Window.partitionBy(*keys, parent)
        ahead = F.sum("n").over(inside.orderBy(own).rowsBetween(Window.unboundedPreceding, -1))
        tables.append(sums.withColumn("own", F.coalesce(ahead, F.lit(0))))
        sums = sums.groupBy(*keys, parent).agg(F.sum("n").alias("n"))
    out = tables.pop().withColumn("size", F.sum("n").over(Window.partitionBy(*keys, "at64"))).withColumnRenamed("own", "before")
    for shift, table in zip(shifts[3:0:-1], reversed(tables), strict=True):
        upper = out.select(*keys, f"at{shift}", F.col("before").alias("base"), "size")
        out = table.join(upper, [*keys, f"at{shift}"]).withColumn("before", F.col("base") + F.col("own")).drop("own", "base")
    return out.withColumnRenamed("at6", "word")


def ranks(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``rows`` with ``place``, the sum of the weights of smaller values in its group, and ``size``, that of the group.

    A group has each value once. Rows meet the word of 64 values that theirs is in, so no join key has more rows.
    """
    low = F.pmod(F.col(value), F.lit(64)).cast("int")
    keyed = rows.withColumn("word", F.shiftright(value, 6))
    extra = F.collect_list(F.when(F.col(weight) > 1, F.struct(low.alias("low"), (F.col(weight) - 1).alias("more"))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low)
    words = keyed.groupBy(*keys, "word").agg(F.bit_or(bit).alias("bits"), F.sum(weight).alias("n"), extra.alias("extra"))
    found = _directory(words, keys).select(*keys, "word", "bits", "extra", "before", "size")
    joined = keyed.join(found, [*keys, "word"]).withColumn("low", low)
    inside = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("low")))))
    more = F.expr("aggregate(filter(extra, x -> x.low < low), 0L, (s, x) -> s + x.more)")
    return joined.withColumn("place", F.col("before") + inside + more).drop("word", "bits", "extra", "before", "low")


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves (g, doc_id, leaf, tampered)`` with ``place`` in their group, from 0, and its ``size``.

    Rows without an id come first. Rows of one id are told apart by their digest in a ranking of their own; equal
    rows take consecutive places.
    """
    keys = ["g", "missing", "id"]
    keyed = leaves.withColumns({"missing": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    totals = leaves.groupBy("g").agg(F.count("*").alias("size"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("ahead"))
    ids = ranks(keyed.groupBy(*keys).agg(F.count("*").alias("n")), ["g", "missing"], "id", "n").drop("size").join(totals, "g")
    first = F.when(F.col("missing"), 0).otherwise(F.col("place") + F.col("ahead"))
    ids = written(ids.select(*keys, "n", first.alias("first"), "size"), "places")
    single = keyed.join(ids.where("n = 1"), keys).withColumn("place", F.col("first"))

    again = keyed.join(ids.where("n > 1"), keys)
    same = again.groupBy(*keys, "leaf").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("doc_id", "tampered", "first", "size")])
    same = same.withColumn("digest", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    digests = ranks(same.groupBy(*keys, "digest").agg(F.sum("copies").alias("n")), keys, "digest", "n").select(*keys, "digest", "place")
    alike = Window.partitionBy(*keys, "digest").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("first") + F.col("place") + F.coalesce(F.sum("copies").over(alike), F.lit(0))
    several = same.join(digests, [*keys, "digest"]).withColumn("at", at)
    several = several.withColumn("place", F.explode(F.expr("sequence(at, at + copies - 1)")))
    columns = ["g", "doc_id", "leaf", "tampered", "place", "size"]
    return single.select(*columns).unionByName(several.select(*columns))


def hashed(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """Nodes of each level from the leaves up; a last one without a partner is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def steps(levels: list[list[str]], slot: int) -> list[str]:
    """The siblings of a slot from the leaves up, each with the side on which it stands."""
    out = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        out.append(ALONE if other >= len(nodes) else (LEFT if other < slot else RIGHT) + nodes[other])
        slot >>= 1
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for step in path:
        other = step[1:]
        leaf = hashed(leaf) if step == ALONE else hashed(other, leaf) if step[0] == LEFT else hashed(leaf, other)
    return leaf


def height(size: int) -> int:
    """Levels in which an array is reduced: all if its group has further ones, else until one node is left."""
    return LEVELS if size > 1 << LEVELS else max(0, size - 1).bit_length()


def _arrays(nodes: DataFrame, columns: str) -> DataFrame:
    """Slot arrays ``g, block, size, digests, top`` with arrays of further ``columns`` from ``nodes (g, place, size, digest, …)``."""
    names = [c.split()[0] for c in columns.split(",")] if columns else []

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        slots = [p & (1 << LEVELS) - 1 for p in table.column("place").to_pylist()]
        order: list[int] = [0] * len(slots)
        for row, slot in enumerate(slots):
            order[slot] = row
        table = table.take(pa.array(order, pa.int64()))
        digests = [d.hex() for d in table.column("digest").to_pylist()]
        size = table.column("size")[0].as_py()
        top = reduced(digests, height(size))[-1][0]
        lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("digest", *names)]
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([size], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary()), *lists], ["g", "block", "size", "top", "digest", *names])

    lists = "".join(f", {c.split()[0]} array<{c.split()[1]}>" for c in columns.split(",")) if columns else ""
    keyed = nodes.withColumn("block", F.shiftright("place", LEVELS)).select("g", "block", "place", "size", "digest", *names)
    return keyed.groupBy("g", "block").applyInArrow(fill, f"g string, block long, size long, top binary, digest array<binary>{lists}")


def _next(arrays: DataFrame) -> DataFrame:
    """Tops of the arrays as nodes of the next round."""
    size = F.shiftright(F.col("size") + ((1 << LEVELS) - 1), LEVELS)
    return arrays.select("g", F.col("block").alias("place"), size.alias("size"), F.col("top").alias("digest"))


def _down(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """``g, place, path, subroot`` of each slot, from ``paths (g, place, path, subroot)`` of its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, block, size, digests, above, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = reduced([d.hex() for d in digests], height(size))
                own = [",".join([*steps(levels, i), *filter(None, [above])]) for i in range(len(digests))]
                n = len(own)
                places = [(block << LEVELS) + i for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([g] * n), pa.array(places, pa.int64()), pa.array(own), pa.array([subroot] * n)], ["g", "place", "path", "subroot"])

    joined = arrays.join(paths.withColumnRenamed("place", "block"), ["g", "block"])
    return joined.select("g", "block", "size", "digest", "path", "subroot").mapInArrow(run, "g string, place long, path string, subroot string")


def _rounds(nodes: DataFrame, columns: str = "") -> tuple[list[DataFrame], DataFrame]:
    """The arrays of every round, and ``g, digest`` of the last node of each group."""
    out = [written(_arrays(nodes, columns), "slots")]
    while (out[-1].agg(F.max("block")).first()[0] or 0) > 0:
        out.append(written(_arrays(_next(out[-1]), ""), "slots"))
    return out, _next(out[-1]).select("g", "digest")


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``.

    ``docs`` has the columns ``FIELDS``; further ones are not hashed. Rows whose id has a CRC-32 that ``TAMPER_MODULUS``
    divides are verified with one character more than ``n_chars`` says; without an id or without ``n_chars`` they
    stay as they are. A null id comes before all others, repeated ids are ordered by digest; an empty table gives
    an empty result. There is a top for each language: languages are taken to be few enough for one window.
    """
    columns = {c: F.col(c) for c in FIELDS}
    changed = F.coalesce(bucket_of(F.col("doc_id"), TAMPER_MODULUS) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tampered = F.when(changed, leaf_of(*(columns | {"n_chars": F.col("n_chars") + 1}).values()))
    leaves = docs.select("doc_id", group_key(F.col("lang")).alias("g"), leaf_of(*columns.values()).alias("leaf"), tampered.alias("tampered"))
    leaves = written(leaves, "leaves")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rounds, tops = _rounds(placed(leaves).withColumnRenamed("leaf", "digest"), f"doc_id {kind},tampered binary")

    by_name = Window.orderBy("g")
    groups = tops.withColumn("place", (F.row_number().over(by_name) - 1).cast("long")).withColumn("size", F.count("*").over(Window.partitionBy()))
    groups = written(groups, "groups")
    upper, root = _rounds(groups.withColumn("g", F.lit("")))
    paths = root.select("g", F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), F.lit("").alias("subroot"))
    for arrays in reversed(upper):
        paths = _down(arrays, paths)
    paths = groups.join(paths.drop("g"), "place").select("g", F.lit(0).cast("long").alias("place"), "path", F.lower(F.hex("digest")).alias("subroot"))
    for arrays in reversed(rounds[1:]):
        paths = _down(arrays, paths)
    top = root.first()
    top = top["digest"].hex() if top else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, (size, digests, changes, above, subroot) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                nodes = [d.hex() for d in digests]
                levels, above = reduced(nodes, height(size)), above.split(",") if above else []
                out = []
                for slot, leaf in enumerate(nodes):
                    path = steps(levels, slot) + above
                    end = folded(changes[slot].hex() if changes[slot] else leaf, path)
                    out.append((leaf, subroot, top, hashed(*(p[1:] for p in path)), end, end == top))
                arrays = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([ids[row].values, *arrays], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    joined = rounds[0].join(paths.withColumnRenamed("place", "block"), ["g", "block"])
    rows = joined.select("doc_id", "size", "digest", "tampered", "path", "subroot")
    return rows.mapInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
