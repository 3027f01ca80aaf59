"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has ``SIZE`` coordinates. In round i every shingle is hashed to one coordinate and leaves i plus a random
fraction there; the least value stays. The first ``SIZE`` rounds throw shingles anywhere, the next ``SIZE`` rounds
throw all of them at coordinate 0, 1, …, so every coordinate fills, and the work ends with the round in which the last
one does. Agreeing coordinates estimate the Jaccard similarity with the concentration of independent samples.

``ROWS`` coordinates joined make a key, a document has ``BANDS`` of them. A pair of similarity s shares no key with
chance ``(1 - s ** ROWS) ** BANDS``, 7e-9 at 0.85. A key only proposes; links need the exact similarity of the full sets.

Documents that share a key are a bucket. Each bucket has a leader, the text with most copies. Members meet their leaders'
sets (salted, a set at a time), and whoever is close enough is linked to it and leaves the bucket, unless some member
that is not could still be linked to it: by the triangle inequality that needs distances to the leader that differ by
at most ``1 - similarity``. A large group of copies of one text so takes one comparison for each member. What remains
goes to shards, which are searched with an inverted index over the rarest shingles of each set: two sets that are
similar enough share one of the first ``n - ceil(s n) + 1`` in any common order. Remains that are too large for a
shard are dealt into tiles and pairs of tiles meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import marked, raw_texts, written
from liftpanel.llm.graph import components

SHINGLE, SEED = 3, 42
#: Least similarity as a percentage.
PERCENT = 85
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
SHARD_SETS, SHARD_SHINGLES = 2048, 1 << 20
#: Members of a bucket that meet one copy of their leader's set.
LED = 4096
_SEEDS = np.random.default_rng(SEED).integers(1, 2**63, 2 * SIZE, np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; fewer words are one shingle, no word is none."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def identity(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def sketch(own: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The coordinates of a set that is not empty; a value has its round in the upper half."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    at_once = max(1, 1600 // len(own))
    for first in range(0, 2 * size, at_once):
        rounds = np.arange(first, min(2 * size, first + at_once), dtype=np.uint64)
        mixed = (own ^ _SEEDS[rounds, None]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(30)
        place = np.where(rounds[:, None] < size, (mixed >> np.uint64(32)) * np.uint64(size) >> np.uint64(32), rounds[:, None] % np.uint64(size))
        value = rounds[:, None] << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)
        order = np.argsort(value.ravel())[::-1]
        least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        least[place.ravel()[order]] = value.ravel()[order]
        out = np.minimum(out, least)
        if out.max() >> np.uint64(32) < 2 * size:
            break
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in sketch(own).reshape(BANDS, ROWS)]
    return np.array(keys, np.uint64).view(np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def shard_links(ids: list, sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT, tied: list | None = None) -> list[tuple]:
    """Links that tie the sets of a shard together as all links would. With ``side`` only sets of different sides meet.

    Of two groups that are tied already no further pair is compared; sets with one value in ``tied`` are from the start.
    """
    n = len(sets)
    _, shared, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    parts = np.split(shared, np.cumsum([len(s) for s in sets])[:-1])
    label, postings, out = list(range(n)), {}, []
    if tied is not None:
        first: dict = {}
        label = [first.setdefault(t, i) for i, t in enumerate(tied)]

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for new in sorted(range(n), key=lambda i: len(sets[i])):
        size = len(sets[new])
        rarest = parts[new][np.lexsort((parts[new], counts[parts[new]]))][: size - -(-percent * size // 100) + 1]
        met = {i for token in rarest.tolist() for i in postings.get(token, ()) if 100 * len(sets[i]) >= percent * size}
        for old in sorted(met, reverse=True):
            if root(old) != root(new) and (side is None or side[old] != side[new]) and similar(sets[new], sets[old], percent):
                out.append((ids[new], ids[old]))
                label[root(old)] = root(new)
        for token in rarest.tolist():
            if counts[token] > 1:
                postings.setdefault(token, []).append(new)
    return out


def prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, fp, n, keys``: identity, size and keys of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in raw_texts(batch.column(1))]
            keys = pa.array([band_keys(s) if len(s) else () for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([identity(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), keys], ["doc_id", "fp", "n", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp binary, n long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``fp, own``: the set of each identity in ``wanted (fp)`` once, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in raw_texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "own"])

    every = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id binary, own binary")
    few = marked(every, wanted.select(F.col("fp").alias("doc_id")), "wanted").where("wanted")
    return few.select(F.col("doc_id").alias("fp"), "own").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("own").alias("own"))


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``leader, fp, far``: Jaccard distance for each pair of ``pairs (leader, fp)``.

    A leader's set is sent once for every ``LED`` members, ahead of them; a task holds one set.
    """
    name = pairs.schema["fp"].dataType.simpleString()
    kind = {"binary": pa.binary(), "bigint": pa.int64()}[name]
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LED).cast("int").alias("salts"))
    salted = pairs.join(salts, "leader").withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    members = salted.join(sets, "fp").select("leader", "salt", F.lit(1).alias("member"), "fp", "own")
    heads = salts.join(sets.withColumnRenamed("fp", "leader"), "leader")
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("leader", "salt", F.lit(0).alias("member"), F.col("leader").alias("fp"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for leader, _, member, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not member:
                    head = own
                    continue
                both = common(head, own)
                out.append((leader, fp, both, len(head) + len(own) - both))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [kind, kind, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["leader", "fp", "common", "together"])

    rows = members.unionByName(heads).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
    return rows.mapInArrow(run, f"leader {name}, fp {name}, common long, together long")


def _shards(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links in the buckets of ``rest (band, bits, fp, n)``."""
    sizes = rest.groupBy("band", "bits").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    tiles = F.ceil(F.greatest(F.col("members") / SHARD_SETS, F.col("shingles") / SHARD_SHINGLES)).cast("int")
    tiled = rest.join(sizes.select("band", "bits", tiles.alias("tiles")), ["band", "bits"])
    tiled = tiled.withColumn("own_tile", F.pmod(F.xxhash64("fp", "band"), F.col("tiles")).cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    key = ["band", "bits", "x", "y"]
    dealt = dealt.select("band", "bits", F.least("own_tile", "other").alias("x"), F.greatest("own_tile", "other").alias("y"), F.col("own_tile").alias("side"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by shard; a shard may go on in the next batch."""
        current, ids, sets_, side = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (found := shard_links(ids, sets_, side if current[2] != current[3] else None, percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            for *shard, own_side, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current:
                    yield from close()
                    current, ids, sets_, side = shard, [], [], []
                ids.append(fp)
                sets_.append(np.frombuffer(raw, np.uint64))
                side.append(own_side)
        yield from close()

    rows = dealt.join(sets, "fp").select(*key, "side", "fp", "own")
    return rows.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "a binary, b binary")


def links(docs: DataFrame, distinct: DataFrame, text_col: str, percent: int = PERCENT) -> DataFrame:
    """``a, b``: links between the sets of ``distinct (fp, n, keys, copies)``."""
    keyed = distinct.where("n > 0").select("fp", "n", "copies", F.posexplode("keys").alias("band", "bits"))
    leaders = keyed.groupBy("band", "bits").agg(F.max(F.struct("copies", "fp")).alias("most"), F.count("*").alias("members")).where("members > 1")
    met = written(keyed.join(leaders.select("band", "bits", F.col("most.fp").alias("leader")), ["band", "bits"]).select("band", "bits", "leader", "fp", "n"), "buckets")
    sets = written(sets_of(docs, met.select("fp").distinct(), text_col), "sets")
    pairs = met.where("fp <> leader").select("leader", "fp").distinct()
    far = written(distances(pairs, sets), "distances")
    near = F.col("common") * 100 >= F.col("together") * percent
    starred = far.where(near).select(F.col("fp").alias("a"), F.col("leader").alias("b"))

    # Who is linked to the leader stays in the bucket only if a member that is not may be linked to it.
    led = met.where("fp <> leader").join(far, ["leader", "fp"]).withColumn("near", near)
    distance = 1 - F.col("common") / F.col("together")
    open_ = led.where(~F.col("near")).groupBy("band", "bits").agg(F.min(distance).alias("nearest"))
    slack = 1 - percent / 100 + 1e-9
    rest = led.join(open_, ["band", "bits"]).where(~F.col("near") | (distance + slack >= F.col("nearest")))
    inside = _shards(written(rest.select("band", "bits", "fp", "n"), "unlike"), sets, percent)
    return starred.unionByName(inside)


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links, the own one included; ``kept`` says whether
    it is the row's own. Equal sets are linked. Null texts and texts without a word have no shingles and no links. A
    row without an id gets the smallest id of its group, null if none has one, and then counts as kept. Repeated
    rows give repeated rows, an empty table gives an empty one, and further columns are not looked at.
    """
    every = written(prints(docs, id_col, text_col), "prints")
    smallest = every.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    distinct = every.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    roots = components(links(docs, distinct, text_col, percent)).withColumnRenamed("node", "fp")
    linked = smallest.join(roots, "fp")
    of_root = linked.groupBy("root").agg(F.min("least_id").alias("group_id"))
    labels = smallest.join(linked.join(of_root, "root").select("fp", "group_id"), "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("group_id"))
    with_words = every.where("n > 0").select("doc_id", "fp", "n").join(labels, "fp").select("doc_id", "n", "group_id")
    all_rows = with_words.unionByName(every.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("group_id")))
    return all_rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("group_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))
