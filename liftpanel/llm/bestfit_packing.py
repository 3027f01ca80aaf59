"""Best-fit packing planned on a histogram of lengths.

Documents are tokenised once, inside tasks, into pieces of at most ``capacity`` tokens. Only the number of
pieces of each length reaches the driver: at most ``capacity`` rows. Best-fit decreasing then works on
counts. Sequences that look alike are one interval of sequence numbers, so a step fills many at once and the
plan has a few rows for each length, however many documents there are. Pieces take the planned slots by
joining on their rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.llm.common import in_groups, raw_texts, worker_state, written

CAPACITY, END_ID = 2048, 0
#: Chunks whose ids a Python worker remembers; it forgets all of them when there are more.
REMEMBERED = 600_000
#: ASCII marks after which a chunk may be cut: the tokenizer ends a run of letters there. The apostrophe begins contractions.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

PIECES = "piece int, start long, length long, ids_crc32 long"


#: Words of these letters alone are one unit for the tokenizer, whose model can then be asked directly.
PLAIN = re.compile("[a-zà-öø-ÿß]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones of Latin-1 for
    themselves, the others in order from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkIds(dict):
    """Ids of a chunk between ASCII white space, as little-endian unsigned 32-bit bytes.

    This tokenizer never joins what white space parts and folds case, so a text's ids are those of its
    chunks in lower case, one after the other. Marks at the end of a chunk are remembered apart from its word.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED) -> None:
        super().__init__()
        self.tokenizer, self.remembered = tokenizer, remembered
        self.letters = "".join(letter for _, letter in sorted(byte_letters().items()))

    def __missing__(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(MARKS)
        if word and len(word) < len(chunk) and word[-1:].isalpha() and b"'" not in chunk and b"<|" not in chunk:
            ids = self[word] + self[chunk[len(word) :]]
        else:
            ids = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the words that are new in one call."""
        if len(self) + len(chunks) > self.remembered:
            self.clear()
        words = {w for c in chunks if c not in self and (w := c.rstrip(MARKS)) not in self}
        model, rest = self.tokenizer.model, []
        for word in words:
            lower = word.decode("utf-8", "replace").lower()
            if PLAIN.fullmatch(lower):
                letters = lower.encode().decode("latin-1").translate(self.letters)
                self[word] = np.array([t.id for t in model.tokenize(letters)], "<u4").tobytes()
            else:
                rest.append(word)
        encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        for word, e in zip(rest, encoded, strict=True):
            self[word] = np.array(e.ids, "<u4").tobytes()

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        # Special tokens are found before case is folded, so what looks like one is encoded as it is.
        chunks = [(t if b"<|" in t else t.lower()).split() for t in texts]
        self.learn(set().union(*chunks))
        for own in chunks:
            yield b"".join(map(self.__getitem__, own))


def chunk_ids(path: str, remembered: int = REMEMBERED) -> ChunkIds:
    """The worker's memory for this tokenizer, kept from task to task."""
    known = worker_state("chunks").setdefault("chunk_ids", {})
    if path not in known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known[path] = ChunkIds(Tokenizer.from_file(path))
    known[path].remembered = remembered
    return known[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids, then the end id, cut every ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. Null text is empty: one piece,
    which holds the end id alone.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = chunk_ids(tokenizer, remembered)
        for batch in batches:
            rows, out = [], []
            ids_of = (ids for group in in_groups(raw_texts(batch.column(1))) for ids in memory.of(group))
            for row, ids in enumerate(ids_of):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append(row)
                    out.append((piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, {PIECES}")


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks up to, first sequence, pieces in each, offset of the first).

    Pieces of one length are placed together: into the open sequences with the least room that is enough, as
    many into each as fit, and into new ones when no room is left. Every step ends a length or uses up an
    interval of like sequences, and makes two intervals at most, so there are a few rows for each length.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    keys: list[int] = []
    plan, sequences = [], 0

    def leave(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(keys, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(keys, length)
            if at < len(keys):
                free = keys[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], keys[at]
            else:
                free, first, n = capacity, sequences, -(-(total - rank) // (capacity // length))
                sequences += n
            each = free // length
            full = min(n, (total - rank) // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - free))
                leave(free - each * length, first, full)
                rank += full * each
            rest = total - rank
            if full < n and rest:
                plan.append((length, rank, total, first + full, rest, capacity - free))
                leave(free - rest * length, first + full, 1)
                rank, full = total, full + 1
            leave(free, first + full, n - full)
    return plan


def ranked(cut: DataFrame, pieces_total: int, rows_each: int = 100_000) -> DataFrame:
    """Adds ``rank`` from 0 within each length. Lengths are split into parts by a hash of the piece, as many as
    it takes for ``rows_each`` rows in a part on average; a part's ranks begin after those of the parts before it."""
    parts = max(1, -(-pieces_total // rows_each))
    salted = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "part").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["length", "part"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Each sequence holds at most ``capacity`` tokens without gaps from offset 0. Rows with a null id and
    repeated rows are packed like any other; an empty table gives an empty result; further columns are not read.
    ``remembered`` bounds the chunks whose ids a Python worker keeps: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, id_col, text_col, remembered), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = plan_slots(counts, capacity)
    names = ["length", "rank_from", "rank_to", "first", "each", "place"]
    slots = spark.createDataFrame(plan, ", ".join(f"{n} long" for n in names))
    # The plan has a few rows for each length, at most `capacity` lengths: its size does not depend on the corpus.
    slots = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    nth = F.col("rank") - F.col("rank_from")
    return (
        ranked(cut, sum(counts.values()))
        .join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
            (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"),
        )
    )
