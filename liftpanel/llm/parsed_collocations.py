"""Collocations counted on a prefix-free parse.

Pieces of text between punctuation marks are cut into chunks where a window of ``OVERLAP`` words has a hash that is
0 modulo ``MODULUS``. Content alone decides, so repeated text is cut alike everywhere. A chunk ends with the window
that begins the next one: with ``LONGEST - 1`` words of overlap every phrase lies in a chunk, and it is counted in the
chunk in which it starts before that last window (in the last chunk of a piece it may start anywhere), so once. The
distinct chunks and how often each occurs are the dictionary; phrases are counted inside chunks, weighted.

A phrase is frequent only if all words and pairs of words in it are. Frequent words and pairs leave marks in
``2 ** MARK_BITS`` bits that go to all tasks, and only phrases whose words and pairs are marked are counted as text.
Marks never miss a frequent one; others that are marked by chance are counted too and fall to the exact count. With
more and more marks set, less is saved, and the result stays the same.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.llm.common import raw_texts, written

LONGEST, LEAST, TOP = 5, 100, 2000
OVERLAP, MODULUS = LONGEST - 1, 8
MARK_BITS = 26
SEED = 42
#: Bytes that a task gathers before it hands on what it has counted.
HELD_BYTES = 8 << 20
SALTS = 64
CUT = re.compile(rb"[.,;:!?\n-\r]")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNKNOWN = "und"


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def chunks_of(pieces: list[list[bytes]], modulus: int = MODULUS) -> Iterator[tuple[int, bytes, bool]]:
    """(piece, chunk, whether it is the piece's last one) for pieces with at least one word."""
    words = [w for p in pieces for w in p]
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if len(words) >= OVERLAP:
        hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        grams = np.zeros(len(words) - OVERLAP + 1, np.uint64)
        for i in range(OVERLAP):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(grams)]
        at = np.flatnonzero(mixed(grams) % np.uint64(modulus) == 0)
        at = at[at + OVERLAP <= ends[np.searchsorted(ends, at, "right")]]
        starts = np.union1d(starts, at)
    piece = np.searchsorted(ends, starts, "right")
    following = np.append(starts[1:], len(words))
    last = following == ends[piece]
    stops = np.where(last, following, following + OVERLAP)
    for p, a, b, final in zip(piece.tolist(), starts.tolist(), stops.tolist(), last.tolist(), strict=True):
        yield p, b" ".join(words[a:b]), final


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, last, chunk, f``: the distinct chunks of all texts and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[bytes]] = []
        langs: list[str] = []
        held = 0

        def found() -> Iterator[pa.RecordBatch]:
            chunks: dict[tuple[str, bool], list[bytes]] = defaultdict(list)
            for piece, chunk, last in chunks_of(pieces):
                chunks[langs[piece], last].append(chunk)
            for (lang, last), own in chunks.items():
                counts = pc.value_counts(pa.array(own, pa.binary()))
                n = len(counts)
                arrays = [pa.repeat(lang, n), pa.repeat(last, n), counts.field(0).cast(pa.string()), counts.field(1)]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "last", "chunk", "f"])
            pieces.clear()
            langs.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                own = [w for p in CUT.split(text.lower()) if (w := p.split())]
                pieces += own
                langs += [lang] * len(own)
                held += len(text)
                if held >= HELD_BYTES:
                    yield from found()
                    held = 0
        if pieces:
            yield from found()

    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parsed = narrow.mapInArrow(run, "lang string, last boolean, chunk string, f long")
    return parsed.groupBy("lang", "last", "chunk").agg(F.sum("f").alias("f"))


class Marks:
    """A set of hashes, seen through their first ``MARK_BITS`` bits."""

    def __init__(self, hashes: DataFrame) -> None:
        """From ``hashes (h)``; at most ``2 ** (MARK_BITS - 6)`` rows reach the driver."""
        place = F.shiftrightunsigned("h", 64 - MARK_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
        bits = hashes.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.bits = np.zeros(1 << (MARK_BITS - 6), np.uint64)
        for batch in bits.toArrow().to_batches():
            self.bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - MARK_BITS)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


class Block:
    """Words of some chunks of one language in a row, and the weight that each place has as a start."""

    def __init__(self, lang: str, rows: pa.Table) -> None:
        """From rows ``last, chunk, f`` of the dictionary."""
        lists = pc.split_pattern(rows.column("chunk").combine_chunks().cast(pa.binary()), b" ")
        words = lists.flatten().dictionary_encode()
        self.ids = words.indices.to_numpy().astype(np.int64)
        self.vocabulary = words.dictionary.to_pylist()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        last, weights = rows.column("last").to_numpy(), rows.column("f").to_numpy()
        place = np.arange(len(self.ids))
        self.weight = np.where(np.repeat(last, sizes) | (place + OVERLAP < self.end), np.repeat(weights, sizes), 0)
        self.lang = lang

    def hashes(self) -> np.ndarray:
        """Of each word with its language, as Spark computes them from the text."""
        prefix = self.lang.encode() + b"\n"
        own = np.fromiter((xxhash.xxh64_intdigest(prefix + w, SEED) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return own[self.ids]

    def pairs(self, words: Marks) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the pair that begins at each place, and whether there is one of marked words."""
        hashes = self.hashes()
        known = words(hashes)
        pair = np.zeros(len(hashes), np.uint64)
        pair[:-1] = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        there = np.zeros(len(hashes), bool)
        there[:-1] = known[:-1] & known[1:] & (np.arange(1, len(hashes)) < self.end[:-1])
        return pair, there

    def count_words(self) -> Iterator[tuple[int, bytes, int]]:
        sums = np.bincount(self.ids, self.weight, len(self.vocabulary)).astype(np.int64)
        return ((1, w, f) for w, f in zip(self.vocabulary, sums.tolist(), strict=True) if f)

    def count_phrases(self, words: Marks, pairs: Marks) -> Iterator[tuple[int, bytes, int]]:
        """Phrases of 2 to LONGEST words whose pairs are all marked."""
        pair, there = self.pairs(words)
        there[there] = pairs(pair[there])
        at, rank = np.flatnonzero(there & (self.weight > 0)), self.ids
        for size in range(2, LONGEST + 1):
            key = rank[at] * len(self.vocabulary) + self.ids[at + size - 1]
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            sums = np.bincount(inverse, self.weight[at]).astype(np.int64)
            words = [self.ids[at[first] + i].tolist() for i in range(size)]
            for f, *own in zip(sums.tolist(), *words, strict=True):
                yield size, b" ".join([self.vocabulary[w] for w in own]), f
            rank = np.zeros(len(self.ids), np.int64)
            rank[at] = inverse
            at = at[(at + size < self.end[at]) & there[np.minimum(at + size - 1, len(there) - 1)]]
            if not len(at):
                return


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of one language from batches of the dictionary."""
    held: dict[str, list[pa.RecordBatch]] = defaultdict(list)
    size = 0

    def found() -> Iterator[Block]:
        for lang, parts in held.items():
            yield Block(lang, pa.Table.from_batches(parts))
        held.clear()

    for batch in batches:
        for lang in pc.unique(batch.column(0)):
            held[lang.as_py()].append(batch.filter(pc.equal(batch.column(0), lang)).select(["last", "chunk", "f"]))
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield from found()
            size = 0
    yield from found()


def _counted(parsed: DataFrame, words: Marks | None = None, pairs: Marks | None = None) -> DataFrame:
    """``lang, size, phrase, f`` of all words, or of the phrases that the marks let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = list(block.count_words() if words is None else block.count_phrases(words, pairs))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            arrays = [pa.repeat(block.lang, len(rows)), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()).cast(pa.string()), pa.array(columns[2], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "size", "phrase", "f"])

    rows = parsed.mapInArrow(run, "lang string, size int, phrase string, f long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _frequent_pairs(parsed: DataFrame, words: Marks, least: int) -> DataFrame:
    """``h``: hashes of pairs that together occur ``least`` times or more; all frequent pairs are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            pair, there = block.pairs(words)
            at = np.flatnonzero(there & (block.weight > 0))
            hashes, inverse = np.unique(pair[at], return_inverse=True)
            sums = np.bincount(inverse, block.weight[at], len(hashes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], ["h", "f"])

    return parsed.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("h")


def frequent_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang, size, phrase, f`` of all phrases of 1 to ``LONGEST`` words that occur ``least`` times or more, and
    ``lang, n``, the words of each language."""
    parsed = written(dictionary(docs, lang_col, text_col), "dictionary")
    every = written(_counted(parsed), "words")
    single = every.where(F.col("f") >= least)
    words = Marks(single.select(F.xxhash64(F.concat_ws("\n", "lang", "phrase")).alias("h")))
    pairs = Marks(_frequent_pairs(parsed, words, least))
    longer = _counted(parsed, words, pairs).where(F.col("f") >= least)
    return written(single.unionByName(longer), "frequent"), every.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``LONGEST`` words.

    ``score`` is floor(1000 a n / (l r)) at the cut of the phrase where that is least, the first of equals, ``l``
    and ``r`` are the counts of the two parts there. Phrases that never occur outside a longer one are left out.
    Letters A to Z are folded. A null language is ``und``, a null text is empty; texts without a word, and phrases
    that occur less than ``least`` times, give no row; an empty table gives an empty result. Repeated rows count as
    often as they are there; no other columns are read.
    """
    frequent, totals = frequent_phrases(docs, least, lang_col, text_col)
    candidates = frequent.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"))
    inside = F.explode(F.array(F.expr("slice(words, 1, size - 1)"), F.expr("slice(words, 2, size - 1)")))
    covered = candidates.where("size > 2").select("lang", "a", inside.alias("part")).groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("a").alias("most"))
    free = candidates.join(covered, ["lang", "phrase"], "left").where("most is null or most < a").drop("most")

    cuts = free.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "alrn"}
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact['a']} * {exact['n']}) div ({exact['l']} * {exact['r']})")
    best = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
