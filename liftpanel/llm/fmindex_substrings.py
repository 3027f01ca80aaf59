"""Repeated passages, found with compressed FM-indexes.

A window is ``WINDOW`` consecutive words. Equal windows have equal minimizers (the least hash among their
``GRAM``-word grams), so each run of windows with one minimizer is a *region* and goes to the shard of its
minimizer: windows that are equal always meet in one shard, and no text meets the whole corpus. Equal regions
are put together before anything is moved, with the smallest id that has them, and regions whose minimizer
only one document has are done.

A shard builds an FM-index over its regions: words as symbols, the Burrows-Wheeler transform in a wavelet
matrix of packed bits with sampled ranks. The regions are then streamed past it by backward search, many side
by side: one step extends a match by the word to its left; a match of ``WINDOW`` words is cut back to
``WINDOW - 1`` by widening its interval to all rows with the same prefix. So every window's interval, that is
all its occurrences, costs one step, and the smallest id among them is known beforehand for each interval.

A minimizer whose different regions have more than ``block_words`` words would make too large a shard. Its
regions are cut anew by a longer key of each window: its 4, then its 16 least grams, at last all of them in
order. Equal windows agree in every such key, so they still meet in one shard, and the longest key leaves a
shard with a single different window. An FM-index thus holds at most twice ``block_words`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import in_groups, marked, raw_texts, worker_state, written

WINDOW, GRAM = 50, 8
LONGEST_RUN = 512
BLOCK_WORDS = 400_000
REMEMBERED = 600_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def word_hashes() -> WordHashes:
    memory = worker_state("words").setdefault("word_hashes", WordHashes())
    if len(memory) > REMEMBERED:
        memory.clear()
    return memory


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def last_level(window: int) -> int:
    """The level whose key has all grams of a window."""
    width, level = window - min(GRAM, window) + 1, 1
    while 4**level < width:
        level += 1
    return level


def window_keys(grams: np.ndarray, width: int, level: int) -> np.ndarray:
    """A hash of the ``4 ** level`` least of each ``width`` consecutive grams; of all of them in order at the last level."""
    if level == 0:
        return sliding_min(grams, width)
    every = np.lib.stride_tricks.sliding_window_view(grams, width)
    if 4**level < width:
        every = np.sort(every, axis=1)[:, : 4**level]
    keys = np.zeros(len(every), np.uint64)
    for column in every.T:
        keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys


def runs_of(texts: list[bytes], window: int = WINDOW, level: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first window, windows, key, hash of the region's words) of each run, for many texts at once. The key
    is the minimizer at level 0; at the last level every window is a run of its own."""
    memory = word_hashes()
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < window:
        return
    hashes = np.fromiter((h for own in words for h in map(memory.__getitem__, own)), np.uint64, total)
    gram = min(GRAM, window)
    grams = np.zeros(total - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least = window_keys(grams, window - gram + 1, level)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[text])
    if not len(at):
        return
    first = np.ones(len(at), bool)
    first[1:] = (text[at][1:] != text[at][:-1]) | (least[at][1:] != least[at][:-1])
    place = np.arange(len(at))
    first |= (place - np.maximum.accumulate(np.where(first, place, 0))) % (1 if level and level == last_level(window) else LONGEST_RUN) == 0
    heads = np.flatnonzero(first)
    lengths = np.diff(np.append(heads, len(at)))
    heads = at[heads]
    begin = (ends - sizes)[text[heads]]
    digest, current = xxhash.xxh64_intdigest, -1
    for row, start, n, minimizer in zip(text[heads].tolist(), (heads - begin).tolist(), lengths.tolist(), least[heads].tolist(), strict=True):
        if row != current:
            current, joined = row, b" ".join(words[row])
            stops = np.cumsum([len(w) + 1 for w in words[row]]).tolist()
        a, b = (stops[start - 1] if start else 0), stops[start + n + window - 2] - 1
        yield row, start, n, minimizer, digest(joined[a:b], 1)


def runs(rows: DataFrame, window: int) -> DataFrame:
    """``m, r, doc_id, t, start, n`` of every run in ``rows (doc_id, t, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            for group in in_groups(raw_texts(batch.column(2))):
                found = list(runs_of(group, window))
                columns = list(zip(*found, strict=True)) or [()] * 5
                take = pa.array(np.array(columns[0], np.int64) + before)
                before += len(group)
                hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (columns[3], columns[4])]
                own = [pa.array(np.array(c, np.int32)) for c in (columns[1], columns[2])]
                yield pa.RecordBatch.from_arrays([*hashes, batch.column(0).take(take), batch.column(1).take(take), *own], ["m", "r", "doc_id", "t", "start", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.where("doc_id is not null").mapInArrow(run, f"m long, r long, doc_id {kind}, t long, start int, n int")


class WaveletMatrix:
    """Ranks of symbols in a sequence; one bit for each level and place, counts every 64 places."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        node = np.zeros(symbols, np.int64)
        symbol = np.arange(symbols)
        for level in reversed(range(max(1, int(symbols - 1).bit_length()))):
            bit = sequence >> level & 1
            packed = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            packed[: len(bit)] = bit
            words = np.packbits(packed, bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((level, words, ones, len(bit) - int(bit.sum())))
            node = self.step(self.levels[-1], symbol, node)
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.node = node

    @staticmethod
    def step(level: tuple[int, np.ndarray, np.ndarray, int], symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        shift, words, ones, zeros = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        before = ones[word] + np.bitwise_count(words[word] & mask)
        return np.where(symbol >> shift & 1, zeros + before, at - before)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place beside it."""
        for level in self.levels:
            at = self.step(level, symbol, at)
        return at - self.node[symbol]


class FMIndex:
    """Of some sequences of symbols over 0; 0 ends each. Rows are sorted by their first 64 symbols, which
    is enough for patterns up to that length."""

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, window: int = WINDOW) -> None:
        end = np.zeros(1, np.int64)
        text = np.concatenate([x for s in sequences for x in (s, end)])
        self.size, symbols = len(text), int(text.max()) + 1
        prefix, ranks, width = {1: text}, text, 1
        while width < window:
            ranks = np.unique(ranks * (self.size + symbols) + self.ahead(ranks, width), return_inverse=True)[1] + 1
            width *= 2
            prefix[width] = ranks
        rows = np.argsort(ranks, kind="stable")
        self.window = window
        self.wavelet = WaveletMatrix(text[rows - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        row_owner = np.repeat(owner, [len(s) + 1 for s in sequences])[rows]
        heads = self.heads(prefix, rows, window)
        group = np.cumsum(heads) - 1
        self.least = np.minimum.reduceat(row_owner, np.flatnonzero(heads))[group]
        heads = self.heads(prefix, rows, window - 1)
        starts = np.flatnonzero(heads)
        group = np.cumsum(heads) - 1
        self.low, self.high = starts[group], np.append(starts[1:], self.size)[group]

    @staticmethod
    def ahead(ranks: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(ranks)
        out[: len(ranks) - by] = ranks[by:]
        return out

    def heads(self, prefix: dict[int, np.ndarray], rows: np.ndarray, length: int) -> np.ndarray:
        """Whether a row differs from the one above in its first ``length`` symbols."""
        out = np.ones(len(rows), bool)
        if length:
            half = max(w for w in prefix if w <= length)
            a, b = prefix[half][rows], self.ahead(prefix[half], length - half)[rows]
            out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        first = self.before[symbol]
        return first + both[: len(symbol)], first + both[len(symbol) :]

    def least_owner(self, streams: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of each stream the least owner of its occurrences; every stream is indexed itself."""
        order = sorted(range(len(streams)), key=lambda i: -len(streams[i]))
        sizes = np.array([len(streams[i]) for i in order], np.int64)
        ends = np.cumsum(sizes)
        joined = np.concatenate([streams[i] for i in order])
        out = np.zeros(len(joined), np.int64)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))
            low, high = low[:live], high[:live]
            at = ends[:live] - 1 - step
            if step >= self.window - 1:
                low, high = self.low[low], self.high[low]
            low, high = self.extend(joined[at], low, high)
            if step >= self.window - 1:
                out[at] = self.least[low]
        answers: list[np.ndarray] = [out] * len(order)
        for i, stop, size in zip(order, ends.tolist(), sizes.tolist(), strict=True):
            answers[i] = out[stop - size : stop - self.window + 1]
        return answers


def shard_intervals(regions: list[tuple[bytes, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(region, first window, windows, least owner) for runs of windows that share their least owner."""
    symbols: dict[bytes, int] = {}
    streams = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in text.split()], np.int64) for text, _ in regions]
    least = FMIndex(streams, np.array([o for _, o in regions], np.int64), window).least_owner(streams)
    out = []
    for i, own in enumerate(least):
        heads = np.flatnonzero(np.append(len(own) > 0, own[1:] != own[:-1]))
        for start, n in zip(heads.tolist(), np.diff(np.append(heads, len(own))).tolist(), strict=True):
            out.append((i, start, n, int(own[start])))
    return out


def _region_texts(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """``m, r, owner, last, words`` of the regions in ``wanted (m, r, owner, last, crowded, doc_id, t, start, n)``."""
    key = ["doc_id", "t"]
    lists = wanted.groupBy(*key).agg(F.collect_list(F.struct("m", "r", "owner", "last", "crowded", "start", "n")).alias("wanted"))
    texts = marked(rows, wanted.select("doc_id").distinct(), "marked").where("marked").select(*key, "text").dropDuplicates(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, regions in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                for x in regions:
                    cut = b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1])
                    out.append((x["m"], x["r"], x["owner"], x["last"], x["crowded"], cut))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["m", "r", "owner", "last", "crowded", "words"])

    joined = texts.join(lists, key).select("text", "wanted")
    return joined.mapInArrow(run, "m long, r long, owner long, last long, crowded boolean, words binary")


INTERVALS = "m long, r long, first int, windows int, least long"


def _indexed(regions: DataFrame, window: int, block_words: int) -> DataFrame:
    """``INTERVALS`` from one FM-index for each block of a shard. Regions come sorted by minimizer, a block ends
    with the last region of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, int, int, bytes]] = []
        words = 0

        def found() -> pa.RecordBatch:
            rows = [(block[i][0], block[i][1], a, n, least) for i, a, n, least in shard_intervals([(x[4], x[2]) for x in block], window) if least < block[i][3]]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["m", "r", "first", "windows", "least"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words >= block_words and row[0] != block[-1][0]:
                    yield found()
                    block, words = [], 0
                block.append(row)
                words += row[4].count(b" ") + 1
        if block:
            yield found()

    columns = regions.select("m", "r", "owner", "last", "words")
    return columns.repartition("m").sortWithinPartitions("m", "r").mapInArrow(run, INTERVALS)


def _shared(regions: DataFrame, window: int, block_words: int) -> DataFrame:
    """``m, crowded`` of the keys that more than one id has, from ``regions (m, r, owner, last, n)``."""
    keys = regions.groupBy("m").agg(F.min("owner").alias("low"), F.max("last").alias("high"), F.sum(F.col("n") + (window - 1)).alias("size"))
    return keys.where("low < high").select("m", (F.col("size") > block_words).alias("crowded"))


def _narrowed(regions: DataFrame, window: int, level: int) -> DataFrame:
    """``up_m, up_r, owner, last, m, r, start, n, words``: the regions cut anew by the keys of this level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = 0
            # A level's keys look at every gram of every window, so groups are smaller here.
            for group in in_groups(raw_texts(batch.column(4)), 1 << 17):
                found = list(runs_of(group, window, level))
                columns = list(zip(*found, strict=True)) or [()] * 5
                words = [t.split() for t in group]
                cut = [b" ".join(words[row][start : start + n + window - 1]) for row, start, n, _, _ in found]
                take = pa.array(np.array(columns[0], np.int64) + before)
                before += len(group)
                hashes = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (columns[3], columns[4])]
                own = [pa.array(np.array(c, np.int32)) for c in (columns[1], columns[2])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(4)), *hashes, *own, pa.array(cut, pa.binary())], ["up_m", "up_r", "owner", "last", "m", "r", "start", "n", "words"])

    schema = "up_m long, up_r long, owner long, last long, m long, r long, start int, n int, words binary"
    return regions.select("m", "r", "owner", "last", "words").mapInArrow(run, schema)


def _lists(intervals: DataFrame) -> DataFrame:
    """``m, r, spans``: one row for each region; it has at most ``LONGEST_RUN`` windows, and each is in one interval."""
    return intervals.groupBy("m", "r").agg(F.collect_list(F.struct("first", "windows", "least")).alias("spans"))


def _intervals(regions: DataFrame, window: int, block_words: int, level: int = 0) -> DataFrame:
    """``INTERVALS`` of ``regions (m, r, owner, last, crowded, words)``; those of crowded keys through longer keys."""
    found = _indexed(regions.where("not crowded"), window, block_words)
    crowded = regions.where("crowded")
    if crowded.isEmpty():
        return found
    level += 1
    parts = written(_narrowed(crowded, window, level), "parts")
    shared = _shared(parts.groupBy("m", "r").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.min("n").alias("n")), window, block_words)
    if level == last_level(window):
        shared = shared.withColumn("crowded", F.lit(False))
    least = [F.min("owner").alias("owner"), F.max("last").alias("last"), F.first("crowded").alias("crowded"), F.first("words").alias("words")]
    narrower = written(parts.join(shared, "m").groupBy("m", "r").agg(*least), "narrower")
    inner = parts.select("m", "r", "up_m", "up_r", "last", "start").join(_lists(_intervals(narrower, window, block_words, level)), ["m", "r"])
    inner = inner.select(F.col("up_m").alias("m"), F.col("up_r").alias("r"), "last", "start", F.explode("spans").alias("span")).where("span.least < last")
    return found.unionByName(inner.select("m", "r", (F.col("start") + F.col("span.first")).alias("first"), "span.windows", "span.least"))


def _kept(rows: DataFrame, removed: Column) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of ``rows (doc_id, text)`` without the words in ``removed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                at, kept = 0, []
                for a, b in sorted((x["a"], x["b"]) for x in spans or ()):
                    kept += words[at : max(a, at)]
                    at = max(at, b)
                kept = kept + words[at:] if spans else words
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.string()], strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", removed.cast("array<struct<a:int,b:int>>").alias("removed")).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def repeated_intervals(rows: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, t, removed``: words a to b (exclusive) of a text, for each (a, b) in a list, are covered by windows
    that a smaller id has too. A region gives one list, whatever number of intervals it has.
    ``rows`` has ``doc_id`` (integer), ``t`` (a hash that tells texts of one id apart) and ``text``."""
    every = written(runs(rows, window), "runs")
    place = F.struct("doc_id", "t", "start", "n")
    regions = every.groupBy("m", "r").agg(F.min(place).alias("place"), F.max("doc_id").alias("last"))
    shared = _shared(regions.select("m", "r", "last", F.col("place.doc_id").alias("owner"), F.col("place.n").alias("n")), window, block_words)
    wanted = regions.join(shared, "m").select("m", "r", "last", "crowded", F.col("place.doc_id").alias("owner"), "place.*")
    texts = written(_region_texts(rows, written(wanted, "regions"), window), "region-texts")
    intervals = _intervals(texts, window, block_words)
    found = every.join(_lists(intervals), ["m", "r"]).withColumn("spans", F.filter("spans", lambda x: x["least"] < F.col("doc_id"))).where(F.size("spans") > 0)
    place = F.col("start")
    ends = lambda x: F.struct((place + x["first"]).alias("a"), (place + x["first"] + x["windows"] + (window - 1)).alias("b"))
    return found.select("doc_id", "t", F.transform("spans", ends).alias("removed"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row: without the words of windows that a smaller id has too.

    Windows are judged on the input. Null and empty texts have no words. A text without an id keeps all its
    words and takes none from others. Rows that repeat an id take none from each other; their texts are
    told apart. An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = rows.select("doc_id", "t", "text")
    spans = written(repeated_intervals(rows, window, block_words), "repeats")
    lists = spans.groupBy("doc_id", "t").agg(F.flatten(F.collect_set("removed")).alias("removed"))
    both = marked(rows, spans.select("doc_id").distinct(), "marked")
    touched = both.where("marked").join(lists, ["doc_id", "t"], "left")
    return _kept(touched, F.col("removed")).unionByName(_kept(both.where("not marked"), F.lit(None)))
