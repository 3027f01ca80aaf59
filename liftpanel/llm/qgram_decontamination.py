"""Benchmark decontamination by the q-gram lemma.

Text and items are folded: letters of ASCII and Latin-1 in lower case, ASCII punctuation and white space out.
An item is cut into overlapping segments, long ones that bear some edits and, more densely, short ones: a passage
of at least ``SURE`` folded bytes from anywhere in an item holds a whole short segment. Every ``STEP``-th q-gram of a
text is looked up among all q-grams of the items. If a part of a text equals a segment of n bytes up to k edits, at least
``(n - k - Q + 1) // STEP`` of the text's q-grams lie inside that part, an edit spoils ``Q / STEP`` of them at
most, and the others lie on k + 1 neighbouring diagonals. So shared q-grams are counted in overlapping bands of
diagonals, bands below the bound are dropped, and a banded alignment verifies the rest. No leak within the edit
budget is lost before the alignment. Items under ``LEAST`` folded bytes are searched as they are, between bounds of words.

The benchmark is the query side: it goes to the tasks in blocks of about ``block_bytes`` of items, each block
against every whole text. An index has 12 bytes for each byte of its items, and 1 MB.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.common import in_groups, written

Q, STEP, BAND, LEAST = 12, 4, 16, 24
SEGMENT, STRIDE, EDIT_SHARE, LEAST_BOUND = 80, 40, 1 / 16, 3
SHORT_SEGMENT, SHORT_STRIDE = 48, 16
#: An exact passage of this many folded bytes is found wherever it begins in its item.
SURE = SHORT_SEGMENT + SHORT_STRIDE - 1
SLOTS = 20
LEAK = "item_id: long, leak_start: int, leak_end: int, segments: int, edits: int"

DROPPED = string.punctuation.encode() + bytes([9, 10, 11, 12, 13, 32])
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Upper-case letters of Latin-1 in UTF-8; the lower-case one has its second byte 32 higher.
LATIN_UPPER = re.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
IS_DROPPED = np.isin(np.arange(256), np.frombuffer(DROPPED, np.uint8))
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def fold(text: bytes) -> bytes:
    return LATIN_UPPER.sub(lambda m: bytes([0xC3, m[0][1] + 32]), text.translate(LOWER, DROPPED))


def folded_places(text: bytes) -> np.ndarray:
    """For each byte of ``fold(text)`` its place in ``text``."""
    return np.flatnonzero(~IS_DROPPED[np.frombuffer(text, np.uint8)])


def stepped(folded: bytes) -> np.ndarray:
    """A hash modulo 2^64 of the q-grams that begin at multiples of ``STEP``."""
    words = np.frombuffer(folded[: len(folded) // STEP * STEP], "<u4").astype(np.uint64)
    n = max(0, len(words) - 2)
    return words[:n] * FACTORS[0] + words[1 : n + 1] * FACTORS[1] + words[2:] * FACTORS[2]


def all_grams(folded: bytes) -> np.ndarray:
    out = np.zeros(max(0, len(folded) - Q + 1), np.uint64)
    for shift in range(min(STEP, len(out))):
        out[shift::STEP] = stepped(folded[shift:])
    return out


def bound(length: int, edits: int) -> int:
    """Q-grams that a text must share with a segment of this length if it differs by so many edits."""
    return (length - edits - Q + 1) // STEP - Q // STEP * edits


def budget(length: int) -> int:
    """Edits allowed in a segment: a share of its length, as long as the bound stays at ``LEAST_BOUND``."""
    return max([0, *(k for k in range(int(length * EDIT_SHARE) + 1) if bound(length, k) >= LEAST_BOUND)])


def powers(n: int, base: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class ShortItems:
    """Items under ``LEAST`` folded bytes. Parts of a text between bounds of words are told by a sum of bytes times
    powers modulo 2^64, then by their bytes."""

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.owners: dict[bytes, list[int]] = {}
        for item, text in items:
            self.owners.setdefault(text, []).append(item)
        self.hashes = {n: np.sort([self.hashed(t) for t in self.owners if len(t) == n]) for n in sorted({len(t) for t in self.owners})}

    def hashed(self, text: bytes) -> np.uint64:
        return (np.frombuffer(text, np.uint8).astype(np.uint64) * powers(len(text), self.FACTOR)).sum(dtype=np.uint64)

    def found(self, folded: bytes, places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, 0) in the folded text; ``places`` are those of its bytes in the text."""
        if not self.owners or not folded:
            return []
        size = len(folded)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(np.frombuffer(folded, np.uint8).astype(np.uint64) * powers(size, self.FACTOR), out=sums[1:])
        back = powers(size, pow(self.FACTOR, -1, 1 << 64))
        bound = np.ones(size + 1, bool)
        bound[1:-1] = np.diff(places) > 1
        starts, out = np.flatnonzero(bound[:-1]), []
        for n, hashes in self.hashes.items():
            at = starts[starts <= size - n]
            at = at[bound[at + n]]
            at = at[np.isin((sums[at + n] - sums[at]) * back[at], hashes)]
            out += [(item, a, a + n, 0) for a in at.tolist() for item in self.owners.get(folded[a : a + n], ())]
        return out


class Index:
    """Q-grams of some benchmark items, sorted by hash, and the segments of the items.

    A q-gram is kept once, with its place; the segments that it lies in follow from the place."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        long = [(item, text) for item, text in items if len(text) >= LEAST]
        self.short = ShortItems([(item, text) for item, text in items if 0 < len(text) < LEAST])
        self.text = b"".join(text for _, text in long)
        self.sizes = np.array([len(text) for _, text in long], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        hashes = np.concatenate([all_grams(text) for _, text in long] or [np.zeros(0, np.uint64)])
        places = np.concatenate([np.arange(start, start + len(text) - Q + 1, dtype=np.int32) for start, (_, text) in zip(self.starts.tolist(), long, strict=True)] or [np.zeros(0, np.int32)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place = hashes[order], places[order]
        # Of each kind: length, stride, segments of each item and the number of its first one.
        self.kinds: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        owner, begin, length, before = [], [], [], 0
        for size, stride, least in ((SEGMENT, STRIDE, LEAST), (SHORT_SEGMENT, SHORT_STRIDE, SHORT_SEGMENT + 1)):
            last = np.maximum(0, self.sizes - size)
            n = np.where(self.sizes >= least, -(-last // stride) + 1, 0)
            item = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            self.kinds.append((size, stride, n, before + np.cumsum(n) - n))
            owner.append(item)
            begin.append(np.minimum(within * stride, last[item]))
            length.append(np.minimum(size, self.sizes[item]))
            before += len(item)
        ids = np.array([item for item, _ in long], np.int64)
        self.item, self.begin, self.length = np.concatenate(owner), np.concatenate(begin), np.concatenate(length)
        self.owner = ids[self.item].tolist()
        budgets = np.array([budget(n) for n in range(SEGMENT + 1)], np.int64)
        self.edits = budgets[self.length]
        self.bound = np.array([bound(n, int(k)) for n, k in enumerate(budgets)], np.int64)[self.length]
        self.table = np.zeros(1 << SLOTS, bool)
        self.table[self.hashes >> np.uint64(64 - SLOTS)] = True

    def segment(self, number: int) -> bytes:
        start = int(self.starts[self.item[number]] + self.begin[number])
        return self.text[start : start + int(self.length[number])]

    @property
    def segments(self) -> list[bytes]:
        return [self.segment(i) for i in range(len(self.item))]

    def segments_at(self, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, segment): the segments that hold the q-gram at a place of an item."""
        rows, numbers = [], []
        for size, stride, n, first in self.kinds:
            many, before = n[item], first[item]
            low = np.maximum(0, -((size - Q - place) // stride))
            count = np.maximum(0, np.minimum(place // stride, many - 2) - low + 1)
            row = np.repeat(np.arange(len(item)), count)
            rows.append(row)
            numbers.append((before + low)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
            # The last segment of an item ends with it, whatever the stride.
            row = np.flatnonzero((many > 0) & (place >= self.sizes[item] - size))
            rows.append(row)
            numbers.append((before + many - 1)[row])
        return np.concatenate(rows), np.concatenate(numbers)

    def bands(self, folded: bytes) -> list[tuple[int, int]]:
        """(segment, first diagonal) of each band that meets its bound."""
        hashes = stepped(folded)
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - SLOTS)])
        if not len(self.bound) or len(at) < self.bound.min():
            return []
        low, high = np.searchsorted(self.hashes, hashes[at], "left"), np.searchsorted(self.hashes, hashes[at], "right")
        n = high - low
        total = int(n.sum())
        if total < self.bound.min():
            return []
        place = self.place[np.repeat(low - np.cumsum(n) + n, n) + np.arange(total)].astype(np.int64)
        item = np.searchsorted(self.starts, place, "right") - 1
        row, segment = self.segments_at(item, place - self.starts[item])
        # A diagonal is at least -SEGMENT; shifted, bands are whole numbers.
        diagonal = (np.repeat(at * STEP, n) - place + self.starts[item])[row] + self.begin[segment] + SEGMENT
        band = diagonal // BAND
        both = diagonal % BAND < self.edits[segment]
        keys = np.concatenate([segment, segment[both]]) * (1 << 40) + np.concatenate([band, band[both] - 1]) + 1
        keys, counts = np.unique(keys, return_counts=True)
        segment = keys >> 40
        good = counts >= self.bound[segment]
        return [(int(s), int((k & ((1 << 40) - 1)) - 1) * BAND - SEGMENT) for s, k in zip(segment[good], keys[good], strict=True)]

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item, start, end, segments, most edits) of the regions that hold segments of an item;
        places are code points. Segments of one item that touch or nearly touch are one region.

        The folded texts are searched as one, parted by gaps that are longer than any segment."""
        gap = bytes(2 * SEGMENT)
        folded = [fold(t) for t in texts]
        starts = np.cumsum([0, *(len(f) + len(gap) for f in folded)])
        joined = gap.join(folded)
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        of_text: dict[int, list[tuple[int, int, int, int]]] = {}
        for item, start, end, edits in self.verified(joined, self.bands(joined)):
            row = int(np.searchsorted(starts, start, "right")) - 1
            start, end = start - int(starts[row]), min(end - int(starts[row]), len(folded[row]))
            if start < end:
                of_text.setdefault(row, []).append((item, start, end, edits))
        for row, text in enumerate(folded) if self.short.owners else ():
            found = self.short.found(text, folded_places(texts[row]))
            if found:
                of_text.setdefault(row, []).extend(found)
        for row, found in of_text.items():
            places = folded_places(texts[row])
            points = np.cumsum((np.frombuffer(texts[row], np.uint8) & 0xC0) != 0x80)
            regions: list[list[int]] = []
            for item, start, end, edits in sorted(found):
                last = regions[-1] if regions else None
                if last and last[0] == item and start <= last[2] + STRIDE:
                    last[2], last[3], last[4] = max(last[2], end), last[3] + 1, max(last[4], edits)
                else:
                    regions.append([item, start, end, 1, edits])
            out[row] = [(item, int(points[places[a]]) - 1, int(points[places[b - 1]]), n, e) for item, a, b, n, e in regions]
        return out

    def verified(self, folded: bytes, bands: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in the folded text, once for each segment and place."""
        best: set[tuple[int, int, int, int, int]] = set()
        rest = []
        for segment, first in bands:
            pattern = self.segment(segment)
            at = folded.find(pattern, max(0, first), max(0, first) + BAND + int(self.edits[segment]) + len(pattern))
            if at >= 0:
                best.add((segment, self.owner[segment], at, at + len(pattern), 0))
            else:
                rest.append((segment, first))
        for (segment, _), (edits, start, end) in zip(rest, self.align(folded, rest), strict=True):
            if edits <= self.edits[segment] and end > start:
                best.add((segment, self.owner[segment], start, end, edits))
        return [x[1:] for x in sorted(best)]

    def align(self, folded: bytes, rest: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Least edits, start and end of each segment within its band of diagonals, all candidates row by row at once."""
        if not rest:
            return []
        size = self.length[[s for s, _ in rest]]
        first = np.array([f for _, f in rest])
        width = BAND + int(self.edits.max()) + 1
        rows = int(size.max())
        pattern = np.zeros((len(rest), rows), np.int16)
        for i, (s, _) in enumerate(rest):
            pattern[i, : size[i]] = np.frombuffer(self.segment(s), np.uint8)
        at = first[:, None] + np.arange(rows + width)
        inside = (at >= 0) & (at < len(folded))
        text = np.where(inside, np.frombuffer(folded, np.uint8)[np.clip(at, 0, max(0, len(folded) - 1))].astype(np.int16), -1)
        edit, far = 1 << 16, 1 << 40
        column = np.arange(width)
        start = first[:, None] + column
        cost = np.where((start >= 0) & (start <= len(folded)), column, far)
        for row in range(rows):
            new = cost + (pattern[:, row, None] != text[:, row : row + width]) * edit
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + edit)
            new = np.minimum.accumulate(new - column * edit, axis=1) + column * edit
            cost = np.where((row < size)[:, None], new, cost)
        end = cost.argmin(1)
        least = cost[np.arange(len(rest)), end]
        ends = np.minimum(first + size + end, len(folded))
        return [(int(c >> 16), int(f + (c & (edit - 1))), int(e)) for c, f, e in zip(least, first, ends, strict=True)]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = 8 << 20) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes``; rows without text and items of nothing but
    punctuation and white space are no queries. A repeated row counts once."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        yield Index(sorted({(-1 if r["item_id"] is None else r["item_id"], fold(r["text"].encode())) for r in own}))


def leaks(text: Column, index: Index) -> Column:
    """Array of the leaks in a text; empty for null, for an empty text and for an empty benchmark."""

    names = [x.split(":")[0] for x in LEAK.split(", ")]

    @F.pandas_udf(f"array<struct<{LEAK}>>")
    def find(texts: pd.Series) -> pd.Series:
        groups = in_groups(t.encode() if t else b"" for t in texts)
        found = [leaks for group in groups for leaks in index.leaks(group)]
        return pd.Series([[dict(zip(names, x, strict=True)) for x in leaks] for leaks in found], dtype=object)

    return find(text.cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, leak_start, leak_end, segments, edits``: regions of a text that hold a benchmark passage.

    ``segments`` counts the item's segments found there, ``edits`` is the most edits that one of them needed.
    An exact passage of ``SURE`` folded bytes or more is found wherever it begins in its item, an edited one where a
    segment is within its budget; of an item under ``LEAST`` folded bytes every occurrence between bounds of words.
    The result for a block of the benchmark is written before the next block is indexed.
    An item without an id is reported as -1. Repeated rows of a text are reported each; an empty table on either
    side gives an empty result; further columns are not read.
    """
    out = None
    for index in indexes(benchmark):
        if out is not None:
            out = written(out, "leaks")
        part = docs.select(F.col(id_col).alias("doc_id"), F.explode(leaks(F.col(text_col), index)).alias("leak")).select("doc_id", "leak.*")
        out = part if out is None else out.unionByName(part)
    return out
