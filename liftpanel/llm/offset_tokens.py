"""Token counts of parts of documents.

A document is encoded once and whole, so a token never depends on where a part begins. The vocabulary is
byte-level: tokens cut the UTF-8 bytes of a text without gaps, and the length of each token is known from the
vocabulary. Parts (fields, sections) are intervals of code points; they are joined to the tokens' byte
intervals by binary search. The rule for tokens that cross a boundary: ``tokens`` counts a token for the part
that holds its first byte; ``share`` gives every part the share of the token's bytes that it holds.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftpanel.llm.bestfit_packing import MARKS, PLAIN, byte_letters
from liftpanel.llm.common import worker_state

REMEMBERED = 600_000
#: One blank and what follows it, or white space: this tokenizer cuts there in any case.
CHUNK = re.compile(rb" ?[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+(?![^\x20\x09-\x0d])|[\x20\x09-\x0d]+")
#: White space outside ASCII, and controls that some count as such: these texts are encoded in one piece.
OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
PARTS = "array<struct<part:string,start:int,end:int>>"


class ByteTokens(dict):
    """Byte lengths of the tokens of a chunk, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer) -> None:
        super().__init__()
        tokenizer.encode_special_tokens = True
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters = "".join(letter for _, letter in sorted(byte_letters().items()))
        self.sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())], "<u4")

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        word = chunk.rstrip(MARKS)
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text.removeprefix(" ").lower()):
            letters = word.decode("latin-1").translate(self.letters)
            sizes = np.array([len(t.value) for t in self.model.tokenize(letters)], "<u4").tobytes()
            sizes += self[chunk[len(word) :]] if len(word) < len(chunk) else b""
        else:
            sizes = self.encoded(chunk)
        self[chunk] = sizes
        return sizes

    def encoded(self, text: bytes) -> bytes:
        return self.sizes[self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids].tobytes()

    def bounds(self, text: bytes) -> np.ndarray:
        """Places in bytes where tokens begin, and the end of the text."""
        sizes = self.encoded(text) if OTHER_SPACE.search(text) else b"".join(map(self.__getitem__, CHUNK.findall(text)))
        return np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)])


def byte_tokens(path: str) -> ByteTokens:
    known = worker_state("tokens").setdefault("byte_tokens", {})
    if path not in known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known[path] = ByteTokens(Tokenizer.from_file(path))
    return known[path]


def line_parts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte intervals of the lines, each with its line feed; an empty text is one empty line."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    starts = np.concatenate([[0], breaks])
    ends = np.append(breaks, len(text))
    return (starts, ends) if len(starts) == 1 or starts[-1] < len(text) else (starts[:-1], ends[:-1])


def attribute(bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For byte intervals: tokens that begin inside, bytes shares of tokens, and tokens that begin inside and end outside."""
    first, last = np.searchsorted(bounds[:-1], starts), np.searchsorted(bounds[:-1], ends)
    tokens = np.maximum(last - first, 0)
    place = np.arange(len(bounds), dtype=float)
    share = np.interp(ends, bounds, place) - np.interp(starts, bounds, place) if len(bounds) > 1 else np.zeros(len(starts))
    crossing = (tokens > 0) & (bounds[np.minimum(last, len(bounds) - 1)] > ends)
    return tokens, share, crossing.astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """``doc_id, part, part_start, part_end, tokens, share, crossing`` for each part of each text.

    ``parts_col`` has ``PARTS``: names and intervals of code points, in any order, which may overlap or leave
    gaps; ends are cut to the text. Without it the parts are the lines, named by their number from 0. A null
    text is empty; it has one empty line. A row with null or no parts gives no rows. Repeated rows are counted
    each, an empty table gives an empty result, further columns are not read. ``tokenizer`` is the path of a
    byte-level tokenizer file that every executor can read.
    """
    parts = F.lit(None) if parts_col is None else F.col(parts_col)
    columns = ["doc_id", "part", "part_start", "part_end", "tokens", "share", "crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = byte_tokens(tokenizer)
        for batch in batches:
            rows, out = [], [[] for _ in columns[1:]]
            given = batch.column(2).to_pylist()
            for row, value in enumerate(batch.column(1).cast(pa.binary())):
                text = value.as_py() or b""
                points = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
                if parts_col is None:
                    starts, ends = line_parts(text)
                    names = [str(i) for i in range(len(starts))]
                else:
                    own = [x for x in given[row] or () if x is not None]
                    names = [x["part"] for x in own]
                    limit = len(points) - 1
                    starts = points[np.clip([x["start"] or 0 for x in own], 0, limit).astype(int)] if own else np.zeros(0, int)
                    ends = np.maximum(starts, points[np.clip([limit if x["end"] is None else x["end"] for x in own], 0, limit).astype(int)]) if own else starts
                counts = attribute(memory.bounds(text), starts, ends)
                rows += [row] * len(names)
                places = (np.searchsorted(points, starts), np.searchsorted(points, ends))
                for column, values in zip(out, (names, *(x.tolist() for x in (*places, *counts))), strict=True):
                    column += values
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], columns)

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), parts.cast(PARTS).alias("parts"))
    return narrow.mapInArrow(run, f"doc_id {kind}, part string, part_start int, part_end int, tokens long, share double, crossing long")
