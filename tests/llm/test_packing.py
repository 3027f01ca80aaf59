import bisect
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from liftpanel.llm.bestfit_packing import ChunkIds, pack, plan_slots
from tests.llm.cases import bears_odd_tables, odd

FILE = path("word_bpe_49k.json")
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(rooms, length)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40)))))
def test_plan_is_best_fit_decreasing(case):
    capacity, counts = case
    plan = plan_slots(counts, capacity)
    bins, placed = {}, {}
    for length, low, high, first, each, offset in plan:
        for rank in range(low, high):
            placed.setdefault(length, []).append(rank)
            bins.setdefault(first + (rank - low) // each, []).append((offset + (rank - low) % each * length, length))
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in counts.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit(counts, capacity)


def test_plan_does_not_grow_with_counts():
    small = plan_slots({n: 1000 + n for n in range(1, 2049)})
    large = plan_slots({n: (1000 + n) * 10**9 for n in range(1, 2049)})
    assert max(len(small), len(large)) < 6 * 2048


TEXTS = ["it's don't 'tis 'start !!'sa", "ÉCOLE É Straße, ΑΣ. x…y „a“ a b\x1cc d", "<|endoftext|> a<|startoftext|>b <|x", "", "\x00 \x0b áb Á... 12'34's can't!!!'ll"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.sampled_from(TEXTS), st.text("abcXYZÉéßñ'’., \n ́<|>09", max_size=60)))
def test_ids_of_chunks_are_those_of_the_text(text):
    text = text.encode("utf-8", "replace").decode()
    memory = worker()
    want = np.array(memory.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(memory.of([text.encode()])) == [want]


def worker(known=[]):  # noqa: B006
    if not known:
        known.append(ChunkIds(Tokenizer.from_file(FILE)))
    return known[0]


def test_pieces_and_sequences(spark):
    docs = odd(spark)
    got = pack(docs, FILE, capacity=64).toPandas()
    tokenizer, want = Tokenizer.from_file(FILE), []
    for doc_id, text, *_ in docs.collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for i, at in enumerate(range(0, len(ids), 64))]
    have = [tuple(None if x != x else int(x) for x in r) for r in got[COLUMNS].itertuples(index=False)]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all() and own.length.sum() <= 64
    assert got.sequence_id.nunique() == best_fit(got.length.value_counts().to_dict(), 64)


def test_special_tokens_are_told_by_case():
    memory = ChunkIds(Tokenizer.from_file(FILE))
    for text in ("<|ENDOFTEXT|> Two", "a <|endoftext|> B", "x<|endoftext|>Y", "<|EndOfText|>", "<|startoftext|>."):
        want = np.array(memory.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(memory.of([text.encode()])) == [want]


def test_odd_tables(spark):
    bears_odd_tables(spark, lambda d: pack(d, FILE, capacity=128).select(*COLUMNS))
