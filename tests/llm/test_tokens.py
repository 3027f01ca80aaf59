from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from liftpanel.llm.offset_tokens import PARTS, ByteTokens, count_tokens
from tests.llm.cases import bears_odd_tables, odd

FILE = path("byte_bpe_50k.json")


def memory(known=[]):  # noqa: B006
    if not known:
        known.append(ByteTokens(Tokenizer.from_file(FILE)))
    return known[0]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text("ab É \n\t'.!9 \x1c🙂", max_size=50)))
def test_bounds_are_those_of_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    tokens = memory().tokenizer.encode(text, add_special_tokens=False).tokens
    assert [int(b) for b in memory().bounds(text.encode())[1:]] == [sum(map(len, tokens[: i + 1])) for i in range(len(tokens))]


def test_lines_sum_to_whole(spark):
    got = count_tokens(odd(spark).where("doc_id is not null"), FILE).groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.sum("share").alias("s")).collect()
    tokenizer, times = Tokenizer.from_file(FILE), {}
    tokenizer.encode_special_tokens = True
    for doc_id, text, *_ in odd(spark).where("doc_id is not null").collect():
        times[doc_id] = times.get(doc_id, 0) + len(tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n"] for r in got} == times
    assert all(abs(r["s"] - r["n"]) < 1e-6 for r in got)


def test_tokens_that_cross_a_boundary(spark):
    text = "the question 🙂 é"
    parts = [("all", 0, None), ("a", 0, 7), ("b", 7, 13), ("smile", 13, 14), ("rest", 14, 99), ("none", 5, 5), ("over", 2, 9)]
    rows = spark.createDataFrame([(1, text, parts), (2, None, parts), (3, "x", None), (4, "x", [])], f"doc_id long, text string, parts {PARTS}")
    got = {(r["doc_id"], r["part"]): r for r in count_tokens(rows, FILE, parts_col="parts").collect()}
    tokenizer = Tokenizer.from_file(FILE)
    sizes = [len(t) for t in tokenizer.encode(text, add_special_tokens=False).tokens]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    for name, a, b in parts:
        a, b = len(text[:a].encode()), len(text[: len(text) if b is None else b].encode())
        inside = [i for i, s in enumerate(starts) if a <= s < b]
        row = got[1, name]
        assert row["tokens"] == len(inside)
        assert row["crossing"] == sum(starts[i] + sizes[i] > b for i in inside)
        held = sum(max(0, min(b, s + n) - max(a, s)) / n for s, n in zip(starts, sizes, strict=True))
        assert abs(row["share"] - held) < 1e-9
    assert got[2, "all"]["tokens"] == 0 and not [k for k in got if k[0] in (3, 4)]


def test_odd_tables(spark):
    bears_odd_tables(spark, lambda d: count_tokens(d, FILE))
