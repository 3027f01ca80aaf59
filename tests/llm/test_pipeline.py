"""The pipeline against the same decisions taken one row at a time."""

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from liftpanel.llm.common import held_out
from liftpanel.llm.ecoc_language import fit
from liftpanel.llm.qgram_decontamination import Index, fold
from liftpanel.llm.oracles import ORACLES
from liftpanel.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.cases import SCHEMA, empty, odd, odd_rows, rows_of, with_clashes
from tests.llm.test_minhash_groups import plain_groups

STAGES = dict(corpus_pipeline.STAGES)


def kept_once(rows):
    """One row of each group: (id, text) pairs, by five-word shingles, Jaccard 0.8 and all pairs. Texts without a word are a group."""
    by_group, out = {}, []
    for row, group in zip(rows, plain_groups([t for _, t in rows]), strict=True):
        by_group.setdefault(group, []).append(row)
    for members in by_group.values():
        ids = [i for i, _ in members if i is not None]
        out.append((min(ids), next(t for i, t in members if i == min(ids))) if ids else members[0])
    return out


def test_whole_pipeline_against_plain_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    model = fit(docs, ~held_out(F.col("doc_id"), 4, 2))
    rejected = model.predict([(t or "").encode() for _, t in rows]).rejected
    rows = [r for r, bad in zip(rows, rejected, strict=True) if not bad]
    rows = kept_once(rows)
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    index = Index(sorted((r["item_id"], fold(r["text"].encode())) for r in items))
    rows = [(i, t) for i, t in rows if not index.leaks([t.encode()])[0]]
    last = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast(c).alias(n) for n, c in (("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    clean = dict(STAGES["secrets"](spark, last, SMALL).select("doc_id", "text").collect())
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = {}
    for i, text in clean.items():
        want[i] = len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert (own.length.cumsum() - own.length == own.offset).all() and own.length.sum() <= 2048
    # The data have something for each stage to do.
    assert len(want) < docs.count() and any("[secret]" in t for t in clean.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns_of_documents(spark, name):
    docs = odd(spark)
    out = STAGES[name](spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    clashing = STAGES[name](spark, with_clashes(docs), SMALL)
    assert clashing.columns == with_clashes(docs).columns
    assert rows_of(clashing.select(*docs.columns)) == rows_of(out)
    assert STAGES[name](spark, empty(spark), SMALL).count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows = [(i, t) for i, t, *_ in odd_rows()]
    got = STAGES["near_duplicates"](spark, odd(spark), SMALL).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(kept_once(rows), key=repr)


def test_ids_that_repeat_with_other_texts(spark):
    a, b = "one two three four five six", "eins zwei drei vier fuenf sechs"
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (None, a), (None, "nobody has this text"), (None, "nobody has this text")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = STAGES["near_duplicates"](spark, docs, SMALL).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, a), (1, b), (None, "nobody has this text")], key=repr)


def test_language_keeps_clean_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert STAGES["language"](spark, docs, SMALL).count() >= 0.995 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    got = STAGES["language"](spark, odd(spark), SMALL).select("doc_id").collect()
    assert not {102, 103, 104, 105} & {r["doc_id"] for r in got}


def test_secrets_are_gone_and_nothing_else(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefabcdefabcdef12 b", "en", "s", 30), (2, "plain", "en", "s", 5), (3, None, "en", "s", None)], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["secrets"](spark, docs, SMALL).collect()}
    assert got == {1: ("a [secret] b", 12), 2: ("plain", 5), 3: (None, None)}


def test_every_operator_has_a_query():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["liftpanel.llm.stages"] * 5
    assert np.array_equal([n for n, _ in corpus_pipeline.STAGES], ["language", "near_duplicates", "decontamination", "secrets", "packing"])
