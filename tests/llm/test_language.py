import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from liftpanel.llm.ecoc_language import FEATURES, codewords, fit, fit_rows, has_letter, identify, ngram_shares
from tests.conftest import SMALL
from tests.llm.cases import bears_odd_tables, prose


@pytest.mark.parametrize("classes", [1, 2, 3, 4, 6, 7, 9, 40])
def test_codewords_differ(classes):
    code = codewords(classes)
    assert code.shape[0] == classes and set(np.unique(code)) <= {-1.0, 1.0}
    distance = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
    assert not distance or min(distance) >= (2 ** (classes - 2) if classes <= 7 else code.shape[1] // 4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    from liftpanel.llm.common import held_out

    wrong = docs.withColumn("lang", F.when(held_out(F.col("doc_id"), 4, 2), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, identify(docs).collect())) == sorted(map(tuple, identify(wrong).collect()))


def test_sample_is_bounded_and_bits_can_err(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30, lang), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 60)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), rows_each=25)
    texts = [prose(rng, 30, lang) for lang in model.languages for _ in range(10)]
    want = [lang for lang in model.languages for _ in range(10)]
    assert list(model.predict([t.encode() for t in texts]).lang_pred) == want
    model.weights[:, 0] *= -1  # one classifier always wrong: the code corrects it
    assert list(model.predict([t.encode() for t in texts]).lang_pred) == want


def test_letterless_is_unknown(spark):
    assert [has_letter(t.encode()) for t in ["", " 12%", "1a", "é", "日", "²½"]] == [False, False, True, True, True, False]
    rows = [(1, "some words here", "en"), (2, "und noch mehr", "de"), (3, "1 2 3", "en"), (4, None, "en"), (5, "", None)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and all(got[i]["rejected"] for i in (3, 4, 5))


def test_mixed_and_foreign_texts_are_rejected_and_clean_ones_kept(spark):
    """Held-out texts, halves of two languages in one text, and letters of no learned language."""
    from liftpanel.llm.common import held_out

    docs = spark.read.parquet(f"{SMALL[:-5]}0.01/documents.parquet").where("n_chars > 600")
    model = fit(docs, ~held_out(F.col("doc_id"), 4, 2), rows_each=80)
    out = docs.where(held_out(F.col("doc_id"), 4, 2)).orderBy("doc_id").toPandas()
    rejected = lambda texts: model.predict([t.encode() for t in texts]).rejected.mean()
    assert rejected(out.text) <= 0.02
    own = {lang: [t[:1500] for t in part.text] for lang, part in out.groupby("lang")}
    for a, b in [("en", "fr"), ("de", "es"), ("en", "de")]:
        assert rejected([x[:700] + " " + y[:700] for x, y in zip(own[a], own[b], strict=False)]) > 0.8, (a, b)
    rng = random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрст", "日本語中文字漢学校生"):
        words = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))  # noqa: B023, E731
        assert rejected([words(150) for _ in range(40)]) > 0.9, letters
        assert rejected([words(15) for _ in range(40)]) > 0.5, letters


def test_odd_tables(spark):
    want = bears_odd_tables(spark, identify)
    assert len(want) == 35


def plain_sample(rows, rows_each):
    def order(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        return (h - (1 << 64) if h >> 63 else h, i)

    langs = {lang for _, lang, text in rows if lang and text is not None and has_letter(text.encode())}
    return sorted((x, i) for x in langs for _, i in sorted((order(i), i) for i, lang, text in rows if lang == x and text is not None)[:rows_each])


def test_sample_and_decoding_against_plain_python(spark):
    """Which rows are learned from, and the votes and losses of the codewords, worked out one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rows = [tuple(r) for r in docs.collect()]
    texts = {i: t for i, _, t in rows}
    model = fit(docs, F.lit(True), rows_each=20)
    chosen = plain_sample(rows, 20)
    want = fit_rows(np.vstack([ngram_shares([texts[i].encode()]) for _, i in chosen]), [lang for lang, _ in chosen])
    assert model.languages == want.languages and np.array_equal(model.weights, want.weights) and model.margin == want.margin
    some = [t.encode() for t in list(texts.values())[:40] if t]
    for text, row in zip(some, model.predict(some).itertuples(), strict=True):
        votes = (ngram_shares([text])[0] - model.centre) @ model.weights
        losses = [sum(w * np.exp(-v * c) for w, v, c in zip(model.bit_weight, votes, word, strict=True)) for word in model.code]
        assert row.lang_pred == model.languages[int(np.argmin(losses))]
        assert row.margin == pytest.approx(sorted(losses)[1] - sorted(losses)[0], abs=1e-5)


def test_more_rows_than_features_solve_the_smaller_system():
    rng = np.random.default_rng(1)
    shares = rng.random((60, 40)).astype(np.float32)
    langs = ["a", "b", "c"] * 20
    small = fit_rows(shares, langs)
    centre = shares.mean(0)
    bits = small.code[[small.languages.index(x) for x in langs]]
    x = (shares - centre).astype(float)
    assert np.allclose(small.weights, x.T @ np.linalg.solve(x @ x.T + 0.02 * np.eye(60), bits), atol=1e-4)


def test_fit_holds_the_sample_once_and_solves_the_same_systems():
    rng = np.random.default_rng(2)
    for n, features in ((1600, FEATURES), (600, 256)):
        langs = [("de", "en", "es", "fr")[i % 4] for i in range(n)]
        shares = (rng.random((n, features), np.float32) ** 8 + np.array([x == "en" for x in langs])[:, None] * rng.random(features) / 9).astype(np.float32)
        tracemalloc.start()
        model = fit_rows(shares, langs)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # One copy of the sample in double precision is twice its size. With more rows than features it is the system that counts.
        assert n > features or peak < 2 * shares.nbytes
        x = (shares - shares.mean(0)).astype(float)
        bits = model.code[[model.languages.index(y) for y in langs]]
        direct = np.linalg.solve(x.T @ x + 0.02 * np.eye(features), x.T @ bits) if features < n else x.T @ np.linalg.solve(x @ x.T + 0.02 * np.eye(n), bits)
        assert np.allclose(model.weights, direct, atol=1e-4 * np.abs(direct).max())
