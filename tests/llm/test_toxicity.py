import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftpanel.llm.deobfuscated_toxicity import disguised, fit, fit_logistic, log_model, restore, score, trigram_counts, words_of
from tests.llm.cases import bears_odd_tables, odd, prose

BAD = ["grumbok", "snarvex", "plindost"]


@pytest.fixture(scope="module")
def table(spark):
    """Invented insults in a fifth of the texts; one in ten labels is missing."""
    rng, rows = random.Random(8), []
    for i in range(600):
        toxic = i % 5 == 0
        words = prose(rng, 40, rng.choice(["en", "de"])).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), None if i % 10 == 7 else int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


@pytest.fixture(scope="module")
def model(table):
    return fit(table, table.select("doc_id", "toxic"), F.lit(True))


def test_trigram_counts_grow_with_the_corpus(spark, table):
    once, twice = trigram_counts(table), trigram_counts(table.union(table))
    assert once.sum() > 0 and twice.sum() > 1.9 * once.sum()
    assert np.allclose(np.exp(log_model(once)).sum(-1), 1, atol=1e-4)


@pytest.mark.parametrize(("token", "word"), [("gr0mb0k", "grombok"), ("5narvex", "snarvex"), ("pl1nd0st", "plindost"), ("s.n.a.r.v.e.x", "snarvex"), ("grummmbok", "grumbok"), ("$n@rv3x!!", "snarvex")])
def test_restored_words(model, token, word):
    assert word in words_of(token, model.log_chance)


def test_best_path_against_all_paths(model):
    """The dynamic programme finds the least cost over every way through the lattice."""
    from liftpanel.llm.deobfuscated_toxicity import LEET, LEET_COST, LETTERS, PARTING, PARTING_COST, REPEAT_COST

    def paths(token):
        if not token:
            yield "", 0.0
            return
        n = len(token) - len(token.lstrip(token[0]))
        c, rest = token[0], token[n:]
        own = [(c, REPEAT_COST * (n > 1)), *([(c * 2, REPEAT_COST * (n > 2))] if n > 1 else [])] if c in LETTERS else []
        for x in LEET.get(c, ""):
            own += [(x, LEET_COST), *([(x * 2, LEET_COST)] if n > 1 else [])]
        if c in PARTING or not own:
            own.append(("", PARTING_COST))
        for out, cost in paths(rest):
            for x, extra in own:
                yield x + out, extra + cost

    def total(word, cost):
        symbols = [0, 0, *(LETTERS.index(c) + 1 for c in word), 0]
        return cost - sum(float(model.log_chance[a, b, c]) for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False))

    for token in ["1d10t", "s!!lly", "a.b-c", "gr00mm", "|x|", "0_0p", "th3_m4n"]:
        assert restore(token, model.log_chance) == min((round(total(w, c), 4), w) for w, c in paths(token))[1]


def test_plain_words_are_left_alone(model):
    assert not disguised("hello") and disguised("h3llo") and not disguised("1234") and disguised("heeello")
    assert words_of("hello,", model.log_chance) == ["hello"] and words_of("***", model.log_chance) == []


def test_held_out_scores(spark, table):
    got = score(table, table.select("doc_id", "toxic")).join(table.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.score.between(0, 1)).all()
    truth = got.doc_id % 5 == 0
    assert ((got.predicted == 1) == truth).mean() > 0.97


def test_disguised_insults_score_like_plain_ones(model):
    plain = "the er ing of grumbok and the snarvex st plindost er"
    hidden = ["the er ing of gr*umbok and the 5narv3x st pl!ndost er", "the er ing of g r u m b o k and the s.n.a.r.v.e.x st plinnndost er"]
    scores = model.scores([plain, *hidden, "the er ing of and the st er", ""])
    assert (scores[:3] > 0.5).all() and (scores[3:] < 0.5).all()


def test_other_columns_and_held_out_labels_do_not_matter(spark, table):
    from liftpanel.llm.common import held_out

    labels = table.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, score(table, labels).collect())) == sorted(map(tuple, score(table, flipped).collect()))


def test_regression_finds_the_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [2, -1, 0] + 0.5)))).astype(float)
    weights, bias = fit_logistic(x, y, np.ones(4000))
    assert np.allclose(weights, [2, -1, 0], atol=0.25) and abs(bias - 0.5) < 0.2


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    bears_odd_tables(spark, lambda d: score(d, labels))
    flat = score(odd(spark), labels.limit(0)).toPandas()
    assert len(flat) == 35 and flat.score.nunique() == 1


@pytest.mark.parametrize("spaced", ["a g r u m b o k", "g r u m b o k s n a r v e x", "s n a r v e x g r u m b o k"])
def test_spaced_words_beside_others(model, spaced):
    from liftpanel.llm.deobfuscated_toxicity import TokenFeatures

    hits = TokenFeatures(model.log_chance).count(f"the er {spaced} ing st")[1]
    assert all("=" + w in hits for w in BAD if " ".join(w) in spaced)
    plain, hidden = model.scores(["the er grumbok ing st", f"the er {spaced} ing st"])
    assert (plain > 0.5) == (hidden > 0.5)


def test_the_sample_sorts_no_label_in_one_task(table, monkeypatch):
    """Each label's rows are taken as a top-k, not as a window over all of them."""
    from liftpanel.llm import deobfuscated_toxicity

    plans, keep = [], deobfuscated_toxicity.written
    monkeypatch.setattr(deobfuscated_toxicity, "written", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or keep(df, label))
    fit(table, table.select("doc_id", "toxic"), F.lit(True), rows_each=4000)
    assert plans and all("TakeOrderedAndProject" in p and "row_number" not in p for p in plans)
