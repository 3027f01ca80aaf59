from datetime import date
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftpanel.operators import diagnostics, effects, selection
from tests.helpers import DAY

START, CAMPAIGN = date(2020, 1, 1), date(2020, 1, 11)
COLUMNS = "analysis_id string, run_kind string, campaign_start date, reference_date date, observed double, mean double, lower double, upper double, sd double"


def predictions(spark, n=20, seed=0, zero_at=None):
    rng = np.random.default_rng(seed)
    rows = []
    for kind in ("main", "spec"):
        for i in range(n):
            observed, mean = 100 + 10 * rng.standard_normal(), 90 + rng.standard_normal()
            if i == zero_at:
                observed = 0.0
            rows.append(("a", kind, CAMPAIGN, START + i * DAY, float(observed), float(mean), float(mean - 4), float(mean + 5), 2.0))
    return spark.createDataFrame(rows, COLUMNS), rows


def test_point_and_cumulative_effects(spark):
    df, rows = predictions(spark)
    got = effects.inferences(df).where("run_kind = 'main'").orderBy("reference_date").collect()
    running = 0.0
    for r, row in zip(got, rows):
        observed, mean, lower, upper = row[4:8]
        assert r.point_effects_means == observed - mean
        assert r.point_effects_lower == observed - upper and r.point_effects_upper == observed - lower
        running += observed - mean if r.reference_date >= CAMPAIGN else 0.0
        assert r.post_cum_effects_means == pytest.approx(running)
        assert r.post_cum_effects_lower <= r.post_cum_effects_means <= r.post_cum_effects_upper
        assert r.error == observed - mean and r.perc_error == (observed - mean) / observed
    assert got[9].post_cum_effects_upper == 0.0


def test_bounds_of_the_sum_replace_sums_of_bounds(spark):
    df, rows = predictions(spark)
    running = F.sum(F.when(F.col("reference_date") >= F.col("campaign_start"), F.col("mean")))
    from pyspark.sql import Window

    w = Window.partitionBy("run_kind").orderBy("reference_date")
    with_sum = df.withColumn("cum_mean", running.over(w)).withColumn("cum_lower", F.col("cum_mean") - 3).withColumn("cum_upper", F.col("cum_mean") + 4)
    last = effects.inferences(with_sum).where("run_kind = 'main'").orderBy(F.desc("reference_date")).first()
    assert last.post_cum_effects_means - last.post_cum_effects_lower == pytest.approx(4)
    assert last.post_cum_effects_upper - last.post_cum_effects_means == pytest.approx(3)
    s = {r.quantity: r for r in effects.summary(with_sum).where("run_kind = 'main'").collect()}
    assert s["predicted_upper"].cumulative - s["predicted"].cumulative == pytest.approx(4)
    assert s["predicted_upper"].average - s["predicted"].average == pytest.approx(0.4)
    assert s["abs_effect"].cumulative == pytest.approx(last.post_cum_effects_means)


def test_summary_report_and_sd(spark):
    df, rows = predictions(spark)
    post = [r for r in rows if r[1] == "main" and r[3] >= CAMPAIGN]
    actual, predicted = sum(r[4] for r in post), sum(r[5] for r in post)
    data = effects.summary(df)
    s = {r.quantity: r for r in data.where("run_kind = 'main'").collect()}
    assert len(s) == 10
    assert s["actual"].cumulative == pytest.approx(actual) and s["actual"].average == pytest.approx(actual / 10)
    assert s["rel_effect"].average == pytest.approx((actual - predicted) / predicted)
    assert s["rel_effect_lower"].average <= s["rel_effect"].average <= s["rel_effect_upper"].average
    alphas = df.select("analysis_id", "run_kind").distinct().withColumn("alpha", F.lit(0.1))
    sd = {r.quantity: r for r in effects.effect_sd(data, alphas).where("run_kind = 'main'").collect()}
    z = round(NormalDist().inv_cdf(0.95), 2)
    assert sd["predicted"].average == pytest.approx(round(9 / (2 * z), 2))
    assert sd["predicted"].cumulative == pytest.approx(round(90 / (2 * z), 2))
    report = effects.summary_report(data, alphas).where("run_kind = 'main'").orderBy("line").collect()
    assert [r.label for r in report] == ["Actual", "Prediction (s.d.)", "90% CI", "Absolute effect (s.d.)", "90% CI", "Relative effect (s.d.)", "90% CI"]
    assert report[0].cumulative == f"{actual:.2f}"
    assert report[5].average.endswith("%)") and report[6].average.startswith("[")


def test_half_a_cent_is_not_decided_by_noise(spark):
    values = [(2.675, 2.68), (3070645.39499999999, 3070645.4), (3070645.3950000004, 3070645.4), (-0.005, -0.01), (0.0049, 0.0), (None, None)]
    df = spark.createDataFrame(values, "x double, expected double").withColumn("got", effects.cents(F.col("x")))
    assert [(r.x, r.got) for r in df.collect()] == values


def test_no_division_by_zero(spark):
    df, _ = predictions(spark, zero_at=12)
    got = effects.errors(df).where("observed = 0").collect()
    assert got and all(r.perc_error is None for r in got)
    nothing = df.withColumn("mean", F.lit(0.0))
    assert {r.average for r in effects.summary(nothing).where("quantity like 'rel%'").collect()} == {None}
    scored = {r.run_kind: r.mape for r in selection.mape(df, ["analysis_id", "run_kind"]).collect()}
    assert all(v is not None for v in scored.values())
    with pytest.raises(ValueError):
        selection.mape(df, ["analysis_id"], "post")


def test_selection_takes_the_first_of_equals_and_ignores_unscored(spark):
    rows = [("a", "main", "x", 0, None), ("a", "main", "y", 1, 0.2), ("a", "main", "z", 2, 0.2), ("b", "main", "x", 0, 0.3), ("b", "main", "y", 1, 0.1), ("c", "main", "x", 0, None)]
    df = spark.createDataFrame(rows, "analysis_id string, run_kind string, candidate string, candidate_ord int, mape double")
    got = {r.analysis_id: r.candidate for r in selection.select_model(df).collect()}
    assert got == {"a": "y", "b": "y", "c": "x"}
    placebo = {(r.analysis_id, r.run_kind, r.candidate) for r in selection.placebo_candidates(selection.select_model(df)).collect()}
    assert placebo == {("a", "spec", "y"), ("b", "spec", "y"), ("c", "spec", "x")}


def test_verdict_and_probability(spark):
    p = spark.createDataFrame([("a", "spec", 0.05), ("b", "spec", 0.051), ("c", "spec", 0.001), ("a", "main", 0.0)], "analysis_id string, run_kind string, p_value double")
    analyses = spark.createDataFrame([("a", 0.95), ("b", 0.95), ("c", 0.9999)], "analysis_id string, spec_thr double")
    got = {r.analysis_id: r.specificity_test for r in selection.placebo_verdict(p, analyses).collect()}
    assert got == {"a": "Negative", "b": "Positive", "c": "Positive"}
    prob = [r[0] for r in p.orderBy("p_value").select(effects.effect_probability(F.col("p_value"))).collect()]
    assert prob == [100, 100, 95, 95]


def test_p_value_is_the_tail_of_the_sum(spark):
    df, rows = predictions(spark)
    post = [r for r in rows if r[1] == "main" and r[3] >= CAMPAIGN]
    z = sum(r[4] - r[5] for r in post) / (2.0 * np.sqrt(len(post)))
    got = effects.p_value(df).where("run_kind = 'main'").first().p_value
    assert got == pytest.approx(NormalDist().cdf(-abs(z)), abs=1e-7)


def test_bounds_of_the_panels(spark):
    df, rows = predictions(spark)
    inference = effects.inferences(df)
    b = effects.plot_bounds(inference).where("run_kind = 'main'").first()
    frame = inference.where("run_kind = 'main'").toPandas()
    assert b.min_observed == frame[["observed", "complete_preds_means", "complete_preds_lower"]].min().min()
    assert b.max_observed == frame[["observed", "complete_preds_means", "complete_preds_upper"]].max().max()
    assert b.max_cumulative == frame[["post_cum_effects_means", "post_cum_effects_upper"]].max().max()


def residual_df(spark, values):
    rows = [("a", "main", START + i * DAY, 10.0 + float(v), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "analysis_id string, run_kind string, reference_date date, observed double, error double")


def test_histogram_matches_numpy_and_sums_to_one(spark):
    values = np.random.default_rng(1).standard_normal(500)
    got = diagnostics.residual_histogram(residual_df(spark, values)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r.rows for r in got] == list(counts)
    width = edges[1] - edges[0]
    assert sum(r.density for r in got) * width == pytest.approx(1.0)
    fitted = NormalDist(values.mean(), values.std())
    np.testing.assert_allclose([r.normal_density for r in got], [fitted.pdf(c) for c in (edges[1:] + edges[:-1]) / 2])
    one = diagnostics.residual_histogram(residual_df(spark, [3.0] * 4)).where("rows > 0").collect()
    assert [(r.bin, r.rows, r.density) for r in one] == [(0, 4, None)]


def test_quantile_quantile_points(spark):
    values = np.random.default_rng(2).standard_normal(60) * 3 + 1
    got = diagnostics.qq_points(residual_df(spark, values)).orderBy("rn").collect()
    n = len(values)
    medians = np.r_[1 - 0.5 ** (1 / n), (np.arange(2, n) - 0.3175) / (n + 0.365), 0.5 ** (1 / n)]
    theory = np.array([NormalDist().inv_cdf(m) for m in medians])
    slope, intercept = np.polyfit(theory, np.sort(values), 1)
    np.testing.assert_allclose([r.theoretical for r in got], theory, rtol=1e-10)
    np.testing.assert_allclose([r.observed for r in got], np.sort(values))
    np.testing.assert_allclose([r.fitted for r in got], intercept + slope * theory, rtol=1e-8)


def test_relative_error_and_residuals(spark):
    values = [1.0, -2.0, 4.0]
    assert diagnostics.relative_error(residual_df(spark, values)).first().relative_error == pytest.approx(1.0 / 11.0)
    df, _ = predictions(spark)
    assert diagnostics.residuals(effects.inferences(df)).count() == 20
