"""Candidates by least squares, scaling, and the whole pipeline with planted effects."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftpanel.operators import effects, model
from liftpanel.plans import panel
from liftpanel.schema import SERIES
from liftpanel.sources import stages
from tests.helpers import DAY, analyses_df, feature_rows, features_df, weekly_series

START, CAMPAIGN, END = date(2020, 3, 1), date(2020, 11, 1), date(2020, 11, 30)
K = (END - CAMPAIGN).days + 1


def planted(spark, lifts, **settings):
    """Analyses and series; the lift starts at the real campaign, the placebo window has none."""
    first = START - K * DAY
    n = (END - first).days + 1
    rows, analyses = [], []
    for i, lift in enumerate(lifts):
        target, useful, useless = weekly_series(np.random.default_rng(i), n, lift, (CAMPAIGN - first).days)
        name = f"a{i}"
        analyses.append((name, "T", ["u", "v"], START, CAMPAIGN, END))
        for role, dim, values in (("target", "T", target), ("control", "u", useful), ("control", "v", useless)):
            rows += [(name, role, dim, first + d * DAY, float(v)) for d, v in enumerate(values)]
    return spark.createDataFrame(rows, SERIES), analyses_df(spark, analyses, **settings)


@pytest.fixture(scope="module")
def result(spark):
    series, analyses = planted(spark, [25.0, -25.0, 0.0])
    tables = panel.run_panel(series, analyses)
    return {name: df.toPandas() for name, df in tables.items()}


def test_a_planted_effect_is_found_and_the_verdict_follows_the_placebo(result):
    runs = result["runs"].set_index(["analysis_id", "run_kind"])
    assert set(runs["status"]) == {"ok"} and set(result) == set(stages.RESULT_TABLES)
    summary = result["summary_data"].set_index(["analysis_id", "run_kind", "quantity"])
    for i, lift in enumerate([25.0, -25.0, 0.0]):
        key = (f"a{i}", "main")
        low, high = (summary.loc[(*key, f"abs_effect_{b}"), "average"] for b in ("lower", "upper"))
        assert low <= lift <= high
        assert (runs.loc[key, "p_value"] < 0.01) == (lift != 0.0)
        placebo_p = runs.loc[(f"a{i}", "spec"), "p_value"]
        assert runs.loc[key, "specificity_test"] == ("Negative" if 1 - placebo_p >= 0.95 else "Positive")
        assert runs.loc[(f"a{i}", "spec"), "model_name"] == runs.loc[key, "model_name"] == "metric_u"


def test_tables_are_consistent(result):
    inference = result["inferences"]
    assert len(inference) == 3 * 2 * ((END - START).days + 1)
    post = inference[inference["reference_date"] >= inference["campaign_start"]]
    for _, rows in post.groupby(["analysis_id", "run_kind"]):
        rows = rows.sort_values("reference_date")
        np.testing.assert_allclose(rows["post_cum_effects_means"], rows["point_effects_means"].cumsum(), rtol=1e-9)
        assert (rows["complete_preds_lower"] < rows["complete_preds_upper"]).all()


def small_features(spark, analysis="a", days=140):
    target, useful, useless = weekly_series(np.random.default_rng(1), days)
    start = date(2020, 1, 1)
    values = {("target", "metric_in_perim_T"): target, ("control", "metric_u"): useful, ("control", "metric_v"): useless}
    return feature_rows(analysis, values, start, start + 120 * DAY)


def test_candidates_against_numpy(spark):
    df = features_df(spark, small_features(spark))
    wide = df.groupBy("reference_date").pivot("feature").agg(F.first("value")).orderBy("reference_date").toPandas()
    y, u, v = (wide[c].to_numpy() for c in ("metric_in_perim_T", "metric_u", "metric_v"))
    got = model.control_regressions(df).unionByName(model.trend_regression(df)).orderBy("reference_date").toPandas()
    for name, x in (("metric_u", u), ("metric_v", v), ("control_mean", (u + v) / 2)):
        slope, level = np.polyfit(x[:120], y[:120], 1)
        own = got[got.candidate == name]
        np.testing.assert_allclose(own["mean"], level + slope * x, rtol=1e-9)
        sd = np.std(y[:120] - level - slope * x[:120])
        np.testing.assert_allclose(own["upper"] - own["mean"], 1.959963984540054 * sd, rtol=1e-6)
    number = np.arange(140.0)
    slope, level = np.polyfit(number[:120], y[:120], 1)
    rest = y - level - slope * number
    phase = np.array([rest[:120][d::7].mean() for d in range(7)])
    own = got[got.candidate == "weekly_trend"]
    np.testing.assert_allclose(own["mean"], level + slope * number + phase[np.arange(140) % 7], rtol=1e-9)
    np.testing.assert_allclose(own["sd"], np.std(rest[:120] - phase[np.arange(120) % 7]), rtol=1e-9)


def test_each_run_has_its_own_level(spark):
    df = features_df(spark, small_features(spark) + small_features(spark, "b"))
    alphas = spark.createDataFrame([("a", "main", 0.05), ("b", "main", 0.1)], "analysis_id string, run_kind string, alpha double")
    rows = model.all_candidates(df, alphas).where("candidate = 'control_mean'").toPandas()
    width = (rows["upper"] - rows["mean"]).groupby(rows["analysis_id"]).first() / rows["sd"].iloc[0]
    assert width["a"] == pytest.approx(1.959964, abs=1e-5) and width["b"] == pytest.approx(1.644854, abs=1e-5)
    # The standard deviation that the report works out is the one that made the interval.
    summary = effects.summary(model.control_regressions(df, alphas=alphas, each_control=False).drop("candidate"))
    sds = {(r.analysis_id, r.quantity): r.average for r in effects.effect_sd(summary, alphas).collect()}
    assert sds["a", "predicted"] == pytest.approx(sds["b", "predicted"], rel=0.01) == pytest.approx(rows["sd"].iloc[0], rel=0.01)


def test_a_constant_control_predicts_the_mean(spark):
    start = date(2020, 1, 1)
    values = {("target", "t"): [1.0, 2.0, 3.0, 9.0], ("control", "c"): [5.0] * 4}
    df = features_df(spark, feature_rows("a", values, start, start + 3 * DAY))
    rows = model.control_regressions(df).where("candidate = 'c'").collect()
    assert {r["mean"] for r in rows} == {2.0} and rows[0].sd == pytest.approx(np.std([1.0, 2.0, 3.0]))


def test_no_feature_rows_are_shuffled_by_run_alone(spark):
    df = features_df(spark, small_features(spark))
    plan = model.control_regressions(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_scaling_keeps_dummies_and_survives_constants(spark):
    start = date(2020, 1, 1)
    values = {("target", "t"): [1.0, 2.0, 3.0, 9.0], ("control", "c"): [5.0] * 4, ("holiday", "flag_holiday"): [0.0, 1.0, 0.0, 0.0]}
    df = features_df(spark, feature_rows("a", values, start, start + 3 * DAY))
    got = {}
    for r in model.standardize(df).orderBy("reference_date").collect():
        got.setdefault(r.feature, []).append(r.scaled)
    s = np.std([1.0, 2.0, 3.0])
    assert got["t"] == pytest.approx([-1 / s, 0, 1 / s, 7 / s])
    assert got["c"] == [0.0] * 4 and got["flag_holiday"] == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        model.standardize(df, "post")


def test_hyperpriors_follow_the_scaled_target(spark):
    start = date(2020, 1, 1)
    values = np.random.default_rng(0).normal(10, 2, 40)
    df = features_df(spark, feature_rows("a", {("target", "t"): values}, start, start + 30 * DAY))
    z = (values - values.mean()) / values.std()
    m, s = abs(z[:30].mean()), 0.1 * z[:30].std()
    got = model.hyperpriors(df).first()
    assert got.prior_alpha == pytest.approx(m**2 / s**2 + 2)
    assert got.prior_beta == pytest.approx(m * (m**2 / s**2 + 1))


def test_short_runs_are_reported_without_predictions(spark):
    series, analyses = planted(spark, [0.0])
    short = analyses.withColumn("start", F.date_sub("campaign_start", 60))
    tables = panel.run_panel(series, short)
    assert {r.status for r in tables["runs"].collect()} == {"period too short"} and tables["inferences"].count() == 0
    with pytest.raises(ValueError, match="for 2 runs"):
        panel.run_panel(series, short, strict=True)


def test_saved_results_come_back_and_failed_runs_leave_nothing_old(spark, tmp_path):
    path = str(tmp_path / "out")
    series, analyses = planted(spark, [10.0])
    tables = panel.run_panel(series, analyses)
    panel.save_panel(tables, path)
    loaded = stages.load_results(spark, path, "a0")
    first = loaded["runs"].first()
    assert first.model_name == "metric_u" and first.elapsed_s > 0
    again = effects.wide_summary(loaded["summary_data"]).first()
    assert again.actual_cumulative == pytest.approx(tables["summary_data"].where("quantity = 'actual' and run_kind = 'main'").first().cumulative)
    # Exploration works on a stored run.
    from liftpanel.operators import explore

    assert explore.target_bounds(loaded["features"]).count() == 1 and explore.target_corr(explore.pct_change(loaded["features"])).count() == 2
    stored, live = panel.explore_run(spark, path, "a0"), panel.exploration(tables["features"].where("run_kind = 'main'"))
    for name, df in live.items():
        assert sorted(map(str, stored[name].select(df.columns).collect())) == sorted(map(str, df.collect())), name
    short = analyses.withColumn("start", F.date_sub("campaign_start", 60))
    panel.save_panel(panel.run_panel(series, short), path)
    loaded = stages.load_results(spark, path, "a0")
    assert loaded["runs"].first().status == "period too short" and loaded["inferences"].count() == 0 and loaded["summary_data"].count() == 0
