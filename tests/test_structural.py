"""Linear algebra as folds and the parts of a structural prediction, against numpy."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftpanel.functions.linear import let, numbers, products, square, sweep
from liftpanel.operators import structural
from tests.helpers import DAY, feature_rows, features_df

START, N, PRE = date(2021, 1, 4), 430, 400
CAMPAIGN = START + PRE * DAY


def data(seed=1):
    rng = np.random.default_rng(seed)
    shared = rng.standard_normal(N)
    a = 50 + 5 * (shared + 0.3 * rng.standard_normal(N))
    b = 20 + 2 * (shared + 0.5 * rng.standard_normal(N))
    c, flat = rng.standard_normal(N) * 7, np.full(N, 3.0)
    day = np.arange(N)
    noise = np.zeros(N)
    for t in range(1, N):
        noise[t] = 0.6 * noise[t - 1] + rng.standard_normal()
    week, month = np.array([3, 1, 0, -1, -2, -4, 3.0])[day % 7], 4 * np.sin(2 * np.pi * (day % 30) / 30)
    y = 100 + 0.05 * day + week + month + 1.5 * (a - 50) - 0.8 * (b - 20) + noise
    return {("target", "t"): y, ("control", "a"): a, ("control", "b"): b, ("control", "c"): c, ("control", "flat"): flat}


@pytest.fixture(scope="module")
def features(spark):
    return features_df(spark, feature_rows("x", data(), START, CAMPAIGN)).cache()


def scaled(values):
    std = values[:PRE].std()
    return (values - values[:PRE].mean()) / (std if std > 0 else 1)


def test_sweeps_solve_and_pass_over_what_is_explained(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 4))
    x = np.column_stack([x, x[:, 0] - 2 * x[:, 1], x @ [1, 2, 3, 4] + rng.standard_normal(60)])
    rows = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    sums = rows.select(F.posexplode(products(F.col("x")))).groupBy("pos").agg(F.sum("col").alias("s")).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("g"))
    matrix = square(F.transform("g", lambda c: c["s"]), F.lit(6))
    got = np.array(sums.select(let(matrix, lambda m: F.aggregate(numbers(0, 4), m, sweep))).first()[0])
    beta, rest, *_ = np.linalg.lstsq(x[:, :4], x[:, 5], rcond=None)
    np.testing.assert_allclose(got[:4, 5], beta, rtol=1e-9)
    np.testing.assert_allclose(got[5, 5], rest[0], rtol=1e-9)
    np.testing.assert_allclose(got[:4, :4], np.linalg.inv(x[:, :4].T @ x[:, :4]), rtol=1e-8)


def test_gram(features):
    want = {k: scaled(v)[:PRE] for (_, k), v in data().items()}
    got = {(r.feature_i, r.feature_j): r["product"] for r in structural.gram(features).collect()}
    assert len(got) == 15 and {i for i, _ in got if i == "t"} and not any(j == "t" and i != "t" for i, j in got)
    for (i, j), s in got.items():
        assert s == pytest.approx(want[i] @ want[j], abs=1e-8)


def test_sparse_fit_meets_the_conditions_of_its_optimum(features):
    values = {k: scaled(v)[:PRE] for (_, k), v in data().items()}
    got = {r.feature: r.coefficient for r in structural.sparse_fit(features).collect()}
    assert got["flat"] == 0 and got["c"] == 0 and got["a"] > 0.3 and set(got) == {"a", "b", "c", "flat"}
    rest = values["t"] - sum(got[k] * values[k] for k in got)
    for k in ("a", "b", "c"):
        slope = values[k] @ rest / PRE
        if got[k]:
            assert slope == pytest.approx(np.sign(got[k]) * structural.PENALTY, abs=1e-6)
        else:
            assert abs(slope) <= structural.PENALTY + 1e-9


def test_without_penalty_it_is_least_squares(features):
    values = {k: scaled(v)[:PRE] for (_, k), v in data().items()}
    got = {r.feature: r.coefficient for r in structural.sparse_fit(features, penalty=0.0, passes=300).collect()}
    beta, *_ = np.linalg.lstsq(np.column_stack([values[k] for k in "abc"]), values["t"], rcond=None)
    assert [got[k] for k in "abc"] == pytest.approx(beta, abs=1e-6)


def test_importance(spark):
    fit = spark.createDataFrame([("x", "main", "a", -0.5, -0.4), ("x", "main", "b", 0.1, 0.5), ("x", "main", "c", 0.0, 0.3)], "analysis_id string, run_kind string, feature string, coefficient double, product double")
    got = {r.feature: (r.importance, r.rank, r.share) for r in structural.importance(fit).collect()}
    assert got["a"] == pytest.approx((0.5, 1, 0.8)) and got["b"] == pytest.approx((0.1, 2, 0.2)) and got["c"][1:] == (3, 0.0)


def test_all_controls_predict_the_target(features):
    rows = structural.all_controls(features, 1.96).orderBy("reference_date").collect()
    y, mean = (np.array([r[c] for r in rows]) for c in ("observed", "mean"))
    assert len(rows) == N and np.corrcoef(y[:PRE], mean[:PRE])[0, 1] > 0.4
    assert rows[0].sd == pytest.approx(np.sqrt(((y - mean)[:PRE] ** 2).mean()))


def runs(spark, monthly=True):
    return spark.createDataFrame([("x", "main", CAMPAIGN, START + (N - 1) * DAY, monthly)], "analysis_id string, run_kind string, campaign_start date, end date, monthly_seasonality boolean")


def test_two_seasons_are_least_squares_on_both_phases(spark, features):
    lines = structural.straight_line(features)
    got = {(r.period, r.phase): r.effect for r in structural.two_seasons(lines, runs(spark)).collect()}
    y, day = data()["target", "t"][:PRE], np.arange(PRE)
    rest = y - np.polyval(np.polyfit(day, y, 1), day)
    x = np.column_stack([day % 7 == i for i in range(7)] + [day % 30 == i for i in range(30)]).astype(float)
    want = x @ np.linalg.lstsq(x, rest, rcond=None)[0]
    np.testing.assert_allclose([got[7, t % 7] + got[30, t % 30] for t in day], want, atol=1e-8)
    assert sum(got[7, i] for i in range(7)) == pytest.approx(0, abs=1e-9)
    weekly = structural.two_seasons(lines, runs(spark, monthly=False)).collect()
    assert {r.period for r in weekly} == {7}


def test_forecast_carries_the_state_on(spark, features):
    y = data()["target", "t"][:PRE]
    series = features.where((F.col("role") == "target") & (F.col("reference_date") < F.col("campaign_start"))).select("analysis_id", "run_kind", "reference_date", "value")
    for order in (1, 3):
        orders = spark.createDataFrame([("x", "main", order)], "analysis_id string, run_kind string, ar_order int")
        got = [r.forecast for r in structural.ar_forecast(series, orders, runs(spark)).orderBy("reference_date").collect()]
        d = y - y.mean()
        gamma = [d[k:] @ d[: PRE - k] / (PRE - k) for k in range(order + 1)]
        phi = np.linalg.solve([[gamma[abs(i - j)] for j in range(order)] for i in range(order)], gamma[1:])
        state, want = list(d[::-1][:order]), []
        for _ in range(N - PRE):
            state = [phi @ state, *state[:-1]]
            want.append(y.mean() + state[0])
        assert got == pytest.approx(want, rel=1e-9)


def test_components_add_up_and_explain(spark, features):
    orders = spark.createDataFrame([("x", "main", 1)], "analysis_id string, run_kind string, ar_order int")
    got = structural.components(features, runs(spark), orders).toPandas()
    assert len(got) == N * len(structural.COMPONENTS)
    sums = got.groupby("reference_date").agg(total=("value", "sum"), mean=("mean", "first")).sort_index()
    np.testing.assert_allclose(sums.total, sums["mean"], rtol=1e-12)
    y = data()["target", "t"]
    assert (y - sums["mean"].to_numpy())[:PRE].std() < 0.45 * (y - np.polyval(np.polyfit(np.arange(PRE), y[:PRE], 1), np.arange(N)))[:PRE].std()
    wide = got.pivot(index="reference_date", columns="component", values="value").sort_index()
    assert (wide.autoregression[:PRE] == 0).all() and (wide.autoregression[PRE:] != 0).any()
