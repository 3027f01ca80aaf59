"""Autocorrelation, correlation, decomposition and unit root against independent numpy computations."""

from datetime import date
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from liftpanel.functions import normal
from liftpanel.operators import explore, stationarity
from tests.helpers import DAY, feature_rows, features_df

START, CAMPAIGN = date(2020, 1, 1), date(2020, 12, 1)


def series_df(spark, by_id):
    rows = [(k, "main", START + i * DAY, float(v)) for k, values in by_id.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "analysis_id string, run_kind string, reference_date date, value double")


def by_lag(df, column):
    out = {}
    for r in df.orderBy("analysis_id", "lag").collect():
        out.setdefault(r.analysis_id, []).append(r[column])
    return out


def some_series(n=200):
    rng = np.random.default_rng(0)
    ar = np.zeros(n)
    for t in range(2, n):
        ar[t] = 0.5 * ar[t - 1] + 0.3 * ar[t - 2] + rng.standard_normal()
    return {"noise": rng.standard_normal(n), "ar2": ar, "walk": rng.standard_normal(n).cumsum()}


def test_acf_and_pacf(spark):
    data = some_series()
    df = series_df(spark, data)
    acf, pacf = by_lag(explore.acf(df), "acf"), by_lag(explore.pacf(df), "pacf")
    for name, x in data.items():
        n, c = len(x), x - x.mean()
        sums = np.array([c[k:] @ c[: n - k] for k in range(41)])
        np.testing.assert_allclose(acf[name], sums / sums[0], atol=1e-12)
        gamma = sums / (n - np.arange(41))
        expected = [1.0]
        for order in range(1, 41):
            toeplitz = gamma[np.abs(np.subtract.outer(range(order), range(order)))]
            expected.append(np.linalg.solve(toeplitz, gamma[1 : order + 1])[-1])
        np.testing.assert_allclose(pacf[name], expected, atol=1e-8)


def test_short_and_constant_series(spark):
    df = series_df(spark, {"short": [1.0, 2.0, 4.0], "flat": [3.0] * 50})
    acf = by_lag(explore.acf(df, 5), "acf")
    assert acf["short"][3:] == [0.0, 0.0, 0.0] and set(acf["flat"]) == {None}
    status = {r.analysis_id: r.status for r in explore.variance_status(df).collect()}
    assert status == {"short": "ok", "flat": "target has no variance"}
    explore.pacf(df, 5).collect()


def test_order_follows_the_partial_autocorrelations(spark):
    data = some_series(2000)
    df = series_df(spark, data)
    runs = spark.createDataFrame([(k, "main", k == "walk") for k in data], "analysis_id string, run_kind string, fix_order boolean")
    got = {r.analysis_id: r.ar_order for r in stationarity.ar_order(df, runs, threshold=0.2).collect()}
    assert got == {"noise": 1, "ar2": 2, "walk": 1}


def test_changes_and_correlations_match_pandas(spark):
    rng = np.random.default_rng(3)
    n = 120
    values = {("target", "t"): 50 + 5 * rng.standard_normal(n), ("control", "x"): 40 + 5 * rng.standard_normal(n), ("visitor", "z"): 9 + rng.standard_normal(n)}
    values[("control", "x")] += 0.8 * values[("target", "t")]
    holes = values[("visitor", "z")].copy()
    holes[::9] = 0.0
    values[("visitor", "z")] = holes
    values[("click", "sparse")] = np.where(np.arange(n) % 2, 5.0, 0.0)
    df = features_df(spark, feature_rows("a", values, START, CAMPAIGN))
    changes = explore.pct_change(df)
    frame = pd.DataFrame({f: v for (_, f), v in values.items()}).pct_change().replace([np.inf, -np.inf], np.nan)
    share = frame.isna().mean()
    got = {r.feature: (r.missing_share, r.is_sparse) for r in explore.sparse_changes(changes).collect()}
    assert got == {f: (pytest.approx(s), s >= 0.4) for f, s in share.items()}
    kept = frame.loc[:, share < 0.4].dropna()
    expected = kept.corr()["t"].drop("t").abs().sort_values(ascending=False)
    rows = explore.target_corr(changes).orderBy("rank").collect()
    assert [r.feature for r in rows] == list(expected.index) == ["x", "z"]
    np.testing.assert_allclose([r.correlation for r in rows], expected.to_numpy())


def test_a_sparse_target_keeps_its_run_and_says_so(spark):
    n = 60
    values = {("target", "t"): np.where(np.arange(n) % 2, 5.0, 0.0), ("control", "x"): np.arange(1.0, n + 1)}
    df = features_df(spark, feature_rows("a", values, START, CAMPAIGN))
    changes = explore.pct_change(df)
    assert [r.feature for r in explore.target_corr(changes).collect()] == ["x"]
    assert [r.status for r in explore.corr_status(changes).collect()] == ["target too sparse"]


def test_unknown_input_type(spark):
    df = features_df(spark, feature_rows("a", {("target", "t"): [1.0]}, START, CAMPAIGN))
    with pytest.raises(ValueError, match="unknown input type"):
        explore.input_series(df, "weather")
    assert explore.input_series(df, "gtrend").count() == 1


def test_weekly_decomposition(spark):
    rng = np.random.default_rng(5)
    x = np.linspace(0, 10, 100) + np.tile([3, 1, 0, -1, -2, -3, 2], 15)[:100] + 0.1 * rng.standard_normal(100)
    got = stationarity.seasonal_additive(series_df(spark, {"a": x})).orderBy("reference_date").toPandas()
    trend = np.full(100, np.nan)
    trend[3:-3] = np.convolve(x, np.ones(7) / 7, "valid")
    means = np.array([np.nanmean((x - trend)[p::7]) for p in range(7)])
    seasonal = np.tile(means - means.mean(), 15)[:100]
    np.testing.assert_allclose(got["trend"].to_numpy(dtype=float), trend)
    np.testing.assert_allclose(got["seasonal"], seasonal)
    np.testing.assert_allclose(got["deseasonal"], x - seasonal)


def adf_by_lstsq(x):
    """The same test written with one lstsq per lag."""
    n = len(x)
    top = int(np.ceil(12 * (n / 100) ** 0.25))
    d = np.diff(x)

    def fit(lags, first):
        rows = range(first, len(d))
        a = np.array([[x[t], 1.0, *[d[t - j] for j in range(1, lags + 1)]] for t in rows])
        y = d[first:]
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = ((y - a @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
        nobs = len(y)
        loglik = -nobs / 2 * (np.log(2 * np.pi * rss / nobs) + 1)
        return beta[0] / se, -2 * loglik + 2 * a.shape[1]

    lags = min(range(top + 1), key=lambda k: fit(k, top)[1])
    return fit(lags, lags)[0], lags


def test_unit_root_statistic_and_verdict(spark):
    data = some_series(400)
    df = series_df(spark, data | {"tiny": [1.0, 2.0, 3.0], "flat": [1.0] * 30})
    rows = {r.analysis_id: r for r in stationarity.adf_test(df, "value").collect()}
    for name, x in data.items():
        expected, expected_lags = adf_by_lstsq(x)
        assert rows[name].used_lag == expected_lags and rows[name].statistic == pytest.approx(expected, rel=1e-6)
    got = {name: (r.verdict, r.p_value) for name, r in rows.items()}
    assert got["tiny"][1] is None and got["flat"] == ("Not stationary", None)
    assert got["noise"][0] == "Stationary" and got["walk"][0] == "Not stationary"
    assert got["tiny"][0] == "Not stationary"


def test_unit_root_p_values(spark):
    """The response surface at published critical values, and its ends."""
    from pyspark.sql import functions as F

    taus = spark.createDataFrame([(x,) for x in (-3.43, -2.86, -2.57, 5.0, -30.0)], "tau double")
    p = [r.p for r in taus.select(stationarity._p_value(F.col("tau")).alias("p")).collect()]
    assert p[:3] == pytest.approx([0.01, 0.05, 0.1], abs=2e-3) and p[3:] == [1.0, 0.0]


def test_candidates(spark):
    runs = spark.createDataFrame([("a", "main", "search"), ("b", "main", "search"), ("c", "main", "local_level"), ("d", "main", "search")], "analysis_id string, run_kind string, search_model string")
    verdicts = spark.createDataFrame([("a", "main", "Stationary"), ("b", "main", "Not stationary"), ("c", "main", "Stationary")], "analysis_id string, run_kind string, verdict string")
    got = {}
    for r in stationarity.candidates(verdicts, runs).orderBy("analysis_id", "candidate_ord").collect():
        got.setdefault(r.analysis_id, []).append(r.candidate)
    three = ["local_level", "local_linear", "semi_local_linear"]
    assert got == {"a": ["no_trend"], "b": three, "c": ["local_level"], "d": three}


def test_normal_expressions(spark):
    p = [1e-12, 1e-6, 0.001, 0.01, 0.07, 0.075, 0.3, 0.5, 0.9, 0.975, 0.999999]
    df = normal.with_normal_quantile(spark.createDataFrame([(x,) for x in p], "p double"), "p", "z")
    for r in df.collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)
    z = [-6.0, -1.96, -0.1, 0.0, 0.5, 3.0]
    tails = spark.createDataFrame([(x,) for x in z], "z double").withColumn("tail", normal.normal_tail(F.col("z")))
    for r in tails.collect():
        assert r.tail == pytest.approx(NormalDist().cdf(-abs(r.z)), abs=7.5e-8)
