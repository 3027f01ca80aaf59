"""Cleaning, exogenous counts and search interest against plain loops."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftpanel.operators import clean, exog, interest
from tests.helpers import DAY, analyses_df, feature_rows, features_df

START, CAMPAIGN = date(2020, 1, 1), date(2020, 2, 10)


def flat_until_by_loop(values, start, campaign, win=7):
    """Walk the days before the campaign from the second on while the trailing spread is 0."""
    found = None
    for i in range(1, len(values)):
        day = start + i * DAY
        if day >= campaign or np.std(values[max(0, i - win + 1) : i + 1]) != 0:
            break
        found = day
    return found


def test_flat_start_matches_a_day_loop(spark):
    rng = np.random.default_rng(0)
    rows, expected = [], {}
    for i in range(120):
        n = 60
        values = rng.integers(0, 4, n).astype(float)
        head = rng.integers(0, 60)
        values[:head] = rng.choice([0.0, 3.0])
        if i % 7 == 0:
            values[10:25] = 1.0
        rows += feature_rows(f"a{i}", {("target", "t"): values, ("control", "c"): np.ones(n)}, START, CAMPAIGN)
        expected[f"a{i}"] = flat_until_by_loop(values, START, CAMPAIGN)
    df = features_df(spark, rows)
    assert {r.analysis_id: r.flat_until for r in clean.flat_head(df).collect()} == expected
    first = clean.trim_flat_head(df).groupBy("analysis_id", "feature").agg(F.min("reference_date").alias("d")).collect()
    for r in first:
        assert r.d == (START if expected[r.analysis_id] is None else expected[r.analysis_id] + DAY)
    assert len(first) == 240


def test_dead_regressors_go_and_exempt_columns_stay(spark):
    n, quiet = 60, 40
    zeros_before = np.r_[np.zeros(quiet), np.ones(n - quiet)]
    cancel = np.r_[np.tile([1.0, -1.0], quiet // 2), np.ones(n - quiet)]
    df = features_df(
        spark,
        feature_rows(
            "a",
            {
                ("target", "t"): zeros_before,
                ("control", "dead"): zeros_before,
                ("control", "cancel"): cancel,
                ("control", "alive"): np.ones(n),
                ("holiday", "flag_holiday"): zeros_before,
                ("month", "month_March"): zeros_before,
            },
            START,
            CAMPAIGN,
        ),
    )
    dropped = {r.feature for r in clean.dropped_features(df).collect()}
    assert dropped == {"dead", "cancel"}
    assert {r.feature for r in clean.dropped_features(df, use_abs=True).collect()} == {"dead"}
    for use_abs, gone in ((False, {"dead", "cancel"}), (True, {"dead"})):
        left = {r.feature for r in clean.drop_dead_features(df, use_abs).select("feature").distinct().collect()}
        assert left == {"t", "dead", "cancel", "alive", "flag_holiday", "month_March"} - gone


def fill_by_loop(values, digits):
    known = [i for i, v in enumerate(values) if v is not None]
    out = list(values)
    for a, b in zip(known, known[1:]):
        for i in range(a + 1, b):
            out[i] = values[a] + (values[b] - values[a]) / (b - a) * (i - a)
    half_up = lambda v: float(np.floor(v + 0.5))
    return [None if v is None else (half_up(v) if digits == 0 else v) for v in out]


@pytest.mark.parametrize("digits", [0, None])
def test_linear_fill_matches_a_loop(spark, digits):
    rng = np.random.default_rng(1)
    rows, expected = [], {}
    for i in range(80):
        values = [None if rng.random() < 0.4 else float(rng.integers(0, 50)) for _ in range(25)]
        if i % 5 == 0:
            values[:6] = [None] * 6
        if i == 1:
            values = [None] * 25
        rows += [(f"k{i}", START + j * DAY, v) for j, v in enumerate(values)]
        expected[f"k{i}"] = fill_by_loop(values, digits)
    df = spark.createDataFrame(rows, "k string, reference_date date, v double")
    got = {}
    for r in exog.fill_linear(df, ["k"], "reference_date", "v", digits).orderBy("k", "reference_date").collect():
        got.setdefault(r.k, []).append(r.v)
    for k, values in expected.items():
        assert got[k] == [None if v is None else pytest.approx(v) for v in values]


def test_counts_to_daily_cases(spark):
    rows = [("A", START, 5.0), ("A", START, 2.0), ("A", START + DAY, 9.0), ("A", START + 2 * DAY, 8.0), ("A", START + 4 * DAY, 14.0)]
    counts = spark.createDataFrame(rows, "target string, reference_date date, cases double")
    daily = exog.cumulative_to_daily(exog.daily_total(counts, ["target"]), ["target"])
    assert [r.new_cases for r in daily.orderBy("reference_date").collect()] == [None, 2.0, None, 6.0]
    a = analyses_df(
        spark,
        [(x, x, ["z"], START + DAY, START + 4 * DAY, START + 5 * DAY) for x in ("A", "B")],
        covid_usage=True,
        covid_smooth=True,
    )
    got = [tuple(r)[3:] for r in exog.exog_series(counts, a).orderBy("reference_date").collect()]
    # B has no counts; the window starts two days early for the placebo; the gap between 2 and 6 is filled.
    day = lambda i: START + i * DAY
    assert got == [(day(-1), None), (day(0), None), (day(1), 2.0), (day(2), 2.5), (day(3), pytest.approx(10 / 3)), (day(4), 4.0), (day(5), None)]


def test_trailing_mean_counts_days_not_rows(spark):
    rows = [("k", START + i * DAY, v) for i, v in ((0, 1.0), (1, None), (6, 3.0), (7, 5.0), (20, 9.0))]
    df = spark.createDataFrame(rows, "k string, reference_date date, v double")
    got = [r.v for r in exog.smooth_known(df, ["k"], "v").orderBy("reference_date").collect()]
    assert got == [1.0, None, 2.0, 4.0, 9.0]


def interest_tables(spark):
    sunday = date(2020, 1, 5)
    weekly = [("T", "shoe", sunday + 7 * i * DAY, v) for i, v in enumerate((10.0, 20.0, 30.0, 40.0, 50.0))]
    daily = [("T", "shoe", sunday + i * DAY, float(i)) for i in range(35)]
    brand = [("", "brand", d, 1.0) for _, _, d, _ in daily]
    columns = "geo string, keyword string, reference_date date, value double"
    weekly_brand = [("", "brand", d, v) for _, _, d, v in weekly]
    other = [("U", "shoe", sunday, 1000.0)]
    return spark.createDataFrame(weekly + weekly_brand + other, columns), spark.createDataFrame(daily + brand + other, columns)


def keyword_analyses(spark, keywords=("shoe", "none"), **settings):
    rows = [("a", "T", ["c"], date(2020, 1, 20), date(2020, 1, 25), date(2020, 2, 6))]
    settings = {"gtrend_usage": True, "disable_gtrend": False} | settings
    return analyses_df(spark, rows, **settings).withColumn("keywords", F.array(*map(F.lit, keywords)))


def test_interest_is_scaled_by_month_within_the_window(spark):
    weekly, daily = interest_tables(spark)
    got = interest.interest_series(weekly, daily, keyword_analyses(spark), "brand").collect()
    shoe = {r.reference_date: r.value for r in got if r.campaign_dimension == "shoe"}
    # Window from the Sunday before the placebo's first day; January has 10+20+30+40, February 50.
    assert min(shoe) == date(2020, 1, 5) and max(shoe) == date(2020, 2, 8)
    assert shoe[date(2020, 1, 15)] == 10.0
    assert shoe[date(2020, 2, 2)] == 28.0 * 50 / 100
    assert {r.campaign_dimension for r in got} == {"shoe", "global_brand"}


def test_keyword_without_weekly_data_is_left_out(spark):
    weekly, daily = interest_tables(spark)
    rows = [("T", "new", date(2020, 1, 20), 5.0)]
    daily = daily.unionByName(spark.createDataFrame(rows, daily.schema))
    got = interest.interest_series(weekly, daily, keyword_analyses(spark, ("shoe", "new")), "brand")
    assert {r.campaign_dimension for r in got.select("campaign_dimension").distinct().collect()} == {"shoe", "global_brand"}


def test_a_keyword_all_analyses_ask_for(spark):
    """Many analyses share the brand: each gets every day of its own window once."""
    weekly, daily = interest_tables(spark)
    rows = [(f"a{i}", "T", ["c"], date(2020, 1, 10) + (i % 9) * DAY, date(2020, 1, 21), date(2020, 1, 25)) for i in range(200)]
    analyses = analyses_df(spark, rows, disable_gtrend=False)
    got = interest.interest_series(weekly, daily, analyses, "brand").groupBy("analysis_id").agg(
        F.count("*").alias("n"), F.min("reference_date").alias("lo"), F.max("reference_date").alias("hi")
    ).collect()
    assert len(got) == 200
    for r in got:
        start = date(2020, 1, 10) + (int(r.analysis_id[1:]) % 9) * DAY - 5 * DAY
        lo = start - (start.isoweekday() % 7) * DAY
        assert (r.lo, r.hi) == (max(lo, date(2020, 1, 5)), date(2020, 1, 25))
        assert r.n == (r.hi - r.lo).days + 1


def test_only_the_brand_itself_is_exempt_and_lists_are_sets(spark):
    """A keyword that begins like the brand's label is smoothed; one that is named twice counts once."""
    days = [(g, k, date(2020, 1, 1) + i * DAY, float(i % 5 + 1)) for g, k in (("M", "global_news"), ("M", "news"), ("", "brand")) for i in range(90)]
    daily = spark.createDataFrame(days, "geo string, keyword string, reference_date date, value double")
    base = analyses_df(spark, [("a", "T", ["c"], date(2020, 1, 20), date(2020, 2, 20), date(2020, 3, 1))], gtrend_usage=True, disable_gtrend=False, gtrend_smooth=True)
    table = base.withColumns({"keywords": F.expr("array('news', 'global_news', 'news', null)"), "geo": F.lit("M")})
    got = interest.interest_series(daily, daily, table, "brand").collect()
    by_keyword = {}
    for r in got:
        by_keyword.setdefault(r.campaign_dimension, {})[r.reference_date] = r.value
    assert set(by_keyword) == {"news", "global_news", "global_brand"}
    assert by_keyword["news"] == by_keyword["global_news"] != by_keyword["global_brand"]
    assert len(got) == 3 * len(by_keyword["news"])


def test_interest_switches(spark):
    weekly, daily = interest_tables(spark)

    def names(**settings):
        got = interest.interest_series(weekly, daily, keyword_analyses(spark, **settings), "brand")
        return {r.campaign_dimension for r in got.select("campaign_dimension").distinct().collect()}

    assert names(gtrend_usage=False) == {"global_brand"}
    assert names(disable_gtrend=True) == set()
    smooth = interest.interest_series(weekly, daily, keyword_analyses(spark, gtrend_smooth=True), "brand").collect()
    raw = interest.interest_series(weekly, daily, keyword_analyses(spark), "brand").collect()
    value = lambda rows, name: {r.reference_date: r.value for r in rows if r.campaign_dimension == name}
    assert value(smooth, "global_brand") == value(raw, "global_brand")
    unsmoothed = value(raw, "shoe")
    for day, v in value(smooth, "shoe").items():
        last = [unsmoothed[day - i * DAY] for i in range(7) if day - i * DAY in unsmoothed]
        assert v == pytest.approx(np.mean(last))
