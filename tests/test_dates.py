import calendar
import random
from datetime import date, timedelta

from dateutil.relativedelta import relativedelta
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.operators import clean, runs as runs_ops
from tests.helpers import DAY, analyses_df, feature_rows, features_df


def windows(n=200, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = date(2015, 1, 1) + rng.randrange(2000) * DAY
        campaign = start + rng.randrange(1, 900) * DAY
        out.append((f"a{i}", "t", ["c"], start, campaign, campaign + rng.randrange(0, 120) * DAY))
    return out


def test_placebo_window_is_the_same_shape_and_ends_before_the_campaign(spark):
    analyses = analyses_df(spark, windows())
    got = {(r.analysis_id, r.run_kind): r for r in runs_ops.expand_runs(analyses).collect()}
    extended = {r.analysis_id: r.data_start for r in runs_ops.data_window(analyses).collect()}
    for key, _, _, start, campaign, end in windows():
        main, spec = got[key, "main"], got[key, "spec"]
        assert (main.start, main.campaign_start, main.end) == (start, campaign, end)
        assert spec.end == campaign - DAY
        assert spec.end - spec.campaign_start == end - campaign
        assert spec.campaign_start - spec.start == campaign - start
        assert extended[key] == spec.start


def test_month_ranges_cover_whole_months_without_gaps(spark):
    rows = windows(60, 2)
    got = {}
    for r in runs_ops.month_ranges(analyses_df(spark, rows), ["analysis_id"]).collect():
        got.setdefault(r.analysis_id, []).append((r.month_start, r.month_end))
    for key, _, _, start, campaign, end in rows:
        first = start - (end - campaign) - DAY
        months = sorted(got[key])
        assert months[0][0] == first.replace(day=1)
        assert months[-1][1] == end.replace(day=calendar.monthrange(end.year, end.month)[1])
        for (_, a), (b, _) in zip(months, months[1:]):
            assert b == a + DAY


def test_week_bounds_and_labels(spark):
    some = [date(2019, 12, 20) + i * DAY for i in range(40)]
    df = spark.createDataFrame([(d,) for d in some], "d date").select(
        "d",
        D.week_start("d").alias("s"),
        D.week_end("d").alias("e"),
        D.month_key("d").alias("k"),
        D.month_name("d").alias("n"),
    )
    for r in df.collect():
        assert r.s.isoweekday() == 7 and r.e.isoweekday() == 6
        assert r.s <= r.d <= r.e and r.e - r.s == timedelta(days=6)
        assert r.k == f"{r.d.year}-{r.d.month}"
        assert r.n == r.d.strftime("%B")


def test_month_slices_tile_the_week_aligned_window(spark):
    rows = windows(50, 3) + [("edge", "t", ["c"], date(2020, 1, 1), date(2020, 1, 20), date(2020, 2, 1))]
    plan = runs_ops.month_slices(runs_ops.data_window(analyses_df(spark, rows)), ["analysis_id"])
    got = {}
    for r in plan.collect():
        assert r.timeframe == f"{r.slice_start} {r.slice_end}"
        assert (r.slice_start.year, r.slice_start.month) == (r.slice_end.year, r.slice_end.month)
        got.setdefault(r.analysis_id, []).append((r.slice_start, r.slice_end))
    for key, _, _, start, campaign, end in rows:
        slices = sorted(got[key])
        lo = start - (end - campaign) - DAY
        assert slices[0][0] == lo - (lo.isoweekday() % 7) * DAY
        assert slices[-1][1] == end + (6 - end.isoweekday() % 7) * DAY
        for (_, a), (b, _) in zip(slices, slices[1:]):
            assert b == a + DAY


def test_spine_has_every_day_once_in_any_time_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = [("a", "t", ["c"], date(2020, 3, 1), date(2020, 3, 20), date(2020, 5, 30))]
        spine = runs_ops.spine(runs_ops.expand_runs(analyses_df(spark, rows))).where("run_kind = 'main'")
        got = sorted(r.reference_date for r in spine.collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [date(2020, 3, 1) + i * DAY for i in range(91)]


def test_period_rules_match_calendar_arithmetic(spark):
    rng = random.Random(4)
    rows, expected = [], {}
    for i in range(300):
        start = date(2016, 1, 1) + rng.randrange(1000) * DAY
        campaign = start + rng.randrange(100, 900) * DAY
        end = campaign + rng.randrange(0, 40) * DAY
        yearly = rng.random() < 0.5
        rows.append((f"a{i}", "t", ["c"], start, campaign, end, yearly))
        pre, post = relativedelta(campaign, start), relativedelta(end, campaign)
        ok = (pre.years != 0 or pre.months >= 6) and (post.days >= 10 or post.months != 0 or post.years != 0)
        expected[f"a{i}"] = ok and (not yearly or pre.years >= 2)
    analyses = spark.createDataFrame(
        rows,
        "analysis_id string, target string, controls array<string>, start date, campaign_start date, end date, yearly_seasonality boolean",
    )
    runs = analyses.withColumn("run_kind", F.lit("main"))
    feats = features_df(
        spark,
        [
            (a, "main", c, "target", "f", d, 1.0)
            for a, _, _, s, c, e, _ in rows
            for d in {s, e}
        ],
    )
    got = {r.analysis_id: r.status == "ok" for r in clean.check_periods(feats, runs).collect()}
    assert got == expected


def test_strict_mode_names_the_short_run(spark):
    import pytest

    runs = spark.createDataFrame([("a", "main", date(2020, 2, 1), False)], "analysis_id string, run_kind string, campaign_start date, yearly_seasonality boolean")
    feats = features_df(spark, feature_rows("a", {("target", "f"): [1.0] * 40}, date(2020, 1, 1), date(2020, 2, 1)))
    with pytest.raises(ValueError, match="for 1 runs"):
        clean.require_periods(clean.check_periods(feats, runs))
