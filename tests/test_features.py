from datetime import date

import pytest
from pyspark.sql import functions as F

from liftpanel.operators import extract, features, runs as runs_ops
from liftpanel.schema import SERIES
from tests.helpers import DAY, analyses_df

START, CAMPAIGN, END = date(2020, 1, 1), date(2020, 1, 21), date(2020, 1, 30)


def analyses(spark, **settings):
    return analyses_df(spark, [("a", "T one", ["x"], START, CAMPAIGN, END)], **settings)


def series(spark, rows):
    return spark.createDataFrame(rows, SERIES)


def test_calendar_is_filled_like_a_chain_of_left_joins(spark):
    rows = [("a", "target", "T one", START + i * DAY, float(i + 1)) for i in range(-9, 30, 2)]
    rows += [("a", "control", "x", START + i * DAY, 10.0 * i) for i in (-8, 3, 4, 29)]
    rows += [("a", "visitor", "x y", START + 2 * DAY, 7.0), ("a", "covid", "", START + 5 * DAY, None)]
    df, runs = series(spark, rows), runs_ops.expand_runs(analyses(spark))
    long = features.feature_long(df, runs)
    names = {("target", "T one"): "metric_in_perim_T_one", ("control", "x"): "metric_x", ("visitor", "x y"): "visitor_x_y", ("covid", ""): "new_covid_cases"}
    columns = list(names.values())
    assert features.feature_columns(long) == columns
    wide = features.feature_wide(long)
    chain = runs_ops.spine(runs).select("analysis_id", "run_kind", "reference_date")
    for (role, dim), name in names.items():
        one = df.where((F.col("role") == role) & (F.col("campaign_dimension") == dim))
        chain = chain.join(one.select("analysis_id", "reference_date", F.col("value").alias(name)), ["analysis_id", "reference_date"], "left")
    chain = chain.fillna(0.0).select(wide.columns)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, chain.collect()))
    assert long.count() == 2 * 30 * 4


def test_a_day_given_twice_is_added_up_not_multiplied(spark):
    rows = [("a", "target", "T one", START, 1.0), ("a", "target", "T one", START, 2.0), ("a", "control", "x", START, 5.0)]
    long = features.feature_long(series(spark, rows), runs_ops.expand_runs(analyses(spark))).where("run_kind = 'main'")
    got = {(r.feature, r.reference_date): r.value for r in long.collect()}
    assert len(got) == 60
    assert got["metric_in_perim_T_one", START] == 3.0 and got["metric_x", START] == 5.0


def test_target_exists_without_any_row(spark):
    long = features.feature_long(series(spark, []), runs_ops.expand_runs(analyses(spark)))
    assert {(r.feature, r.value) for r in long.collect()} == {("metric_in_perim_T_one", 0.0)}
    assert long.count() == 60


def test_rows_outside_the_windows_do_not_count(spark):
    rows = [("a", "control", "x", END + DAY, 5.0), ("a", "control", "y", START - 11 * DAY, 5.0)]
    long = features.feature_long(series(spark, rows), runs_ops.expand_runs(analyses(spark)))
    assert {r.feature for r in long.select("feature").distinct().collect()} == {"metric_in_perim_T_one"}


def test_holidays_and_days_without_a_country(spark):
    holidays = spark.createDataFrame([("DE", date(2020, 1, 1), "New Year"), ("DE", date(2020, 1, 1), "again")], "country string, date date, name string")
    runs = runs_ops.expand_runs(analyses(spark, add_holidays=True, country="DE"))
    got = features.holiday_feature(runs, holidays)
    assert got.count() == 60
    assert {r.reference_date for r in got.where("value = 1.0").collect()} == {date(2020, 1, 1)}
    nowhere = features.holiday_feature(runs_ops.expand_runs(analyses(spark, add_holidays=True)), holidays)
    assert nowhere.count() == 60 and nowhere.agg(F.max("value")).first()[0] == 0.0
    assert features.holiday_feature(runs_ops.expand_runs(analyses(spark)), holidays).count() == 0


def test_month_dummies_mark_exactly_one_level_a_day(spark):
    runs = runs_ops.expand_runs(analyses(spark, yearly_seasonality=True))
    dummies = features.month_dummies(runs)
    levels = {r.feature for r in dummies.where("run_kind = 'spec'").collect()}
    assert levels == {"month_December", "month_January"}
    per_day = dummies.groupBy("run_kind", "reference_date").agg(F.sum("value").alias("s")).collect()
    assert {r.s for r in per_day} == {1.0}
    fewer = features.month_dummies(runs, drop_first=True)
    assert {r.feature for r in fewer.collect()} == {"month_January"}
    assert features.month_dummies(runs_ops.expand_runs(analyses(spark))).count() == 0


def test_indicator_columns(spark):
    rows = [(1, "a", 1), (2, "b", None), (3, None, 2), (3, None, 2), (4, "other", 1)]
    df = spark.createDataFrame(rows, "id int, month_name string, k int")
    got = features.indicator_columns(df, "id", {"month_name": ["a", "b"], "k": ["1", "2"]}, {"month_name": "m", "k": "k"})
    assert got.columns == ["id", "m_a", "m_b", "k_1", "k_2"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 1, 0), (2, 0, 1, 0, 0), (3, 0, 0, 0, 1), (4, 0, 0, 1, 0)]
    with pytest.raises(ValueError, match="same column"):
        features.indicator_columns(df, "id", {"month_name": ["a"], "k": ["a"]}, {"month_name": "x", "k": "x"})


def test_features_that_share_a_name_stay_apart(spark):
    """A blank beside its underscore twin, and a control named like the target's prefix."""
    day = date(2020, 1, 1)
    table = analyses_df(spark, [("x", "A", ["NEW YORK", "NEW_YORK", "in_perim_A", "B", "B", None], day, day + 5 * DAY, day + 9 * DAY)])
    rows = [("control", d, day + i * DAY, v) for i in range(10) for d, v in (("NEW YORK", 1.0), ("NEW_YORK", 10.0), ("in_perim_A", 100.0), ("B", 5.0))]
    rows += [("target", "A", day + i * DAY, 7.0) for i in range(10)]
    daily = spark.createDataFrame(rows, "role string, campaign_dimension string, reference_date date, value double")
    found = extract.series_for_analyses(daily, table)
    long = features.feature_long(found, runs_ops.expand_runs(table)).where("run_kind = 'main'")
    got = {r[0]: (r[1], r[2]) for r in long.groupBy("feature").agg(F.sum("value"), F.first("role")).collect()}
    assert got == {
        "metric_NEW_YORK~control~NEW YORK": (10.0, "control"),
        "metric_NEW_YORK~control~NEW_YORK": (100.0, "control"),
        "metric_in_perim_A~control~in_perim_A": (1000.0, "control"),
        "metric_in_perim_A~target~A": (70.0, "target"),
        "metric_B": (50.0, "control"),
    }
    shared = features.shared_names(found).collect()
    assert len(shared) == 4 and all(r.status.startswith("name shared") for r in shared)



def test_later_steps_per_feature_need_no_new_shuffle(spark):
    from liftpanel.operators import clean

    rows = [("a", "target", "T one", START + i * DAY, float(i)) for i in range(30)]
    long = features.feature_long(series(spark, rows), runs_ops.expand_runs(analyses(spark)))

    def shuffles(df):
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return sum("Exchange hashpartitioning" in line for line in text.splitlines())

    assert shuffles(clean.drop_dead_features(long)) <= shuffles(long)
