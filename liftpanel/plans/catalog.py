"""Registered queries: every operator on the test warehouse, whole tables, no sampling.

Results carry days as ISO text and rounded doubles so that they compare across engines.
"""

from __future__ import annotations

import calendar
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftpanel.functions import dates as D
from liftpanel.operators import (
    clean,
    diagnostics,
    effects,
    exog,
    explore,
    extract,
    features,
    interest,
    model,
    runs as runs_ops,
    selection,
    stationarity,
    structural,
)
from liftpanel.functions.normal import two_sided_z
from liftpanel.operators.extract import RoleMeasure
from liftpanel.plans import panel, warehouse as W
from liftpanel.schema import RUN_KEYS
from liftpanel.sources import facts, stages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALPHA = 0.05


def shown(df: DataFrame, digits: int = 4, by_column: dict[str, int] | None = None) -> DataFrame:
    """Days as text, doubles rounded to ``digits``, single columns to their own number of digits."""
    by_column = by_column or {}
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, by_column.get(field.name, digits))
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(fn: Query | None = None, digits: int = 4, **by_column: int):
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: shown(f(spark, sf_dir), digits, by_column)
        return f

    return register(fn) if fn is not None else register


# --- inputs shared by the queries -------------------------------------------------------------


def _series(spark, sf_dir, *roles, **settings) -> tuple[DataFrame, DataFrame]:
    """(analyses, role series) of the region panel for the given roles."""
    analyses = W.region_analyses(spark, sf_dir, **settings)
    with_lines = bool({"click", "impression"} & set(roles))
    fact = W.fact_marketing(spark, sf_dir, analyses, with_lines)
    measures = [m for m in W.role_measures() if m.role in roles]
    return analyses, extract.extract_series(fact, analyses, "date", "country_code", measures)


def _features(spark, sf_dir, *extra, **settings) -> DataFrame:
    """Region features: target and controls, further roles on request."""
    analyses, series = _series(spark, sf_dir, "target", "control", *extra, **settings)
    return features.feature_long(series, runs_ops.expand_runs(analyses))


def _faulty_features(spark, sf_dir) -> DataFrame:
    """Region features with a dead control and a flat start.

    The control that comes first by name is 0 before the campaign, the target is 0 on its first 30 days.
    """
    clean_ones = _features(spark, sf_dir)
    run = Window.partitionBy(*RUN_KEYS)
    first_control = F.min(F.when(F.col("role") == "control", F.col("feature"))).over(run)
    first_day = F.min("reference_date").over(run)
    dead = (F.col("feature") == F.col("first_control")) & (F.col("reference_date") < F.col("campaign_start"))
    flat = (F.col("role") == "target") & (F.col("reference_date") < F.date_add("first_day", 30))
    return (
        clean_ones.withColumn("first_control", first_control)
        .withColumn("first_day", first_day)
        .withColumn("value", F.when(dead | flat, 0.0).otherwise(F.col("value")))
        .select(features.FEATURE_COLUMNS)
    )


def _regressions(spark, sf_dir) -> DataFrame:
    return model.control_regressions(_features(spark, sf_dir), ALPHA)


def _predictions(spark, sf_dir) -> DataFrame:
    """Predictions of every run from the mean of its controls."""
    return model.control_regressions(_features(spark, sf_dir), ALPHA, each_control=False).drop("candidate")


def _inferences(spark, sf_dir) -> DataFrame:
    return effects.inferences(_predictions(spark, sf_dir))


def _residuals(spark, sf_dir) -> DataFrame:
    """Residuals rounded to 2 digits, so that bins and ranks do not hang on the last bit."""
    return diagnostics.residuals(_inferences(spark, sf_dir)).withColumn("error", F.round("error", 2))


def _summary_shown(data: DataFrame) -> DataFrame:
    """Sums in cents, averages finer (a sum of cents over 92 days can end on half a cent), shares to 6 digits."""
    share = F.col("quantity").startswith("rel")
    return data.withColumns(
        {
            c: F.when(share, F.round(c, 6)).otherwise(F.round(c, digits))
            for c, digits in (("average", 4), ("cumulative", 2))
        }
    )


def _alphas(spark, sf_dir) -> DataFrame:
    return runs_ops.expand_runs(W.region_analyses(spark, sf_dir, alpha=ALPHA)).select(*RUN_KEYS, "alpha")


# --- sources ----------------------------------------------------------------------------------


@query
def read_fact_range(spark, sf_dir):
    lines = facts.read_fact(spark, f"{sf_dir}/lineitem.parquet", "l_shipdate", "1998-01-01", "1998-03-31")
    return lines.select("l_orderkey", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice")


@query
def month_bounds(spark, sf_dir):
    return W.supplier_windows(spark, sf_dir).select(
        "analysis_id",
        D.whole_month_start("start", "campaign_start", "end").alias("month_start"),
        D.whole_month_end("end").alias("month_end"),
    )


@query
def month_ranges(spark, sf_dir):
    return runs_ops.month_ranges(W.supplier_windows(spark, sf_dir), ["analysis_id"])


@query
def disabled_role_empty(spark, sf_dir):
    """Rows per analysis and role with clicks enabled and all other optional roles left off."""
    _, series = _series(spark, sf_dir, *(m.role for m in W.role_measures()), click_usage=True)
    return series.groupBy("analysis_id", "role").agg(F.count(F.lit(1)).alias("days"))


# --- role extracts ----------------------------------------------------------------------------


def _role(spark, sf_dir, measure: RoleMeasure, with_lines=False, **settings) -> DataFrame:
    analyses = W.region_analyses(spark, sf_dir, **settings)
    fact = W.fact_marketing(spark, sf_dir, analyses, with_lines)
    return extract.extract_role(fact, analyses, "date", "country_code", measure)


@query
def target_daily(spark, sf_dir):
    return _role(spark, sf_dir, RoleMeasure("target", F.col("metric")))


@query
def target_in_perimeter(spark, sf_dir):
    return _role(spark, sf_dir, RoleMeasure("target", F.col("metric"), W.perimeter()))


@query
def target_out_perimeter(spark, sf_dir):
    outside = extract.out_of_perimeter(W.perimeter())
    return _role(spark, sf_dir, RoleMeasure("out_perim", F.col("metric"), outside), out_perim_usage=True)


@query
def target_out_perimeter_as_written(spark, sf_dir):
    outside = extract.out_of_perimeter(W.perimeter(), "as_written")
    return _role(spark, sf_dir, RoleMeasure("out_perim", F.col("metric"), outside), out_perim_usage=True)


@query
def control_daily(spark, sf_dir):
    return _role(spark, sf_dir, RoleMeasure("control", F.col("metric")))


@query
def control_daily_repeated(spark, sf_dir):
    """Controls that are listed twice, and a null among them, count once and not at all."""
    analyses = W.region_analyses(spark, sf_dir)
    analyses = analyses.withColumn("controls", F.concat("controls", "controls", F.array(F.lit(None).cast("string"))))
    measure = RoleMeasure("control", F.col("metric"))
    return extract.extract_role(W.fact_marketing(spark, sf_dir, analyses), analyses, "date", "country_code", measure)


@query
def visitor_daily(spark, sf_dir):
    return _role(
        spark, sf_dir, RoleMeasure("visitor", F.col("new_visitors"), W.paid_traffic()), visitor_usage=True
    )


@query
def click_daily(spark, sf_dir):
    return _role(spark, sf_dir, RoleMeasure("click", F.col("clicks"), W.paid_traffic()), True, click_usage=True)


@query
def impression_daily(spark, sf_dir):
    return _role(
        spark, sf_dir, RoleMeasure("impression", F.col("impressions"), W.paid_traffic()), True, impression_usage=True
    )


@query
def npc_daily(spark, sf_dir):
    return _role(spark, sf_dir, RoleMeasure("npc", F.col("npc_first_touch")), npc_usage=True)


@query
def payment_daily(spark, sf_dir):
    analyses = W.event_analyses(spark, sf_dir)
    measure = RoleMeasure("target", F.col("gmv_proceeds_usd").cast("decimal(18,2)"))
    return extract.extract_role(W.fact_payment(spark, sf_dir, analyses), analyses, "reference_date", "subject", measure)


@query
def user_sql_extract(spark, sf_dir):
    text = """
        SELECT date AS reference_date, country_code AS campaign_dimension, sum(metric) AS metric
        FROM {fact}
        WHERE date BETWEEN :start AND :end AND array_contains(:control, country_code)
        GROUP BY date, country_code
    """
    args = {"start": "1997-10-01", "end": "2000-08-31", "control": ["AFRICA", "ASIA"]}
    return facts.extract_sql(spark, text, args, fact=W.fact_marketing(spark, sf_dir))


def _count_lines(spark, sf_dir):
    """Every order as a line ``region,datetime,cases``. Orders of some priorities lack a cell, have one too many or
    no number, those of status P have no day."""
    day = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    count = (F.col("o_orderkey") % 1000).cast("string")
    priority = F.col("o_orderpriority")
    rest = (
        F.when(priority == "2-HIGH", "")
        .when(priority == "4-NOT SPECIFIED", F.concat(F.lit(","), count, F.lit(",more")))
        .when(priority == "5-LOW", ",n/a")
        .when(F.col("o_orderkey") % 10 == 0, ",")
        .otherwise(F.concat(F.lit(","), count))
    )
    orders = W.table(spark, sf_dir, "orders")
    lines = orders.select(F.concat(F.col("o_custkey").cast("string"), F.lit(","), day, rest).alias("line"))
    return facts.split_cumulative_lines(lines, ["region", "datetime", "cases"], "datetime")


@query
def csv_accepted(spark, sf_dir):
    return _count_lines(spark, sf_dir)[0]


@query
def csv_rejected(spark, sf_dir):
    return _count_lines(spark, sf_dir)[1]


# --- calendar ---------------------------------------------------------------------------------


@query
def run_windows(spark, sf_dir):
    return runs_ops.expand_runs(W.supplier_windows(spark, sf_dir))


@query
def daily_spine(spark, sf_dir):
    """Calendar of every region's runs, from its first to its last order."""
    fact = W.fact_marketing(spark, sf_dir)
    extent = fact.groupBy(F.col("country_code").alias("analysis_id")).agg(
        F.min("date").alias("start"), F.max("date").alias("end")
    )
    windows = extent.withColumn("campaign_start", F.date_sub("end", 90))
    return runs_ops.spine(runs_ops.expand_runs(windows))


@query
def week_bounds(spark, sf_dir):
    day = F.to_date("o_orderdate").alias("day")
    return (
        W.table(spark, sf_dir, "orders").groupBy(day).agg(F.count(F.lit(1)).alias("orders"))
        .withColumn("week_start", D.week_start("day")).withColumn("week_end", D.week_end("day"))
    )


@query
def month_slices(spark, sf_dir):
    return runs_ops.month_slices(runs_ops.data_window(W.supplier_windows(spark, sf_dir)), ["analysis_id"])


@query
def month_labels(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return W.table(spark, sf_dir, "orders").groupBy(
        D.month_key(day).alias("month"), D.month_name(day).alias("month_name")
    ).agg(F.count(F.lit(1)).alias("orders"))


@query
def period_labels(spark, sf_dir):
    return (
        _features(spark, sf_dir)
        .groupBy(*RUN_KEYS, D.period("reference_date", "campaign_start").alias("period"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total"))
    )


@query
def period_check(spark, sf_dir):
    analyses = W.region_analyses(spark, sf_dir, yearly_seasonality=True)
    return clean.check_periods(
        clean.clean_features(_faulty_features(spark, sf_dir)), runs_ops.expand_runs(analyses)
    )


@query
def period_check_short(spark, sf_dir):
    """The event window is far too short for an analysis, which the status has to say."""
    analyses = W.event_analyses(spark, sf_dir)
    measures = [RoleMeasure(r, F.col("gmv_proceeds_usd").cast("decimal(18,2)")) for r in ("target", "control")]
    series = extract.extract_series(W.fact_payment(spark, sf_dir, analyses), analyses, "reference_date", "subject", measures)
    runs = runs_ops.expand_runs(analyses)
    return clean.check_periods(features.feature_long(series, runs), runs)


# --- search interest --------------------------------------------------------------------------


def _interest_inputs(spark, sf_dir, **settings):
    by_day = W.with_brand(W.line_interest(spark, sf_dir))
    types = W.table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set("p_type")).alias("k")).scalar()
    analyses = W.region_analyses(
        spark, sf_dir, gtrend_usage=True, disable_gtrend=False, **settings
    ).withColumn("keywords", types)
    return W.weekly_interest(by_day), W.daily_interest(by_day), analyses


@query(digits=6)
def interest_scale(spark, sf_dir):
    weekly, _, analyses = _interest_inputs(spark, sf_dir)
    requests = interest.interest_requests(analyses, W.BRAND)
    return interest.monthly_scale(interest.interest_for_analyses(weekly, requests)).drop("is_brand")


@query(digits=6)
def interest_rescaled(spark, sf_dir):
    weekly, daily, analyses = _interest_inputs(spark, sf_dir)
    requests = interest.interest_requests(analyses, W.BRAND)
    scale = interest.monthly_scale(interest.interest_for_analyses(weekly, requests))
    return interest.rescale_interest(interest.interest_for_analyses(daily, requests), scale).drop("gtrend_smooth", "is_brand")


@query(digits=6)
def interest_all(spark, sf_dir):
    weekly, daily, analyses = _interest_inputs(spark, sf_dir, gtrend_smooth=False)
    return interest.interest_series(weekly, daily, analyses, W.BRAND)


@query(digits=6)
def interest_smoothed(spark, sf_dir):
    weekly, daily, analyses = _interest_inputs(spark, sf_dir, gtrend_smooth=True)
    return interest.interest_series(weekly, daily, analyses, W.BRAND)


@query(digits=6)
def interest_repeated(spark, sf_dir):
    """Keywords that are listed twice, in a market that is not the target's name."""
    weekly, daily, analyses = _interest_inputs(spark, sf_dir, gtrend_smooth=True)
    analyses = analyses.withColumns({"keywords": F.concat("keywords", "keywords"), "geo": F.concat(F.lit("market of "), "target")})
    moved = F.when(F.col("geo") == "", "").otherwise(F.concat(F.lit("market of "), "geo"))
    return interest.interest_series(weekly.withColumn("geo", moved), daily.withColumn("geo", moved), analyses, W.BRAND)


# --- exogenous counts -------------------------------------------------------------------------


@query
def exog_daily_sum(spark, sf_dir):
    return exog.daily_total(W.case_counts(spark, sf_dir), ["target"])


@query
def exog_new_cases(spark, sf_dir):
    return exog.cumulative_to_daily(exog.daily_total(W.case_counts(spark, sf_dir), ["target"]), ["target"])


@query
def exog_filled(spark, sf_dir):
    analyses = W.region_analyses(spark, sf_dir, covid_usage=True)
    return exog.exog_series(W.case_counts(spark, sf_dir, with_gaps=True), analyses)


@query
def exog_smoothed(spark, sf_dir):
    analyses = W.region_analyses(spark, sf_dir, covid_usage=True, covid_smooth=True)
    return exog.exog_series(W.case_counts(spark, sf_dir, with_gaps=True), analyses)


@query
def exog_edges_filled(spark, sf_dir):
    """Linear fill over the whole life of the counts: gaps closed, unknown edges left open."""
    totals = exog.cumulative_to_daily(exog.daily_total(W.case_counts(spark, sf_dir, with_gaps=True), ["target"]), ["target"])
    extent = W.table(spark, sf_dir, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi")
    )
    days = W.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("target"),
        F.explode(D.days(extent.select("lo").scalar(), extent.select("hi").scalar())).alias("reference_date"),
    )
    joined = days.join(totals.select("target", "reference_date", "new_cases"), ["target", "reference_date"], "left")
    return exog.fill_linear(joined, ["target"], "reference_date", "new_cases")


# --- analytical dataset -----------------------------------------------------------------------


@query
def features_long(spark, sf_dir):
    usage = dict(visitor_usage=True, click_usage=True, impression_usage=True, npc_usage=True)
    return _features(spark, sf_dir, "visitor", "click", "impression", "npc", **usage)


@query
def features_wide(spark, sf_dir):
    """Columns are named beforehand: every region as target, control and visitor."""
    columns = [prefix + name.replace(" ", "_") for prefix in ("metric_in_perim_", "metric_", "visitor_") for name in W.REGIONS]
    return features.feature_wide(_features(spark, sf_dir, "visitor", visitor_usage=True), columns)


@query
def holiday_flag(spark, sf_dir):
    analyses = W.region_analyses(spark, sf_dir, add_holidays=True)
    return features.holiday_feature(runs_ops.expand_runs(analyses), W.holiday_dates(spark, sf_dir)).drop("role")


@query
def month_dummies(spark, sf_dir):
    """Twelve 0/1 columns beside the target of each day."""
    analyses, series = _series(spark, sf_dir, "target", yearly_seasonality=True)
    runs = runs_ops.expand_runs(analyses)
    dummies = features.feature_wide(features.month_dummies(runs), [f"month_{m}" for m in calendar.month_name[1:]])
    target = features.feature_long(series, runs).select(*RUN_KEYS, "reference_date", "value")
    return target.join(dummies, [*RUN_KEYS, "reference_date"])


@query
def one_hot_levels(spark, sf_dir):
    levels = {"o_orderstatus": W.ORDER_STATUSES, "o_orderpriority": W.ORDER_PRIORITIES}
    return features.indicator_columns(W.table(spark, sf_dir, "orders"), "o_orderkey", levels, {c: c for c in levels})


# --- post-processing --------------------------------------------------------------------------


@query
def dead_features(spark, sf_dir):
    return clean.dropped_features(_faulty_features(spark, sf_dir))


@query
def flat_head_trim(spark, sf_dir):
    return clean.flat_head(_faulty_features(spark, sf_dir))


@query
def clean_features(spark, sf_dir):
    return clean.clean_features(_faulty_features(spark, sf_dir))


# --- exploration ------------------------------------------------------------------------------


@query
def input_series(spark, sf_dir):
    return explore.input_series(_features(spark, sf_dir, "visitor", visitor_usage=True), "visitor")


@query
def target_bounds(spark, sf_dir):
    return explore.target_bounds(_features(spark, sf_dir))


@query(digits=6)
def target_acf(spark, sf_dir):
    return explore.acf(explore.pre_target(_features(spark, sf_dir)))


@query(digits=6)
def target_pacf(spark, sf_dir):
    return explore.pacf(explore.pre_target(_features(spark, sf_dir)))


@query
def variance_status(spark, sf_dir):
    flat = _features(spark, sf_dir).withColumn(
        "value", F.when(F.col("run_kind") == "spec", 0.0).otherwise(F.col("value"))
    )
    return explore.variance_status(explore.pre_target(flat))


@query(digits=6)
def pct_change(spark, sf_dir):
    return explore.pct_change(_features(spark, sf_dir))


@query(digits=6)
def sparse_changes(spark, sf_dir):
    return explore.sparse_changes(explore.pct_change(_features(spark, sf_dir)))


@query(digits=6)
def target_corr(spark, sf_dir):
    return explore.target_corr(explore.pct_change(_features(spark, sf_dir)))


@query(digits=6)
def corr_status(spark, sf_dir):
    return explore.corr_status(explore.pct_change(_features(spark, sf_dir)))


# --- model ------------------------------------------------------------------------------------


@query(digits=2)
def weekly_seasonal(spark, sf_dir):
    return stationarity.seasonal_additive(explore.pre_target(_features(spark, sf_dir)))


@query(digits=6)
def adf(spark, sf_dir):
    return stationarity.adf_test(stationarity.seasonal_additive(explore.pre_target(_features(spark, sf_dir))))


@query
def trend_candidates(spark, sf_dir):
    """Daily totals have no unit root, their running totals do; one region fixes its model."""
    target = explore.pre_target(_features(spark, sf_dir))
    both = target.withColumn(
        "value",
        F.when(F.col("run_kind") == "main", F.col("value")).otherwise(
            F.sum(F.col("value") - 1).over(Window.partitionBy(*RUN_KEYS).orderBy("reference_date"))
        ),
    )
    analyses = W.region_analyses(spark, sf_dir).withColumn(
        "search_model", F.when(F.col("target") == "ASIA", "semi_local_linear").otherwise("search")
    )
    verdicts = stationarity.adf_test(stationarity.seasonal_additive(both))
    return stationarity.candidates(verdicts, runs_ops.expand_runs(analyses))


def ar_order_table(spark, sf_dir) -> DataFrame:
    """Order by a low threshold on the search runs; main runs keep the fixed order 1."""
    analyses = W.region_analyses(spark, sf_dir)
    runs = runs_ops.expand_runs(analyses).withColumn("fix_order", F.col("run_kind") == "main")
    return stationarity.ar_order(explore.pre_target(_features(spark, sf_dir)), runs, threshold=0.02)


@query
def ar_order(spark, sf_dir):
    return ar_order_table(spark, sf_dir)


@query(digits=6)
def standardized(spark, sf_dir):
    return model.standardize(_features(spark, sf_dir)).select(*RUN_KEYS, "feature", "reference_date", "scaled")


@query(digits=6)
def hyperpriors(spark, sf_dir):
    return model.hyperpriors(_features(spark, sf_dir))


@query
def design_moments(spark, sf_dir):
    return model.design_moments(_features(spark, sf_dir))


@query(digits=2)
def single_control_fit(spark, sf_dir):
    return _predictions(spark, sf_dir)


@query
def gram(spark, sf_dir):
    return structural.gram(_features(spark, sf_dir))


@query(digits=6)
def sparse_fit(spark, sf_dir):
    return structural.sparse_fit(_features(spark, sf_dir))


@query(digits=6)
def importance(spark, sf_dir):
    return structural.importance(structural.sparse_fit(_features(spark, sf_dir)))


@query(digits=2)
def all_controls_fit(spark, sf_dir):
    """The target from all controls together, with its interval."""
    return structural.all_controls(_features(spark, sf_dir), two_sided_z(ALPHA))


def _monthly_runs(spark, sf_dir) -> DataFrame:
    """Runs of the regions; all but one have the second season."""
    return runs_ops.expand_runs(W.region_analyses(spark, sf_dir)).withColumn("monthly_seasonality", F.col("target") != "ASIA")


@query
def two_seasons(spark, sf_dir):
    return structural.two_seasons(structural.straight_line(_features(spark, sf_dir)), _monthly_runs(spark, sf_dir))


@query
def ar_forecast(spark, sf_dir):
    """The target carried on after the campaign start with the orders that ``ar_order`` lists."""
    series = explore.pre_target(_features(spark, sf_dir))
    return structural.ar_forecast(series, ar_order_table(spark, sf_dir), _monthly_runs(spark, sf_dir))


@query(digits=2)
def components(spark, sf_dir):
    """Every day of every run: line, two seasons, all controls, autoregression, and their sum."""
    return structural.components(_features(spark, sf_dir), _monthly_runs(spark, sf_dir), ar_order_table(spark, sf_dir))


# --- selection --------------------------------------------------------------------------------


@query(error=2, perc_error=6)
def inference_errors(spark, sf_dir):
    return effects.errors(_predictions(spark, sf_dir)).select(*RUN_KEYS, "reference_date", "error", "perc_error")


def _scores(spark, sf_dir) -> DataFrame:
    """Error of every regression candidate, the control mean first, then the controls by name."""
    return panel.scored(_regressions(spark, sf_dir))


@query(digits=6)
def candidate_mape(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(digits=6)
def candidate_mape_pre(spark, sf_dir):
    return selection.mape(_regressions(spark, sf_dir), model.FIT_KEYS, "pre")


@query(digits=6)
def selected_model(spark, sf_dir):
    return selection.select_model(_scores(spark, sf_dir))


# --- effects and diagnostics ------------------------------------------------------------------


@query(digits=2)
def point_effects(spark, sf_dir):
    return _inferences(spark, sf_dir).select(
        *RUN_KEYS, "reference_date", *[f"point_effects_{b}" for b in ("means", "lower", "upper")]
    )


@query(digits=1)
def cumulative_effects(spark, sf_dir):
    return _inferences(spark, sf_dir).select(
        *RUN_KEYS, "reference_date", *[f"post_cum_effects_{b}" for b in ("means", "lower", "upper")]
    )


@query(digits=6)
def effect_summary(spark, sf_dir):
    return _summary_shown(effects.summary(_predictions(spark, sf_dir)))


@query
def effect_sd(spark, sf_dir):
    data = effects.summary(_predictions(spark, sf_dir))
    return effects.effect_sd(data, _alphas(spark, sf_dir))


@query
def effect_report(spark, sf_dir):
    data = effects.summary(_predictions(spark, sf_dir))
    return effects.summary_report(data, _alphas(spark, sf_dir))


@query(digits=6)
def effect_probability(spark, sf_dir):
    p = effects.p_value(_predictions(spark, sf_dir))
    return p.withColumn("probability", effects.effect_probability(F.round("p_value", 6)))


@query(digits=2)
def plot_bounds(spark, sf_dir):
    return effects.plot_bounds(_inferences(spark, sf_dir))


@query(digits=2, perc_error=6)
def residuals(spark, sf_dir):
    return diagnostics.residuals(_inferences(spark, sf_dir))


@query(bin_centre=6, density=12, normal_density=12)
def residual_hist(spark, sf_dir):
    return diagnostics.residual_histogram(_residuals(spark, sf_dir))


@query(error=2, normal_density=12)
def residual_density(spark, sf_dir):
    return diagnostics.residual_density(_residuals(spark, sf_dir))


@query(digits=6)
def residual_acf(spark, sf_dir):
    return diagnostics.residual_acf(_residuals(spark, sf_dir))


@query(digits=8)
def relative_error(spark, sf_dir):
    return diagnostics.relative_error(_residuals(spark, sf_dir))


@query(digits=2, theoretical=6)
def qq_points(spark, sf_dir):
    return diagnostics.qq_points(_residuals(spark, sf_dir))


@query(digits=6)
def nation_effect_summary(spark, sf_dir):
    """The flagship summary for every nation, with all other nations as its controls."""
    analyses = W.nation_analyses(spark, sf_dir)
    fact = W.fact_marketing(spark, sf_dir, analyses)
    measures = [m for m in W.role_measures() if m.role in ("target", "control")]
    series = extract.extract_series(fact, analyses, "date", "source_medium", measures)
    long = features.feature_long(series, runs_ops.expand_runs(analyses))
    predictions = model.control_regressions(long, ALPHA, each_control=False).drop("candidate")
    return _summary_shown(effects.summary(predictions))


# --- placebo and register ---------------------------------------------------------------------


@query(digits=6)
def placebo_summary(spark, sf_dir):
    return _summary_shown(effects.summary(_predictions(spark, sf_dir).where(F.col("run_kind") == "spec")))


@query(digits=6)
def placebo_verdict(spark, sf_dir):
    p = effects.p_value(_predictions(spark, sf_dir))
    return selection.placebo_verdict(p, W.region_analyses(spark, sf_dir, spec_thr=0.95))


@query
def placebo_fit_plan(spark, sf_dir):
    """Which candidate each placebo run takes over from its main run."""
    return selection.placebo_candidates(selection.select_model(_scores(spark, sf_dir)))


@query
def stage_replaced(spark, sf_dir):
    """A stage of features after one analysis was computed again, with half the values, and one was emptied."""
    old = _features(spark, sf_dir).drop("campaign_start")
    new = old.where("analysis_id = 'ASIA'").withColumn("value", F.col("value") / 2)
    gone = W.table(spark, sf_dir, "region").select(F.col("r_name").alias("analysis_id")).where("analysis_id in ('ASIA', 'EUROPE')")
    return stages.replaced(old, new, gone)


@query
def stored_replaced(spark, sf_dir):
    """The same through the store: written, changed, and read by the manifest of the change."""
    stage = f"{_store(spark)}/features"
    old = _features(spark, sf_dir).drop("campaign_start")
    stages.write_stage(old, stage, buckets=8)
    new = stages.read_stage(spark, stage, old.schema).where("analysis_id = 'ASIA'").withColumn("value", F.col("value") / 2)
    gone = W.table(spark, sf_dir, "region").select(F.col("r_name").alias("analysis_id")).where("analysis_id in ('ASIA', 'EUROPE')")
    stages.write_stage(new, stage, gone=gone)
    return stages.read_stage(spark, stage, old.schema)


def _store(spark) -> str:
    return f"{stages.shared_folder(spark)}/liftpanel-store-{uuid.uuid4().hex}"


def _register(spark, runs: DataFrame) -> DataFrame:
    """The register of a store that these runs were saved in; columns that only a finished run has are null."""
    missing = [f for f in T.StructType.fromDDL(stages.RESULT_SCHEMAS["runs"]) if f.name not in runs.columns]
    store = _store(spark)
    stages.save_results({"runs": runs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})}, store)
    return stages.load_results(spark, store, None, None, ("runs",))["runs"]


@query
def run_listing(spark, sf_dir):
    return stages.list_runs(_register(spark, runs_ops.expand_runs(W.supplier_windows(spark, sf_dir))))


@query
def run_exists(spark, sf_dir):
    """Are the customers' market segments and regions taken as names by the region panel?"""
    segments = W.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("analysis_id"))
    wanted = segments.unionByName(W.table(spark, sf_dir, "region").select(F.col("r_name").alias("analysis_id")))
    return stages.check_names(wanted, _register(spark, runs_ops.expand_runs(W.region_analyses(spark, sf_dir))))


@query
def panel_runs(spark, sf_dir):
    """The whole pipeline on the region panel: candidates, placebo, verdict; one row per run."""
    analyses, series = _series(spark, sf_dir, "target", "control", add_holidays=True)
    tables = panel.run_panel(series, analyses, W.holiday_dates(spark, sf_dir))
    return tables["runs"].drop("elapsed_s").withColumns({c: F.round(c, 4) for c in ("mape", "p_value")})


@query
def run_deleted(spark, sf_dir):
    """The register of the saved region panel after a main run was deleted: its placebo and all others stay."""
    analyses, series = _series(spark, sf_dir, "target", "control", add_holidays=True)
    store = _store(spark)
    stages.save_results({"runs": panel.run_panel(series, analyses, W.holiday_dates(spark, sf_dir))["runs"].withColumn("elapsed_s", F.lit(None))}, store)
    stages.delete_run(spark, store, "ASIA")
    left = stages.load_results(spark, store, None, None, ("runs",))["runs"]
    return left.drop("elapsed_s").withColumns({c: F.round(c, 4) for c in ("mape", "p_value")})


def _stored_exploration(spark, sf_dir) -> dict[str, DataFrame]:
    """Explorations of the region panel's features, saved and loaded."""
    store = _store(spark)
    stages.save_results({"features": model.standardize(_features(spark, sf_dir))}, store)
    return panel.explore_run(spark, store, None, None)


@query(digits=6)
def stored_acf(spark, sf_dir):
    return _stored_exploration(spark, sf_dir)["acf"]


@query(digits=6)
def stored_corr(spark, sf_dir):
    return _stored_exploration(spark, sf_dir)["target_corr"]
