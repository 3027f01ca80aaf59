"""Scaling, prior scales, design sums, and the candidate predictions: least squares by aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions.normal import two_sided_z, with_normal_quantile
from liftpanel.schema import DUMMY_ROLES, RUN_KEYS

# Fixed value: spread of the trend's prior relative to the target's, see hyperpriors.
PRIOR_SPREAD = 0.1

FIT_KEYS = [*RUN_KEYS, "candidate"]
# Names of candidates that are not single controls.
CONTROL_MEAN, WEEKLY_TREND = "control_mean", "weekly_trend"


def standardize(features: DataFrame, scope: str = "pre") -> DataFrame:
    """Add ``mean``, ``std`` and ``scaled`` per feature; dummies pass through unscaled.

    ``scope`` says which days give mean and standard deviation: those before the campaign ('pre')
    or all ('full'). A feature without variance is only centred.
    """
    if scope not in ("pre", "full"):
        raise ValueError(f"unknown scope {scope!r}")
    used = F.col("value")
    if scope == "pre":
        used = F.when(F.col("reference_date") < F.col("campaign_start"), used)
    per_feature = Window.partitionBy(*RUN_KEYS, "feature")
    dummy = F.col("role").isin(*DUMMY_ROLES)
    return (
        features.withColumn("mean", F.when(dummy, 0.0).otherwise(F.avg(used).over(per_feature)))
        .withColumn("std", F.when(dummy, 1.0).otherwise(F.stddev_pop(used).over(per_feature)))
        .withColumn(
            "scaled",
            (F.col("value") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0),
        )
    )


def hyperpriors(features: DataFrame) -> DataFrame:
    """Inverse-gamma prior of the trend's scales from the target before the campaign.

    Mean and spread are those of the target scaled over the full window (on its own scale the mean
    would be 0); they follow from four plain aggregates, the scaled series itself is not needed.
    """
    before = F.when(F.col("reference_date") < F.col("campaign_start"), F.col("value"))
    m = F.try_divide(F.abs(F.col("pre_mean") - F.col("full_mean")), F.col("full_std"))
    s = F.try_divide(F.col("pre_std"), F.col("full_std")) * PRIOR_SPREAD
    ratio = F.try_divide(F.col("m") * F.col("m"), F.col("s") * F.col("s"))
    return (
        features.where(F.col("role") == "target")
        .groupBy(*RUN_KEYS)
        .agg(
            F.avg(before).alias("pre_mean"),
            F.stddev_pop(before).alias("pre_std"),
            F.avg("value").alias("full_mean"),
            F.stddev_pop("value").alias("full_std"),
        )
        .select(*RUN_KEYS, m.alias("m"), s.alias("s"))
        .select(
            *RUN_KEYS,
            (ratio + 2).alias("prior_alpha"),
            (F.col("m") * (ratio + 1)).alias("prior_beta"),
        )
    )


def design_moments(features: DataFrame, scope: str = "pre") -> DataFrame:
    """Per regressor, before the campaign: rows, sum of squares and product sum with the target, scaled."""
    scaled = standardize(features, scope).where(F.col("reference_date") < F.col("campaign_start"))
    day = Window.partitionBy(*RUN_KEYS, "reference_date")
    with_target = scaled.withColumn("y", F.max(F.when(F.col("role") == "target", F.col("scaled"))).over(day))
    return (
        with_target.where(F.col("role") != "target")
        .groupBy(*RUN_KEYS, "feature")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("scaled") * F.col("scaled")).alias("xx"),
            F.sum(F.col("scaled") * F.col("y")).alias("xy"),
        )
    )


def _with_z(fitted: DataFrame, alpha: float, alphas: DataFrame | None) -> DataFrame:
    """Add the two-sided normal quantile of each run's own level, or of the one level for all."""
    if alphas is None:
        return fitted.withColumn("z", F.lit(two_sided_z(alpha)))
    level = alphas.select(*RUN_KEYS, (1 - F.col("alpha") / 2).alias("tail"))
    return fitted.join(with_normal_quantile(level, "tail", "z").drop("tail"), RUN_KEYS, "left")


def _with_bounds(rows: DataFrame) -> DataFrame:
    margin = F.col("z") * F.col("sd")
    return rows.select(
        *FIT_KEYS, "campaign_start", "reference_date", "observed", "mean",
        (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"), "sd",
    )


def control_regressions(features: DataFrame, alpha: float = 0.05, alphas: DataFrame | None = None, each_control: bool = True) -> DataFrame:
    """Quick predictions without a state space: the target on one regressor by least squares.

    Candidates are the mean of the controls (``control_mean``, the first) and, unless switched off, every
    control alone. Slope, intercept and residual spread come from the days before the campaign, as aggregates
    that meet the days again as one row per candidate. ``alphas (RUN_KEYS, alpha)`` gives each run its own
    level, otherwise ``alpha`` holds for all.
    """
    is_target = F.col("role") == "target"
    days = [*RUN_KEYS, "campaign_start", "reference_date"]
    used = features.where(F.col("role").isin("target", "control"))
    by_day = used.groupBy(*days).agg(
        F.max(F.when(is_target, F.col("value"))).alias("observed"), F.avg(F.when(~is_target, F.col("value"))).alias("x")
    )
    rows = by_day.select(*days, F.lit(CONTROL_MEAN).alias("candidate"), "observed", "x")
    if each_control:
        single = used.where(~is_target).select(*days, F.col("feature").alias("candidate"), F.col("value").alias("x"))
        rows = rows.unionByName(single.join(by_day.select(*days, "observed"), days).select(*rows.columns))
    before = rows.where(F.col("reference_date") < F.col("campaign_start"))
    slope = F.coalesce("slope", F.lit(0.0))
    spread = F.col("var_y") - 2 * slope * F.col("cov") + slope * slope * F.col("var_x")
    fitted = (
        before.groupBy(*FIT_KEYS)
        .agg(
            F.regr_slope("observed", "x").alias("slope"),
            F.avg("x").alias("centre_x"),
            F.avg("observed").alias("centre_y"),
            F.var_pop("observed").alias("var_y"),
            F.var_pop("x").alias("var_x"),
            F.covar_pop("observed", "x").alias("cov"),
        )
        .select(*FIT_KEYS, slope.alias("slope"), "centre_x", "centre_y", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sd"))
    )
    mean = F.col("centre_y") + F.col("slope") * (F.col("x") - F.col("centre_x"))
    return _with_bounds(rows.join(_with_z(fitted, alpha, alphas), FIT_KEYS).withColumn("mean", mean))


def trend_regression(features: DataFrame, alpha: float = 0.05, alphas: DataFrame | None = None) -> DataFrame:
    """Candidate ``weekly_trend``: a straight line through the days before the campaign plus the mean rest of each weekday."""
    number, weekday = F.unix_date("reference_date").alias("number"), F.dayofweek("reference_date").alias("weekday")
    target = features.where(F.col("role") == "target")
    days = target.select(*RUN_KEYS, "campaign_start", "reference_date", number, weekday, F.col("value").alias("observed"))
    before = F.col("reference_date") < F.col("campaign_start")
    line = days.where(before).groupBy(*RUN_KEYS).agg(
        F.coalesce(F.regr_slope("observed", "number"), F.lit(0.0)).alias("slope"), F.avg("number").alias("centre_x"), F.avg("observed").alias("centre_y")
    )
    straight = F.col("centre_y") + F.col("slope") * (F.col("number") - F.col("centre_x"))
    on_line = days.join(line, RUN_KEYS).withColumn("line", straight).withColumn("rest", F.col("observed") - straight)
    phases = on_line.where(before).groupBy(*RUN_KEYS, "weekday").agg(F.avg("rest").alias("phase"), F.count("rest").alias("n"), F.sum(F.col("rest") ** 2).alias("squares"))
    # The rest of a weekday has its mean as centre, so its squared sum splits into mean and spread.
    left = F.sum(F.col("squares") - F.col("n") * F.col("phase") ** 2)
    spread = phases.groupBy(*RUN_KEYS).agg(F.sqrt(F.greatest(left / F.sum("n"), F.lit(0.0))).alias("sd"))
    rows = on_line.join(phases.select(*RUN_KEYS, "weekday", "phase"), [*RUN_KEYS, "weekday"], "left").join(_with_z(spread, alpha, alphas), RUN_KEYS)
    mean = F.col("line") + F.coalesce("phase", F.lit(0.0))
    return _with_bounds(rows.withColumn("mean", mean).withColumn("candidate", F.lit(WEEKLY_TREND)))


def candidate_order() -> Column:
    """Sort key of candidates: the mean of the controls, each control by name, the trend."""
    return F.struct(F.col("candidate") == WEEKLY_TREND, F.col("candidate") != CONTROL_MEAN, F.col("candidate"))


def all_candidates(features: DataFrame, alphas: DataFrame) -> DataFrame:
    """Predictions of every candidate of every run, at each run's own level."""
    return control_regressions(features, alphas=alphas).unionByName(trend_regression(features, alphas=alphas))
