"""Post-processing of the analytical dataset: dead regressors, flat start, period rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.schema import DUMMY_ROLES, RUN_KEYS

# The least history before and after the campaign start.
MIN_PRE_MONTHS = 6
MIN_POST_DAYS = 10
MIN_PRE_MONTHS_YEARLY = 24


def _pre():
    return F.col("reference_date") < F.col("campaign_start")


def _pre_value(use_abs: bool):
    return F.when(_pre(), F.abs("value") if use_abs else F.col("value"))


def dropped_features(features: DataFrame, use_abs: bool = False) -> DataFrame:
    """Regressors whose values before the campaign sum to 0; target and dummies are exempt.

    ``use_abs`` keeps columns whose positive and negative values only cancel out.
    """
    return (
        features.where(~F.col("role").isin("target", *DUMMY_ROLES))
        .groupBy(*RUN_KEYS, "feature")
        .agg(F.sum(_pre_value(use_abs)).alias("pre_sum"))
        .where(F.col("pre_sum") == 0)
        .select(*RUN_KEYS, "feature", F.lit("pre-period sum is 0").alias("reason"))
    )


def drop_dead_features(features: DataFrame, use_abs: bool = False) -> DataFrame:
    """Drop what dropped_features lists, in the features' own partitioning: no second read, no join."""
    pre_sum = F.sum(_pre_value(use_abs)).over(Window.partitionBy(*RUN_KEYS, "feature"))
    exempt = F.col("role").isin("target", *DUMMY_ROLES)
    return (
        features.withColumn("_pre_sum", pre_sum)
        .where(exempt | F.col("_pre_sum").isNull() | (F.col("_pre_sum") != 0))
        .drop("_pre_sum")
    )


def _with_flat_until(features: DataFrame, win: int) -> DataFrame:
    """Add ``flat_until`` to the target's rows: the last day of its flat start, null if there is none.

    A day is flat if the target did not vary over the trailing ``win`` days. The first day of the
    series is not looked at: a single value never varies.
    """
    per_feature = Window.partitionBy(*RUN_KEYS, "feature")
    by_day = per_feature.orderBy(F.unix_date("reference_date"))
    target = F.when((F.col("role") == "target") & _pre(), F.col("value"))
    considered = target.isNotNull() & (F.col("_rn") > 1)
    live = F.min(F.when(considered & (F.col("_std") != 0), F.col("reference_date"))).over(per_feature)
    before_live = F.col("_live").isNull() | (F.col("reference_date") < F.col("_live"))
    flat = considered & (F.col("_std") == 0) & before_live
    return (
        features.withColumn("_std", F.stddev_pop(target).over(by_day.rangeBetween(-(win - 1), 0)))
        .withColumn("_rn", F.row_number().over(by_day))
        .withColumn("_live", live)
        .withColumn("flat_until", F.max(F.when(flat, F.col("reference_date"))).over(per_feature))
        .drop("_std", "_rn", "_live")
    )


def flat_head(features: DataFrame, win: int = 7) -> DataFrame:
    """Last day of the target's flat start per run; null where the target moves from the second day on."""
    target = features.where(F.col("role") == "target")
    return _with_flat_until(target, win).groupBy(*RUN_KEYS).agg(F.max("flat_until").alias("flat_until"))


def trim_flat_head(features: DataFrame, win: int = 7) -> DataFrame:
    """Drop every feature's days up to the end of the target's flat start.

    Only the target's rows are looked at; their one day per run meets the features again, which stay
    where they are if that small side is broadcast.
    """
    return (
        features.join(flat_head(features, win), RUN_KEYS, "left")
        .where(F.col("flat_until").isNull() | (F.col("reference_date") > F.col("flat_until")))
        .drop("flat_until")
    )


def clean_features(features: DataFrame, use_abs: bool = False, win: int = 7) -> DataFrame:
    return trim_flat_head(drop_dead_features(features, use_abs), win)


def check_periods(features: DataFrame, runs: DataFrame) -> DataFrame:
    """One status row per run: enough history before and after the campaign start?"""
    extent = features.where(F.col("role") == "target").groupBy(*RUN_KEYS).agg(
        F.min("reference_date").alias("first_day"), F.max("reference_date").alias("last_day")
    )
    cs = F.col("campaign_start")
    pre_ok = F.add_months("first_day", MIN_PRE_MONTHS) <= cs
    post_ok = F.datediff("last_day", cs) >= MIN_POST_DAYS
    yearly_ok = ~F.col("yearly_seasonality") | (F.add_months("first_day", MIN_PRE_MONTHS_YEARLY) <= cs)
    ok = F.coalesce(pre_ok & post_ok & yearly_ok, F.lit(False))
    return (
        runs.select(*RUN_KEYS, "campaign_start", "yearly_seasonality")
        .join(extent, RUN_KEYS, "left")
        .select(
            *RUN_KEYS,
            "first_day",
            "last_day",
            F.coalesce(pre_ok, F.lit(False)).alias("pre_ok"),
            F.coalesce(post_ok, F.lit(False)).alias("post_ok"),
            F.coalesce(yearly_ok, F.lit(False)).alias("yearly_ok"),
            F.when(ok, "ok").otherwise("period too short").alias("status"),
        )
    )


def require_periods(status: DataFrame) -> None:
    """Strict mode: raise if any run breaks the period rules; ``status`` says which."""
    bad = status.where(F.col("status") != "ok").count()
    if bad:
        raise ValueError(f"start, campaign_start or end leave too little data for {bad} runs; check_periods lists them by status")
