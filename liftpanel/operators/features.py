"""The analytical dataset: one long table of features on a gap-free calendar, wide on demand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.schema import ROLE_ORDER, ROLE_PREFIX, RUN_KEYS

FEATURE_COLUMNS = [*RUN_KEYS, "campaign_start", "role", "feature", "reference_date", "value"]


def feature_name(role: Column, dim: Column) -> Column:
    """Prefix of the role plus the dimension value, blanks as underscores. Different features may share a name."""
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_PREFIX.items() for x in kv]), role)
    name = F.when(role == "covid", prefix).otherwise(F.concat(prefix, dim))
    return F.regexp_replace(name, " ", "_")


def full_name() -> Column:
    """Display name with role and dimension value as they are: no two features have the same."""
    return F.concat_ws("~", "feature", "role", "campaign_dimension")


def shared_names(series: DataFrame) -> DataFrame:
    """``analysis_id, feature, role, campaign_dimension, status`` for features whose display name others have too."""
    identity = ["analysis_id", "role", "campaign_dimension"]
    named = series.select(*identity).distinct().withColumn("feature", feature_name(F.col("role"), F.col("campaign_dimension")))
    same = F.count(F.lit(1)).over(Window.partitionBy("analysis_id", "feature"))
    return named.withColumn("same", same).where("same > 1").select(
        "analysis_id", "feature", "role", "campaign_dimension", F.concat(F.lit("name shared, shown as "), full_name()).alias("status")
    )


def feature_long(series: DataFrame, runs: DataFrame) -> DataFrame:
    """Series on the daily calendar of every run, missing days as 0.

    The target always exists, every other feature exists if its analysis has at least one row of it
    in the loaded range. Each observed day also stands for the gap up to the next one, so the
    calendar is filled by looking one row ahead: the series are read once and shuffled once, by
    analysis and feature, and everything that later works per feature finds them already in place.

    A feature is a role and a dimension value. Where several of an analysis have one display name, each gets
    role and value added to it, so ``feature`` tells them apart; see ``shared_names``.
    """
    windows = runs.select(*RUN_KEYS, "campaign_start", "start", "end")
    # The runs of an analysis cover its whole data window; the marker makes the target exist.
    data = runs.groupBy("analysis_id").agg(
        F.min("start").alias("data_start"), F.max("end").alias("data_end"), F.first("target").alias("target")
    )
    marker = data.select(
        "analysis_id",
        F.lit("target").alias("role"),
        F.col("target").alias("campaign_dimension"),
        F.col("data_start").alias("reference_date"),
        F.lit(None).cast("double").alias("value"),
    )
    # Features that share a name share a partition, so whether a name is unique needs no shuffle of its own.
    per_feature = ["analysis_id", "feature", "role", "campaign_dimension"]
    by_day = (
        series.select(marker.columns)
        .unionByName(marker)
        .withColumn("feature", feature_name(F.col("role"), F.col("campaign_dimension")))
        .repartition("analysis_id", "feature")
        .groupBy(*per_feature, "reference_date")
        .agg(F.sum("value").alias("value"))
        .join(data.select("analysis_id", "data_start", "data_end"), "analysis_id")
        .where(F.col("reference_date").between(F.col("data_start"), F.col("data_end")))
    )
    identity = F.struct("role", F.coalesce("campaign_dimension", F.lit("")).alias("campaign_dimension"))
    same_name = Window.partitionBy("analysis_id", "feature")
    shared = F.min(identity).over(same_name) != F.max(identity).over(same_name)
    ordered = Window.partitionBy(*per_feature).orderBy("reference_date")
    first = F.when(F.lag("reference_date").over(ordered).isNull(), F.col("data_start"))
    following = F.lead("reference_date").over(ordered)
    return (
        by_day.withColumn("shared", shared)
        .withColumn("from_day", F.coalesce(first, F.col("reference_date")))
        .withColumn("to_day", F.coalesce(F.date_sub(following, 1), F.col("data_end")))
        .select(
            "analysis_id",
            "role",
            F.when(F.col("shared"), full_name()).otherwise(F.col("feature")).alias("feature"),
            F.col("reference_date").alias("observed_day"),
            "value",
            F.explode(D.days("from_day", "to_day")).alias("reference_date"),
        )
        .join(windows, "analysis_id")
        .where(F.col("reference_date").between(F.col("start"), F.col("end")))
        .withColumn(
            "value",
            F.when(F.col("reference_date") == F.col("observed_day"), F.coalesce("value", F.lit(0.0))).otherwise(0.0),
        )
        .select(FEATURE_COLUMNS)
    )


def flag_holiday(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Add ``flag_holiday`` (1.0/0.0) by country and day; a day without a country is no holiday."""
    known = holidays.select("country", F.col("date").alias("reference_date")).distinct()
    return (
        days.join(known.withColumn("is_holiday", F.lit(1.0)), ["country", "reference_date"], "left")
        .withColumn("flag_holiday", F.coalesce("is_holiday", F.lit(0.0)))
        .drop("is_holiday")
    )


def holiday_feature(runs: DataFrame, holidays: DataFrame) -> DataFrame:
    days = runs.where("add_holidays").select(
        *RUN_KEYS, "campaign_start", "country", F.explode(D.days("start", "end")).alias("reference_date")
    )
    return flag_holiday(days, holidays).select(
        *RUN_KEYS,
        "campaign_start",
        F.lit("holiday").alias("role"),
        F.lit(ROLE_PREFIX["holiday"]).alias("feature"),
        "reference_date",
        F.col("flag_holiday").alias("value"),
    )


def month_dummies(runs: DataFrame, drop_first: bool = False) -> DataFrame:
    """0/1 features for the months that occur in a run's window, by exploding its own calendar.

    All levels are kept unless ``drop_first``, which leaves out the alphabetically first one.
    """
    levels = F.array_sort(
        F.array_distinct(F.transform(D.month_starts("start", "end"), lambda d: D.month_name(d)))
    )
    if drop_first:
        levels = F.slice(levels, F.lit(2), F.size(levels))
    return (
        runs.where("yearly_seasonality")
        .select(*RUN_KEYS, "campaign_start", levels.alias("levels"), F.explode(D.days("start", "end")).alias("reference_date"))
        .select(*RUN_KEYS, "campaign_start", "reference_date", F.explode("levels").alias("level"))
        .select(
            *RUN_KEYS,
            "campaign_start",
            F.lit("month").alias("role"),
            F.concat(F.lit(ROLE_PREFIX["month"]), "level").alias("feature"),
            "reference_date",
            F.when(D.month_name("reference_date") == F.col("level"), 1.0).otherwise(0.0).alias("value"),
        )
    )


def level_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long form of categorical columns: ``key, column, level``, a row for each that is known."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("pair")
    return df.select(key, pairs).select(key, "pair.*").where("level is not null")


def indicator_columns(df: DataFrame, key: str, levels: dict[str, list[str]], prefix: dict[str, str]) -> DataFrame:
    """``key`` and a 0/1 column ``<prefix>_<level>`` for each level that the caller names, with one prefix for each column.

    Long rows meet the wanted levels, and each key's own levels come back as a set; levels nobody named
    are passed over, and a key without any has zeros.
    """
    names = [prefix[c] + "_" + str(level) for c in levels for level in levels[c]]
    if len(set(names)) < len(names):
        raise ValueError("two levels would get the same column, give the columns other prefixes")
    tag = F.concat_ws("=", "column", "level")
    own = level_rows(df, key, list(levels)).groupBy(key).agg(F.collect_set(tag).alias("tags"))
    wanted = [f"{c}={level}" for c in levels for level in levels[c]]
    has = [F.coalesce(F.array_contains("tags", tag), F.lit(False)).cast("int").alias(name) for tag, name in zip(wanted, names, strict=True)]
    return df.select(key).distinct().join(own, key, "left").select(key, *has)


def analytical_dataset(series: DataFrame, runs: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Every feature of every run, long: series, holiday flag and month dummies."""
    parts = [feature_long(series, runs), month_dummies(runs)]
    if holidays is not None:
        parts.append(holiday_feature(runs, holidays))
    return reduce(DataFrame.unionByName, parts)


def feature_columns(features: DataFrame) -> list[str]:
    """Column order of the wide table: target, then regressors by role and name (names only are collected)."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_ORDER.items() for x in kv]), F.col("role"))
    rows = features.select(order.alias("ord"), "feature").distinct().orderBy("ord", "feature").collect()
    return [r["feature"] for r in rows]


def feature_wide(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Wide view: reference_date, target, regressors; one pivot whatever the number of features."""
    columns = columns if columns is not None else feature_columns(features)
    return features.groupBy(*RUN_KEYS, "reference_date").pivot("feature", columns).agg(F.sum("value"))
