"""Search-interest series: monthly-scaled daily interest per analysis and keyword.

Weekly interest is comparable over the whole window, daily interest only within its month. The
daily values are therefore scaled by their month's share of the best month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions import dates as D

SERIES_KEYS = ["analysis_id", "keyword"]
# The brand's label may be a keyword too; the two are different series.
ALL_KEYS = [*SERIES_KEYS, "is_brand"]


def brand_label(brand: str) -> str:
    return f"global_{brand}"


def interest_requests(analyses: DataFrame, brand: str | None = None) -> DataFrame:
    """Keywords each analysis needs, in its market ``geo``, plus the world-wide brand series.

    The brand is used by every analysis with interest enabled, the keywords only with ``gtrend_usage``.
    """
    keywords = F.transform(
        F.when(F.col("gtrend_usage"), F.array_compact(F.array_distinct("keywords"))).otherwise(F.array().cast("array<string>")),
        lambda k: F.struct(F.col("geo"), k.alias("source_keyword"), k.alias("keyword"), F.lit(False).alias("is_brand")),
    )
    wanted = keywords
    if brand is not None:
        brand_row = F.struct(
            F.lit("").alias("geo"), F.lit(brand).alias("source_keyword"), F.lit(brand_label(brand)).alias("keyword"), F.lit(True).alias("is_brand")
        )
        wanted = F.concat(keywords, F.array(brand_row))
    return analyses.where(~F.col("disable_gtrend")).select(
        "analysis_id",
        "gtrend_smooth",
        D.week_start(D.extended_start("start", "campaign_start", "end")).alias("from_day"),
        D.week_end("end").alias("to_day"),
        F.inline(wanted),
    )


def interest_for_analyses(interest: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of an interest table that fall into the week-aligned window of each request."""
    rows = interest.withColumnRenamed("keyword", "source_keyword")
    matched = D.join_windows(rows, requests, ["geo", "source_keyword"], "from_day", "to_day")
    return matched.select(*SERIES_KEYS, "is_brand", "gtrend_smooth", "reference_date", "value")


def monthly_scale(weekly: DataFrame, keys=ALL_KEYS) -> DataFrame:
    """Scale of a month: its sum of weekly values over the largest monthly sum."""
    by_month = weekly.groupBy(*keys, D.month_key("reference_date").alias("month")).agg(
        F.sum("value").alias("month_sum")
    )
    best = F.max("month_sum").over(Window.partitionBy(*keys))
    return by_month.withColumn("scale_factor", F.try_divide(F.col("month_sum"), best))


def rescale_interest(daily: DataFrame, scale: DataFrame, keys=ALL_KEYS) -> DataFrame:
    """Daily value times the scale of its month; null where the month has no weekly data."""
    return (
        daily.withColumn("month", D.month_key("reference_date"))
        .join(scale.select(*keys, "month", "scale_factor"), [*keys, "month"], "left")
        .withColumn("value", F.col("value") * F.col("scale_factor"))
        .drop("month", "scale_factor")
    )


def trailing_mean(value: str, keys, order: str = "reference_date", win: int = 7):
    """Mean over the last ``win`` calendar days; missing days and nulls do not count."""
    window = Window.partitionBy(*keys).orderBy(F.unix_date(order)).rangeBetween(-(win - 1), 0)
    return F.avg(value).over(window)


def smooth_interest(series: DataFrame, keys=ALL_KEYS, win: int = 7) -> DataFrame:
    """Smooth the series of analyses that ask for it; null days are dropped, the brand is exempt."""
    exempt = ~F.col("gtrend_smooth") | F.col("is_brand")
    return (
        series.where(exempt | F.col("value").isNotNull())
        .withColumn("mean", trailing_mean("value", keys, win=win))
        .withColumn("value", F.when(exempt, F.col("value")).otherwise(F.col("mean")))
        .drop("mean")
    )


def interest_series(
    weekly: DataFrame, daily: DataFrame, analyses: DataFrame, brand: str | None = None, win: int = 7
) -> DataFrame:
    """Role series ``gtrend`` for all analyses.

    Keywords without weekly or without daily data give no rows: nothing could be scaled.
    """
    requests = interest_requests(analyses, brand)
    scale = monthly_scale(interest_for_analyses(weekly, requests))
    known = F.count("value").over(Window.partitionBy(*ALL_KEYS))
    scaled = (
        rescale_interest(interest_for_analyses(daily, requests), scale)
        .withColumn("known", known)
        .where("known > 0")
        .drop("known")
    )
    return smooth_interest(scaled, win=win).select(
        "analysis_id",
        F.lit("gtrend").alias("role"),
        F.col("keyword").alias("campaign_dimension"),
        "reference_date",
        "value",
    )
