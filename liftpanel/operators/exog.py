"""Exogenous cumulative counts to gap-filled daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.operators.interest import trailing_mean


def daily_total(cumulative: DataFrame, keys) -> DataFrame:
    """Regional rows summed to one cumulative count per day."""
    return cumulative.groupBy(*keys, "reference_date").agg(F.sum("cases").alias("cases"))


def cumulative_to_daily(totals: DataFrame, keys, value: str = "cases", out: str = "new_cases") -> DataFrame:
    """Difference to the previous reported day; the first day and downward corrections are unknown."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("reference_date"))
    return totals.withColumn(out, F.when(step >= 0, step))


def fill_linear(df: DataFrame, keys, order: str, value: str, round_digits: int | None = 0) -> DataFrame:
    """Linear interpolation by row position between known values; edges stay unknown.

    All values, known ones too, are rounded to ``round_digits`` decimals (None: not at all).
    """
    ordered = Window.partitionBy(*keys).orderBy(order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("rn"), F.col(value).alias("v")))
    left, right = F.col("_left"), F.col("_right")
    slope = (right["v"] - left["v"]) / (right["rn"] - left["rn"])
    filled = F.coalesce(F.col(value), left["v"] + slope * (F.col("_rn") - left["rn"]))
    if round_digits is not None:
        filled = F.round(filled, round_digits)
    return (
        df.withColumn("_rn", F.row_number().over(ordered))
        .withColumn("_left", F.last(known, ignorenulls=True).over(before))
        .withColumn("_right", F.first(known, ignorenulls=True).over(after))
        .withColumn(value, filled)
        .drop("_rn", "_left", "_right")
    )


def smooth_known(df: DataFrame, keys, value: str, win: int = 7) -> DataFrame:
    """Trailing mean on days with a value; other days stay unknown."""
    return df.withColumn(value, F.when(F.col(value).isNotNull(), trailing_mean(value, keys, win=win)))


def on_calendar(daily: DataFrame, analyses: DataFrame, value: str = "new_cases") -> DataFrame:
    """Daily counts of each analysis' target on every day of its data window."""
    days = analyses.where("covid_usage").select(
        "analysis_id",
        "target",
        "covid_smooth",
        F.explode(D.days(D.extended_start("start", "campaign_start", "end"), "end")).alias("reference_date"),
    )
    return days.join(daily.select("target", "reference_date", value), ["target", "reference_date"], "left")


def exog_series(cumulative: DataFrame, analyses: DataFrame, win: int = 7, round_digits: int | None = 0) -> DataFrame:
    """Role series ``covid`` for all analyses from cumulative counts ``(target, reference_date, cases)``.

    An analysis whose target has no usable count gives no rows. Days before the first and after
    the last report stay unknown here and become 0 in the feature table.
    """
    daily = cumulative_to_daily(daily_total(cumulative, ["target"]), ["target"])
    known = F.count("new_cases").over(Window.partitionBy("analysis_id"))
    with_data = on_calendar(daily, analyses).withColumn("known", known).where("known > 0")
    filled = fill_linear(with_data, ["analysis_id"], "reference_date", "new_cases", round_digits)
    return (
        filled.withColumn("mean", trailing_mean("new_cases", ["analysis_id"], win=win))
        .withColumn(
            "value",
            F.when(F.col("covid_smooth") & F.col("new_cases").isNotNull(), F.col("mean")).otherwise(F.col("new_cases")),
        )
        .select(
            "analysis_id",
            F.lit("covid").alias("role"),
            F.lit("").alias("campaign_dimension"),
            "reference_date",
            "value",
        )
    )
