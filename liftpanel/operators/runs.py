"""Analyses to runs, windows and daily calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.schema import MAIN, PLACEBO, RUN_KEYS


def data_window(analyses: DataFrame) -> DataFrame:
    """Add ``data_start`` and ``data_end``: the days to load, placebo included."""
    return analyses.withColumn("data_start", D.extended_start("start", "campaign_start", "end")).withColumn(
        "data_end", F.col("end")
    )


def expand_runs(analyses: DataFrame) -> DataFrame:
    """Two rows per analysis: the real window and the equally long placebo window before it."""
    shift = D.placebo_shift("campaign_start", "end")
    windows = F.array(
        F.struct(
            F.lit(MAIN).alias("run_kind"),
            F.col("start").alias("start"),
            F.col("campaign_start").alias("campaign_start"),
            F.col("end").alias("end"),
        ),
        F.struct(
            F.lit(PLACEBO).alias("run_kind"),
            F.date_sub("start", shift).alias("start"),
            F.date_sub("campaign_start", shift).alias("campaign_start"),
            F.date_sub("campaign_start", 1).alias("end"),
        ),
    )
    rest = [c for c in analyses.columns if c not in ("analysis_id", "start", "campaign_start", "end")]
    return analyses.select("analysis_id", F.inline(windows), *rest)


def spine(runs: DataFrame) -> DataFrame:
    """One row per run and day, both ends included."""
    return runs.select(
        *RUN_KEYS, "campaign_start", F.explode(D.days("start", "end")).alias("reference_date")
    )


def month_ranges(windows: DataFrame, keys) -> DataFrame:
    """The whole months to copy for each analysis, as (month_start, month_end)."""
    lo = D.whole_month_start("start", "campaign_start", "end")
    return windows.select(
        *keys, F.explode(D.month_starts(lo, D.whole_month_end("end"))).alias("month_start")
    ).select(*keys, "month_start", F.last_day("month_start").alias("month_end"))


def month_slices(windows: DataFrame, keys) -> DataFrame:
    """Month-wise fetch plan between the week-aligned ends of each data window.

    The last day is always part of a slice, also when it is the first of a month.
    """
    lo, hi = D.week_start("data_start"), D.week_end("data_end")
    first = F.greatest(F.col("month_start"), F.col("lo"))
    last = D.month_end_within("month_start", "hi")
    return (
        windows.select(*keys, lo.alias("lo"), hi.alias("hi"))
        .select(*keys, "lo", "hi", F.explode(D.month_starts("lo", "hi")).alias("month_start"))
        .select(*keys, first.alias("slice_start"), last.alias("slice_end"), D.timeframe(first, last).alias("timeframe"))
    )
