"""Calendar arithmetic as column expressions (dates only, so no time zone can shift a day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def placebo_shift(campaign_start, end) -> Column:
    """Days by which the placebo window lies before the real one: the campaign's length."""
    return F.datediff(_c(end), _c(campaign_start)) + 1


def extended_start(start, campaign_start, end) -> Column:
    """First day that has to be loaded so that the placebo has a full training period."""
    return F.date_sub(_c(start), placebo_shift(campaign_start, end))


def whole_month_start(start, campaign_start, end) -> Column:
    return F.trunc(extended_start(start, campaign_start, end), "MM")


def whole_month_end(end) -> Column:
    return F.last_day(_c(end))


def month_starts(lo, hi) -> Column:
    """Array with the first day of every month that [lo, hi] touches."""
    return F.sequence(F.trunc(_c(lo), "MM"), F.trunc(_c(hi), "MM"), F.expr("interval 1 month"))


def join_windows(rows: DataFrame, windows: DataFrame, on: list[str], lo: str, hi: str) -> DataFrame:
    """Join daily rows to the windows [lo, hi] that hold their ``reference_date``.

    Windows are spread over the months they touch and the month joins the key. A key that most
    windows ask for (a popular control, the brand) is thereby split by time instead of meeting all
    its rows in one task, and rows are only compared with windows of their own month.
    """
    spread = windows.withColumn("_month", F.explode(month_starts(lo, hi)))
    return (
        rows.withColumn("_month", F.trunc("reference_date", "MM"))
        .join(spread, [*on, "_month"])
        .where(F.col("reference_date").between(F.col(lo), F.col(hi)))
        .drop("_month")
    )


def days(lo, hi) -> Column:
    """Array with every day of [lo, hi]."""
    return F.sequence(_c(lo), _c(hi), F.expr("interval 1 day"))


def week_start(d) -> Column:
    """The Sunday on or before ``d``."""
    return F.date_sub(_c(d), F.dayofweek(_c(d)) - 1)


def week_end(d) -> Column:
    """The Saturday on or after ``d``."""
    return F.next_day(F.date_sub(_c(d), 1), "SAT")


def month_end_within(d, end) -> Column:
    return F.least(F.last_day(_c(d)), _c(end))


def timeframe(lo, hi) -> Column:
    """Label of a fetch slice, ``yyyy-MM-dd yyyy-MM-dd``."""
    return F.concat_ws(" ", _c(lo).cast("string"), _c(hi).cast("string"))


def month_key(d) -> Column:
    """``yyyy-M``, the month without padding."""
    return F.concat_ws("-", F.year(_c(d)), F.month(_c(d)))


def month_name(d) -> Column:
    """Full English month name."""
    return F.date_format(_c(d), "MMMM")


def period(d, campaign_start) -> Column:
    return F.when(_c(d) < _c(campaign_start), "pre").otherwise("post")
