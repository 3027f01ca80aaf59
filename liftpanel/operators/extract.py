"""Daily role series from fact tables.

The fact is read once and reduced to one row per day and dimension value, for all roles together,
*before* it meets the analyses. Overlapping windows of many analyses thus multiply the small daily
table, never the fact, and a dimension value that holds a third of the fact is combined on the map
side instead of being shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.schema import ROLE_VALUE


@dataclass(frozen=True)
class RoleMeasure:
    """What a role sums and which fact rows count for it."""

    role: str
    value: Column
    where: Column | None = None

    @property
    def condition(self) -> Column:
        return F.lit(True) if self.where is None else self.where


def out_of_perimeter(perimeter: Column, mode: str = "complement") -> Column:
    """Rows outside a perimeter.

    ``complement`` puts every row that is not inside outside, rows with unknown dimensions too.
    ``as_written`` is the plain negation: where the perimeter is unknown the row is on neither side.
    """
    if mode == "complement":
        return ~F.coalesce(perimeter, F.lit(False))
    if mode == "as_written":
        return ~perimeter
    raise ValueError(f"unknown perimeter mode {mode!r}")


def daily_roles(fact: DataFrame, date_col: str, dim_col: str, measures: list[RoleMeasure]) -> DataFrame:
    """(role, campaign_dimension, reference_date, value): one scan and one aggregate for all roles."""
    if all(m.where is not None for m in measures):
        fact = fact.where(reduce(lambda a, b: a | b, [m.where for m in measures]))
    sums = [
        column
        for m in measures
        for column in (
            F.sum(F.when(m.condition, m.value)).cast("double").alias(f"{m.role}_value"),
            F.count_if(m.condition).alias(f"{m.role}_rows"),
        )
    ]
    by_day = fact.groupBy(F.col(date_col).alias("reference_date"), F.col(dim_col).alias("campaign_dimension")).agg(*sums)
    roles = F.array(
        *[
            F.struct(
                F.lit(m.role).alias("role"),
                F.col(f"{m.role}_value").alias("value"),
                F.col(f"{m.role}_rows").alias("rows"),
            )
            for m in measures
        ]
    )
    return (
        by_day.select("reference_date", "campaign_dimension", F.inline(roles))
        .where(F.col("rows") > 0)
        .select("role", "campaign_dimension", "reference_date", "value")
    )


def role_requests(analyses: DataFrame) -> DataFrame:
    """Which dimension values each analysis needs in which role; roles switched off give no row."""
    target = F.array(F.col("target"))
    # A list is a set: naming a dimension twice does not count it twice.
    controls = F.array_compact(F.array_distinct("controls"))
    wanted = F.array(
        *[
            F.struct(F.lit(role).alias("role"), dims.alias("dims"), enabled.alias("enabled"))
            for role, dims, enabled in (
                ("target", target, F.lit(True)),
                ("out_perim", target, F.col("out_perim_usage")),
                ("control", controls, F.lit(True)),
                ("visitor", controls, F.col("visitor_usage")),
                ("click", controls, F.col("click_usage")),
                ("impression", controls, F.col("impression_usage")),
                ("npc", controls, F.col("npc_usage")),
            )
        ]
    )
    return (
        analyses.select(
            "analysis_id",
            D.extended_start("start", "campaign_start", "end").alias("data_start"),
            F.col("end").alias("data_end"),
            F.inline(wanted),
        )
        .where("enabled")
        .select("analysis_id", "data_start", "data_end", "role", F.explode("dims").alias("campaign_dimension"))
    )


def series_for_analyses(daily: DataFrame, analyses: DataFrame) -> DataFrame:
    """Hand the daily role table out to the analyses: hash join on role, dimension and month."""
    matched = D.join_windows(
        daily, role_requests(analyses), ["role", "campaign_dimension"], "data_start", "data_end"
    )
    return matched.select("analysis_id", "role", "campaign_dimension", "reference_date", "value")


def extract_series(
    fact: DataFrame, analyses: DataFrame, date_col: str, dim_col: str, measures: list[RoleMeasure]
) -> DataFrame:
    """All role series of all analyses from one pass over the fact."""
    return series_for_analyses(daily_roles(fact, date_col, dim_col, measures), analyses)


def extract_role(fact: DataFrame, analyses: DataFrame, date_col: str, dim_col: str, measure: RoleMeasure) -> DataFrame:
    """One role's series, with the value column named after the role."""
    return extract_series(fact, analyses, date_col, dim_col, [measure]).select(
        "analysis_id",
        "reference_date",
        "campaign_dimension",
        F.col("value").alias(ROLE_VALUE[measure.role]),
    )
