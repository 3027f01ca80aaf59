"""Error of the candidates, the winner per run, the run table and the placebo verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.operators.effects import errors
from liftpanel.schema import MAIN, PLACEBO, RUN_KEYS


def mape(predictions: DataFrame, keys, scope: str = "all") -> DataFrame:
    """Mean absolute percentage error; days with observed 0 do not count.

    ``scope`` 'all' takes every day of the run, 'pre' only those before the campaign.
    """
    if scope not in ("all", "pre"):
        raise ValueError(f"unknown scope {scope!r}")
    rows = errors(predictions)
    if scope == "pre":
        rows = rows.where(F.col("reference_date") < F.col("campaign_start"))
    return rows.groupBy(*keys).agg(F.avg(F.abs("perc_error")).alias("mape"))


def select_model(scores: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """The candidate with the lowest error per run, the first of equals; unscored ones lose."""
    best = Window.partitionBy(*keys).orderBy(F.col("mape").asc_nulls_last(), "candidate_ord")
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == 1).drop("rank")


def placebo_candidates(winners: DataFrame) -> DataFrame:
    """The placebo of an analysis is fitted with the trend selected for its main run, without a search."""
    return winners.where(F.col("run_kind") == MAIN).select(
        "analysis_id", F.lit(PLACEBO).alias("run_kind"), F.lit(0).alias("candidate_ord"), "candidate"
    )


def placebo_verdict(p_values: DataFrame, analyses: DataFrame) -> DataFrame:
    """``Negative`` if the placebo window shows an effect after all, else ``Positive``."""
    sure = 1 - F.col("p_value") >= F.col("spec_thr")
    return (
        p_values.where(F.col("run_kind") == PLACEBO)
        .join(analyses.select("analysis_id", "spec_thr"), "analysis_id")
        .select("analysis_id", "p_value", F.when(sure, "Negative").otherwise("Positive").alias("specificity_test"))
    )


def placebo_winners(winners: DataFrame, scores: DataFrame) -> DataFrame:
    """Winners of the main runs, and for each placebo the candidate of its main run with the error it has there."""
    main = winners.where(F.col("run_kind") == MAIN)
    taken = placebo_candidates(main).select(*RUN_KEYS, "candidate")
    return main.unionByName(scores.join(taken, [*RUN_KEYS, "candidate"]).select(*main.columns))


def run_table(
    runs: DataFrame, winners: DataFrame, p_values: DataFrame, orders: DataFrame, status: DataFrame, verdicts: DataFrame
) -> DataFrame:
    """One row per run: window, flags, selected candidate, error, p value and the placebo's verdict.

    The status names what kept a run from a result; ``elapsed_s`` is filled in when results are saved.
    """
    chosen = winners.select(*RUN_KEYS, F.col("candidate").alias("model_name"), "mape")
    return (
        runs.join(status.select(*RUN_KEYS, "first_day", "last_day", F.col("status").alias("period_status")), RUN_KEYS, "left")
        .join(chosen, RUN_KEYS, "left")
        .join(p_values.select(*RUN_KEYS, "p_value"), RUN_KEYS, "left")
        .join(orders.select(*RUN_KEYS, "ar_order"), RUN_KEYS, "left")
        .join(verdicts.select("analysis_id", "specificity_test"), "analysis_id", "left")
        .select(
            *RUN_KEYS,
            "target",
            F.col("first_day").alias("start"),
            "campaign_start",
            F.col("last_day").alias("end"),
            "monthly_seasonality",
            "yearly_seasonality",
            "fix_order",
            "alpha",
            "model_name",
            "ar_order",
            "mape",
            "p_value",
            F.when(F.col("run_kind") == MAIN, F.col("specificity_test")).alias("specificity_test"),
            F.lit(None).cast("double").alias("elapsed_s"),
            F.when(F.col("period_status") != "ok", F.col("period_status"))
            .when(F.col("model_name").isNull(), "no candidate")
            .otherwise("ok")
            .alias("status"),
        )
    )
