"""The whole analysis for all analyses at once, main and placebo runs through the same plan."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftpanel.operators import clean, effects, explore, features, model, selection, stationarity
from liftpanel.operators.explore import pre_target
from liftpanel.operators.runs import expand_runs
from liftpanel.schema import INPUT_TYPES, MAIN, RUN_KEYS
from liftpanel.sources import stages


def dataset(series: DataFrame, analyses: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Analytical dataset of both runs of every analysis."""
    return features.analytical_dataset(series, expand_runs(analyses), holidays)


def scored(predicted: DataFrame, scope: str = "all") -> DataFrame:
    """Error of every candidate of every run to 6 digits, with the order in which ties resolve."""
    scores = selection.mape(predicted, model.FIT_KEYS, scope).withColumn("mape", F.round("mape", 6))
    order = Window.partitionBy(*RUN_KEYS).orderBy(model.candidate_order())
    return scores.withColumn("candidate_ord", F.row_number().over(order) - 1)


def run_panel(
    series: DataFrame,
    analyses: DataFrame,
    holidays: DataFrame | None = None,
    mape_scope: str = "all",
    strict: bool = False,
) -> dict[str, DataFrame]:
    """From role series to the result tables, see stages.RESULT_SCHEMAS.

    Candidates of the main run compete by error; the placebo takes over the winner's. Runs that break the
    period rules get no predictions and say so in ``runs``; ``strict`` raises instead. Cleaned features and
    candidate predictions, which several tables read, are cut from their lineage: both are computed here.
    """
    runs = expand_runs(analyses)
    cleaned = stages.cut_lineage(clean.clean_features(dataset(series, analyses, holidays)))
    status = clean.check_periods(cleaned, runs)
    if strict:
        clean.require_periods(status)
    usable = cleaned.join(status.where(F.col("status") == "ok").select(*RUN_KEYS), RUN_KEYS, "left_semi")
    candidates = stages.cut_lineage(model.all_candidates(usable, runs.select(*RUN_KEYS, "alpha")))
    scores = scored(candidates, mape_scope)
    chosen = selection.placebo_winners(selection.select_model(scores), scores)
    predicted = candidates.join(chosen.select(*model.FIT_KEYS), model.FIT_KEYS, "left_semi").drop("candidate")
    p_values = effects.p_value(predicted)
    orders = stationarity.ar_order(pre_target(usable), runs)
    verdicts = selection.placebo_verdict(p_values, analyses)
    return {
        "runs": selection.run_table(runs, chosen, p_values, orders, status, verdicts),
        "inferences": effects.inferences(predicted),
        "summary_data": effects.summary(predicted),
        "features": model.standardize(cleaned),
    }


def save_panel(tables: dict[str, DataFrame], path: str) -> None:
    """Save all tables of ``run_panel`` in one change, the register written last: with the seconds that the others took."""
    started = time.perf_counter()
    register = stages.cut_lineage(tables["runs"])
    spark, keys = register.sparkSession, register.select(*RUN_KEYS)
    change = stages.Change(path, stages.resolve(spark, path))
    stages.results_change({k: v for k, v in tables.items() if k != "runs"}, change, keys)
    took = F.lit(time.perf_counter() - started)
    stages.results_change({"runs": register.withColumn("elapsed_s", took)}, change, keys)
    change.publish(spark)


def exploration(stored: DataFrame) -> dict[str, DataFrame]:
    """All explorations of stored features, see stages.RESULT_SCHEMAS: of one run, of some, or of all, each a plan of
    its own over the columns that it needs. Input series are named ``input_`` and their type."""
    before, changes = explore.pre_target(stored), explore.pct_change(stored)
    return {f"input_{kind}": explore.input_series(stored, kind) for kind in INPUT_TYPES} | {
        "target_bounds": explore.target_bounds(stored),
        "acf": explore.acf(before),
        "pacf": explore.pacf(before),
        "variance_status": explore.variance_status(before),
        "pct_change": changes,
        "sparse_changes": explore.sparse_changes(changes),
        "target_corr": explore.target_corr(changes),
        "corr_status": explore.corr_status(changes),
    }


def explore_run(
    spark: SparkSession, path: str, analysis_id: str | None, run_kind: str | None = MAIN, version: int | None = None
) -> dict[str, DataFrame]:
    """``exploration`` of a saved run, from its bucket alone; the analysis need not be computed again."""
    return exploration(stages.load_results(spark, path, analysis_id, run_kind, ("features",), version)["features"])
