"""Residual diagnostics of the days before the campaign."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions.normal import normal_pdf, with_normal_quantile
from liftpanel.operators import explore
from liftpanel.schema import RUN_KEYS

RESIDUAL_LAGS = 10


def residuals(inference: DataFrame, keys=RUN_KEYS) -> DataFrame:
    return inference.where(F.col("reference_date") < F.col("campaign_start")).select(
        *keys, "reference_date", "observed", "error", "perc_error"
    )


def residual_histogram(resid: DataFrame, bins: int = 20, keys=RUN_KEYS) -> DataFrame:
    """Equal-width histogram as a density, with the normal density at each bin's centre.

    The normal curve has the residuals' mean and population standard deviation. Empty bins are
    rows too, so the densities times the width sum to 1. Statistics and counts come from the same
    shuffle: the counts are one conditional aggregate per bin.
    """
    per_run = Window.partitionBy(*keys)
    lowest, highest = F.min("error").over(per_run), F.max("error").over(per_run)
    place = F.floor(F.try_divide(F.col("error") - F.col("lo"), F.col("width")))
    counts = (
        resid.withColumn("lo", lowest)
        .withColumn("width", (highest - lowest) / bins)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("lo").alias("lo"),
            F.first("width").alias("width"),
            F.avg("error").alias("centre"),
            F.stddev_pop("error").alias("spread"),
            F.array(*[F.count_if(F.col("bin") == i) for i in range(bins)]).alias("counts"),
        )
    )
    middle = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    return counts.select("*", F.posexplode("counts").alias("bin", "rows")).select(
        *keys,
        "bin",
        middle.alias("bin_centre"),
        "rows",
        F.try_divide(F.col("rows"), F.col("n") * F.col("width")).alias("density"),
        normal_pdf(middle, F.col("centre"), F.col("spread")).alias("normal_density"),
    )


def residual_density(resid: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Normal density at every residual, for the curve over the histogram."""
    per_run = Window.partitionBy(*keys)
    return resid.select(
        *keys,
        "reference_date",
        "error",
        normal_pdf(F.col("error"), F.avg("error").over(per_run), F.stddev_pop("error").over(per_run)).alias(
            "normal_density"
        ),
    )


def relative_error(resid: DataFrame, keys=RUN_KEYS) -> DataFrame:
    return resid.groupBy(*keys).agg(F.try_divide(F.avg("error"), F.avg("observed")).alias("relative_error"))


def qq_points(resid: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Theoretical against ordered residual quantiles, with the least-squares line through them.

    Plotting positions are Filliben's medians of the uniform order statistics.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ordered = resid.withColumn(
        "rn", F.row_number().over(Window.partitionBy(*keys).orderBy("error", "reference_date"))
    ).withColumn("n", n)
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    median = (
        F.when(F.col("rn") == F.col("n"), last)
        .when(F.col("rn") == 1, 1 - last)
        .otherwise((F.col("rn") - 0.3175) / (F.col("n") + 0.365))
    )
    per_run = Window.partitionBy(*keys)
    return (
        with_normal_quantile(ordered.withColumn("median", median), "median", "theoretical")
        .withColumn("slope", F.regr_slope("error", "theoretical").over(per_run))
        .withColumn("intercept", F.avg("error").over(per_run) - F.col("slope") * F.avg("theoretical").over(per_run))
        .select(
            *keys,
            "rn",
            "theoretical",
            F.col("error").alias("observed"),
            (F.col("intercept") + F.col("slope") * F.col("theoretical")).alias("fitted"),
        )
    )


def residual_acf(resid: DataFrame, nlags: int = RESIDUAL_LAGS, keys=RUN_KEYS) -> DataFrame:
    return explore.acf(resid, nlags, keys, value="error")
