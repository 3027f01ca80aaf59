"""Exploration: input series, autocorrelation, changes and correlation with the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.schema import DUMMY_ROLES, INPUT_TYPES, RUN_KEYS


def pre_target(features: DataFrame) -> DataFrame:
    """The target before the campaign: RUN_KEYS, reference_date, value."""
    return features.where(
        (F.col("role") == "target") & (F.col("reference_date") < F.col("campaign_start"))
    ).select(*RUN_KEYS, "reference_date", "value")


def input_series(features: DataFrame, input_type: str) -> DataFrame:
    """All series of one input type together with the target."""
    if input_type not in INPUT_TYPES:
        raise ValueError(f"unknown input type {input_type!r}: expected one of {sorted(INPUT_TYPES)}")
    return features.where(F.col("role").isin("target", *INPUT_TYPES[input_type])).select(
        *RUN_KEYS, "role", "feature", "reference_date", "value"
    )


def target_bounds(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("role") == "target")
        .groupBy(*RUN_KEYS)
        .agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    )


def lag_sums(series: DataFrame, nlags: int, keys=RUN_KEYS, order="reference_date", value="value") -> DataFrame:
    """Per series: ``n``, and array ``s`` with s[k] = sum of products of deviations k rows apart.

    All lags are offsets in one ordered window, so the series is shuffled and sorted once and no
    row is joined or repeated per lag.
    """
    centred = series.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    over = f"(PARTITION BY {', '.join(keys)} ORDER BY {order})"
    products = [f"_d * lag(_d, {k}) OVER {over} AS _p{k}" for k in range(nlags + 1)]
    sums = ", ".join(f"coalesce(sum(_p{k}), 0.0D)" for k in range(nlags + 1))
    return (
        centred.selectExpr(*keys, *products).groupBy(*keys).agg(F.expr("count(1) AS n"), F.expr(f"array({sums}) AS s"))
    )


def acf(series: DataFrame, nlags: int = 40, keys=RUN_KEYS, order="reference_date", value="value") -> DataFrame:
    """Biased autocorrelation by lag; a constant series has none (null)."""
    sums = lag_sums(series, nlags, keys, order, value)
    return sums.select(*keys, F.posexplode("s").alias("lag", "_s"), F.col("s")[0].alias("_s0")).select(
        *keys, "lag", F.try_divide("_s", "_s0").alias("acf")
    )


def adjusted_autocovariance(sums: DataFrame) -> DataFrame:
    """Add ``gamma``: every lag sum divided by its number of products, n - k."""
    return sums.withColumn("gamma", F.transform("s", lambda x, k: F.try_divide(x, F.col("n") - k)))


def levinson(nlags: Column, finish) -> Column:
    """Durbin-Levinson recursion over the column ``gamma`` as a fold over the lags.

    ``phi`` holds the regression coefficients of the current order, ``out`` the partial
    correlations so far; ``finish`` makes the result of the two.
    """
    gamma = F.col("gamma")
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def step(state, k):
        phi = state["phi"]

        def dot(pick):
            products = F.transform(phi, lambda p, j: p * F.get(gamma, pick(j)))
            return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)

        ahead = F.get(gamma, k) - dot(lambda j: k - 1 - j)
        last = F.try_divide(ahead, F.get(gamma, F.lit(0)) - dot(lambda j: j + 1))
        # A one-element array carries the new coefficient, so that it is computed once.
        with_last = F.transform(
            F.array(last),
            lambda a: F.struct(
                F.concat(F.transform(phi, lambda p, j: p - a * F.get(phi, k - 2 - j)), F.array(a)).alias("phi"),
                F.concat(state["out"], F.array(a)).alias("out"),
            ),
        )
        return F.get(with_last, F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), nlags), start, step, finish)


def pacf_vector(nlags: int) -> Column:
    """Partial correlations of all lags from 0."""
    return levinson(F.lit(nlags), lambda state: state["out"])


def pacf(series: DataFrame, nlags: int = 40, keys=RUN_KEYS, order="reference_date", value="value") -> DataFrame:
    gammas = adjusted_autocovariance(lag_sums(series, nlags, keys, order, value))
    return gammas.select(*keys, F.posexplode(pacf_vector(nlags)).alias("lag", "pacf"))


def variance_status(series: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """``ok``, or why the autocorrelation of a series says nothing."""
    return series.groupBy(*keys).agg(
        F.when(F.stddev_pop("value") == 0, "target has no variance").otherwise("ok").alias("status")
    )


def pct_change(features: DataFrame) -> DataFrame:
    """Day-over-day relative change of every feature but the dummies, before the campaign."""
    previous = F.lag("value").over(Window.partitionBy(*RUN_KEYS, "feature").orderBy("reference_date"))
    return (
        features.where(~F.col("role").isin(*DUMMY_ROLES) & (F.col("reference_date") < F.col("campaign_start")))
        .withColumn("previous", previous)
        .select(
            *RUN_KEYS,
            "role",
            "feature",
            "reference_date",
            F.try_divide(F.col("value") - F.col("previous"), F.col("previous")).alias("change"),
        )
    )


def sparse_changes(changes: DataFrame, max_missing: float = 0.4) -> DataFrame:
    """Share of missing changes per feature, and whether that is too much to correlate."""
    return (
        changes.groupBy(*RUN_KEYS, "role", "feature")
        .agg(F.avg(F.col("change").isNull().cast("double")).alias("missing_share"))
        .withColumn("is_sparse", F.col("missing_share") >= max_missing)
    )


def corr_status(changes: DataFrame, max_missing: float = 0.4) -> DataFrame:
    """One row per run: ``ok``, or that the target has too few changes to correlate with."""
    sparse = sparse_changes(changes, max_missing).where(F.col("role") == "target")
    return sparse.select(*RUN_KEYS, "missing_share", F.when(F.col("is_sparse"), "target too sparse").otherwise("ok").alias("status"))


def target_corr(changes: DataFrame, max_missing: float = 0.4) -> DataFrame:
    """|Pearson correlation| of each feature's changes with the target's, strongest first.

    Only days on which every feature kept has a change count. The target is kept however sparse it is;
    ``corr_status`` says where it is too sparse to trust.
    """
    share = Window.partitionBy(*RUN_KEYS, "feature")
    kept = changes.withColumn(
        "missing_share", F.avg(F.col("change").isNull().cast("double")).over(share)
    ).where((F.col("role") == "target") | (F.col("missing_share") < max_missing))
    day = Window.partitionBy(*RUN_KEYS, "reference_date")
    complete = (
        kept.withColumn("holes", F.sum(F.col("change").isNull().cast("int")).over(day))
        .withColumn("target_change", F.max(F.when(F.col("role") == "target", F.col("change"))).over(day))
        .where((F.col("holes") == 0) & F.col("target_change").isNotNull())
    )
    return (
        complete.where(F.col("role") != "target")
        .groupBy(*RUN_KEYS, "feature")
        # Not corr(): it divides by zero where one of the two never changes; here that is null.
        .agg(
            F.abs(
                F.try_divide(F.covar_pop("change", "target_change"), F.stddev_pop("change") * F.stddev_pop("target_change"))
            ).alias("correlation")
        )
        .withColumn(
            "rank",
            F.row_number().over(
                Window.partitionBy(*RUN_KEYS).orderBy(F.col("correlation").desc_nulls_last(), "feature")
            ),
        )
    )
