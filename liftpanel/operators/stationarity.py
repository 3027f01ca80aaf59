"""Weekly decomposition, unit-root test, trend candidates and autoregressive order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions.linear import let, numbers, products, square, sweep
from liftpanel.functions.normal import normal_tail
from liftpanel.operators.explore import pacf
from liftpanel.schema import RUN_KEYS

# Candidates searched for a series with and without a unit root.
SEARCHED = {
    "Not stationary": ("local_level", "local_linear", "semi_local_linear"),
    "Stationary": ("no_trend",),
}

# MacKinnon (1994) response surface for one series with a constant.
TAU_SPLIT = -1.61
TAU_MIN = -18.83
TAU_MAX = 2.74
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)

# Partial autocorrelations looked at, and the size that still counts.
PACF_LAGS = 40
PACF_THRESHOLD = 0.3


def seasonal_additive(series: DataFrame, keys=RUN_KEYS, period: int = 7) -> DataFrame:
    """Add ``trend`` (centred mean of a full period), ``seasonal`` (mean by phase, centred) and ``deseasonal``."""
    half = period // 2
    ordered = Window.partitionBy(*keys).orderBy("reference_date")
    around = ordered.rowsBetween(-half, half)
    phase = Window.partitionBy(*keys, "_phase")
    return (
        series.withColumn("_phase", F.pmod(F.row_number().over(ordered) - 1, F.lit(period)))
        .withColumn("trend", F.when(F.count("value").over(around) == period, F.avg("value").over(around)))
        .withColumn("_by_phase", F.avg(F.col("value") - F.col("trend")).over(phase))
        .withColumn("_first", F.row_number().over(phase.orderBy("reference_date")) == 1)
        .withColumn(
            "seasonal",
            F.col("_by_phase") - F.avg(F.when(F.col("_first"), F.col("_by_phase"))).over(Window.partitionBy(*keys)),
        )
        .withColumn("deseasonal", F.col("value") - F.col("seasonal"))
        .drop("_phase", "_by_phase", "_first")
    )


def _p_value(tau: Column) -> Column:
    """MacKinnon's response surface at a statistic."""
    poly = lambda cs: reduce(lambda acc, c: acc * tau + c, reversed(cs[:-1]), F.lit(cs[-1]))
    inside = let(F.when(tau <= TAU_SPLIT, poly(TAU_SMALL)).otherwise(poly(TAU_LARGE)), lambda z: F.when(z > 0, 1 - normal_tail(z)).otherwise(normal_tail(z)))
    return F.when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).otherwise(inside)


def _unit_root(x: Column, n: Column, max_lag: Column) -> Column:
    """Struct ``used, beta, inverse, rest`` of the regression of the differences of ``x`` on the level before, older
    differences and a constant; the lag is chosen by AIC on the days that all lags have, then fitted on all days."""
    size = max_lag + 3
    last = size - 1

    def fits(d: Column) -> Column:
        def vector(t: Column) -> Column:
            lags = F.transform(numbers(1, max_lag), lambda j: F.coalesce(F.get(d, t - j), F.lit(0.0)))
            return F.concat(F.array(F.lit(1.0), F.get(x, t)), lags, F.array(F.get(d, t)))

        def add(sums: Column, t: Column) -> Column:
            return F.zip_with(sums, let(vector(t), products), lambda a, b: a + b)

        def nested(sums: Column) -> Column:
            start = F.struct(square(sums, size).alias("m"), F.array().cast("array<double>").alias("rests"))
            step = lambda s, k: let(sweep(s["m"], k), lambda m: F.struct(m.alias("m"), F.concat(s["rests"], F.array(F.get(F.get(m, last), last))).alias("rests")))
            return F.aggregate(numbers(0, max_lag + 1), start, step, lambda s: s["rests"])

        def chosen(sums: Column) -> Column:
            rows = n - 1 - max_lag
            score = lambda v, i: rows * F.ln(F.greatest(v, F.lit(1e-300)) / rows) + 2 * (i + 2)
            scores = F.transform(F.slice(nested(sums), 2, max_lag + 1), score)
            return let(let(scores, lambda s: (F.array_position(s, F.array_min(s)) - 1).cast("int")), lambda used: fitted(sums, used))

        def fitted(sums: Column, used: Column) -> Column:
            every = F.aggregate(numbers(used, max_lag - 1), sums, add)
            m = F.aggregate(numbers(0, used + 1), square(every, size), sweep)
            parts = lambda m: F.struct(used.alias("used"), F.get(F.get(m, F.lit(1)), last).alias("beta"), F.get(F.get(m, F.lit(1)), F.lit(1)).alias("inverse"), F.get(F.get(m, last), last).alias("rest"))
            return let(m, parts)

        none = F.transform(numbers(1, (size * (size + 1) / 2).cast("int")), lambda _: F.lit(0.0))
        return let(F.aggregate(numbers(max_lag, n - 2), none, add), chosen)

    return let(F.transform(numbers(1, n - 1), lambda i: F.get(x, i) - F.get(x, i - 1)), fits)


def adf_test(series: DataFrame, value: str = "deseasonal", sig: float = 0.01, keys=RUN_KEYS) -> DataFrame:
    """Unit-root test per series (constant, lag by AIC): statistic, p_value, used_lag and the verdict at level ``sig``.

    A series becomes one row with its values as an array, bounded by its calendar, and its regressions are folds over
    it; scaling changes neither statistic nor lag. A series that cannot be tested, too short or without variance, gets
    nulls and counts as not stationary.
    """
    lists = series.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("reference_date", F.col(value).cast("double").alias("v")))).alias("days"),
        F.count(value).cast("int").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
    )
    n = F.col("n")
    max_lag = F.least(F.ceil(12.0 * F.pow(n / 100.0, 0.25)), F.floor(n / 2) - 2).cast("int")
    x = F.transform("days", lambda r: (r["v"] - F.col("mean")) / F.col("std"))
    fit = F.when((max_lag >= 0) & (F.col("std") > 0), let(x, lambda x: _unit_root(x, n, max_lag)))
    fitted = lists.select(*keys, "n", fit.alias("fit"))
    spread = F.try_divide(F.col("fit.rest"), n - 2 * F.col("fit.used") - 3) * F.col("fit.inverse")
    tested = fitted.select(*keys, F.try_divide(F.col("fit.beta"), F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("statistic"), F.col("fit.used").alias("used_lag"))
    tested = tested.select(*keys, "statistic", _p_value(F.col("statistic")).alias("p_value"), "used_lag")
    return tested.withColumn("verdict", F.when(F.col("p_value") < sig, "Stationary").otherwise("Not stationary"))


def candidates(verdicts: DataFrame, runs: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """(keys, candidate, candidate_ord): what to fit for each run, in the order in which ties resolve.

    ``search_model`` = 'search' takes the list of the verdict, anything else is the one candidate.
    """
    lists = F.when(
        F.col("search_model") == "search",
        F.when(F.col("verdict") == "Stationary", F.array(*map(F.lit, SEARCHED["Stationary"]))).otherwise(
            F.array(*map(F.lit, SEARCHED["Not stationary"]))
        ),
    ).otherwise(F.array("search_model"))
    return (
        runs.select(*keys, "search_model")
        .join(verdicts.select(*keys, "verdict"), keys, "left")
        .select(*keys, F.posexplode(lists).alias("candidate_ord", "candidate"))
    )


def ar_order(
    series: DataFrame, runs: DataFrame, nlags: int = PACF_LAGS, threshold: float = PACF_THRESHOLD, keys=RUN_KEYS
) -> DataFrame:
    """Autoregressive order per run; 1 where ``fix_order`` is set.

    It is the last lag up to which, from lag 2 on, all partial autocorrelations of the target reach
    ``threshold`` in size; 1 if lag 2 does not.
    """
    weak = ~F.coalesce(F.abs("pacf") >= threshold, F.lit(False))
    found = (
        pacf(series, nlags, keys)
        .groupBy(*keys)
        .agg((F.coalesce(F.min(F.when((F.col("lag") >= 2) & weak, F.col("lag"))), F.lit(nlags + 1)) - 1).alias("found"))
    )
    return (
        runs.select(*keys, "fix_order")
        .join(found, keys, "left")
        .select(*keys, F.when(F.col("fix_order") | F.col("found").isNull(), 1).otherwise(F.col("found")).alias("ar_order"))
    )
