"""Effects and reports from any predictions table.

A predictions table has RUN_KEYS, campaign_start, reference_date, observed, mean, lower and upper.
If it also carries the bounds of the running post-period sum (cum_mean, cum_lower, cum_upper),
cumulative effects use them; otherwise they are running sums of the daily bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions.normal import normal_tail, with_normal_quantile
from liftpanel.schema import RUN_KEYS

# The quantities of a summary, in order.
QUANTITIES = (
    "actual",
    "predicted",
    "predicted_lower",
    "predicted_upper",
    "abs_effect",
    "abs_effect_lower",
    "abs_effect_upper",
    "rel_effect",
    "rel_effect_lower",
    "rel_effect_upper",
)


def _post() -> Column:
    return F.col("reference_date") >= F.col("campaign_start")


def point_effects(predictions: DataFrame) -> DataFrame:
    """Observed minus predicted; the lower effect comes from the upper prediction and vice versa."""
    return (
        predictions.withColumn("point_effects_means", F.col("observed") - F.col("mean"))
        .withColumn("point_effects_lower", F.col("observed") - F.col("upper"))
        .withColumn("point_effects_upper", F.col("observed") - F.col("lower"))
    )


def cumulative_effects(predictions: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Running sum of the point effects from the campaign start on, 0 before."""
    running = Window.partitionBy(*keys).orderBy("reference_date").rowsBetween(Window.unboundedPreceding, 0)

    def total(column: Column) -> Column:
        return F.sum(F.when(_post(), column).otherwise(0.0)).over(running)

    observed = total(F.col("observed"))
    if "cum_mean" in predictions.columns:
        means, lower, upper = (observed - F.coalesce(c, F.lit(0.0)) for c in ("cum_mean", "cum_upper", "cum_lower"))
    else:
        means, lower, upper = (observed - total(F.col(c)) for c in ("mean", "upper", "lower"))
    return (
        predictions.withColumn("post_cum_effects_means", means)
        .withColumn("post_cum_effects_lower", lower)
        .withColumn("post_cum_effects_upper", upper)
    )


def errors(predictions: DataFrame) -> DataFrame:
    """``error`` and ``perc_error``, the latter null where the observed value is 0."""
    error = F.col("observed") - F.col("mean")
    return predictions.withColumn("error", error).withColumn("perc_error", F.try_divide(error, F.col("observed")))


def inferences(predictions: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """The full inference table of every run."""
    full = errors(cumulative_effects(point_effects(predictions), keys))
    return full.select(
        *keys,
        "campaign_start",
        "reference_date",
        "observed",
        F.col("mean").alias("complete_preds_means"),
        F.col("lower").alias("complete_preds_lower"),
        F.col("upper").alias("complete_preds_upper"),
        *[f"{kind}_{bound}" for kind in ("point_effects", "post_cum_effects") for bound in ("means", "lower", "upper")],
        "error",
        "perc_error",
    )


def summary(predictions: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Ten quantities per run, averaged and cumulated over the post period."""
    post = predictions.where(_post())
    sums = [F.sum("observed").alias("actual"), F.sum("mean").alias("predicted")]
    if "cum_mean" in predictions.columns:
        last = lambda c: F.max_by(c, "reference_date")
        sums = [sums[0], last("cum_mean").alias("predicted")]
        sums += [last("cum_lower").alias("predicted_lower"), last("cum_upper").alias("predicted_upper")]
    else:
        sums += [F.sum("lower").alias("predicted_lower"), F.sum("upper").alias("predicted_upper")]
    total = post.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), *sums)
    effects = total.withColumns(
        {
            "abs_effect": F.col("actual") - F.col("predicted"),
            "abs_effect_lower": F.col("actual") - F.col("predicted_upper"),
            "abs_effect_upper": F.col("actual") - F.col("predicted_lower"),
        }
    )
    effects = effects.withColumns(
        {
            f"rel_effect{bound}": F.try_divide(F.col(f"abs_effect{bound}"), F.col("predicted"))
            for bound in ("", "_lower", "_upper")
        }
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("quantity_ord"),
                F.lit(q).alias("quantity"),
                # A relative effect is the same for the daily average and for the sum.
                (F.col(q) if q.startswith("rel") else F.col(q) / F.col("days")).alias("average"),
                F.col(q).alias("cumulative"),
            )
            for i, q in enumerate(QUANTITIES)
        ]
    )
    return effects.select(*keys, F.inline(rows))


def with_interval_z(alphas: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Keys, alpha and ``z``: the two-sided normal quantile of each run's alpha, to 2 decimals."""
    tail = alphas.select(*keys, "alpha", (1 - F.col("alpha") / 2).alias("tail"))
    return with_normal_quantile(tail, "tail", "z").select(*keys, "alpha", F.round("z", 2).alias("z"))


def cents(x: Column) -> Column:
    """Two decimals, half up, decided on six: the last bits of a long sum must not tip a half cent."""
    return F.round(x.try_cast("decimal(38,6)"), 2).cast("double")


def interval_sd(lower: Column, upper: Column) -> Column:
    """Standard deviation implied by an interval of width 2 z."""
    return cents(F.try_divide(upper - lower, F.col("z") * 2))


def wide_summary(summary_data: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """One row per run with <quantity>_average and <quantity>_cumulative."""
    return summary_data.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("quantity") == q, F.col(part))).alias(f"{q}_{part}")
            for q in QUANTITIES
            for part in ("average", "cumulative")
        ]
    )


def _shown(quantity: str, part: str) -> Column:
    scale = 100.0 if quantity.startswith("rel") else 1.0
    return cents(F.col(f"{quantity}_{part}") * scale)


def effect_sd(summary_data: DataFrame, alphas: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Standard deviation of prediction, absolute and relative effect, from the rounded bounds."""
    wide = wide_summary(summary_data, keys).join(with_interval_z(alphas, keys), keys)
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("quantity"),
                *[
                    interval_sd(_shown(f"{q}_lower", part), _shown(f"{q}_upper", part)).alias(part)
                    for part in ("average", "cumulative")
                ],
            )
            for q in ("predicted", "abs_effect", "rel_effect")
        ]
    )
    return wide.select(*keys, F.inline(rows))


def summary_report(summary_data: DataFrame, alphas: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """The printed table: seven text rows per run; the interval's label follows alpha."""
    wide = wide_summary(summary_data, keys).join(with_interval_z(alphas, keys), keys)

    def text(x: Column) -> Column:
        return F.format_string("%.2f", x)

    def value(q, part, unit):
        sd = interval_sd(_shown(f"{q}_lower", part), _shown(f"{q}_upper", part))
        return F.concat(text(_shown(q, part)), F.lit(f"{unit} ("), text(sd), F.lit(f"{unit})"))

    def bounds(q, part, unit):
        lower, upper = _shown(f"{q}_lower", part), _shown(f"{q}_upper", part)
        return F.concat(F.lit("["), text(lower), F.lit(f"{unit}, "), text(upper), F.lit(f"{unit}]"))

    interval = F.concat(F.format_string("%.0f", (1 - F.col("alpha")) * 100), F.lit("% CI"))
    lines = [(F.lit("Actual"), lambda part: text(_shown("actual", part)))]
    for label, q, unit in (
        ("Prediction (s.d.)", "predicted", ""),
        ("Absolute effect (s.d.)", "abs_effect", ""),
        ("Relative effect (s.d.)", "rel_effect", "%"),
    ):
        lines.append((F.lit(label), lambda part, q=q, unit=unit: value(q, part, unit)))
        lines.append((interval, lambda part, q=q, unit=unit: bounds(q, part, unit)))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("line"),
                label.alias("label"),
                cell("average").alias("average"),
                cell("cumulative").alias("cumulative"),
            )
            for i, (label, cell) in enumerate(lines)
        ]
    )
    return wide.select(*keys, F.inline(rows))


def p_value(predictions: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Tail probability of the observed post sum for independent daily errors of spread ``sd``."""
    post = predictions.where(_post())
    z = F.try_divide(F.sum("observed") - F.sum("mean"), F.sqrt(F.sum(F.col("sd") * F.col("sd"))))
    return post.groupBy(*keys).agg(z.alias("z")).select(*keys, normal_tail(F.col("z")).alias("p_value"))


def effect_probability(p: Column) -> Column:
    """Posterior probability of an effect in whole percent."""
    return F.ceil((1 - p) * 100)


def plot_bounds(inference: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """Smallest and largest value in each of the three panels of the result chart."""

    def span(name, low, high):
        lows = [F.min(c) for c in low]
        highs = [F.max(c) for c in high]
        return F.least(*lows).alias(f"min_{name}"), F.greatest(*highs).alias(f"max_{name}")

    return inference.groupBy(*keys).agg(
        *span(
            "observed",
            ("observed", "complete_preds_means", "complete_preds_lower"),
            ("observed", "complete_preds_means", "complete_preds_upper"),
        ),
        *span("point", ("point_effects_means", "point_effects_lower"), ("point_effects_means", "point_effects_upper")),
        *span(
            "cumulative",
            ("post_cum_effects_means", "post_cum_effects_lower"),
            ("post_cum_effects_means", "post_cum_effects_upper"),
        ),
    )
