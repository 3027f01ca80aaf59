"""What one prediction is made of: line, seasons, all controls together, autoregressive errors; all as sums and folds.

Products of regressors are summed by days in a grouping, so a run with many controls is spread over tasks; what is
left of a run, a matrix as wide as its controls or a table of phases, is one row that a fold works on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from liftpanel.functions.linear import let, numbers, soft_threshold, total
from liftpanel.operators.explore import adjusted_autocovariance, lag_sums, levinson
from liftpanel.operators.model import standardize
from liftpanel.schema import RUN_KEYS
from liftpanel.sources.stages import cut_lineage

# Days of the two seasonal periods.
WEEK, MONTH = 7, 30

# What a coefficient must exceed on the standardised scale, and the passes over all coefficients.
PENALTY = 0.05
PASSES = 50

# Fixed value: passes of the two seasons against each other. The periods have no common divisor, so the phases are
# nearly balanced and a pass leaves a small share of the step before it; after this many nothing is left to see.
SEASON_PASSES = 20

# Components of a prediction in their order.
COMPONENTS = ("line", "weekly", "monthly", "regressors", "autoregression")


def _before(features: DataFrame) -> DataFrame:
    return features.where(F.col("reference_date") < F.col("campaign_start"))


def gram(features: DataFrame, scope: str = "pre") -> DataFrame:
    """``feature_i, feature_j, product``: sums of products of all scaled features before the campaign, the target
    first, then by name; each pair once. A day's features meet in one array, not in a join of days with themselves."""
    is_regressor = (F.col("role") != "target").alias("regressor")
    scaled = _before(standardize(features, scope)).select(*RUN_KEYS, "reference_date", F.struct(is_regressor, "feature", "scaled").alias("cell"))
    days = scaled.groupBy(*RUN_KEYS, "reference_date").agg(F.array_sort(F.collect_list("cell")).alias("cells"))

    def row(a: Column, i: Column) -> Column:
        pair = lambda b: F.struct(a["feature"].alias("feature_i"), b["feature"].alias("feature_j"), (a["scaled"] * b["scaled"]).alias("v"))
        return F.transform(F.slice("cells", i + 1, F.size("cells") - i), pair)

    pairs = days.select(*RUN_KEYS, F.inline(F.flatten(F.transform("cells", row))))
    return pairs.groupBy(*RUN_KEYS, "feature_i", "feature_j").agg(F.sum("v").alias("product"))


def _matrices(products: DataFrame, targets: DataFrame) -> DataFrame:
    """Per run ``names`` and the full matrix ``g`` in their order, from ``gram`` and ``targets (RUN_KEYS, target)``."""
    turned = products.where("feature_i <> feature_j").select(*RUN_KEYS, F.col("feature_j").alias("feature_i"), F.col("feature_i").alias("feature_j"), "product")
    both = products.select(*turned.columns).unionByName(turned).join(targets, RUN_KEYS)
    inner = F.struct((F.col("feature_j") != F.col("target")).alias("o"), "feature_j", "product")
    rows = both.groupBy(*RUN_KEYS, "target", "feature_i").agg(F.array_sort(F.collect_list(inner)).alias("row"))
    outer = F.struct((F.col("feature_i") != F.col("target")).alias("o"), "feature_i", F.transform("row", lambda c: c["product"]).alias("row"))
    return rows.groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(outer)).alias("rows")).select(
        *RUN_KEYS, F.transform("rows", lambda r: r["feature_i"]).alias("names"), F.transform("rows", lambda r: r["row"]).alias("g")
    )


def sparse_fit(features: DataFrame, penalty: float = PENALTY, passes: int = PASSES, scope: str = "pre") -> DataFrame:
    """``feature, coefficient, product``: the target on all other features at once, scaled, small coefficients 0.

    Least squares with a penalty on the sum of absolute coefficients, by coordinate descent over the matrix of
    products; ``product`` is the mean product with the target. A feature without variance has coefficient 0.
    """
    targets = features.where("role = 'target'").select(*RUN_KEYS, F.col("feature").alias("target")).distinct()
    days = _before(features).where("role = 'target'").groupBy(*RUN_KEYS).agg(F.count("*").alias("n"))
    found = _matrices(gram(features, scope), targets).join(days, RUN_KEYS)
    width = F.size("g") - 1

    def step(b: Column, s: Column) -> Column:
        j = (s % width).cast("int")
        row = lambda g: F.get(g, j + 1)

        def renewed(r: Column) -> Column:
            own = F.get(r, j + 1)
            rest = F.get(r, F.lit(0)) - total(F.transform(b, lambda v, k: F.get(r, k + 1) * v)) + own * F.get(b, j)
            new = F.coalesce(F.try_divide(soft_threshold(rest / F.col("n"), penalty), own / F.col("n")), F.lit(0.0))
            return let(new, lambda new: F.transform(b, lambda v, k: F.when(k == j, new).otherwise(v)))

        return let(row(F.col("g")), renewed)

    start = F.transform(numbers(1, width), lambda _: F.lit(0.0))
    fitted = found.withColumn("b", F.aggregate(numbers(0, width * passes - 1), start, step))
    cells = F.transform("b", lambda v, k: F.struct(F.get(F.col("names"), k + 1).alias("feature"), v.alias("coefficient"), (F.get(F.get(F.col("g"), F.lit(0)), k + 1) / F.col("n")).alias("product")))
    return fitted.select(*RUN_KEYS, F.inline(cells))


def importance(fit: DataFrame) -> DataFrame:
    """``feature, importance, rank, share``: absolute coefficients, strongest first, and what each regressor adds to the
    explained product with the target."""
    run = Window.partitionBy(*RUN_KEYS)
    part = F.col("coefficient") * F.col("product")
    size = F.abs("coefficient")
    return fit.select(
        *RUN_KEYS, "feature", size.alias("importance"), F.row_number().over(run.orderBy(F.round(size, 9).desc(), "feature")).alias("rank"),
        F.try_divide(part, F.sum(part).over(run)).alias("share"),
    )


def regressor_part(features: DataFrame, fit: DataFrame) -> DataFrame:
    """``reference_date, value``: what all regressors together add to the target, in its own unit, on every day."""
    scaled = standardize(features)
    spread = F.max(F.when(F.col("role") == "target", F.col("std"))).over(Window.partitionBy(*RUN_KEYS))
    parts = scaled.withColumn("spread", spread).where("role <> 'target'").join(fit.select(*RUN_KEYS, "feature", "coefficient"), [*RUN_KEYS, "feature"])
    return parts.groupBy(*RUN_KEYS, "reference_date").agg(F.sum(F.col("coefficient") * F.col("scaled") * F.col("spread")).alias("value"))


def all_controls(features: DataFrame, z: float, penalty: float = PENALTY) -> DataFrame:
    """``observed, mean, lower, upper, sd`` on every day: the target from all controls together."""
    used = features.where(F.col("role").isin("target", "control"))
    target = used.where("role = 'target'").select(*RUN_KEYS, "campaign_start", "reference_date", F.col("value").alias("observed"))
    run = Window.partitionBy(*RUN_KEYS)
    before = F.col("reference_date") < F.col("campaign_start")
    rows = target.join(regressor_part(used, sparse_fit(used, penalty)), [*RUN_KEYS, "reference_date"])
    rows = rows.withColumn("mean", F.avg(F.when(before, F.col("observed"))).over(run) + F.col("value"))
    rows = rows.withColumn("sd", F.sqrt(F.avg(F.when(before, (F.col("observed") - F.col("mean")) ** 2)).over(run)))
    return rows.select(*RUN_KEYS, "campaign_start", "reference_date", "observed", "mean", (F.col("mean") - z * F.col("sd")).alias("lower"), (F.col("mean") + z * F.col("sd")).alias("upper"), "sd")


def straight_line(features: DataFrame) -> DataFrame:
    """The target with ``line``, through its days before the campaign, ``rest``, and ``number``, the day's place in the run."""
    before = F.col("reference_date") < F.col("campaign_start")
    run = Window.partitionBy(*RUN_KEYS)
    target = features.where("role = 'target'").select(*RUN_KEYS, "campaign_start", "reference_date", F.col("value").alias("observed"))
    days = target.withColumn("number", F.datediff("reference_date", F.min("reference_date").over(run)))
    # Not over(run): the frame of a window would keep every day's pair in memory for an aggregate that a grouping combines.
    fit = days.where(before).groupBy(*RUN_KEYS).agg(F.coalesce(F.regr_slope("observed", "number"), F.lit(0.0)).alias("slope"), F.avg("number").alias("x"), F.avg("observed").alias("y"))
    on_line = days.join(fit, RUN_KEYS).withColumn("line", F.col("y") + F.col("slope") * (F.col("number") - F.col("x")))
    return on_line.withColumn("rest", F.col("observed") - F.col("line")).drop("slope", "x", "y")


def two_seasons(lines: DataFrame, monthly: DataFrame, passes: int = SEASON_PASSES) -> DataFrame:
    """``period, phase, effect``: mean rest by phase of the week and, where ``monthly (RUN_KEYS, monthly_seasonality)``
    says so, by phase of 30 days, each judged on what the other one leaves. Weekly effects have mean 0 over the phases.

    Days are combined to at most 210 pairs of phases; the passes go over these.
    """
    week, month = (F.col("number") % WEEK).alias("a"), (F.col("number") % MONTH).alias("b")
    cells = _before(lines).groupBy(*RUN_KEYS, week, month).agg(F.sum("rest").alias("s"), F.count("*").cast("double").alias("n"))
    run = cells.groupBy(*RUN_KEYS).agg(F.collect_list(F.struct("a", "b", "s", "n")).alias("cells")).join(monthly.select(*RUN_KEYS, "monthly_seasonality"), RUN_KEYS)

    def means(size: int, own: str, other: str, effects: Column) -> Column:
        def mean(phase: Column) -> Column:
            mine = F.filter("cells", lambda c: c[own] == phase)
            rest = total(F.transform(mine, lambda c: c["s"] - c["n"] * F.get(effects, c[other])))
            return F.coalesce(F.try_divide(rest, total(F.transform(mine, lambda c: c["n"]))), F.lit(0.0))

        return F.transform(numbers(0, size - 1), mean)

    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    centred = lambda a: F.transform(a, lambda v: v - total(a) / WEEK)

    def step(state: Column, _: Column) -> Column:
        weekly = let(means(WEEK, "a", "b", state["month"]), centred)
        return let(weekly, lambda w: F.struct(w.alias("week"), F.when(F.col("monthly_seasonality"), means(MONTH, "b", "a", w)).otherwise(zeros(MONTH)).alias("month")))

    found = F.aggregate(numbers(1, passes), F.struct(zeros(WEEK).alias("week"), zeros(MONTH).alias("month")), step)
    out = run.select(*RUN_KEYS, "monthly_seasonality", found.alias("found"))
    each = lambda name, days: out.select(*RUN_KEYS, "monthly_seasonality", F.lit(days).alias("period"), F.posexplode(f"found.{name}").alias("phase", "effect"))
    return each("week", WEEK).unionByName(each("month", MONTH).where("monthly_seasonality")).drop("monthly_seasonality")


def ar_forecast(series: DataFrame, orders: DataFrame, horizon: DataFrame, value: str = "value") -> DataFrame:
    """``reference_date, forecast`` for the days after ``series``: its mean and what an autoregression carries on.

    ``orders (RUN_KEYS, ar_order)`` gives each run its order, ``horizon (RUN_KEYS, campaign_start, end)`` the days.
    Coefficients are those of the Durbin-Levinson recursion at that order; the state, the last days of the series and
    then the forecasts themselves, is carried through a fold over the days.
    """
    most = F.lit(40)
    sums = adjusted_autocovariance(lag_sums(series, 40, value=value))
    latest = F.row_number().over(Window.partitionBy(*RUN_KEYS).orderBy(F.desc("reference_date")))
    mean = F.avg(value).over(Window.partitionBy(*RUN_KEYS))
    tails = series.select(*RUN_KEYS, (F.col(value) - mean).alias("d"), mean.alias("mean"), latest.alias("ago")).where(F.col("ago") <= most)
    tails = tails.groupBy(*RUN_KEYS).agg(F.array_sort(F.collect_list(F.struct("ago", "d"))).alias("tail"), F.max("mean").alias("mean"))
    days = F.datediff("end", "campaign_start") + 1
    runs = sums.join(tails, RUN_KEYS).join(orders.select(*RUN_KEYS, "ar_order"), RUN_KEYS).join(horizon.select(*RUN_KEYS, "campaign_start", days.alias("days")), RUN_KEYS)
    phi = levinson(F.least(F.col("ar_order"), most), lambda state: state["phi"])
    state = F.struct(F.slice(F.transform("tail", lambda t: t["d"]), 1, F.col("ar_order")).alias("last"), F.array().cast("array<double>").alias("out"))

    def carried(phi: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            ahead = total(F.zip_with(phi, s["last"], lambda p, d: F.coalesce(p * d, F.lit(0.0))))
            return let(ahead, lambda a: F.struct(F.slice(F.concat(F.array(a), s["last"]), 1, F.col("ar_order")).alias("last"), F.concat(s["out"], F.array(a)).alias("out")))

        return F.aggregate(numbers(1, F.col("days")), state, step, lambda s: s["out"])

    ahead = runs.select(*RUN_KEYS, "campaign_start", "mean", F.posexplode(let(phi, carried)).alias("day", "ahead"))
    return ahead.select(*RUN_KEYS, F.date_add("campaign_start", F.col("day")).alias("reference_date"), (F.col("mean") + F.col("ahead")).alias("forecast"))


def components(features: DataFrame, runs: DataFrame, orders: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """``reference_date, component, value`` in long form, and ``mean``, their sum: the structural prediction of each day.

    Line, then seasons on what it leaves, then all controls on what these leave, then an autoregression of the last
    rest, which only forecasts: before the campaign it is 0. ``runs`` has RUN_KEYS, campaign_start, end and
    monthly_seasonality. Each step's days, a few columns, are cut from their lineage, which later steps read several
    times: they are computed here.
    """
    features = cut_lineage(features.where(F.col("role").isin("target", "control")))
    lines = cut_lineage(straight_line(features))
    seasons = two_seasons(lines, runs)
    effect = lambda days, name: seasons.where(F.col("period") == days).select(*RUN_KEYS, F.col("phase").alias(f"at_{name}"), F.col("effect").alias(name))
    days = lines.withColumns({"at_weekly": F.col("number") % WEEK, "at_monthly": F.col("number") % MONTH})
    days = days.join(effect(WEEK, "weekly"), [*RUN_KEYS, "at_weekly"], "left").join(effect(MONTH, "monthly"), [*RUN_KEYS, "at_monthly"], "left")
    days = cut_lineage(days.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("weekly", "monthly")}))
    left = days.select(*RUN_KEYS, "reference_date", (F.col("rest") - F.col("weekly") - F.col("monthly")).alias("left"))

    used = features.join(left, [*RUN_KEYS, "reference_date"])
    used = cut_lineage(used.withColumn("value", F.when(F.col("role") == "target", F.col("left")).otherwise(F.col("value"))).drop("left"))
    added = regressor_part(used, sparse_fit(used, penalty)).withColumnRenamed("value", "regressors")
    days = cut_lineage(days.join(added, [*RUN_KEYS, "reference_date"], "left").withColumn("regressors", F.coalesce("regressors", F.lit(0.0))))

    last = _before(days).select(*RUN_KEYS, "reference_date", (F.col("rest") - F.col("weekly") - F.col("monthly") - F.col("regressors")).alias("value"))
    ahead = ar_forecast(last, orders, runs).withColumnRenamed("forecast", "autoregression")
    days = days.join(ahead, [*RUN_KEYS, "reference_date"], "left").withColumn("autoregression", F.coalesce("autoregression", F.lit(0.0)))
    mean = sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in COMPONENTS]))
    return days.withColumn("mean", mean).select(*RUN_KEYS, "reference_date", each, "mean")
