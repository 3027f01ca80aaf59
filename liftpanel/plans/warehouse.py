"""The test warehouse seen as marketing facts, interest tables, case counts and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftpanel.functions import dates as D
from liftpanel.operators.extract import RoleMeasure
from liftpanel.schema import analyses_table
from liftpanel.sources.facts import day_grain, prune_to_windows

# The standard windows.
ORDER_WINDOW = ("1998-01-01", "2000-06-01", "2000-08-31")
EVENT_WINDOW = ("2024-01-08", "2024-01-22", "2024-01-30")

# Holidays of the test markets, the same month-days every year.
HOLIDAYS = (("01-01", "New Year"), ("05-01", "Labour Day"), ("12-25", "Christmas"))

BRAND = "brand"

# The regions, and levels of two columns of the orders.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
ORDER_STATUSES = ["F", "O", "P"]
ORDER_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation key with its nation and region name."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def fact_marketing(
    spark: SparkSession, sf_dir: str, analyses: DataFrame | None = None, with_lines: bool = False
) -> DataFrame:
    """Orders as a marketing fact; a row is one customer's orders of a day, priority and status.

    Orders are combined per customer and day before they meet the customer table, so a customer
    with a third of all orders arrives at that join as a few thousand rows, not as one hot key.
    ``with_lines`` adds clicks and impressions from the order lines, combined per order first for
    the same reason. No side is broadcast by hint: Spark does it below its size threshold.
    """
    orders = table(spark, sf_dir, "orders")
    if analyses is not None:
        orders = prune_to_windows(orders, "o_orderdate", analyses)
    sums = [
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("metric"),
        F.count(F.lit(1)).alias("npc_first_touch"),
        F.lit(1).alias("new_visitors"),
    ]
    if with_lines:
        lines = table(spark, sf_dir, "lineitem")
        if analyses is not None:
            # The wanted orders drop other lines before those are combined.
            lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        lines = (
            lines.groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
        )
        orders = orders.join(lines, "o_orderkey", "left")
        sums += [
            F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("clicks"),
            F.coalesce(F.sum("lines"), F.lit(0)).alias("impressions"),
        ]
    per_customer = orders.groupBy(
        "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus"
    ).agg(*sums)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(markets(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "date",
            F.col("r_name").alias("country_code"),
            F.col("n_name").alias("source_medium"),
            F.col("c_mktsegment").alias("channel"),
            F.col("o_orderstatus").alias("account_name"),
            F.col("o_orderpriority").alias("traffic_group"),
            F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("subchannel"),
            *[c for c in per_customer.columns if c not in ("o_custkey", "date", "o_orderpriority", "o_orderstatus")],
        )
    )


def perimeter():
    """The campaign's perimeter: channel, account and every sub-channel but one, unknown included."""
    return (
        (F.col("channel") == "BUILDING")
        & (F.col("account_name") == "F")
        & ((F.col("subchannel") != "1-URGENT") | F.col("subchannel").isNull())
    )


def paid_traffic():
    """One traffic group does not count as visits, clicks or impressions."""
    return F.col("traffic_group") != "5-LOW"


def role_measures() -> list[RoleMeasure]:
    """All roles over the marketing fact with lines; the target counts in full, not per perimeter."""
    return [
        RoleMeasure("target", F.col("metric")),
        RoleMeasure("control", F.col("metric")),
        RoleMeasure("visitor", F.col("new_visitors"), paid_traffic()),
        RoleMeasure("click", F.col("clicks"), paid_traffic()),
        RoleMeasure("impression", F.col("impressions"), paid_traffic()),
        RoleMeasure("npc", F.col("npc_first_touch")),
    ]


def fact_payment(spark: SparkSession, sf_dir: str, analyses: DataFrame) -> DataFrame:
    events = prune_to_windows(table(spark, sf_dir, "events"), "ts", analyses)
    return day_grain(
        events.select(F.col("ts").alias("payment_ts"), F.col("event_type").alias("subject"), F.col("value").alias("gmv_proceeds_usd")),
        "payment_ts",
    )


def _panel(names: DataFrame, window, **settings) -> DataFrame:
    """One analysis per name: it is the target, all other names are its controls."""
    all_names = names.agg(F.array_sort(F.collect_set("name")).alias("names")).scalar()
    start, campaign_start, end = window
    return analyses_table(
        names.select(
            F.col("name").alias("analysis_id"),
            F.col("name").alias("target"),
            F.array_remove(all_names, F.col("name")).alias("controls"),
            F.col("name").alias("country"),
            F.lit(start).cast("date").alias("start"),
            F.lit(campaign_start).cast("date").alias("campaign_start"),
            F.lit(end).cast("date").alias("end"),
            *[F.lit(v).alias(k) for k, v in settings.items()],
        )
    )


def region_analyses(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return _panel(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), ORDER_WINDOW, **settings)


def nation_analyses(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return _panel(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), ORDER_WINDOW, **settings)


def event_analyses(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return _panel(names, EVENT_WINDOW, **settings)


def supplier_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One window per supplier: first to last shipment, the last tenth of it as the campaign."""
    lines = table(spark, sf_dir, "lineitem")
    first, last = F.min(F.to_date("l_shipdate")), F.max(F.to_date("l_shipdate"))
    span = F.floor(F.datediff("end", "start") * 9 / 10).cast("int")
    return (
        lines.groupBy(F.col("l_suppkey").cast("string").alias("analysis_id"))
        .agg(first.alias("start"), last.alias("end"))
        .withColumn("campaign_start", F.date_add("start", span))
    )


def line_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantity per part type, supplier region and day, the raw material of 'interest'.

    Lines are combined per part, supplier and day first, so neither a hot part nor a hot supplier
    meets a join as a hot key.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("reference_date"))
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        lines.join(part, lines["l_partkey"] == part["p_partkey"])
        .join(supplier, lines["l_suppkey"] == supplier["s_suppkey"])
        .join(markets(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("r_name").alias("geo"), F.col("p_type").alias("keyword"), "reference_date")
        .agg(F.sum("quantity").alias("value"))
    )


def with_brand(by_keyword: DataFrame) -> DataFrame:
    """Add the world-wide brand series: all keywords of all markets together, in the same pass."""
    twice = F.array(
        F.struct("geo", "keyword"), F.struct(F.lit("").alias("geo"), F.lit(BRAND).alias("keyword"))
    )
    return (
        by_keyword.select(F.inline(twice), "reference_date", "value")
        .groupBy("geo", "keyword", "reference_date")
        .agg(F.sum("value").alias("value"))
    )


def weekly_interest(by_day: DataFrame) -> DataFrame:
    """Weekly values, dated by the Sunday that starts the week."""
    return by_day.groupBy("geo", "keyword", D.week_start("reference_date").alias("reference_date")).agg(
        F.sum("value").alias("value")
    )


def daily_interest(by_day: DataFrame) -> DataFrame:
    """Daily values, 100 for the best day of the month."""
    best = F.max("value").over(Window.partitionBy("geo", "keyword", F.trunc("reference_date", "MM")))
    return by_day.withColumn("value", F.round(F.col("value") * 100 / best, 0))


def case_counts(spark: SparkSession, sf_dir: str, with_gaps: bool = False) -> DataFrame:
    """Running order counts per nation as 'cumulative cases' of its region; on the 17th the count is 5 too low.

    ``with_gaps``, for what fills gaps: days divisible by 9, the first 40 and the last 5 days are not reported.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_day = (
        orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("reference_date"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "reference_date")
        .agg(F.sum("orders").alias("orders"))
    )
    extent = orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    lo, hi = extent.select("lo").scalar(), extent.select("hi").scalar()
    calendar = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.explode(D.days(lo, hi)).alias("reference_date"),
        F.lit(0).cast("bigint").alias("orders"),
    )
    running = Window.partitionBy("c_nationkey").orderBy("reference_date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        calendar.unionByName(per_day)
        .groupBy("c_nationkey", "reference_date")
        .agg(F.sum("orders").alias("orders"))
        .withColumn("cases", F.sum("orders").over(running) - F.when(F.day("reference_date") == 17, 5).otherwise(0))
        .where(
            F.lit(not with_gaps)
            | (
                (F.day("reference_date") % 9 != 0)
                & (F.col("reference_date") >= F.date_add(lo, 40))
                & (F.col("reference_date") <= F.date_sub(hi, 5))
            )
        )
        .join(markets(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("r_name").alias("target"), "reference_date", F.col("cases").cast("double").alias("cases"))
    )


def holiday_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, date, name) for every region and every year that has orders."""
    orders = table(spark, sf_dir, "orders").agg(
        F.year(F.min("o_orderdate")).alias("lo"), F.year(F.max("o_orderdate")).alias("hi")
    )
    years = F.sequence(orders.select("lo").scalar(), orders.select("hi").scalar())
    days = F.array(*[F.struct(F.lit(day).alias("day"), F.lit(name).alias("name")) for day, name in HOLIDAYS])
    return (
        table(spark, sf_dir, "region")
        .select(F.col("r_name").alias("country"), F.explode(years).alias("year"))
        .select("country", "year", F.inline(days))
        .select("country", F.concat_ws("-", "year", "day").cast("date").alias("date"), "name")
    )
