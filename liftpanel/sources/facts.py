"""Fact tables, cumulative-count files and search-interest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftpanel.functions import dates as D

#: Takes the line of a row that the CSV parser could not cut into cells.
CORRUPT = "_malformed_line"


def read_fact(spark: SparkSession, path: str, date_col: str, start, end) -> DataFrame:
    """Rows of a Parquet fact table whose day lies in [start, end]; the bounds reach the scan.

    The bound is written on the raw column, half open, so that a timestamp column is pruned by
    its row-group statistics as well as a date column is.
    """
    day_after_end = F.date_add(F.lit(end).cast("date"), 1)
    return spark.read.parquet(path).where(
        (F.col(date_col) >= F.lit(start).cast("date")) & (F.col(date_col) < day_after_end)
    )


def prune_to_windows(fact: DataFrame, date_col: str, analyses: DataFrame) -> DataFrame:
    """Keep the days that at least one analysis (or its placebo) can use.

    The two bounds are scalar subqueries: Spark evaluates them first and pushes the resulting
    constants into the fact scan, nothing is collected here.
    """
    bounds = analyses.agg(
        F.min(D.extended_start("start", "campaign_start", "end")).alias("lo"),
        F.date_add(F.max("end"), 1).alias("hi"),
    )
    day_type = fact.schema[date_col].dataType
    lo = bounds.select(F.col("lo").cast(day_type)).scalar()
    hi = bounds.select(F.col("hi").cast(day_type)).scalar()
    return fact.where((F.col(date_col) >= lo) & (F.col(date_col) < hi))


def day_grain(fact: DataFrame, ts_col: str, date_col: str = "reference_date") -> DataFrame:
    return fact.withColumn(date_col, F.to_date(ts_col))


def load_months(source: DataFrame, path: str, date_col: str, start, campaign_start, end) -> None:
    """Copy every whole month the analysis needs into a month-partitioned table at ``path``.

    One job for all months. Each month is replaced as a whole, also by nothing if the source has no rows of
    it any more, so a second run after a failure gives the same table; months outside the range are left
    alone. ``rebalance`` lets Spark split a month that is much larger than the others instead of writing
    it from one task.
    """
    spark = source.sparkSession
    day = F.to_date(date_col)
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    cs = F.lit(campaign_start).cast("date")
    months = source.where(
        (F.col(date_col) >= D.whole_month_start(lo, cs, hi))
        & (F.col(date_col) < F.date_add(D.whole_month_end(hi), 1))
    ).withColumn("month", F.date_format(day, "yyyy-MM"))
    (
        months.hint("rebalance", "month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )
    whole = D.month_starts(D.whole_month_start(lo, cs, hi), D.whole_month_end(hi))
    wanted = spark.range(1).select(F.explode(whole).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    there = spark.read.parquet(path).select(F.date_format(day, "yyyy-MM").alias("month")).distinct().join(wanted, "month")
    for row in there.join(months.select("month").distinct(), "month", "left_anti").collect():
        months.drop("month").limit(0).write.mode("overwrite").parquet(f"{path}/month={row['month']}")


def _csv_schema(columns: list[str], date_col: str) -> T.StructType:
    """All cells as text, and ``CORRUPT`` for a line with another number of cells."""
    if date_col not in ("date", "datetime"):
        raise ValueError(f"unknown date column {date_col!r}: expected 'date' or 'datetime'")
    if missing := {date_col, "cases"} - set(columns):
        raise ValueError(f"the header has no column {sorted(missing)}")
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def _accepted_and_rejected(rows: DataFrame, line: Column, corrupt: Column, day: Column, cases: Column) -> tuple[DataFrame, DataFrame]:
    parsed = rows.select(
        line.alias("line"),
        corrupt.isNotNull().alias("malformed"),
        F.substring(day, 1, 10).try_cast("date").alias("reference_date"),
        cases.try_cast("double").alias("cases"),
    )
    reason = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("reference_date").isNull(), "no day")
        .when(F.col("cases").isNull(), "no number")
    )
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select("reference_date", "cases"), judged.where("reason is not null").select("line", "reason")


def split_cumulative_csv(spark: SparkSession, path: str, date_col: str) -> tuple[DataFrame, DataFrame]:
    """Cumulative counts from CSV files: ``reference_date, cases`` of the rows accepted and ``line, reason`` of the others.

    The day stands in ``date`` (one row a day) or ``datetime`` (one per region and day). Columns go by the
    header's names, other ones may stand beside them in any order. Each file's header must be that of the first,
    a file with another one fails the job. A row is rejected as ``malformed`` (other number of cells), ``no day``
    or ``no number``; its line is given as it was if malformed, otherwise put together from its cells.
    """
    columns = spark.read.option("header", True).csv(path).columns
    # Without pruning a line is judged by all its cells, whatever columns are wanted.
    options = {"header": True, "enforceSchema": False, "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}
    rows = spark.read.schema(_csv_schema(columns, date_col)).options(**options).csv(path)
    line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])))
    return _accepted_and_rejected(rows, line, F.col(CORRUPT), F.col(date_col), F.col("cases"))


def split_cumulative_lines(lines: DataFrame, columns: list[str], date_col: str, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """The same for lines without a header, such as messages or a column of a table."""
    options = {"columnNameOfCorruptRecord": CORRUPT}
    schema = ", ".join(f"`{f.name}` string" for f in _csv_schema(columns, date_col))
    cells = F.from_csv(F.col(line_col), schema, options)
    rows = lines.select(F.col(line_col).alias("line"), cells.alias("cells"))
    return _accepted_and_rejected(rows, F.col("line"), F.col(f"cells.{CORRUPT}"), F.col(f"cells.{date_col}"), F.col("cells.cases"))


def read_cumulative_csv(spark: SparkSession, path: str, date_col: str) -> DataFrame:
    """Cumulative counts from CSV without the rows that ``split_cumulative_csv`` rejects."""
    return split_cumulative_csv(spark, path, date_col)[0]


def read_interest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Search interest ``(geo, keyword, reference_date, value)``; a partial-period marker is dropped.

    ``geo`` is the market, empty for world-wide interest.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path).drop("isPartial")
    return raw.select(
        F.coalesce("geo", F.lit("")).alias("geo"),
        "keyword",
        F.to_date("reference_date").alias("reference_date"),
        F.col("value").cast("double").alias("value"),
    )


def conform_role(df: DataFrame, value_name: str) -> DataFrame:
    """Check a role series' three column names, cast the day to date and the value to double."""
    expected = ["reference_date", "campaign_dimension", value_name]
    if df.columns != expected:
        raise ValueError(f"a {value_name} series needs the columns {expected}, not {df.columns}")
    return df.select(
        F.col("reference_date").cast("date").alias("reference_date"),
        F.col("campaign_dimension").cast("string").alias("campaign_dimension"),
        F.col(value_name).cast("double").alias(value_name),
    )


def extract_sql(
    spark: SparkSession, sql: str, args: dict, value_name: str = "metric", **frames: DataFrame
) -> DataFrame:
    """Role series from the user's own SQL; start, end, target and control are bound, not spliced.

    A control list is bound as an array: ``array_contains(:control, country_code)``. DataFrames
    given by name stand for ``{name}`` in the text.
    """
    bound: dict[str, Column | object] = {
        k: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else v for k, v in args.items()
    }
    return conform_role(spark.sql(sql, args=bound, **frames), value_name)
