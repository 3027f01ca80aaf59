"""Stage tables, result tables and the register of runs: Parquet in buckets of analyses, read through a manifest.

A store is a folder of tables. A change writes its rows aside, as folders ``<table>/snapshot=…/bucket=…`` that are
never touched again, and then one small manifest file with the folders that count from now on. The file appears
whole or not at all, so a reader sees all tables before or after a change, and what it resolved stays as it is.
A stage at ``folder/name`` is the table ``name`` of the store ``folder``. A table's schema is declared, so reading
one run looks at no file of another bucket, and ids stay text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftpanel.schema import MAIN, RUN_KEYS, SERIES

# Buckets of a new table; an existing one keeps the number in its manifest. A bucket is what a change rewrites.
BUCKETS = 64
# A row for each folder that counts; a table without rows has one without a folder, for its number of buckets.
MANIFEST = "table_name string, buckets int, bucket int, snapshot string"

_EFFECTS = ", ".join(f"{k}_{b} double" for k in ("point_effects", "post_cum_effects") for b in ("means", "lower", "upper"))
_PREDICTIONS = ", ".join(f"{k}_preds_{b} double" for k in ("complete",) for b in ("means", "lower", "upper"))
RESULT_SCHEMAS = {
    "runs": "analysis_id string, run_kind string, target string, start date, campaign_start date, end date, "
    "monthly_seasonality boolean, yearly_seasonality boolean, fix_order boolean, alpha double, model_name string, ar_order int, "
    "mape double, p_value double, specificity_test string, elapsed_s double, status string",
    "inferences": "analysis_id string, run_kind string, campaign_start date, reference_date date, observed double, "
    f"{_PREDICTIONS}, {_EFFECTS}, error double, perc_error double",
    "summary_data": "analysis_id string, run_kind string, quantity_ord int, quantity string, average double, cumulative double",
    "features": "analysis_id string, run_kind string, campaign_start date, role string, feature string, reference_date date, "
    "value double, mean double, std double, scaled double",
}
RESULT_TABLES = tuple(RESULT_SCHEMAS)


def empty_series(spark: SparkSession, schema: T.StructType = SERIES) -> DataFrame:
    """Typed empty series, for a role that no analysis uses."""
    return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset one in the warehouse, which is shared too."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/liftpanel-work"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and go on from there.

    Lost executors then cost a read, later readers take only the columns they need, and plans stay small.
    The table stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/liftpanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(analysis_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(analysis_id), F.lit(buckets)).cast("int")


def replaced(old: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """``old`` without the rows whose key is in ``gone``, and ``new``. ``gone`` names the key columns, and must
    name what ``new`` brings: a key without new rows is emptied."""
    return old.join(gone.distinct(), gone.columns, "left_anti").unionByName(new, allowMissingColumns=True)


def _parquet(spark: SparkSession, schema: T.StructType | str, base: str, *folders: str) -> DataFrame:
    """Files below ``folders`` (default: ``base``) with the partition columns that follow from ``base``; no rows if there are none."""
    try:
        return spark.read.schema(schema).option("basePath", base).parquet(*(folders or [base]))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Manifest:
    """One state of a store: its version (0: nothing was written yet) and a row for each folder that counts."""

    version: int
    rows: tuple[Row, ...] = ()

    def buckets(self, table: str) -> int | None:
        return next((r.buckets for r in self.rows if r.table_name == table), None)

    def folders(self, table: str, among: set[int] | None = None) -> list[str]:
        own = [r for r in self.rows if r.table_name == table and r.snapshot is not None]
        return [f"snapshot={r.snapshot}/bucket={r.bucket}" for r in own if among is None or r.bucket in among]


def resolve(spark: SparkSession, store: str, version: int | None = None) -> Manifest:
    """The state of a store, the latest one by default: a few rows for each table and bucket."""
    table = _parquet(spark, f"{MANIFEST}, version long", f"{store}/manifest")
    if version is None:
        version = table.agg(F.max("version").alias("version")).first()["version"] or 0
    rows = table.where(F.col("version") == version).drop("version").collect()
    if version and not rows:
        raise ValueError(f"{store} has no version {version}")
    return Manifest(version, tuple(rows))


@dataclass
class Change:
    """Tables written aside on top of ``base``, to be published together: by table its number of buckets, the
    buckets whose old folders end, and the new folders as (bucket, snapshot)."""

    store: str
    base: Manifest
    tables: dict[str, tuple[int, set[int], list[tuple[int, str]]]] = field(default_factory=dict)

    def put(self, df: DataFrame, table: str, keys, gone: DataFrame | None = None, buckets: int = BUCKETS) -> None:
        """Write ``df`` aside, once, and what is left of the buckets that it or ``gone`` concerns."""
        spark, keys = df.sparkSession, list(keys)
        count = self.base.buckets(table) or buckets
        bucketed = T.StructType([*df.schema.fields, T.StructField("bucket", T.IntegerType())])

        def aside(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, str]]]:
            snapshot = uuid.uuid4().hex
            folder = f"{self.store}/{table}/snapshot={snapshot}"
            # Small buckets share a task, one that is far larger than the others is split.
            placed = rows.withColumn("bucket", bucket_of(F.col("analysis_id"), count)).hint("rebalance", "bucket")
            placed.sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(folder)
            there = _parquet(spark, bucketed, folder)
            return there, [(r["bucket"], snapshot) for r in there.select("bucket").distinct().collect()]

        there, new = aside(df)
        gone = (there if gone is None else gone).select(*keys).distinct()
        named = gone.select(bucket_of(F.col("analysis_id"), count).alias("bucket")).distinct().collect()
        concerned = {r["bucket"] for r in named} | {b for b, _ in new}
        if self.base.folders(table, concerned):
            old = read_table(spark, self.store, table, df.schema, self.base, concerned)
            new += aside(old.drop("bucket").join(gone, keys, "left_anti"))[1]
        self.tables[table] = (count, concerned, new)

    def publish(self, spark: SparkSession) -> int:
        """Make all tables of the change count, at once; the new version. Raises if the store went on since ``base``:
        a store has one writer at a time."""
        if resolve(spark, self.store).version != self.base.version:
            raise RuntimeError(f"{self.store} was changed since version {self.base.version}")
        rows = []
        for table in {r.table_name for r in self.base.rows} | set(self.tables):
            count, concerned, new = self.tables.get(table, (self.base.buckets(table), set(), []))
            kept = [(r.bucket, r.snapshot) for r in self.base.rows if r.table_name == table and r.snapshot and r.bucket not in concerned]
            rows += [(table, count, bucket, snapshot) for bucket, snapshot in kept + new or [(None, None)]]
        version = self.base.version + 1
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.store}/manifest/version={version}")
        return version


def read_table(
    spark: SparkSession, store: str, table: str, schema: T.StructType, manifest: Manifest, among: set[int] | None = None
) -> DataFrame:
    """A table in one state of its store, with ``bucket``. Columns that a file has not are null."""
    extra = [T.StructField("snapshot", T.StringType()), T.StructField("bucket", T.IntegerType())]
    full, base = T.StructType([*schema.fields, *extra]), f"{store}/{table}"
    folders = [f"{base}/{folder}" for folder in manifest.folders(table, among)]
    found = _parquet(spark, full, base, *folders) if folders else spark.createDataFrame([], full)
    return found.drop("snapshot")


def _store_of(path: str) -> tuple[str, str]:
    store, _, table = path.rstrip("/").rpartition("/")
    return store, table


def write_stage(df: DataFrame, path: str, keys=("analysis_id",), gone: DataFrame | None = None, buckets: int = BUCKETS) -> int:
    """Replace the rows of the keys in ``gone`` (default: those in ``df``) by ``df``; others are kept. The new version.

    ``keys`` begin with ``analysis_id``. The buckets concerned are written anew, ``df`` is computed once.
    """
    store, table = _store_of(path)
    change = Change(store, resolve(df.sparkSession, store))
    change.put(df, table, keys, gone, buckets)
    return change.publish(df.sparkSession)


def read_stage(
    spark: SparkSession, path: str, schema: T.StructType | str, analysis_id: str | None = None, manifest: Manifest | None = None
) -> DataFrame:
    """Read a stage by its declared schema, as it is now or in the state of ``manifest``; naming an analysis reads its
    bucket only. Columns that a file has not are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    store, table = _store_of(path)
    manifest = manifest or resolve(spark, store)
    if analysis_id is None:
        return read_table(spark, store, table, schema, manifest).drop("bucket")
    bucket = bucket_of(F.lit(analysis_id), manifest.buckets(table) or BUCKETS)
    number = spark.sql("SELECT 1").select(bucket).first()[0]
    own = read_table(spark, store, table, schema, manifest, {number})
    return own.where((F.col("bucket") == bucket) & (F.col("analysis_id") == analysis_id)).drop("bucket")


def results_change(results: dict[str, DataFrame], change: Change, keys: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write result tables aside, in their declared types."""
    unknown = set(results) - set(RESULT_TABLES)
    if unknown:
        raise ValueError(f"unknown result tables {sorted(unknown)}")
    for name, df in results.items():
        schema = T.StructType.fromDDL(RESULT_SCHEMAS[name])
        typed = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        change.put(typed, name, RUN_KEYS, keys, buckets)


def save_results(results: dict[str, DataFrame], path: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Save result tables, all in one change. All rows of the runs in ``keys (RUN_KEYS)`` are replaced, also in tables
    that have no rows for them any more; without it, the runs of each table."""
    if results:
        spark = next(iter(results.values())).sparkSession
        change = Change(path, resolve(spark, path))
        results_change(results, change, keys if keys is None else cut_lineage(keys), buckets)
        change.publish(spark)


def load_results(
    spark: SparkSession,
    path: str,
    analysis_id: str | None,
    run_kind: str | None = MAIN,
    tables=RESULT_TABLES,
    version: int | None = None,
) -> dict[str, DataFrame]:
    """Result tables of one run in one state of the store, the latest or ``version``. None as ``analysis_id`` or
    ``run_kind`` is all of them."""
    manifest = resolve(spark, path, version)
    loaded = {name: read_stage(spark, f"{path}/{name}", RESULT_SCHEMAS[name], analysis_id, manifest) for name in tables}
    return loaded if run_kind is None else {name: df.where(F.col("run_kind") == run_kind) for name, df in loaded.items()}


def list_runs(runs: DataFrame) -> DataFrame:
    """Known analyses; a placebo run is listed under its analysis."""
    return runs.select("analysis_id").distinct()


def check_names(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """For each wanted ``analysis_id``: is the name already taken?"""
    known = list_runs(runs).withColumn("taken", F.lit(True))
    return wanted.select("analysis_id").distinct().join(known, "analysis_id", "left").select(
        "analysis_id", F.coalesce("taken", F.lit(False)).alias("taken")
    )


def delete_run(spark: SparkSession, path: str, analysis_id: str, run_kind: str = MAIN) -> bool:
    """Drop one run, main or placebo, from every result table, in one change; True if anything was there."""
    gone = spark.createDataFrame([(analysis_id, run_kind)], "analysis_id string, run_kind string")
    change = Change(path, resolve(spark, path))
    for name, schema in RESULT_SCHEMAS.items():
        there = read_stage(spark, f"{path}/{name}", schema, analysis_id, change.base).where(F.col("run_kind") == run_kind)
        if not there.isEmpty():
            change.put(spark.createDataFrame([], schema), name, RUN_KEYS, gone)
    if change.tables:
        change.publish(spark)
    return bool(change.tables)
