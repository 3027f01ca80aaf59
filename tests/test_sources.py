from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from liftpanel.schema import ANALYSES, SERIES, analyses_table
from liftpanel.sources import facts, stages
from tests.conftest import SMALL
from tests.helpers import DAY, analyses_df


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_read_reaches_the_scan(spark):
    df = facts.read_fact(spark, f"{SMALL}/lineitem.parquet", "l_shipdate", "1998-01-01", "1998-01-31")
    plan = plan_of(df.select("l_orderkey"))
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in plan
    assert "LessThan(l_shipdate,1998" in plan and "< 1998-02-01 00:00:00" in plan
    assert "l_extendedprice" not in plan
    found = df.agg(F.min("l_shipdate"), F.max("l_shipdate")).first()
    assert found[0] >= datetime(1998, 1, 1) and found[1] < datetime(1998, 2, 1)


def test_month_copy_is_whole_idempotent_and_keeps_other_months(spark, tmp_path):
    source = spark.createDataFrame([(date(2020, 1, 1) + i * DAY, i) for i in range(400)], "day date, v int")
    path = str(tmp_path / "copy")
    window = (date(2020, 5, 10), date(2020, 8, 1), date(2020, 8, 20))
    facts.load_months(source, path, "day", *window)
    facts.load_months(source, path, "day", *window)
    copy = spark.read.parquet(path)
    # The placebo starts 20 days earlier, on 2020-04-20.
    assert copy.agg(F.min("day"), F.max("day"), F.count("*")).first()[:] == (date(2020, 4, 1), date(2020, 8, 31), 153)
    facts.load_months(source, path, "day", date(2020, 12, 1), date(2020, 12, 20), date(2020, 12, 25))
    assert spark.read.parquet(path).count() == 153 + 30 + 31


def test_cumulative_csv_in_both_layouts(spark, tmp_path):
    (tmp_path / "us.csv").write_text("date,cases,deaths\n2020-03-01,5,0\n2020-03-02,9,1\n")
    (tmp_path / "eu.csv").write_text("region,datetime,cases\nA,2020-03-01T18:00:00,5\nB,2020-03-01T18:00:00,2\n")
    us = facts.read_cumulative_csv(spark, str(tmp_path / "us.csv"), "date")
    eu = facts.read_cumulative_csv(spark, str(tmp_path / "eu.csv"), "datetime")
    assert [tuple(r) for r in us.orderBy("cases").collect()] == [(date(2020, 3, 1), 5.0), (date(2020, 3, 2), 9.0)]
    assert sorted(tuple(r) for r in eu.collect()) == [(date(2020, 3, 1), 2.0), (date(2020, 3, 1), 5.0)]
    with pytest.raises(ValueError):
        facts.read_cumulative_csv(spark, str(tmp_path / "us.csv"), "when")


def test_cumulative_csv_gives_rejected_rows_with_a_reason(spark, tmp_path):
    head = "cases,date,note\n"
    (tmp_path / "a.csv").write_text(head + "5,2020-03-01,x\n6,2020-03-02\n7,2020-03-03,x,y\n")
    (tmp_path / "b.csv").write_text(head + "n/a,2020-03-04,x\n8,soon,x\n,2020-03-05,x\n9,2020-03-06,\n")
    accepted, rejected = facts.split_cumulative_csv(spark, str(tmp_path), "date")
    assert sorted(map(tuple, accepted.collect())) == [(date(2020, 3, 1), 5.0), (date(2020, 3, 6), 9.0)]
    want = {("6,2020-03-02", "malformed"), ("7,2020-03-03,x,y", "malformed"), ("n/a,2020-03-04,x", "no number"), ("8,soon,x", "no day")}
    got = {tuple(r) for r in rejected.collect()}
    assert want < got and [r for _, r in got - want] == ["no number"]
    assert accepted.count() == 2 and rejected.count() == 5
    (tmp_path / "c.csv").write_text("date,cases,note\n2020-03-07,1,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        facts.split_cumulative_csv(spark, str(tmp_path), "date")[0].collect()
    (tmp_path / "alone").mkdir()
    (tmp_path / "alone" / "d.csv").write_text("date,deaths\n2020-03-07,1\n")
    with pytest.raises(ValueError, match="cases"):
        facts.split_cumulative_csv(spark, str(tmp_path / "alone"), "date")


def test_cumulative_lines(spark):
    lines = spark.createDataFrame([("A,2020-03-01T18:00:00,5",), ("A,2020-03-01",), ("",), (None,)], "line string")
    accepted, rejected = facts.split_cumulative_lines(lines, ["region", "datetime", "cases"], "datetime")
    assert [tuple(r) for r in accepted.collect()] == [(date(2020, 3, 1), 5.0)]
    assert {r.line for r in rejected.collect()} == {"A,2020-03-01", "", None}


def test_interest_reader_drops_the_partial_marker(spark, tmp_path):
    (tmp_path / "i.csv").write_text("geo,keyword,reference_date,value,isPartial\n,k,2020-01-05,7,False\nDE,k,2020-01-05,3,True\n")
    got = facts.read_interest(spark, str(tmp_path / "i.csv"), "csv")
    assert got.columns == ["geo", "keyword", "reference_date", "value"]
    assert sorted(tuple(r) for r in got.collect()) == [("", "k", date(2020, 1, 5), 7.0), ("DE", "k", date(2020, 1, 5), 3.0)]


def test_role_contract(spark):
    good = spark.createDataFrame([("2020-01-01", "x", 3)], "reference_date string, campaign_dimension string, metric int")
    assert facts.conform_role(good, "metric").dtypes == [
        ("reference_date", "date"),
        ("campaign_dimension", "string"),
        ("metric", "double"),
    ]
    with pytest.raises(ValueError):
        facts.conform_role(good, "visitor")
    with pytest.raises(ValueError):
        facts.conform_role(good.select("metric", "reference_date", "campaign_dimension"), "metric")


def test_bound_values_are_data_not_sql(spark):
    fact = spark.createDataFrame([("2020-01-01", "it's", 3)], "d string, c string, m int")
    sql = "SELECT d AS reference_date, c AS campaign_dimension, sum(m) AS metric FROM {fact} WHERE array_contains(:control, c) GROUP BY 1, 2"
    one = facts.extract_sql(spark, sql, {"control": ["it's"]}, fact=fact).collect()
    assert [r.metric for r in one] == [3.0]


def test_analyses_defaults(spark):
    df = analyses_df(spark, [("a", "t", ["c"], date(2020, 1, 1), date(2020, 6, 1), date(2020, 7, 1))])
    assert df.columns == ANALYSES.names
    row = df.first()
    assert row.search_model == "search" and row.alpha == 0.05 and row.keywords == [] and row.disable_gtrend and row.geo == "t"
    cells = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in ("alpha", "spec_thr", "visitor_usage", "geo")})
    row = analyses_table(cells.withColumn("country", F.lit("DE"))).first()
    assert (row.alpha, row.spec_thr, row.visitor_usage, row.geo) == (0.05, 0.95, False, "DE")
    with pytest.raises(ValueError, match="controls"):
        analyses_table(df.drop("controls"))


def test_empty_series_is_typed(spark):
    assert stages.empty_series(spark).schema == SERIES
    assert stages.empty_series(spark).count() == 0


def test_stage_replaces_only_its_analyses(spark, tmp_path):
    path = str(tmp_path / "stage")
    stages.write_stage(spark.createDataFrame([("007", 1), ("b", 2), ("c", 3)], "analysis_id string, v int"), path)
    schema = "analysis_id string, v int, w string"
    stages.write_stage(spark.createDataFrame([("007", 5, "x")], schema), path)
    got = {(r.analysis_id, r.v, r.w) for r in stages.read_stage(spark, path, schema).collect()}
    assert got == {("007", 5, "x"), ("b", 2, None), ("c", 3, None)}
    one = stages.read_stage(spark, path, schema, "007")
    assert one.count() == 1 and "PartitionFilters: [isnotnull(bucket" in plan_of(one)
    gone = spark.createDataFrame([("b",), ("c",), ("never there",)], "analysis_id string")
    stages.write_stage(spark.createDataFrame([("c", 9, None)], schema), path, gone=gone)
    assert {tuple(r) for r in stages.read_stage(spark, path, schema).collect()} == {("007", 5, "x"), ("c", 9, None)}


def test_results_round_trip_listing_and_deletion(spark, tmp_path):
    path = str(tmp_path / "results")
    ids = [("a: 1", "main"), ("a: 1", "spec"), ("b", "main")]
    tables = {}
    for name, ddl in stages.RESULT_SCHEMAS.items():
        width = len(spark.createDataFrame([], ddl).columns)
        tables[name] = spark.createDataFrame([(*i, *[None] * (width - 2)) for i in ids], ddl)
    stages.save_results(tables, path)
    loaded = stages.load_results(spark, path, "a: 1", "spec")
    assert set(loaded) == set(stages.RESULT_TABLES) and all(df.count() == 1 for df in loaded.values())
    runs = stages.read_stage(spark, f"{path}/runs", stages.RESULT_SCHEMAS["runs"])
    assert sorted(r.analysis_id for r in stages.list_runs(runs).collect()) == ["a: 1", "b"]
    wanted = spark.createDataFrame([("b",), ("c",)], "analysis_id string")
    assert {tuple(r) for r in stages.check_names(wanted, runs).collect()} == {("b", True), ("c", False)}
    assert stages.delete_run(spark, path, "a: 1", "spec")
    assert not stages.delete_run(spark, path, "a: 1", "spec")
    for name, ddl in stages.RESULT_SCHEMAS.items():
        left = {(r.analysis_id, r.run_kind) for r in stages.read_stage(spark, f"{path}/{name}", ddl).collect()}
        assert left == {("a: 1", "main"), ("b", "main")}
    # A run that is saved again without some rows loses them; other runs keep theirs.
    again = spark.createDataFrame([("a: 1", "main")], "analysis_id string, run_kind string")
    stages.save_results({"inferences": tables["inferences"].limit(0)}, path, again)
    left = stages.read_stage(spark, f"{path}/inferences", stages.RESULT_SCHEMAS["inferences"]).collect()
    assert {(r.analysis_id, r.run_kind) for r in left} == {("b", "main")}
    with pytest.raises(ValueError):
        stages.save_results({"other": tables["runs"]}, path)


def test_a_reader_sees_a_store_before_or_after_a_change(spark, tmp_path):
    store = str(tmp_path)
    ids = [(f"a{i}", k) for i in range(12) for k in ("main", "spec")]
    schemas = {n: stages.RESULT_SCHEMAS[n] for n in ("summary_data", "inferences")}

    def rows(ddl, kept):
        width = len(spark.createDataFrame([], ddl).columns)
        return spark.createDataFrame([(*i, *[None] * (width - 2)) for i in kept], ddl)

    def sizes(version=None):
        return {n: t.count() for n, t in stages.load_results(spark, store, None, None, tuple(schemas), version).items()}

    stages.save_results({n: rows(d, ids) for n, d in schemas.items()}, store, buckets=4)
    before = stages.resolve(spark, store)
    assert before.version == 1 and before.buckets("inferences") == 4
    held = stages.load_results(spark, store, "a3", None, tuple(schemas))
    # Tables of a change that is not published yet do not count, published ones do all at once.
    gone = spark.createDataFrame(ids, "analysis_id string, run_kind string").where("run_kind = 'spec'")
    change = stages.Change(store, before)
    stages.results_change({n: rows(d, []) for n, d in schemas.items()}, change, gone)
    assert sizes() == {"summary_data": 24, "inferences": 24}
    late = stages.Change(store, before)
    stages.results_change({"inferences": rows(schemas["inferences"], ids[:1])}, late)
    assert change.publish(spark) == 2
    assert sizes() == {"summary_data": 12, "inferences": 12} and sizes(1) == {"summary_data": 24, "inferences": 24}
    assert all(t.count() == 2 for t in held.values())
    # Who began before another's change does not undo it.
    with pytest.raises(RuntimeError, match="since version 1"):
        late.publish(spark)
    with pytest.raises(ValueError, match="no version 9"):
        stages.resolve(spark, store, 9)
    # A table that loses all its rows keeps its number of buckets and can be filled again.
    all_keys = spark.createDataFrame(ids, "analysis_id string, run_kind string")
    stages.save_results({n: rows(d, []) for n, d in schemas.items()}, store, all_keys)
    assert sizes() == {"summary_data": 0, "inferences": 0} and stages.resolve(spark, store).buckets("inferences") == 4
    stages.save_results({"inferences": rows(schemas["inferences"], ids[:3])}, store)
    assert sizes() == {"summary_data": 0, "inferences": 3}


def test_a_change_computes_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    base = spark.range(20).select(F.col("id").cast("string").alias("analysis_id"))
    stages.write_stage(base, str(tmp_path / "t"))
    stages.write_stage(spark.createDataFrame(base.rdd.mapPartitions(count), base.schema), str(tmp_path / "t"))
    assert seen.value == 20 and stages.read_stage(spark, str(tmp_path / "t"), base.schema).count() == 20


def test_a_month_emptied_at_the_source_is_emptied_in_the_copy(spark, tmp_path):
    source = spark.createDataFrame([(date(2020, 1, 1) + i * DAY, i) for i in range(200)], "day date, v int")
    path, window = str(tmp_path / "copy"), (date(2020, 3, 1), date(2020, 5, 1), date(2020, 5, 20))
    facts.load_months(source, path, "day", *window)
    facts.load_months(source.where("month(day) <> 4"), path, "day", *window)
    months = {r[0] for r in spark.read.parquet(path).select(F.month("day")).distinct().collect()}
    assert 4 not in months and {3, 5} <= months


def test_lineage_is_cut_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert stages.shared_folder(spark).removeprefix("file:").startswith(folder.removeprefix("file:"))
    before = {p.name for p in Path(folder).rglob("liftpanel-*")}
    df = stages.cut_lineage(spark.range(10).withColumn("x", F.rand(1)))
    assert len({p.name for p in Path(folder).rglob("liftpanel-*")} - before) == 1
    assert df.count() == 10 and "Scan parquet" in plan_of(df)
    empty = stages.cut_lineage(df.where("id > 100"))
    assert empty.count() == 0 and empty.schema == df.schema
