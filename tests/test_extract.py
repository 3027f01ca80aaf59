from datetime import date

import pytest
from pyspark.sql import functions as F

from liftpanel.operators import extract
from liftpanel.operators.extract import RoleMeasure
from liftpanel.plans import warehouse as W
from liftpanel.sources.facts import prune_to_windows
from tests.conftest import SMALL
from tests.helpers import DAY, analyses_df

START, CAMPAIGN, END = date(2020, 1, 1), date(2020, 1, 11), date(2020, 1, 20)


def fact(spark):
    rows = []
    for i in range(60):
        for dim in ("A", "B", "C"):
            sub = [None, "Brand", "x"][i % 3]
            rows.append((date(2019, 12, 1) + i * DAY, dim, "SEM" if i % 2 else "SEO", sub, i + 1))
    return spark.createDataFrame(rows, "d date, c string, channel string, sub string, m int")


def analyses(spark, **settings):
    rows = [("a", "A", ["B", "C"], START, CAMPAIGN, END), ("b", "B", ["C"], START, CAMPAIGN, END)]
    return analyses_df(spark, rows, **settings)


def perimeter():
    return (F.col("channel") == "SEM") & ((F.col("sub") != "Brand") | F.col("sub").isNull())


def total(df):
    return {(r.analysis_id, r.campaign_dimension): r.s for r in df.groupBy("analysis_id", "campaign_dimension").agg(F.sum("metric").alias("s")).collect()}


def test_inside_and_outside_make_the_whole(spark):
    a = analyses(spark, out_perim_usage=True)
    whole = extract.extract_role(fact(spark), a, "d", "c", RoleMeasure("target", F.col("m")))
    inside = extract.extract_role(fact(spark), a, "d", "c", RoleMeasure("target", F.col("m"), perimeter()))
    outside = extract.extract_role(
        fact(spark), a, "d", "c", RoleMeasure("out_perim", F.col("m"), extract.out_of_perimeter(perimeter()))
    )
    t, i, o = total(whole), total(inside), total(outside)
    assert t and all(i[k] + o[k] == t[k] for k in t)


def test_as_written_leaves_unknown_rows_on_neither_side(spark):
    rows = spark.createDataFrame([(None,), ("Brand",), ("x",)], "sub string")
    inside = F.col("sub") != "Brand"
    assert rows.where(extract.out_of_perimeter(inside, "as_written")).count() == 1
    assert rows.where(extract.out_of_perimeter(inside)).count() == 2
    with pytest.raises(ValueError):
        extract.out_of_perimeter(inside, "other")


def test_series_cover_the_placebo_and_stop_at_the_end(spark):
    got = extract.extract_role(fact(spark), analyses(spark), "d", "c", RoleMeasure("control", F.col("m")))
    span = got.agg(F.min("reference_date"), F.max("reference_date")).first()
    # The campaign lasts 10 days, so loading starts 10 days earlier.
    assert span[:] == (START - 10 * DAY, END)
    assert {(r.analysis_id, r.campaign_dimension) for r in got.collect()} == {("a", "B"), ("a", "C"), ("b", "C")}


def test_roles_switched_off_give_no_rows_and_no_measure_gives_a_wrong_role(spark):
    measures = [RoleMeasure(r, F.col("m")) for r in ("target", "control", "visitor", "click", "impression", "npc")]
    for flag, role in (("visitor_usage", "visitor"), ("npc_usage", "npc")):
        got = extract.extract_series(fact(spark), analyses(spark, **{flag: True}), "d", "c", measures)
        assert {r.role for r in got.select("role").distinct().collect()} == {"target", "control", role}


def test_all_roles_come_from_one_scan(spark):
    a = W.region_analyses(spark, SMALL, visitor_usage=True, npc_usage=True)
    f = W.fact_marketing(spark, SMALL, a)
    measures = [m for m in W.role_measures() if m.role in ("target", "control", "visitor", "npc")]
    plan = extract.extract_series(f, a, "date", "country_code", measures)
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "Scan parquet" in line and "o_orderdate" in line]
    assert len(scans) == 1
    assert "PushedFilters: [IsNotNull(o_orderdate)" in scans[0]


def test_pruning_keeps_every_day_some_analysis_needs(spark):
    a = analyses(spark)
    kept = prune_to_windows(fact(spark), "d", a).agg(F.min("d"), F.max("d")).first()
    assert kept[:] == (START - 10 * DAY, END)


def test_one_customer_with_a_third_of_all_orders(spark, tmp_path):
    """A hot customer and a hot order change no total, whatever the number of partitions."""
    for name in ("customer", "nation", "region", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    hot = orders.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey")).cast("bigint"))
    hot.write.parquet(str(tmp_path / "orders.parquet"))
    a = W.region_analyses(spark, str(tmp_path), click_usage=True)
    measures = [m for m in W.role_measures() if m.role in ("target", "click")]
    results = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold, partitions in (("10MB", "8"), ("-1", "3")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            s = extract.extract_series(W.fact_marketing(spark, str(tmp_path), a, True), a, "date", "country_code", measures)
            results.append(sorted(tuple(r) for r in s.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    expected = (
        hot.join(spark.read.parquet(f"{SMALL}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
        .where(F.col("o_orderdate").between("1997-10-01", "2000-08-31"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
        .first()[0]
    )
    assert sum(r[4] for r in results[0] if r[1] == "target") == pytest.approx(float(expected))
