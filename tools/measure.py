"""Measure how one plan scales with the number of analyses.

    python tools/measure.py /root/testdata/sf0.1 effects|fits 1 10 50 200

Analyses are the nation panel repeated under new names: target, all other nations as controls.
'effects' runs extract, features, cleaning and regression summary, 'fits' the whole pipeline with
one structural model per run.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from liftpanel.operators import clean, effects, extract, features, model, runs as runs_ops  # noqa: E402
from liftpanel.plans import panel, warehouse as W  # noqa: E402


def analyses_of(spark, sf_dir, n):
    one = W.nation_analyses(spark, sf_dir, search_model="local_level")
    copies = F.sequence(F.lit(1), F.lit(-(-n // 25)))
    return (
        one.withColumn("copy", F.explode(copies))
        .withColumn("analysis_id", F.concat_ws("_", F.lpad(F.col("copy").cast("string"), 4, "0"), "analysis_id"))
        .drop("copy")
        .orderBy("analysis_id")
        .limit(n)
    )


def run(spark, sf_dir, what, n):
    analyses = analyses_of(spark, sf_dir, n)
    fact = W.fact_marketing(spark, sf_dir, analyses)
    measures = [m for m in W.role_measures() if m.role in ("target", "control")]
    series = extract.extract_series(fact, analyses, "date", "source_medium", measures)
    started = time.perf_counter()
    if what == "fits":
        out = panel.run_panel(series, analyses)["summary_data"]
    else:
        cleaned = clean.clean_features(features.feature_long(series, runs_ops.expand_runs(analyses)))
        out = effects.summary(model.control_regressions(cleaned, each_control=False).drop("candidate"))
    out.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main(sf_dir, what, sizes):
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, sf_dir, what, sizes[0])
    for n in sizes:
        took = run(spark, sf_dir, what, n)
        print(f"{what} {n:5d} analyses {took:7.1f} s {1000 * took / n:8.0f} ms each", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], [int(x) for x in sys.argv[3:]])
