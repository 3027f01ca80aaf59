"""Small hand-made inputs."""

from datetime import date, timedelta

import numpy as np

from liftpanel.schema import analyses_table

DAY = timedelta(days=1)


def days(start: date, n: int) -> list[date]:
    return [start + i * DAY for i in range(n)]


def feature_rows(analysis_id, values_by_feature, start, campaign_start, run_kind="main"):
    """Long feature rows from {(role, feature): values}."""
    return [
        (analysis_id, run_kind, campaign_start, role, feature, start + i * DAY, float(v))
        for (role, feature), values in values_by_feature.items()
        for i, v in enumerate(values)
    ]


FEATURES = "analysis_id string, run_kind string, campaign_start date, role string, feature string, reference_date date, value double"


def features_df(spark, rows):
    return spark.createDataFrame(rows, FEATURES)


def analyses_df(spark, rows, **settings):
    """rows: (analysis_id, target, controls, start, campaign_start, end)."""
    base = spark.createDataFrame(
        rows,
        "analysis_id string, target string, controls array<string>, start date, campaign_start date, end date",
    )
    from pyspark.sql import functions as F

    return analyses_table(base.withColumns({k: F.lit(v) for k, v in settings.items()}) if settings else base)


def weekly_series(rng, n, lift=0.0, lift_from=None):
    """Target, one useful and one useless control with a weekly pattern; optional lift of the target."""
    useful = 100 + 10 * rng.standard_normal(n)
    useless = 50 + 5 * rng.standard_normal(n)
    week = np.tile([8, 4, 0, -2, -4, -8, 2], n // 7 + 1)[:n]
    target = 200 + 0.8 * useful + week + 4 * rng.standard_normal(n)
    if lift_from is not None:
        target[lift_from:] += lift
    return target, useful, useless
