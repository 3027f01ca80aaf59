"""Keys, fixed names and table schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A run is one analysis on one window: the real one, or the placebo just before it.
RUN_KEYS = ["analysis_id", "run_kind"]
MAIN = "main"
PLACEBO = "spec"

# Trend candidates, in the order in which ties are resolved.
TREND_KINDS = ("local_level", "local_linear", "semi_local_linear", "no_trend")

# Role -> prefix of the feature name, in the column order of the wide table.
ROLE_PREFIX = {
    "target": "metric_in_perim_",
    "out_perim": "metric_out_perim_",
    "control": "metric_",
    "visitor": "visitor_",
    "click": "click_",
    "impression": "impression_",
    "npc": "npc_",
    "gtrend": "gtrend_",
    "covid": "new_covid_cases",
    "holiday": "flag_holiday",
    "month": "month_",
}
ROLE_ORDER = {role: i for i, role in enumerate(ROLE_PREFIX)}

# Role -> name of the value column in a role series.
ROLE_VALUE = {
    "target": "metric",
    "out_perim": "metric",
    "control": "metric",
    "visitor": "visitor",
    "click": "click",
    "impression": "impression",
    "npc": "npc",
}

# Input type that can be explored -> roles it shows beside the target.
INPUT_TYPES = {
    "metric": ("out_perim", "control"),
    "visitor": ("visitor",),
    "click": ("click",),
    "impression": ("impression",),
    "npc": ("npc",),
    "gtrend": ("gtrend",),
    "covid": ("covid",),
}

# Dummies are neither standardised, nor dropped, nor differenced.
DUMMY_ROLES = ("holiday", "month")

ANALYSES = T.StructType(
    [
        T.StructField("analysis_id", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("controls", T.ArrayType(T.StringType()), False),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("country", T.StringType()),
        T.StructField("geo", T.StringType()),
        T.StructField("start", T.DateType(), False),
        T.StructField("campaign_start", T.DateType(), False),
        T.StructField("end", T.DateType(), False),
        T.StructField("out_perim_usage", T.BooleanType()),
        T.StructField("visitor_usage", T.BooleanType()),
        T.StructField("click_usage", T.BooleanType()),
        T.StructField("impression_usage", T.BooleanType()),
        T.StructField("npc_usage", T.BooleanType()),
        T.StructField("gtrend_usage", T.BooleanType()),
        T.StructField("gtrend_smooth", T.BooleanType()),
        T.StructField("disable_gtrend", T.BooleanType()),
        T.StructField("covid_usage", T.BooleanType()),
        T.StructField("covid_smooth", T.BooleanType()),
        T.StructField("add_holidays", T.BooleanType()),
        T.StructField("monthly_seasonality", T.BooleanType()),
        T.StructField("yearly_seasonality", T.BooleanType()),
        T.StructField("fix_order", T.BooleanType()),
        T.StructField("search_model", T.StringType()),
        T.StructField("alpha", T.DoubleType()),
        T.StructField("fit_method", T.StringType()),
        T.StructField("spec_thr", T.DoubleType()),
    ]
)

# Settings of an analysis that its table does not give, as SQL.
DEFAULTS = {
    "keywords": "array()",
    "country": "null",
    # The market whose search interest counts.
    "geo": "coalesce(country, target)",
    "out_perim_usage": "false",
    "visitor_usage": "false",
    "click_usage": "false",
    "impression_usage": "false",
    "npc_usage": "false",
    "gtrend_usage": "false",
    "gtrend_smooth": "false",
    "disable_gtrend": "true",
    "covid_usage": "false",
    "covid_smooth": "false",
    "add_holidays": "false",
    "monthly_seasonality": "false",
    "yearly_seasonality": "false",
    "fix_order": "true",
    "search_model": "'search'",
    "alpha": "0.05",
    "fit_method": "'map'",
    "spec_thr": "0.95",
}


def analyses_table(df: DataFrame) -> DataFrame:
    """Complete an analyses table: cast the given columns, add defaults for missing columns and null cells."""
    missing = [f.name for f in ANALYSES if f.name not in df.columns and f.name not in DEFAULTS]
    if missing:
        raise ValueError(f"analyses table lacks {missing}")
    if "country" not in df.columns:
        df = df.selectExpr("*", "CAST(null AS STRING) AS country")

    def cell(f: T.StructField) -> str:
        parts = [f"CAST({x} AS {f.dataType.simpleString()})" for x in ([f"`{f.name}`"] if f.name in df.columns else []) + [DEFAULTS.get(f.name)] if x]
        return f"coalesce({', '.join(parts)}) AS `{f.name}`" if len(parts) > 1 else f"{parts[0]} AS `{f.name}`"

    return df.selectExpr(*[cell(f) for f in ANALYSES])


SERIES = T.StructType(
    [
        T.StructField("analysis_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("campaign_dimension", T.StringType()),
        T.StructField("reference_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)
