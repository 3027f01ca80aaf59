"""Queries that SQL can express, against DuckDB at the smallest scale."""

import duckdb
import pytest

from liftpanel.llm.oracles import ORACLES, QUALITY
from liftpanel.llm.queries import QUERIES
from tests.conftest import SMALL


def answers(sql, tables):
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    cursor = connection.execute(sql)
    return [c[0] for c in cursor.description], sorted(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns, want = answers(ORACLES[name], SMALL)
    assert columns == df.columns
    assert sorted(map(tuple, df.collect())) == want


def test_cutoffs_equal_sql_where_labels_suffice(spark, tmp_path):
    """Many labelled rows, so that some cutoffs are shown and some rows rejected."""
    import random

    from tests.llm.cases import prose

    rng, rows = random.Random(12), []
    for i in range(2600):
        words = [w + ("##" if i % 13 == 0 else "") for w in prose(rng, rng.randint(45, 70)).split()]
        rows.append((i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), "en" if i % 9 else "de", "s", 1, int(i % 13 > 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    table.drop("quality").coalesce(1).write.parquet(f"{tmp_path}/documents")
    table.select("doc_id", "quality").coalesce(1).write.parquet(f"{tmp_path}/labels")
    for name in ("documents", "labels"):
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    df = QUERIES["op6_risk_quality"](spark, str(tmp_path))
    columns, want = answers(QUALITY, tmp_path)
    got = sorted(map(tuple, df.collect()))
    assert got == want and any(r[columns.index("rules")] for r in got)
