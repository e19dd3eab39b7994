"""Registered queries against their SQL in DuckDB, and evaluation over small frames."""

from __future__ import annotations

import os

import duckdb
import pytest

from docketry.operators import evaluate
from docketry.plans import audit_queries, catalogue, join_queries, scan_queries  # noqa: F401
from docketry.plans import oracle as O

DATA = "/root/testdata/sf0.001"
#: Whole decision plans take long to plan: most of them are compared by the driver only.
HEAVY = {n for n in catalogue.ORACLE_SQL if catalogue.ORACLE_SQL[n].startswith(O.TO_CASES[:60]) and O.RULES[:40] in catalogue.ORACLE_SQL[n]} - {"predictions", "config_sweep", "feature_rows", "section_scores"}
ALL = sorted(set(catalogue.ORACLE_SQL) - HEAVY)


def _rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return [str(list(frame.columns)), *sorted(map(repr, frame.astype(object).values.tolist()))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are elsewhere")
@pytest.mark.parametrize("name", ALL)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    assert _rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == _rows(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_every_query_of_sql_is_registered():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_brier_delta(spark):
    rows = spark.createDataFrame([("a", 0.5, True), ("a", 0.5, False), ("b", 0.9, True)], "key string, confidence double, is_correct boolean")
    got = evaluate.brier_delta(rows).first()
    assert got["n"] == 3
    assert got["before"] == pytest.approx((0.25 + 0.25 + 0.01) / 3)
    assert got["after"] == pytest.approx((0.25 + 0.25 + 0.0001) / 3)
    assert evaluate.brier_delta(rows.limit(0)).first()["before"] is None
