"""Scratch tables: what one call deletes is its own, and what it leaves is its result."""

from __future__ import annotations

import os

import corpus_pipeline
from docketry.llm import common, queries

SF = "/root/testdata/sf0.001"


def left(spark):
    return {f for f in os.listdir(common.shared_dir(spark).removeprefix("file://")) if f.startswith("docketry-")}


def test_results_stay_while_a_pipeline_runs(spark):
    before = queries.op5_exact_dedup(spark, SF)
    first = corpus_pipeline.run(spark, SF)
    n = first.count()
    begin = left(spark)
    second = corpus_pipeline.run(spark, SF)
    assert len(left(spark) - begin) == 1 and begin <= left(spark)
    assert before.groupBy("kept").count().agg({"count": "sum"}).first()[0] == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert first.count() == second.count() == n > 0


def test_scopes_hold_their_own_tables(spark):
    with common.scope() as outer:
        kept = common.store(spark.range(3).toDF("id"), "kept")
        with common.scope() as inner:
            common.store(spark.range(4).toDF("id"), "gone")
        assert len(outer) == len(inner) == 1
        common.release(inner)
        assert kept.count() == 3 and not inner
    assert len(outer) == 1
    common.release(outer)
