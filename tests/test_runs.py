"""Files with faults, the cache, compositions, counters and stored tables."""

from __future__ import annotations

import os
import re

import pytest
from docketry.config import Config
from docketry.operators import evaluate
from docketry.sources import ocr, pdf, tables_io
from pyspark.sql import functions as F


def test_broken_files_have_a_row_of_their_own(spark):
    stream = lambda t: b"<< /Length 9 >>\nstream\n(%s) Tj\nendstream\n" % t
    files = {
        "whole": b"%PDF-1.4\n" + stream(b"one") + stream(b"two"), "cut": b"%PDF-1.4\n" + stream(b"one") + b"<< >>\nstream\n(tw", "none": b"%PDF-1.4\n", "other": b"hello", "empty": b"", "null": None,
        "twice": b"%PDF-1.4\n" + stream(b"one"),
    }
    rows = spark.createDataFrame([*files.items(), ("twice", files["twice"])], "case_id string, content binary").repartition(3)
    got = sorted((r.case_id, r.source_id or "", r.status) for r in pdf.scan(rows).collect())
    assert got == [
        ("cut", "", "truncated"), ("cut", "text_stream_0", "ok"), ("empty", "", "empty"), ("null", "", "empty"), ("other", "", "no PDF"),
        ("twice", "text_stream_0", "ok"), ("twice", "text_stream_0", "ok"), ("whole", "text_stream_0", "ok"), ("whole", "text_stream_1", "ok"),
    ]
    # the streams are those of the scan of whole files
    a = pdf.scan(rows).filter("status = 'ok'").drop("status")
    assert tables_io.parity(a, pdf.read_sources(rows)).count() == 0


def test_a_batch_that_comes_again_leaves_each_key_once(spark, tmp_path):
    at = str(tmp_path / "cache")
    config = Config(ocr_cache_dir=at)
    rows = spark.createDataFrame([(f"{k % 50:02x}ab{k % 50}", f"t{k % 2}", f"text {k % 50}") for k in range(300)], "sha string, tag string, text string").repartition(4)
    for part in (rows, rows, rows.filter("sha < '20'"), rows.limit(0)):
        ocr.append_cache(part, at)
    raw = spark.read.parquet(at)
    assert raw.count() == raw.select("sha", "tag").distinct().count() == 50
    assert len([f for f in os.listdir(at) if f.startswith("prefix=")]) == 50
    held = ocr.read_cache(spark, config)
    assert {(r.sha, r.tag): r.text for r in held.collect()} == {(r.sha, r.tag): r.text for r in rows.collect()}
    asked = spark.createDataFrame([("00ab0", "t0", 1), ("00ab0", "t9", 2), ("zz", "t0", 3), ("31ab49", "t1", 4)], "sha string, tag string, n int")
    assert {r.n: r.text for r in ocr.lookup(asked, held).collect()} == {1: "text 0", 2: None, 3: None, 4: "text 49"}
    assert ocr.lookup(asked, None).filter("text is null").count() == 4
    # folders whose names look like numbers stay what they are
    assert held.filter("prefix = '00'").count() == 1


def test_lookup_reads_the_folders_of_its_hashes_alone(spark, tmp_path):
    at = str(tmp_path / "cache")
    ocr.append_cache(spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"), F.lit("t").alias("tag"), F.lit("x").alias("text")), at)
    cache = ocr.read_cache(spark, Config(ocr_cache_dir=at))
    sha = cache.first().sha
    out = ocr.lookup(spark.createDataFrame([(sha, "t")], "sha string, tag string"), cache)
    assert out.first().text == "x"
    pruned = re.search(r"PartitionFilters: \[[^\n]*prefix[^\n]* = (\w+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert pruned and pruned[1] == sha[:2]


def test_compositions_of_a_table(spark):
    passes = spark.createDataFrame([("a", "base", "1"), ("a", "big", "2"), ("a", "sharp", ""), ("b", "base", None), ("b", "big", "4"), ("a", "base", "0")], "k string, tag string, text string")
    table = spark.createDataFrame([("x", 0, "base"), ("x", 1, "big"), ("y", 0, "big"), ("y", 1, "base"), ("z", 0, "sharp"), ("none", 0, "other")], "composition string, place int, tag string")
    got = {(r.composition, r.k): r.text for r in ocr.replayed(passes, table, ["k"]).collect()}
    assert got == {("x", "a"): "0\n1\n2", ("x", "b"): "4", ("y", "a"): "2\n0\n1", ("y", "b"): "4"}
    assert ocr.replayed(passes.limit(0), table, ["k"]).count() == 0


def test_counters_of_a_run(spark, tmp_path):
    rows, seen = evaluate.observed(spark.range(100), "n", all=F.lit(True), even=F.col("id") % 2 == 0)
    rows.write.parquet(str(tmp_path / "out"))
    out = evaluate.with_counters(spark.read.parquet(str(tmp_path / "out")).agg(F.count("*").alias("n")), seen).first()
    assert (out.n, out["all"], out.even) == (100, 100, 50)


def test_a_stored_table_is_made_again_when_its_input_changes(spark, tmp_path):
    at, data = str(tmp_path / "table"), tmp_path / "in"
    data.mkdir()
    made = []

    def build():
        made.append(1)
        return spark.read.text(str(data))

    def read():
        files = spark.read.format("binaryFile").load(str(data))
        return tables_io.materialized(spark, at, build, of=tables_io.fingerprint(files)).count()

    (data / "a.txt").write_text("1\n2\n")
    assert [read(), read()] == [2, 2] and len(made) == 1
    (data / "b.txt").write_text("3\n")
    assert [read(), read()] == [3, 3] and len(made) == 2
    # a table whose writing was cut off counts as not there
    for f in os.listdir(f"{at}/of"):
        os.remove(f"{at}/of/{f}")
    assert read() == 3 and len(made) == 3


@pytest.mark.parametrize("content,status", [(b"%PDF-1.7\nstream\nendstream", "ok"), (b"%PDF-1.7\nstream\r\nx", "truncated"), (b"\xff\xd8", "no PDF")])
def test_statuses(content, status):
    assert pdf.status_of(content) == status
