"""Joins by prefix and range, phrase search, seeded samples, late bytes and resumable runs, against plain Python."""

from __future__ import annotations

import collections
import datetime
import os
import random
import re

import pytest
from docketry.config import Config
from docketry.operators import joins, search
from docketry.plans import pipeline
from docketry.sources import blobs, ocr, shared, tables_io
from docketry.streaming import resumable
from pyspark.errors import PythonException, StreamingQueryException
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folder(tmp_path, name="x"):
    return f"file://{tmp_path}/{name}"


# ---- prefixes ----


def test_longest_prefix(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé𝄞") for _ in range(n))
    table = [(word(rng.randint(0, 4)), k) for k in range(60)] + [(None, 99), ("ab", 7), ("ab", 3)]
    rows = [(k, word(rng.randint(0, 7))) for k in range(300)] + [(k, "ab") for k in range(300, 700)] + [(700, None), (701, "")]
    df = spark.createDataFrame(rows, "id int, key string").repartition(5)
    out = joins.longest_prefix(df, "key", spark.createDataFrame(table, "prefix string, value int"))
    best = {}
    for p, v in table:
        if p is not None:
            best[p] = min(v, best.get(p, v))
    want = {k: next((best[t[:n]] for n in range(len(t), -1, -1) if t[:n] in best), None) if t is not None else None for k, t in rows}
    got = out.collect()
    assert {r["id"]: r["value"] for r in got} == want and len(got) == len(rows)
    assert not re.search("NestedLoop|Cartesian", plan(out))
    assert joins.longest_prefix(df, "key", spark.createDataFrame([], "prefix string, value int")).filter("value is not null").count() == 0


# ---- ranges ----


def pairs(rows, ranges):
    return sorted((k, j) for k, v in rows for j, lo, hi in ranges if None not in (v, lo, hi) and lo <= v < hi)


@pytest.mark.parametrize("kind", ["bigint", "int", "double", "date", "timestamp", "decimal(20,3)"])
def test_ranges(spark, kind):
    rng = random.Random(2)
    if kind == "date":
        make = lambda: datetime.date(2000, 1, 1) + datetime.timedelta(rng.randint(-20_000, 20_000))
    elif kind == "timestamp":
        make = lambda: datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=rng.randint(-(10**8), 10**8), microseconds=rng.randint(0, 3))
    elif kind == "double":
        make = lambda: rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5))])
    elif kind.startswith("decimal"):
        import decimal

        make = lambda: decimal.Decimal(rng.randint(-5000, 5000)) / 8 * 1
    else:
        top = 2**62 if kind == "bigint" else 2**31 - 2
        make = lambda: rng.choice([rng.randint(-300, 300), rng.randint(-top, top), 0, 16, -16])
    rows = [(k, make()) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 500)] + [(500, None)]
    ranges = [(j, make(), make()) for j in range(60)]
    ranges = [(j, min(a, b), max(a, b)) for j, a, b in ranges] + [(60, rows[0][1], rows[0][1]), (61, None, rows[0][1]), (62, min(v for _, v in rows[:300]), max(v for _, v in rows[:300]))]
    ranges += [(63, ranges[0][2], ranges[0][1])]
    df = spark.createDataFrame(rows, f"id int, v {kind}").repartition(3)
    out = joins.in_ranges(df, "v", spark.createDataFrame(ranges, f"rid int, lo {kind}, hi {kind}"), step=0.5)
    assert sorted((r["id"], r["rid"]) for r in out.select("id", "rid").collect()) == pairs(rows, ranges)
    assert not re.search("NestedLoop|Cartesian", plan(out))


def test_ranges_shuffled_and_few_cells(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, ranges = [(k, k % 50) for k in range(2000)], [(j, -(10**17) * j, 10**17 + 10**15 * j) for j in range(40)]
        out = joins.in_ranges(spark.createDataFrame(rows, "id long, v long"), "v", spark.createDataFrame(ranges, "rid long, lo long, hi long"))
        assert "SortMergeJoin" in plan(out) and out.count() == 2000 * 40
        cells = spark.createDataFrame(ranges, "rid long, lo long, hi long").select(F.size(joins._cells(F.col("lo"), F.col("hi") - 1)).alias("n"))
        assert cells.agg(F.max("n")).first()[0] <= 2 * 15 * joins.LEVELS
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    empty = spark.createDataFrame([], "rid long, lo long, hi long")
    assert joins.in_ranges(spark.createDataFrame(rows, "id long, v long"), "v", empty).count() == 0


# ---- phrases ----


def test_phrases(spark, monkeypatch):
    rng = random.Random(4)
    words = ["a", "b", "ab", "é", "a.b", "x" * 50]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " \n", "a\n a\t\x0ba  a ", "a " * 30_000]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["a a", "a  a", "", None, "zz"]
    want = collections.Counter()
    inside = collections.Counter()
    known = {" ".join(p.split()) for p in phrases if p and p.strip()}
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        here = collections.Counter(p for k in range(1, 6) for i in range(len(ws) - k + 1) if (p := " ".join(ws[i : i + k])) in known)
        want.update(here)
        inside.update(here.keys())
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    table = spark.createDataFrame([(p,) for p in phrases], "p string")
    for size in (search.AUTOMATON, 1000):
        monkeypatch.setattr(search, "AUTOMATON", size)
        got = {r["phrase"]: (r["n"], r["texts"]) for r in search.count_phrases(df, "t", table, "p").collect()}
        assert got == {p: (n, inside[p]) for p, n in want.items()}
    assert search.count_phrases(df, "t", table.filter("p = ''"), "p").count() == 0


# ---- samples ----


@pytest.mark.parametrize("n", [0, 1, 37, 5000])
def test_seeded_sample_is_the_plain_shuffle(spark, tmp_path, n):
    ids = [f"C-{k * 7919 % 1000:04d}" for k in range(1000)] + ["C-0001", None]
    df = spark.createDataFrame([(i,) for i in ids], "case_id string").repartition(7)
    plain = sorted({i for i in ids if i})
    random.Random(3).shuffle(plain)
    picked = tables_io.seeded_sample(df, "case_id", n, 3, folder(tmp_path))
    assert [r["case_id"] for r in picked.orderBy("place").collect()] == plain[:n]
    assert tables_io.in_manifest(df, picked.unionByName(picked), "case_id").count() == sum(i in set(plain[:n]) for i in ids)


def test_sample_of_nothing(spark, tmp_path):
    assert tables_io.seeded_sample(spark.createDataFrame([], "case_id string"), "case_id", 5, 3, folder(tmp_path)).count() == 0


# ---- late bytes ----


def test_bytes_come_back(spark, tmp_path):
    rows = [(k, f"c{k % 7}", None if k % 11 == 0 else bytes([k % 256]) * (k % 300)) for k in range(500)] + [(500, "c", bytes(20 << 20)), (501, None, b"")]
    df = spark.createDataFrame(rows, "id int, c string, raw binary").repartition(4)
    at = folder(tmp_path, "bytes")
    blobs.put(df, at).write.parquet(folder(tmp_path, "places"))
    places = spark.read.parquet(folder(tmp_path, "places"))
    assert places.columns == ["id", "c", "place"]
    got = {r["id"]: (r["c"], r["raw"]) for r in blobs.fetch(places.repartition(3), at).collect()}
    assert got == {k: (c, bytearray(raw) if raw is not None else None) for k, c, raw in rows}
    assert blobs.fetch(places.filter("id < 0"), at).count() == 0
    with pytest.raises(PythonException, match="ends before"):
        blobs.fetch(places.filter("id = 500").selectExpr("id", "named_struct('file', place.file, 'offset', place.offset, 'length', place.length * 3) place"), at).collect()


def test_only_failing_rows_read_their_bytes(spark, tmp_path):
    images = spark.createDataFrame([(f"C{k}", "image_0", f"shows SPN-{k:04d} 2026-01-0{k % 9 + 1}".encode()) for k in range(60)], "case_id string, source_id string, raw binary")
    at = folder(tmp_path, "bytes")
    blobs.put(images.repartition(2), at).write.parquet(folder(tmp_path, "places"))
    places = spark.read.parquet(folder(tmp_path, "places"))
    good = [(f"C{k}", k, "sponsor_id", f"SPN-{k:04d}", "image_0") for k in range(60)]
    bad = [("C3", 103, "sponsor_id", "SPN-OOO3", "image_0"), ("C4", 104, "arrival_date", None, "image_0"), ("C4", 105, "arrival_date", "soon", "text_stream_0"), ("C5", 106, "visa_class", "?", "image_0"), ("gone", 107, "sponsor_id", "x", "image_0")]
    signals = spark.createDataFrame(good + bad, "case_id string, seq long, key string, value string, source_id string").repartition(3)
    asked = spark.sparkContext.accumulator(0)

    def engine(raw, psm, flags):
        asked.add(1)
        return raw.decode(), "ok"

    out = ocr.reread(signals, places, engine, at)
    assert sorted(map(tuple, out.collect())) == [("C3", 103, "SPN-0003"), ("C4", 104, "2026-01-05")] and asked.value == 2
    # without places the same rows
    assert sorted(map(tuple, ocr.reread(signals, images, engine).collect())) == [("C3", 103, "SPN-0003"), ("C4", 104, "2026-01-05")]
    # the bytes of rows that don't fail aren't needed: their file may be gone
    need = ocr.failing(signals).join(places, ["case_id", "source_id"]).select("place.file").distinct()
    keep = {r["file"] for r in need.collect()}
    for f in os.listdir(f"{tmp_path}/bytes"):
        if f not in keep:
            os.remove(f"{tmp_path}/bytes/{f}")
    assert ocr.reread(signals, places, engine, at).count() == 2
    fixed = {r["seq"]: r["value"] for r in ocr.with_rereads(signals, out).collect()}
    assert fixed[103] == "SPN-0003" and fixed[104] == "2026-01-05" and fixed[105] == "soon" and len(fixed) == 65


def test_rereads_change_nothing_where_all_values_have_their_form(spark):
    from docketry.plans import synth

    sources = synth.sources(spark, "/root/testdata/sf0.001").filter("case_id < 'C-0000200'")
    images = sources.filter("kind = 'IMAGE'").select("case_id", "source_id", F.encode("content", "utf-8").alias("raw"))
    engine = lambda raw, psm, flags: ("SPN-1111", "ok")
    columns = ["case_id", "sponsor_id", "arrival_date", "final"]
    plain = pipeline.decided(sources).select(*columns)
    for config in (Config(), Config(reread=False)):
        again = pipeline.decided(sources, config, pipeline.Rereads(engine, images)).select(*columns)
        assert tables_io.parity(plain.withColumn("final", F.to_json("final")), again.withColumn("final", F.to_json("final"))).count() == 0


# ---- resumable runs ----


def put(spark, at, name, lines):
    shared.put(spark, f"{at}/lines/{name}", ("\n".join(lines)).encode())


def test_a_run_that_stops_and_goes_on(spark, tmp_path):
    at = folder(tmp_path)
    run = resumable.Run(f"{at}/lines", f"{at}/run", "case_id string, n long", "case_id", shards=3)
    put(spark, at, "a/1.jsonl", ['{"case_id": "A", "n": 1}', '{"case_id": "B", "n": 2}', '{"case_id": "A", "n": 3}'])
    put(spark, at, "a/2.jsonl", ['{"case_id": "B", "n": 4}', "", '{"case_id": "C", "n"'])
    first = spark.createDataFrame([(c,) for c in "ABCD"], "case_id string")
    assert run.pending(spark, first).count() == 4

    def stop(batch, number):
        if number == 1:
            raise RuntimeError("stopped")

    with pytest.raises(StreamingQueryException):
        run.advance(spark, files_a_batch=1, before=stop)
    assert {r["case_id"] for r in run.pending(spark, first).collect()} >= {"C", "D"}
    run.advance(spark, files_a_batch=1)
    want = [("A", 3, 2), ("B", 4, 2)]
    assert sorted(map(tuple, run.merged(spark).collect())) == want
    assert [r["value"] for r in run.corrupt(spark).collect()] == ['{"case_id": "C", "n"']
    # nothing new, nothing twice
    assert run.advance(spark) == 0 and sorted(map(tuple, run.merged(spark).collect())) == want
    put(spark, at, "b/3.jsonl", ['{"case_id": "C", "n": 5}', '{"n": 6}', '{"case_id": "A", "n": null}', "not json"])
    run.advance(spark)
    assert sorted(map(tuple, run.merged(spark).collect())) == [("A", None, 3), ("B", 4, 2), ("C", 5, 1)]
    assert {r["value"] for r in run.corrupt(spark).collect()} == {'{"case_id": "C", "n"', '{"n": 6}', "not json"}
    assert [r["case_id"] for r in run.pending(spark, first).collect()] == ["D"]
    assert sum(run.rows(spark, shard).count() for shard in range(3)) == run.rows(spark).count() == 6


def test_a_batch_that_was_written_but_not_recorded_is_replaced(spark, tmp_path):
    at = folder(tmp_path)
    run = resumable.Run(f"{at}/lines", f"{at}/run", "case_id string, n long", "case_id")
    put(spark, at, "1.jsonl", ['{"case_id": "A", "n": 1}'] * 5)
    run.advance(spark)
    # the record of the batch is lost, its rows are not
    for name in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/x/run/state/commits/{name}")
    run.advance(spark)
    assert sorted(map(tuple, run.merged(spark).collect())) == [("A", 1, 5)]
