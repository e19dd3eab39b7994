"""Scans and sinks of labels, feature rows and predictions, and resumable runs."""

from __future__ import annotations

import array
import itertools
import random
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import tables as T

LABELS = "case_id string, " + ", ".join(f"{f} string" for f in T.FIELDS) + ", adjudication string"
PREDICTION = ["case_id", *T.FIELDS, "adjudication", "confidence"]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; rows with an error and lines that aren't JSON are left out."""
    raw = spark.read.schema(f"{schema}, error string, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.filter("error is null and _corrupt is null").drop("error", "_corrupt")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("id")).filter("id <> ''")


def write_predictions(preds: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order, in case order over all files: a range sort, so files are as many as partitions."""
    rows = preds.orderBy("case_id").select(F.to_json(F.struct(*sorted(PREDICTION)), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("overwrite").text(path)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its own, largest counts first where it has counts."""
    for name, d in tables.items():
        order = [F.desc("n"), *[c for c, t in d.dtypes if t == "string"]] if "n" in d.columns else d.columns
        # in order over all files: as many as the sort has ranges, so no task writes a whole table
        d.orderBy(*order).write.mode("overwrite").json(f"{path}/{name}")


def pending(cases: DataFrame, done: DataFrame) -> DataFrame:
    return cases.join(done.select("case_id").distinct(), "case_id", "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by order: a partial aggregation, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): how many rows only one side has; no row means that both are the same."""
    return differences(a, b).groupBy("side").agg(F.count("*").alias("n"))


def materialized(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False, of: str = "") -> DataFrame:
    """The table at path; it is built if it isn't there, if it was made of something else than `of`, or if asked.

    `of` names what it is made of, say its input's files and their times (see fingerprint()); it is kept beside the table and
    written last, so a table that was never finished counts as not there.
    """
    try:
        if not rebuild and spark.read.text(f"{path}/of").first()["value"] == of:
            return spark.read.parquet(f"{path}/rows")
    except (AnalysisException, TypeError):
        pass
    build().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(of,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/of")
    return spark.read.parquet(f"{path}/rows")


def fingerprint(files: DataFrame) -> str:
    """One number of the files (path, length, modificationTime) that a table is made of: a sum, so their order doesn't matter."""
    return str(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0])


def sampled_ids(ids: list[str], n: int, seed: int) -> list[str]:
    """A seeded sample of a list of ids that is on the driver already; seeded_sample() takes one of a table."""
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    return ids[:n]


def ranked(ids: DataFrame, id_col: str, folder: str) -> DataFrame:
    """(id_col, rank) of the distinct ids in order, from 0. Sorted rows are kept in `folder`.

    Ids are sorted by ranges, so no task sees all of them; the driver gets one count for each range.
    """
    spark = ids.sparkSession
    place = F.monotonically_increasing_id()
    rows = ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(id_col)
    rows.select(id_col, F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("own")).write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder)
    counts = sorted(map(tuple, rows.groupBy("part").agg(F.count("*")).collect()))
    before = itertools.accumulate((n for _, n in counts), initial=0)
    starts = spark.createDataFrame([(part, n) for (part, _), n in zip(counts, before, strict=False)], "part long, start long")
    return rows.join(F.broadcast(starts), "part").select(id_col, (F.col("start") + F.col("own")).alias("rank"))


def seeded_sample(ids: DataFrame, id_col: str, n: int, seed: int, folder: str) -> DataFrame:
    """(id_col, place) of the n ids that a seeded shuffle of all sorted ids puts first, and their places in it.

    The same ids as random.Random(seed).shuffle() of the sorted list gives. The driver shuffles numbers,
    8 bytes for each distinct id; the ids stay where they are. Repeated ids count once, null ones not at all;
    more than there are gives all.
    """
    spark, rows = ids.sparkSession, ranked(ids, id_col, folder)
    order = array.array("q", range(rows.count()))
    random.Random(seed).shuffle(order)
    table = pa.table({"rank": pa.array(order[:n], pa.int64()), "place": pa.array(range(min(n, len(order))), pa.int64())})
    return rows.join(spark.createDataFrame(table), "rank").select(id_col, "place")


def in_manifest(rows: DataFrame, manifest: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id the manifest names; it may name ids twice, or ids that rows don't have."""
    return rows.join(manifest.select(id_col), id_col, "left_semi")


def newest(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("path", "modificationTime").alias("path"))


def dense_number(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
