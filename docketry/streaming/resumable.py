"""Runs in shards that can stop at any point and go on: a file stream whose batches may be written twice, and a merge.

Input is lines of JSON in files that keep coming. Each batch replaces its own folder, so a batch that was
written but not recorded is written again in place of itself. Lines that are no JSON (a run that was cut
off) are kept apart, with file and line order. The merge takes one row for each key, the last one read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ORDER = "struct<file:string,start:bigint,line:bigint>"


@dataclass(frozen=True)
class Run:
    """One resumable run: lines of `schema` in `source`, rows by `key` in `shards` parts, all else under `folder`."""

    source: str
    folder: str
    schema: str
    key: str
    shards: int = 8

    def advance(self, spark: SparkSession, files_a_batch: int = 1000, before=None) -> int:
        """Take in the files that came since; gives how many lines. Call it again after it stopped for any reason.

        before(rows, batch) is called ahead of each batch's writing.
        """
        lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(self.source, recursiveFileLookup=True)
        parsed = F.from_json("value", f"{self.schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        rows = lines.filter("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), parsed.alias("r"))

        def put(batch: DataFrame, number: int) -> None:
            if before:
                before(batch, number)
            bad = F.col("r._corrupt").isNotNull() | F.col(f"r.{self.key}").isNull()
            shard = F.when(~bad, F.pmod(F.xxhash64(f"r.{self.key}"), F.lit(self.shards)))
            # where a line stands: its file, its part of the file, and its place there
            order = F.struct("file", "start", F.monotonically_increasing_id().alias("line")).cast(_ORDER)
            out = batch.select(bad.alias("bad"), F.coalesce(shard, F.lit(0)).cast("int").alias("shard"), "value", order.alias("order"), F.col("r").dropFields("_corrupt").alias("r"))
            # one folder for each batch: a batch that comes twice replaces what it wrote
            out.write.mode("overwrite").partitionBy("bad", "shard").parquet(f"{self.folder}/rows/batch={number}")

        query = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    def _read(self, spark: SparkSession) -> DataFrame:
        parts = f"bad boolean, shard int, value string, `order` {_ORDER}, r struct<{', '.join(_field(f) for f in self.schema.split(', '))}>, batch long"
        try:
            return spark.read.schema(parts).option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows")
        except AnalysisException:
            return spark.createDataFrame([], parts)

    def rows(self, spark: SparkSession, shard: int | None = None) -> DataFrame:
        """All good rows and where they stood; of one shard, only its folders are read."""
        good = self._read(spark).filter("not bad")
        return (good if shard is None else good.filter(F.col("shard") == shard)).select("r.*", "order", "shard")

    def corrupt(self, spark: SparkSession) -> DataFrame:
        """(file, value) of the lines that couldn't be read or have no key."""
        return self._read(spark).filter("bad").select("order.file", "value")

    def merged(self, spark: SparkSession) -> DataFrame:
        """One row for each key, the last by file, then by place in it, and n_rows, how many there were: a partial aggregation."""
        rows = self.rows(spark)
        rest = [c for c in rows.columns if c not in (self.key, "order", "shard")]
        last = F.max_by(F.struct(*rest), "order").alias("r")
        return rows.groupBy(self.key).agg(last, F.count("*").alias("n_rows")).select(self.key, "r.*", "n_rows")

    def pending(self, spark: SparkSession, cases: DataFrame) -> DataFrame:
        """The cases that no good row names yet."""
        return cases.join(self.rows(spark).select(self.key).distinct(), self.key, "left_anti")


def _field(column: str) -> str:
    name, kind = column.split(" ", 1)
    return f"{name}:{kind}"
