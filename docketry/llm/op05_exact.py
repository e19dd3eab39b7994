"""Exact dedup by content-defined chunk recipes.

Every text is cut where a rolling hash of the last bytes says so, so equal passages give equal
chunks wherever they stand. A chunk's content travels once per partition that holds it; chunks
are deduplicated on (digest, content), so the identifier of a chunk is *verified*: two contents
that share a digest get different identifiers. Texts are then compared as ordered identifier
lists, which are a few bytes for a long document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes that the rolling hash sees, the mean chunk beyond the shortest (a power of two), and the shortest and longest chunk.
WINDOW, MEAN, SHORTEST, LONGEST = 32, 4096, 1024, 32768
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = 4 << 20


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes; they depend on the bytes alone."""
    n = len(data)
    if n <= SHORTEST:
        return [n] if n else []
    marks = []
    for lo in range(0, n, _STEP):
        part = data[max(0, lo - WINDOW + 1) : lo + _STEP]
        rolled, span = _GEAR[part], 1
        while span < WINDOW:  # sums of 2, 4, 8 ... bytes, each shifted by its age
            older = rolled[:-span] << np.uint64(span)
            rolled = rolled.copy()
            rolled[span:] += older
            span *= 2
        at = np.flatnonzero((rolled >> np.uint64(WINDOW - MEAN.bit_length())) & np.uint64(MEAN - 1) == 0)
        marks.append(at[at >= lo - max(0, lo - WINDOW + 1)] + max(0, lo - WINDOW + 1) + 1)
    out, last = [], 0
    for at in [*np.concatenate(marks).tolist(), n]:
        while at - last > LONGEST:
            last += LONGEST
            out.append(last)
        if at - last >= SHORTEST or at == n and at > last:
            out.append(at)
            last = at
    return out


def digest16(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _chunked(digest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "sha", "ord", "digest", "content"]
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                sha, last = hashlib.sha256(raw).hexdigest(), 0
                ends = cuts(np.frombuffer(raw, np.uint8)) or [0]
                for k, end in enumerate(ends):
                    part = raw[last:end]
                    rows.append((doc, sha, k, digest(part), part))
                    last = end
                held += len(raw)
                if held > 8 << 20 or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)

    return run


_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]


@common.settled
def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=digest16) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they are the same code points; null counts as empty. The row with the
    largest id of a group stays. Rows that repeat an id with an equal text all count and are all
    marked kept if their id is the largest. Texts of any length are compared whole, in chunks of at
    most 32 KB. Other columns of docs are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    common.bounded_batches(docs.sparkSession)
    schema = "doc_id long, sha string, ord int, digest binary, content binary"
    # uid tells rows apart that repeat an id: recipes must not mix
    rows = source.mapInArrow(_chunked(digest), schema)
    rows = rows.withColumn("at", F.monotonically_increasing_id() - F.col("ord"))
    pieces = common.store(rows, "pieces")
    # one copy of a chunk leaves a partition: both are grouping keys, so partial aggregation drops repeats
    distinct = pieces.groupBy("digest", "content").agg(F.count("*").alias("uses"))
    clash = distinct.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    clash = common.store(clash, "clash")
    light = pieces.select("doc_id", "sha", "at", "ord", "digest")
    if clash.take(1):
        # contents that share a digest are told apart by their rank among them; such digests are rare by design
        own = pieces.join(clash, "digest").select("digest", "content").distinct()
        rank = F.row_number().over(Window.partitionBy("digest").orderBy("content")).cast("int")
        own = own.withColumn("rank", rank)
        light = (
            pieces.join(own, ["digest", "content"], "left")
            .select("doc_id", "sha", "at", "ord", "digest", F.coalesce("rank", F.lit(0)).alias("rank"))
        )
    else:
        light = light.withColumn("rank", F.lit(0))
    # the verified identifier: digest and, after a clash, the rank
    ident = F.concat("digest", F.when(F.col("rank") > 0, F.encode(F.col("rank").cast("string"), "utf-8")).otherwise(F.lit(b"")))
    recipes = (
        light.withColumn("ident", ident)
        .groupBy("doc_id", "at")
        .agg(
            F.first("sha").alias("text_sha256"),
            F.array_sort(F.collect_list(F.struct("ord", "ident"))).alias("parts"),
        )
        .select("doc_id", "text_sha256", F.size("parts").alias("n_chunks"), F.col("parts.ident").alias("recipe"))
    )
    recipes = common.store(recipes, "recipes")
    groups = common.store(
        recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    total = recipes.count()
    joined = common.skew_join(recipes, groups.withColumn("k", F.col("group_size")), ["recipe"], "k", total)
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks"
    )
