"""Bytes beside their rows: tables carry where bytes lie, and only the rows that need them read them.

A task appends the bytes of its rows to one file of a shared folder, and each row keeps (file, offset,
length). Such rows are small, so they can be joined, filtered and shuffled; `fetch` reads the ranges of
what is left, in order. A task that runs again writes a file of its own, so rows and bytes always fit;
what a lost task wrote is named by no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_schema

PLACE = S.StructType([S.StructField("file", S.StringType()), S.StructField("offset", S.LongType()), S.StructField("length", S.LongType())])
#: Bytes that one batch holds, about.
BATCH = 8 << 20


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Where tasks read and write; s3a is Spark's name of s3."""
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def put(rows: DataFrame, folder: str, bytes_col: str = "raw", place_col: str = "place") -> DataFrame:
    """rows with place_col in place of bytes_col; null bytes have no place, empty ones have one of length 0.

    Write the result before it is used: each run of its plan writes the bytes.
    """
    kept = [f for f in rows.schema if f.name != bytes_col]
    schema = S.StructType([*kept, S.StructField(place_col, PLACE)])
    arrow, here = to_arrow_schema(schema), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root)
        name, out, at = f"{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            places = []
            for value in batch.column(here):
                data = value.as_py()
                if data is None:
                    places.append(None)
                    continue
                out = out or fs.open_output_stream(f"{root}/{name}")
                out.write(data)
                places.append({"file": name, "offset": at, "length": len(data)})
                at += len(data)
            columns = [c.cast(f.type) for c, f in zip(batch.columns[:here], arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, arrow.field(here).type)], schema=arrow)
        if out:
            out.close()

    return rows.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{bytes_col}`").cast("binary")).mapInArrow(run, schema)


def fetch(rows: DataFrame, folder: str, bytes_col: str = "raw", place_col: str = "place") -> DataFrame:
    """rows with bytes_col in place of place_col: each row's range is read, and nothing else of the files."""
    kept = [f for f in rows.schema if f.name != place_col]
    schema = S.StructType([*kept, S.StructField(bytes_col, S.BinaryType())])
    arrow, here = to_arrow_schema(schema), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, file = None, None

        def made(batch: pa.RecordBatch, lo: int, data: list) -> pa.RecordBatch:
            columns = [c.slice(lo, len(data)).cast(f.type) for c, f in zip(batch.columns[:here], arrow, strict=False)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], schema=arrow)

        for batch in batches:
            data, held, lo = [], 0, 0
            for k, place in enumerate(batch.column(here).to_pylist()):
                if place is None:
                    data.append(None)
                else:
                    if place["file"] != name:
                        if file:
                            file.close()
                        name, file = place["file"], fs.open_input_file(f"{root}/{place['file']}")
                    data.append(file.read_at(place["length"], place["offset"]))
                    if len(data[-1]) != place["length"]:
                        raise ValueError(f"{name} ends before {place['offset'] + place['length']}")
                    held += place["length"]
                if held > BATCH:
                    yield made(batch, lo, data)
                    data, held, lo = [], 0, k + 1
            if data:
                yield made(batch, lo, data)
        if file:
            file.close()

    ordered = rows.sortWithinPartitions(f"{place_col}.file", f"{place_col}.offset")
    return ordered.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{place_col}`")).mapInArrow(run, schema)
