"""Registered scans of files and images; importing this module adds them to the catalogue.

The images hold their text as points of grey in their first row, after a mark, and the engine here
reads it back, so the stage's gates, passes and joins can be held against SQL without a program.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.config import Config
from docketry.sources import blobs, imaging, ocr, pdf, shared

from .catalogue import _t, query

_MARK = b"T:"


def _drawn(text: str, width: int) -> np.ndarray:
    out = np.full((4, width), 255, np.uint8)
    row = np.frombuffer(_MARK + text.encode("latin-1") + b"\0", np.uint8)
    out[0, : len(row)] = row
    return out


def read_points(image: bytes, psm: int, flags: list[str]) -> tuple[str, str]:
    """The engine of these images: text only from the image as it is, in mode 6."""
    page = imaging.decode(image)
    if psm != 6 or page is None or page.ndim != 2 or page[0, :2].tobytes() != _MARK:
        return "", "ok"
    return page[0, 2:].tobytes().split(b"\0")[0].decode("latin-1"), "ok"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source row for each order: one of 40 texts, drawn small, as an image, or as a document page."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            made = [imaging.encode(_drawn(f"Visa Class: XW-{k % 40}", (60, 160, 900)[k % 3])) for k in ks]
            meta = [pdf.image_meta(m) for m in made]
            cols = [[f"C-{k:07d}" for k in ks], ["image_0"] * len(ks), ["IMAGE"] * len(ks), [0] * len(ks), made, [""] * len(ks), *zip(*meta, strict=True), list(map(len, made))] if ks else [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, pdf._KINDS, strict=True)], pdf._NAMES)

    return _t(spark, sf_dir, "orders").select("o_orderkey").mapInArrow(draw, pdf.SCHEMA)


@query("SELECT 'C-' || lpad(o_orderkey::VARCHAR, 7, '0') AS case_id, 'image_0' AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Visa Class: XW-' || (o_orderkey % 40) END AS content, [60, 160, 900][(o_orderkey % 3) + 1]::INTEGER AS width FROM orders")
def ocr_stage(s, d):
    """Images too small are not read, each distinct one is read once, and every row gets its text back."""
    sources = _images(s, d)
    read = ocr.recognize(ocr.with_passes(sources), read_points, config=Config(rotation_pass=True, deskew_pass=True))
    return ocr.read_images(sources, read).select("case_id", "source_id", "content", "width")


_PASSES = "SELECT unnest(CASE WHEN k % 3 = 2 THEN ['base', 'big', 'sharp', 'sparse'] ELSE ['base', 'sparse'] END) AS tag FROM (SELECT DISTINCT o_orderkey % 120 AS k FROM orders) WHERE k % 3 > 0"


@query(f"SELECT tag, 'ok' AS status, count(*)::BIGINT AS n FROM ({_PASSES}) GROUP BY 1")
def ocr_passes(s, d):
    """How often each pass ran and how it ended, over the distinct images worth reading."""
    return ocr.statuses(ocr.recognize(ocr.with_passes(_images(s, d)), read_points))


def _packet(key: int, name: str) -> bytes:
    """A file with two text streams, a grey image, and an image whose points are too few."""
    text = lambda t: (b"/Filter /FlateDecode", zlib.compress(t.encode("latin-1")))
    page = _drawn(f"Sponsor: SPN-{key:04d}", 128)
    grey = b"/Subtype /Image /Filter /FlateDecode /Width 128 /Height %d /ColorSpace /DeviceGray"
    parts = [text(f"(Applicant: {name}) Tj (Fee\\072 paid) Tj"), (grey % 4, zlib.compress(page.tobytes())), (grey % 5, zlib.compress(page.tobytes())), text(f"(Note \\({key}\\)) Tj")]
    return b"%PDF-1.4\n" + b"".join(b"<< " + head + b" >>\nstream\n" + body + b"\nendstream\n" for head, body in parts)


def _put_packets(at: str):
    """Writes the packets of (n_nationkey, n_name) rows, and of every tenth one a copy that is cut off."""

    def run(rows: Iterator) -> None:
        fs, root = blobs.filesystem(at)
        fs.create_dir(root)
        for r in rows:
            whole = _packet(r["n_nationkey"], r["n_name"])
            files = {f"N-{r['n_nationkey']:03d}.pdf": whole}
            if r["n_nationkey"] % 10 == 9:
                files[f"T-{r['n_nationkey']:03d}.pdf"] = whole[: whole.index(b">>\nstream\n", whole.index(b"endstream")) + 20]
            for name, data in files.items():
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(data)

    return run


@query("""SELECT 'N-' || lpad(n_nationkey::VARCHAR, 3, '0') AS case_id, u.source_id, u.kind, u.content, u.width, u.mode, 'ok' AS status FROM (SELECT *, unnest([
{'source_id': 'text_stream_0', 'kind': 'TEXT_STREAM', 'content': 'Applicant: ' || n_name || chr(10) || 'Fee: paid', 'width': 0, 'mode': ''}, {'source_id': 'text_stream_1', 'kind': 'TEXT_STREAM', 'content': 'Note (' || n_nationkey || ')', 'width': 0, 'mode': ''},
{'source_id': 'image_0', 'kind': 'IMAGE', 'content': 'Sponsor: SPN-' || lpad(n_nationkey::VARCHAR, 4, '0'), 'width': 128, 'mode': 'L'}]) AS u FROM nation)
UNION ALL SELECT 'T-' || lpad(n_nationkey::VARCHAR, 3, '0'), u.source_id, u.kind, u.content, 0, '', u.status FROM (SELECT *, unnest([
{'source_id': 'text_stream_0', 'kind': 'TEXT_STREAM', 'content': 'Applicant: ' || n_name || chr(10) || 'Fee: paid', 'status': 'ok'}, {'source_id': '', 'kind': '', 'content': '', 'status': 'truncated'}]) AS u FROM nation WHERE n_nationkey % 10 = 9)""")
def file_scan(s, d):
    """A folder of packets, one for each nation and some cut off, listed by Spark, cut into streams by the table function, and its images read."""
    at = f"{shared.shared_dir(s)}/docketry-packets-{uuid.uuid4().hex}"
    shared.put(s, f"{at}/notes.txt", b"no packet")
    _t(s, d, "nation").select("n_nationkey", "n_name").foreachPartition(_put_packets(at))
    found = pdf.scan(pdf.packets(s, at))
    sources = found.filter("status = 'ok'").drop("status")
    read = ocr.read_images(sources, ocr.recognize(ocr.with_passes(sources), read_points)).withColumn("status", F.lit("ok"))
    out = read.unionByName(found.filter("status <> 'ok'").drop("raw"))
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("case_id", none("source_id", ""), none("kind", ""), none("content", ""), none("width", 0), none("mode", ""), "status")
