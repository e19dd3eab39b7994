"""op13: payloads, shards and columns against plain Python, tar's own reader, copies and damage."""

from __future__ import annotations

import hashlib
import os
import tarfile
import uuid
import zlib

import numpy as np
import pytest
from docketry.llm import common
from docketry.llm import op13_media as op
from pyspark.errors import PythonException

DOC = "doc_id long, text string, lang string, digest string, shard string, length long"


def frame(spark, docs):
    return spark.createDataFrame([(*d, "en", "x", "y", 0) for d in docs], DOC)


def folder(spark):
    return common.new_path(spark, "shards")


def local(at):
    return at.removeprefix("file://")


def plain_feature(payload):
    image = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(int)
    n, bits = len(image), ""
    for y in range(8):
        lo = y * n // 8
        for x in range(8):
            part = image[lo : max(lo + 1, (y + 1) * n // 8), 8 * x : 8 * x + 8]
            bits += "1" if part.sum() * image.size > image.sum() * part.size else "0"
    return f"{int(bits, 2):016x}"


def check(spark, docs, **options):
    at = folder(spark)
    got = [r.asDict() for r in op.media_columns(frame(spark, docs).repartition(4), at, **options).collect()]
    assert len(got) == len(docs)
    want = []
    for doc, text in docs:
        raw = (text or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        want.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), plain_feature(payload), 64, len(payload) // 64, 8))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "width", "height", "bits")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in got), key=key) == sorted(want, key=key)
    # each payload has one place, where the stored file is
    places = {(r["payload_sha256"], r["shard"], r["offset"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in got}
    assert len(places) == len({r["payload_sha256"] for r in got})
    for digest, shard, offset, length, sha, _ in places:
        with open(f"{local(at)}/{shard}", "rb") as f:
            f.seek(offset)
            media = f.read(length)
        assert hashlib.sha256(media).hexdigest() == sha and hashlib.sha256(op.decoded(media)).hexdigest() == digest
    # tar's own reader finds the same members
    for name in {p[1] for p in places}:
        with tarfile.open(f"{local(at)}/{name}") as tar:
            members = {(m.name, m.offset_data, m.size) for m in tar.getmembers()}
        assert {(f"{d}.png", o, n) for d, s, o, n, *_ in places if s == name} <= members
    assert not [f for f in os.listdir(local(at)) if f.startswith(".part")]
    return at, got


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "\x00"), (3, "\x00" * 64), (None, "é" * 32), (None, None), (5, "a" * 64), (6, "a" * 65), (7, "𝄞\n\t"), (7, "𝄞\n\t"), (8, "z" * 63)]
    _, got = check(spark, docs)
    empty = {r["payload_sha256"] for r in got if r["n_bytes"] in (0, 1) or r["doc_id"] == 3}
    assert len(empty) == 1


def test_long_texts_and_many_copies(spark):
    rng = np.random.default_rng(0)
    long = "".join(chr(97 + c) for c in rng.integers(0, 26, 300_000))
    docs = [(k, "the same text " * 50) for k in range(900)] + [(k, f"text {k} " * (k % 9)) for k in range(900, 1500)] + [(2000, long), (2001, long * 12)]
    at, got = check(spark, docs, shard_bytes=50_000)
    assert len({r["shard"] for r in got}) > 3
    # what no row points at is a small part of what is stored
    live = {(r["shard"], r["offset"]): r["media_bytes"] for r in got}
    kept = 0
    for name in os.listdir(local(at)):
        if name.endswith(".tar"):
            with tarfile.open(f"{local(at)}/{name}") as tar:
                kept += sum(m.size for m in tar.getmembers())
    assert kept <= 1.2 * sum(live.values())


def test_no_rows(spark):
    assert op.media_columns(frame(spark, []), folder(spark)).count() == 0


def test_a_task_that_runs_again_leaves_the_same_files(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", "b", "a"])], ["doc_id", "text"])
    run = op._stored(f"file://{tmp_path}", 1000)
    first = [b.to_pylist() for b in run(iter([batch]))]
    files = {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)}
    assert [b.to_pylist() for b in run(iter([batch]))] == first
    assert {f: (tmp_path / f).read_bytes() for f in os.listdir(tmp_path)} == files


def test_shards_of_copies_are_written_again(spark):
    at = folder(spark)
    schema = "digest string, shard string, offset long, length long"
    texts = [f"text {k} " * 40 for k in range(20)]
    rows = []
    for k in range(3):
        shards = op._Shards(at, 1 << 30)
        for t in texts[: 20 - k]:
            payload = op.padded(t.encode())
            shards.add(hashlib.sha256(payload).hexdigest(), op.encoded(payload))
        rows += shards.close()
    places = spark.createDataFrame(rows, schema)
    index = places.groupBy("digest").agg({"shard": "min"}).withColumnRenamed("min(shard)", "shard").join(places, ["digest", "shard"]).select("digest", "shard", "offset", "length")
    new = op.repacked(index, places, at, 2000)
    kept = [r.asDict() for r in op.with_features(op.with_headers(new, at), at).collect()]
    assert {r["payload_sha256"] for r in kept} == {hashlib.sha256(op.padded(t.encode())).hexdigest() for t in texts} and len(kept) == 20
    assert {r["shard"] for r in kept} == {f for f in os.listdir(local(at)) if f.endswith(".tar")}


def test_damage_is_an_error(spark):
    at = folder(spark)
    _, index = op.store_media(frame(spark, [(1, "some text"), (2, "other text")]), at)
    row = index.first()
    path = f"{local(at)}/{row['shard']}"
    with open(path, "r+b") as f:
        f.seek(row["offset"] + row["length"] - 20)
        f.write(b"\xff\xfe")
    with pytest.raises(PythonException):
        op.with_features(op.with_headers(index, at), at).collect()
    with pytest.raises(PythonException, match="holds"):
        op.with_headers(index.selectExpr("digest", "shard", "offset", "length + 1 as length"), at).collect()


def test_payloads_come_back():
    for n in (0, 1, 63, 64, 65, 70_000):
        payload = op.padded(os.urandom(n))
        assert op.decoded(op.encoded(payload)) == payload and len(payload) % 64 == 0 and payload
        assert op.header(op.encoded(payload)[:33]) == (64, len(payload) // 64, 8, 0)
    assert uuid.UUID(op.feature(bytes(64)) * 2).int == 0
