"""Media columns: content-addressed payloads in tar shards, and columns that come from range reads of them.

A payload becomes a grey image of 8-bit samples in a PNG file, a member of a tar shard. Tasks write
shards while they read the rows, so no payload is shuffled; each stores a payload once. The index has
a payload's digest, shard, offset and length. Where several tasks stored one payload, the index keeps
the first place; shards with too many bytes that the index no longer names are written again without
them. Metadata columns come from reads of the headers alone, features from the stored bytes.

A shard's name is a digest of what it holds. It is written under another name and moved when whole,
so a task that runs again, or twice at a time, leaves the same file.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a shard, about; a shard holds one member at least.
SHARD = 32 << 20
#: Samples of a row of an image; payloads are padded to whole rows.
WIDTH = 64
#: A shard of which this share of bytes is in no index is written again.
DEAD_SHARE = 0.1
#: Digests that a writing task remembers; beyond that it may store a payload again, which the index then leaves out.
REMEMBERED = 1_000_000

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a tar header, and of a PNG file up to the end of its first chunk.
_TAR, _PNG = 512, 33
_PART = 1 << 20


def padded(text: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of WIDTH."""
    text = text or b""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def encoded(payload: bytes) -> bytes:
    """The payload as a grey PNG of WIDTH samples a row; equal payloads give equal files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    # every row begins with its filter, none
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    data = zlib.compress(lines.tobytes(), 6)
    out = io.BytesIO()
    out.write(_SIGNATURE)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    parts = [(b"IDAT", data[k : k + _PART]) for k in range(0, len(data), _PART)]
    for kind, body in [(b"IHDR", header), *parts, (b"IEND", b"")]:
        out.write(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))))
    return out.getvalue()


def header(start: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type of an image, from the first bytes of its file."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("no PNG file")
    return struct.unpack(">IIBB", start[16:26])


def decoded(media: bytes) -> bytes:
    """The samples of an image that encoded() made."""
    width, height, bits, colour = header(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk at {at}")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if (bits, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not a grey image of unfiltered 8-bit rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Hex digits of 64 bits: which of 8 x 8 parts of the image are brighter than all of it on average."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 8, WIDTH // 8).sum(2, dtype=np.int64)
    n = len(rows)
    lo = np.arange(8) * n // 8
    hi = np.maximum(lo + 1, np.arange(1, 9) * n // 8)
    until = np.concatenate([np.zeros((1, 8), np.int64), rows.cumsum(0)])
    parts, sizes = until[hi] - until[lo], (hi - lo)[:, None] * (WIDTH // 8)
    bright = parts * (n * WIDTH) > rows.sum() * sizes
    return np.packbits(bright.ravel()).tobytes().hex()


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


class _Shards:
    """Writes members into one shard after the other; gives the places of a shard's members when it is whole."""

    def __init__(self, folder: str, shard_bytes: int, salt: str = ""):
        self.fs, self.root = _filesystem(folder)
        self.fs.create_dir(self.root)
        self.limit, self.tar, self.salt = shard_bytes, None, salt

    def add(self, digest: str, media: bytes) -> list[tuple[str, str, int, int]]:
        if self.tar is None:
            self.temporary = f"{self.root}/.part-{uuid.uuid4().hex}"
            self.file, self.places = self.fs.open_output_stream(self.temporary), []
            self.tar = tarfile.open(fileobj=self.file, mode="w", format=tarfile.USTAR_FORMAT)
        member = tarfile.TarInfo(f"{digest}.png")
        member.size = len(media)
        self.places.append((digest, self.tar.offset + _TAR, len(media)))
        self.tar.addfile(member, io.BytesIO(media))
        return self.close() if self.tar.offset >= self.limit else []

    def close(self) -> list[tuple[str, str, int, int]]:
        if self.tar is None:
            return []
        self.tar.close()
        self.file.close()
        self.tar = None
        name = hashlib.sha256((self.salt + "".join(d for d, *_ in self.places)).encode()).hexdigest() + ".tar"
        self.fs.move(self.temporary, f"{self.root}/{name}")
        return [(d, name, at, size) for d, at, size in self.places]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_PLACES = "digest string, shard string, offset long, length long"
_place = [("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]


def _stored(folder: str, shard_bytes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *_place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known, out = _Shards(folder, shard_bytes), set(), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                payload = padded(text.as_py())
                digest = hashlib.sha256(payload).hexdigest()
                out.append((doc, len(text.as_py() or b""), digest, None, None, None))
                if digest not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known.add(digest)
                    out += [(None, None, *place) for place in shards.add(digest, encoded(payload))]
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        out += [(None, None, *place) for place in shards.close()]
        if out:
            yield _batch(out, schema)

    return run


def store_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Store the payload of each row in shards of `folder`; (doc_id, n_bytes, digest) of each row and (digest, shard, offset, length) of each payload.

    A payload is the text in UTF-8, null counting as empty, with zeros up to a positive multiple of
    WIDTH. Rows with equal payloads share one, repeated rows and ids have a row each; ids may be null.
    Texts are stored whole. Other columns are not read; an empty table gives empty results.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = common.store(source.mapInArrow(_stored(folder, shard_bytes), "doc_id long, n_bytes long, " + _PLACES), "media")
    _clean(spark, folder)
    refs = rows.filter("shard is null").select("doc_id", "n_bytes", "digest")
    places = rows.filter("shard is not null").select("digest", "shard", "offset", "length").distinct()
    first = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return refs, repacked(common.store(first, "index"), common.store(places, "places"), folder, shard_bytes)


def _clean(spark, folder: str) -> None:
    """Delete what tasks that were stopped have left unfinished."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.part-*")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(at) or []:
        system.delete(found.getPath(), False)


def _copied(folder: str, shard_bytes: int):
    # of its own for each time, so that no new shard has the name of one that goes
    schema, salt = pa.schema(_place), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(folder, shard_bytes, salt)
        for (digest, *_), media in _ranges(batches, folder, lambda offset, length: (offset, length)):
            if done := shards.add(digest, media):
                yield _batch(done, schema)
        if done := shards.close():
            yield _batch(done, schema)

    return run


def repacked(index: DataFrame, places: DataFrame, folder: str, shard_bytes: int = SHARD, dead_share: float = DEAD_SHARE) -> DataFrame:
    """The index after shards with more than `dead_share` of bytes that it doesn't name are written again and deleted.

    places: all members of the shards. Only what the index names in such shards is read and written.
    """
    spark = index.sparkSession
    live = index.groupBy("shard").agg(F.sum("length").alias("live"))
    sizes = places.groupBy("shard").agg(F.sum("length").alias("all")).join(live, "shard", "left").na.fill(0, ["live"])
    poor = common.store(sizes.filter(F.col("all") - F.col("live") > dead_share * F.col("all")), "poor")
    move = index.join(poor.select("shard"), "shard", "left_semi").select("digest", "shard", "offset", "length")
    bytes_moved = poor.agg(F.sum("live")).first()[0] or 0
    rest = index.join(poor.select("shard"), "shard", "left_anti").select("digest", "shard", "offset", "length")
    moved = _dealt(move, -(-bytes_moved // shard_bytes)).mapInArrow(_copied(folder, shard_bytes), _PLACES)
    out = common.store(rest.unionByName(moved), "index")
    _clean(spark, folder)
    # the new places are stored, so nothing names these shards any more
    poor.select("shard").foreachPartition(functools.partial(_deleted, folder))
    return out


def _deleted(folder: str, shards: Iterator) -> None:
    fs, root = _filesystem(folder)
    for row in shards:
        # a task that runs again finds them gone
        with contextlib.suppress(FileNotFoundError):
            fs.delete_file(f"{root}/{row['shard']}")


def _dealt(index: DataFrame, parts: int) -> DataFrame:
    """Members in the order of their places, in so many ranges; a range reads on from where it is."""
    return index.repartitionByRange(max(1, int(parts)), "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], folder: str, span: Callable[[int, int], tuple[int, int]]) -> Iterator[tuple[tuple, bytes]]:
    """The rows (digest, shard, offset, length, ...) and the bytes of the range that span(offset, length) names."""
    fs, root = _filesystem(folder)
    name, file = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] != name:
                if file:
                    file.close()
                name, file = row[1], fs.open_input_file(f"{root}/{row[1]}")
            at, size = span(row[2], row[3])
            data = file.read_at(size, at)
            if len(data) != size:
                raise ValueError(f"{name} ends before {at + size}")
            yield row, data
    if file:
        file.close()


_HEADERS = _PLACES + ", width long, height long, bits int"


def _headed(folder: str):
    schema = pa.schema([*_place, ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, start in _ranges(batches, folder, lambda offset, length: (offset - _TAR, _TAR + _PNG)):
            member = tarfile.TarInfo.frombuf(start[:_TAR], "utf-8", "strict")
            if member.name != f"{row[0]}.png" or member.size != row[3]:
                raise ValueError(f"{row[1]} holds {member.name} at {row[2]}")
            out.append((*row[:4], *header(start[_TAR:])[:3]))
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def with_headers(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and bits of each image, by reads of its tar and file headers alone.

    A member that is not what the index says is an error.
    """
    return index.select("digest", "shard", "offset", "length").mapInArrow(_headed(folder), _HEADERS)


_FEATURES = _HEADERS + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def _featured(folder: str):
    more = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema([*_place, ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int32()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row, media in _ranges(batches, folder, lambda offset, length: (offset, length)):
            payload = decoded(media)
            sha = hashlib.sha256(payload).hexdigest()
            if sha != row[0]:
                raise ValueError(f"{row[1]} holds other bytes at {row[2]} than were stored")
            out.append((*row, len(payload), sha, zlib.crc32(payload[-WIDTH:]), hashlib.sha256(media).hexdigest(), feature(payload)))
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def with_features(headers: DataFrame, folder: str) -> DataFrame:
    """with_headers() rows and what the stored bytes say: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature.

    A payload that is not what its digest says is an error.
    """
    return headers.mapInArrow(_featured(folder), _FEATURES)


@common.settled
def media_columns(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, its payload's place, header columns and features.

    Each payload is read once, however many rows share it. See store_media() for odd rows.
    """
    refs, index = store_media(docs, folder, id_col, text_col, shard_bytes)
    size = index.agg(F.sum("length")).first()[0] or 0
    media = with_features(with_headers(_dealt(index, -(-4 * size // shard_bytes)), folder), folder)
    uses = refs.groupBy("digest").agg(F.count("*").alias("uses"))
    media = common.store(media.join(uses, "digest"), "features")
    out = common.skew_join(refs, media, ["digest"], "uses", refs.count())
    return out.withColumnRenamed("length", "media_bytes")
