"""Text recognition as a pluggable engine: row filters first, one call for each distinct image and pass, a cache by content and pass.

An image is read by a strategy (one pass, or three for document pages) and then by passes that only
add text: sparse text always, turned pages and straightened pages if the page's ink gives a reason.
Every pass has its own key in the cache, so switching one on reads nothing else again.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.config import CONFIG, Config

from . import blobs, imaging

#: (image bytes, page segmentation mode, further flags) -> (text, status); status is 'ok' or why there is no text.
Engine = Callable[[bytes, int, list[str]], tuple[str, str]]
# Sides of an image worth reading and of a document page; words below which a page is turned or straightened; the ink of a photo;
# how far columns must outdo rows, and by what at least; the angle, variance and gain that make a tilt clear.
LEAST_SIDE, DOCUMENT_SIDE, TURN_WORDS, STRAIGHTEN_WORDS, PHOTO_INK = 100, 800, 12, 40, 0.15
COLUMN_GAIN, COLUMN_LEAST, TILT, TILT_VARIANCE, TILT_GAIN, TILT_MARGIN, SECONDS = 2.0, 30.0, 2, 100.0, 1.5, 1.05, 15
# Letters that a repeated reading of a field is limited to, and its form.
REREAD = {"sponsor_id": ("SPN-0123456789", r"^SPN-\d{4}$"), "arrival_date": ("-0123456789", r"^\d{4}-\d{2}-\d{2}$")}
_READ = "sha string, text string, passes array<struct<tag:string,text:string,status:string,fresh:boolean>>"


def tesseract(image: bytes, psm: int, flags: list[str]) -> tuple[str, str]:
    """The command-line program. Without it, after a timeout or an error there is no text, and the status says so."""
    try:
        done = subprocess.run(["tesseract", "-", "-", "--psm", str(psm), *flags], input=image, capture_output=True, timeout=SECONDS)
    except FileNotFoundError:
        return "", "no program"
    except subprocess.TimeoutExpired:
        return "", "timeout"
    except OSError as e:
        return "", f"error: {e.strerror}"
    return done.stdout.decode("utf-8", "replace"), "ok" if done.returncode == 0 else f"error: {done.returncode}"


def tag_of(name: str, config: Config = CONFIG) -> str:
    """A pass's key in the cache, beside the image's hash: what changes its text is part of it."""
    return name + ("+words" if _words(config) else "")


def _words(config: Config) -> list[str]:
    return ["--user-words", config.user_words] if config.user_words and os.path.exists(config.user_words) else []


def with_passes(sources: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Images that are worth reading, with sha and whether they look like documents. The gate is a row filter, so the engine never sees other rows."""
    images = sources.filter((F.col("kind") == "IMAGE") & _large())
    return images.select("case_id", "source_id", "raw", F.sha2("raw", 256).alias("sha"), F.coalesce(F.greatest("width", "height") >= DOCUMENT_SIDE, F.lit(False)).alias("document"))


def _large() -> Column:
    side = F.greatest("width", "height")
    return side.isNull() | (side >= LEAST_SIDE)


class Reader:
    """Reads one image after the other by all passes that it needs."""

    def __init__(self, engine: Engine, config: Config = CONFIG):
        self.engine, self.config, self.flags = engine, config, _words(config)

    def read(self, raw: bytes, document: bool, cached: dict[str, str]) -> tuple[str, list[tuple[str, str, str, bool]]]:
        """The text, and (tag, text, status, fresh) of every pass that was needed."""
        seen: dict[str, tuple[str, str, str, bool]] = {}
        image: list[np.ndarray | None] = []

        def pixels() -> np.ndarray | None:
            if not image:
                image.append(imaging.decode(raw))
            return image[0]

        def one(name: str, psm: int, make: Callable[[], list[np.ndarray | bytes]]) -> str:
            tag = tag_of(name, self.config)
            if tag not in seen:
                if tag in cached:
                    seen[tag] = (tag, cached[tag], "ok", False)
                else:
                    got = [self.engine(x if isinstance(x, bytes) else imaging.encode(x), psm, self.flags) for x in make()]
                    text = "\n".join(t for t, _ in got if t.strip()) if len(got) > 1 else got[0][0] if got else ""
                    bad = [s for _, s in got if s != "ok"]
                    seen[tag] = (tag, text, bad[0] if bad else "ok" if got else "not needed", True)
            return seen[tag][1]

        shape = lambda f: lambda: [f(p)] if (p := pixels()) is not None else []
        parts = [one("base", 6, lambda: [raw])]
        if document:
            parts.append(one("big", 3, shape(imaging.upscaled)))
            if self.config.sharpen_pass:
                parts.append(one("sharp", 6, shape(imaging.sharpened)))
        text = "\n".join(p for p in parts if p)
        # how much was read decides on the costly passes, whatever other passes add
        words, more = len(re.findall("[A-Za-z]{2,}", text)), []
        if self.config.sparse_text_pass:
            more.append(one("sparse", 11, lambda: [raw]))
        turn, straighten = self.config.rotation_pass and words < TURN_WORDS, self.config.deskew_pass and words < STRAIGHTEN_WORDS
        if (turn or straighten) and (page := pixels()) is not None:
            ink, rows, columns = imaging.geometry(page)
            if turn and ink < PHOTO_INK and columns > COLUMN_GAIN * rows and columns > COLUMN_LEAST:
                more.append(one("turned", 6, lambda: [np.rot90(page, k) for k in (1, 2, 3)]))
            if straighten and ink < PHOTO_INK:
                angle, best, flat = imaging.skew(page)
                if abs(angle) >= TILT and best >= TILT_VARIANCE and best >= TILT_GAIN * flat:
                    more.append(one("straight", 6, lambda: [imaging.turned(imaging.grey(page), angle, grow=True)] if best > flat * TILT_MARGIN else []))
        return "\n".join([text, *(m for m in more if m.strip())]), list(seen.values())


def recognize(need: DataFrame, engine: Engine, cache: DataFrame | None = None, config: Config = CONFIG) -> DataFrame:
    """(sha, text, passes) of each distinct image; cache is (sha, tag, text). Write the result before anything filters on the text."""
    distinct = need.groupBy("sha").agg(F.first("raw").alias("raw"), F.max("document").alias("document"))
    none = F.array().cast("array<struct<tag:string,text:string>>")
    if cache is None:
        rows = distinct.withColumn("known", none)
    else:
        held = cache.join(distinct.select("sha"), "sha", "left_semi").groupBy("sha").agg(F.collect_list(F.struct("tag", "text")).alias("known"))
        rows = distinct.join(held, "sha", "left").withColumn("known", F.coalesce("known", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(engine, config)
        for b in batches:
            for k in range(b.num_rows):
                sha, raw, document, known = (b.column(c)[k].as_py() for c in range(4))
                text, passes = reader.read(raw, document, {x["tag"]: x["text"] for x in known})
                made = [dict(zip(("tag", "text", "status", "fresh"), p, strict=True)) for p in passes]
                kind = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string()), ("status", pa.string()), ("fresh", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([pa.array([sha]), pa.array([text]), pa.array([made], kind)], ["sha", "text", "passes"])

    return rows.select("sha", "raw", "document", "known").mapInArrow(run, _READ)


def cache_rows(read: DataFrame) -> DataFrame:
    """(sha, tag, text) of the passes that were read anew and well: what to append to the cache."""
    return read.select("sha", F.explode("passes").alias("p")).filter("p.fresh and p.status in ('ok', 'not needed')").select("sha", "p.tag", "p.text")


#: Folders of the cache, by the first digits of the hash.
_PREFIX = 2
_CACHE = "sha string, tag string, text string, prefix string"


def write_cache(read: DataFrame, path: str) -> None:
    """Append what was read anew; a batch that comes again, in whole or in part, adds nothing."""
    append_cache(cache_rows(read), path)


def append_cache(rows: DataFrame, path: str) -> None:
    """rows (sha, tag, text) that the cache doesn't have, each key once, in folders by the hash's first digits.

    The keys that are there are read in the folders that the rows belong to, and no texts. Of rows with one
    key the least text counts. One run appends at a time; what two appended at a time is one key to readers.
    """
    spark = rows.sparkSession
    new = rows.groupBy("sha", "tag").agg(F.min("text").alias("text")).withColumn("prefix", F.substring("sha", 1, _PREFIX))
    held = _held(spark, path)
    if held is not None:
        new = new.join(held.select("prefix", "sha", "tag"), ["prefix", "sha", "tag"], "left_anti")
    new.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        # folder names are digits of a hash, and no numbers
        return spark.read.schema(_CACHE).parquet(path)
    except AnalysisException:
        return None


def read_cache(spark: SparkSession, config: Config = CONFIG) -> DataFrame | None:
    """The cache in the config's folder, each pass of an image once; None if there is no folder or nothing in it."""
    held = _held(spark, config.ocr_cache_dir) if config.ocr_cache_dir else None
    return held.groupBy("prefix", "sha", "tag").agg(F.min("text").alias("text")) if held is not None else None


def lookup(need: DataFrame, cache: DataFrame | None) -> DataFrame:
    """need (sha, tag, ...) with the cached text, null where it has to be read; only the folders of the hashes asked for are read."""
    if cache is None:
        return need.withColumn("text", F.lit(None).cast("string"))
    asked = need.withColumn("prefix", F.substring("sha", 1, _PREFIX))
    # hashes have 256 beginnings; where there are more, all folders are read
    some = asked.select("prefix").distinct().limit(257).collect()
    if len(some) <= 256:
        cache = cache.filter(F.col("prefix").isin(*[r["prefix"] for r in some]))
    return asked.join(cache.select("prefix", "sha", "tag", "text"), ["prefix", "sha", "tag"], "left").select(*need.columns, "text")


def read_all(need: DataFrame, engine: Engine, out: str, config: Config = CONFIG) -> DataFrame:
    """`recognize` with the config's cache: the result is written to `out` first, then what was read anew joins the cache."""
    spark = need.sparkSession
    recognize(need, engine, read_cache(spark, config), config).write.parquet(out)
    read = spark.read.parquet(out)
    if config.ocr_cache_dir:
        write_cache(read, config.ocr_cache_dir)
    return read


def statuses(read: DataFrame) -> DataFrame:
    """(tag, status, n): how the passes ended, so that a missing program doesn't pass for blank pages."""
    return read.select(F.explode("passes").alias("p")).groupBy("p.tag", "p.status").agg(F.count("*").alias("n"))


def composed(read: DataFrame, tags: list[str]) -> DataFrame:
    """(sha, text) of another composition of passes that were read already, in the given order, empty ones left out."""
    of = lambda t: F.try_element_at(F.transform(F.filter("passes", lambda p: p["tag"] == t), lambda p: p["text"]), F.lit(1))
    return read.select("sha", F.array_join(F.filter(F.array(*map(of, tags)), lambda x: x.isNotNull() & (x != "")), "\n").alias("text"))


def replayed(passes: DataFrame, compositions: DataFrame, key: list[str]) -> DataFrame:
    """(composition, *key, text): what each composition makes of texts that were read already, for all of them by one shuffle.

    passes: (*key, tag, text). compositions: (composition, place, tag), a row for each pass of each, in
    any number. Texts join in the order of places, then of texts; empty and null ones are left out. Keys that
    have none of a composition's passes have no row of it.
    """
    uses = passes.select(*key, "tag", "text").filter("text <> ''").join(compositions, "tag")
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return uses.groupBy("composition", *key).agg(parts.alias("parts")).select("composition", *key, F.array_join("parts.text", "\n").alias("text"))


def read_images(sources: DataFrame, texts: DataFrame, config: Config = CONFIG) -> DataFrame:
    """sources with the content of images filled in; raw bytes are dropped here."""
    # rows keep their places and meet the distinct images' texts by hash, once; no row meets itself again
    sha = F.when((F.col("kind") == "IMAGE") & _large(), F.sha2("raw", 256))
    out = sources.withColumn("__sha", sha).drop("raw").join(texts.select(F.col("sha").alias("__sha"), "text"), "__sha", "left").drop("__sha")
    return out.withColumn("content", F.when(F.col("kind") == "IMAGE", F.coalesce("text", F.lit(""))).otherwise(F.col("content"))).drop("text")


def failing(signals: DataFrame) -> DataFrame:
    """(case_id, seq, key, source_id) of the image signals whose value lacks its field's form: what is worth another reading."""
    bad = F.lit(False)
    for field, (_, form) in REREAD.items():
        bad = bad | ((F.col("key") == field) & ~F.coalesce("value", F.lit("")).rlike(form))
    return signals.filter(F.col("source_id").startswith("image_") & bad).select("case_id", "seq", "key", "source_id")


def late_images(need: DataFrame, images: DataFrame, folder: str | None = None) -> DataFrame:
    """need (case_id, source_id, ...) with the image bytes as `raw`.

    images: (case_id, source_id, place) of bytes in `folder`, or (case_id, source_id, raw). With places
    nothing but keys travels; the bytes of the rows that are left are read where these rows are.
    """
    if folder is None:
        return need.join(images.select("case_id", "source_id", "raw"), ["case_id", "source_id"])
    return blobs.fetch(need.join(images.select("case_id", "source_id", "place"), ["case_id", "source_id"]), folder)


def reread(signals: DataFrame, images: DataFrame, engine: Engine, folder: str | None = None) -> DataFrame:
    """(case_id, seq, value) of the failing() signals whose image, read with the field's letters alone, shows a value that has its form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for case, seq, key, raw in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                letters, form = REREAD[key]
                text, _ = engine(raw, 6, ["-c", f"tessedit_char_whitelist={letters}"])
                rows.append((case, seq, next((w for w in text.split() if re.match(form, w)), None)))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["case_id", "seq", "value"])

    got = late_images(failing(signals), images, folder).select("case_id", "seq", "key", "raw")
    return got.mapInArrow(run, "case_id string, seq long, value string").filter("value is not null")


def with_rereads(signals: DataFrame, repaired: DataFrame) -> DataFrame:
    """signals with the values of `reread` in place of those that lacked their form.

    What was read again is gathered by case, so signals that lie together by case stay where they are.
    """
    new = repaired.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "value"))).alias("__new"))
    out = signals.join(new, "case_id", "left")
    return out.withColumn("value", F.coalesce(F.try_element_at("__new", F.col("seq")), "value")).select(signals.columns)
