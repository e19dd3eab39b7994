r"""Phrases of words that stand together more often than chance, by hashed and pruned passes.

Pass k reads all texts once. It counts exactly those phrases of k words that can still be frequent: whose
bucket was full enough in the pass before, and whose two parts of k-1 words are frequent. In the same
pass it counts, by hash bucket only, the phrases of k+1 words whose two parts of k words may be
frequent. What is broadcast are two bitmaps of bounded size: the full buckets, and the hashes of the
frequent phrases of k-1 words. Hashes only ever let too many phrases through; what counts is the exact
count of the phrase itself, so results don't depend on the sizes of the bitmaps.

Where a corpus fills all buckets (beyond about MOST_BUCKETS * min_count phrases), they let all
phrases through and the frequent parts alone prune.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Buckets for the next length are a power of two, one for about so many bytes of text, in these bounds (2 MB of bitmap at most).
BYTES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 128, 1 << 16, 1 << 24
#: Bits of the bitmap of frequent phrases: a power of two, about so many for each phrase, in these bounds (64 MB at most).
BITS_A_PHRASE, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
#: Bytes of text that are taken together; a longer text is read in windows of that size.
CHUNK = 3 << 20
#: Buckets of one row on their way to be added up, and rows that are added up together.
BLOCK, FAN = 1 << 14, 1000
#: Frequent phrases in one file.
ROWS_A_FILE = 1_000_000

_BREAKS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_GAPS)] = 1
_CLASS[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_REST, _NEXT = re.compile(rb"[^ \t.,;:!?\n-\r]*"), re.compile(rb"[ \t.,;:!?\n-\r]+[^ \t.,;:!?\n-\r]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a chunk of texts in order, with exact numbers, hashes and pieces."""

    def __init__(self, parts: list[bytes], own: list[int], langs: list[str]):
        """own: only words that begin in a part's first `own` bytes begin phrases; the rest is there to end them."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends_at = np.cumsum([len(p) for p in parts])
        kind = _CLASS[data]
        word = kind == 0
        edge = ends_at[ends_at < len(data)]
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, word[:-1]
        before[edge] = False
        start = np.flatnonzero(word & ~before)
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, word[1:]
        after[edge - 1] = False
        end = np.flatnonzero(word & ~after) + 1
        n = self.n = len(start)
        # a phrase ends where a text or a piece does
        cut = np.cumsum(kind == 2, dtype=np.int32)
        text = np.searchsorted(ends_at, start, "right")
        broken = (cut[start[1:]] != cut[end[:-1] - 1]) | (text[1:] != text[:-1]) if n else np.zeros(0, bool)
        self.piece = np.concatenate([np.zeros(min(n, 1), np.int64), np.cumsum(broken)])
        self.begins = start - np.concatenate([[0], ends_at[:-1]])[text] < np.array(own)[text] if n else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[word]])]).dictionary_encode()
        self.names = found.dictionary
        self.id = found.indices.to_numpy().astype(np.int64)
        self.langs, lang = np.unique(np.array(langs, object), return_inverse=True)
        self.lang = lang[text]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.names.to_pylist()), np.uint64, len(self.names))
        salts = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), 1) for x in self.langs), np.uint64, len(self.langs))
        self.word_hash = hashes[self.id]
        self.hash = {1: _mixed(self.word_hash ^ salts[self.lang])}

    def hashes(self, k: int) -> np.ndarray:
        """Hashes of the phrases of k words that begin at each word; the last k-1 are shorter and of no use."""
        if k not in self.hash:
            last = np.concatenate([self.word_hash[k - 1 :], np.zeros(min(k - 1, self.n), np.uint64)])
            self.hash[k] = _mixed(self.hashes(k - 1) * _A + last)
        return self.hash[k]

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each one on lie in one piece."""
        out = np.zeros(self.n, bool)
        if self.n >= k:
            out[: self.n - k + 1] = self.piece[: self.n - k + 1] == self.piece[k - 1 :]
        return out

    def counted(self, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """Each phrase of k words that begins at one of the words `at`, once, and how often it does."""
        size = max(len(self.names), 1)
        code, most = self.lang[at], len(self.langs)
        for j in range(k):
            if most > (1 << 62) // size:
                known, code = np.unique(code, return_inverse=True)
                most = len(known)
            code, most = code * size + self.id[at + j], most * size
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        first = at[first]
        for lo in range(0, len(first), 100_000):
            some = first[lo : lo + 100_000]
            words = [self.names.take(pa.array(self.id[some + j])) for j in range(k)]
            phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
            yield _rows(pa.array(self.langs[self.lang[some]], pa.string()), phrase.cast(pa.binary()).cast(pa.string()), self.hashes(k)[some].view(np.int64), count[lo : lo + 100_000])


def _rows(lang=None, phrase=None, h=None, n=None, data=None) -> pa.RecordBatch:
    size = len(h)
    none = lambda x, t: pa.nulls(size, t) if x is None else x
    columns = [none(lang, pa.string()), none(phrase, pa.string()), pa.array(h, pa.int64()), pa.array(n, pa.int64()), none(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "h", "n", "data"])


_ROWS = "lang string, phrase string, h long, n long, data binary"


def _chunks(batches: Iterator[pa.RecordBatch], reach: int, chunk: int = CHUNK) -> Iterator[Words]:
    parts, own, langs, held = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            lo, size = 0, len(text or b"")
            while lo < size:
                hi = end = size
                if size - lo > chunk:
                    # a window ends where a word does, and what its last phrases need follows
                    hi = end = _REST.match(text, lo + chunk).end()
                    for _ in range(reach):
                        end = m.end() if (m := _NEXT.match(text, end)) else end
                parts.append(text[lo:end])
                own.append(hi - lo)
                langs.append(lang)
                held += end - lo
                lo = hi
                if held >= chunk:
                    yield Words(parts, own, langs)
                    parts, own, langs, held = [], [], [], 0
    if parts:
        yield Words(parts, own, langs)


def _bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _passed(k: int, longest: int, buckets: int, top: int, full, parts):
    """One pass: exact counts of phrases of k words, and bucket counts of k+1 words. full, parts: broadcast bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, _kind(top)) if k < longest else None
        bits = [np.frombuffer(b.value, np.uint8) if b is not None else None for b in (full, parts)]
        for words in _chunks(batches, longest):
            may = words.whole(k)
            if bits[1] is not None:
                frequent = _bit(bits[1], words.hashes(k - 1))
                may[:-1] &= frequent[:-1] & frequent[1:]
            if bits[0] is not None:
                may[may] = _bit(bits[0], words.hashes(k)[may])
            yield from words.counted(np.flatnonzero(may & words.begins), k)
            if k == 1:
                total = np.bincount(words.lang[words.begins], minlength=len(words.langs))
                yield _rows(pa.array(words.langs, pa.string()), None, np.zeros(len(total), np.int64), total)
            if counts is not None:
                longer = words.whole(k + 1) & words.begins
                longer[:-1] &= may[:-1] & may[1:]
                at, n = np.unique(words.hashes(k + 1)[longer] & np.uint64(buckets - 1), return_counts=True)
                # more than `top` is as good as top
                counts[at] = np.minimum(counts[at] + n, top)
        if counts is not None:
            for b in range(0, buckets, BLOCK):
                part = counts[b : b + BLOCK]
                if part.any():
                    yield _rows(None, None, [b // BLOCK], [1], pa.array([part.tobytes()], pa.binary()))

    return run


def _kind(top: int) -> type:
    """Numbers that hold counts up to `top`."""
    return np.uint8 if top <= 255 else np.uint32


def _summed(top: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kind = _kind(top)
        total = sum(np.frombuffer(d, kind).astype(np.int64) * n for d, n in zip(rows["data"], rows["n"], strict=True))
        return pd.DataFrame({"h": [rows["h"].iloc[0]], "data": [np.minimum(total, top).astype(kind).tobytes()], "n": [1]})

    return run


def _full_buckets(rows: DataFrame, buckets: int, top: int) -> bytes:
    """The bitmap of the buckets that hold `top` or more; rows (h: block, data: counts, n: how often these rows came).

    Rows of a block are added up FAN at a time, so no task gets more of them however many tasks wrote some.
    """
    most = rows.groupBy("h").count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        salt = F.pmod(F.xxhash64("data"), F.lit(most))
        rows = common.store(rows.groupBy("h", salt.alias("salt")).applyInPandas(_summed(top), "h long, data binary, n long"), "buckets")
    bits = np.zeros(buckets, bool)
    for row in rows.groupBy("h").applyInPandas(_summed(top), "h long, data binary, n long").collect():
        lo = row["h"] * BLOCK
        bits[lo : lo + BLOCK] = np.frombuffer(row["data"], _kind(top)) >= top
    return np.packbits(bits, bitorder="little").tobytes()


def _bitmap(frequent: DataFrame) -> bytes:
    """The hashes of the phrases as a bitmap; it is made by Spark's own bitmap functions in parts of 4 KB."""
    size = _power(frequent.count() * BITS_A_PHRASE, LEAST_BITS, MOST_BITS)
    # one more than the place: Spark's first bitmap begins with 1
    at = F.pmod("h", F.lit(size)) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(size // 8)
    for row in parts.collect():
        lo = (row["part"] - 1) * 4096
        out[lo : lo + 4096] = row["bits"]
    return bytes(out)


def _power(wanted: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to `longest` words that occur min_count times or more in a language, and (lang, n) of its words.

    Texts are cut at `[.,;:!?\\n-\\r]` into pieces, these at spaces and tabs into words; A-Z count as a-z.
    All contiguous occurrences in a piece count, overlaps too. Null texts are empty, a null language is
    `und`. Texts are read whole, long ones in windows, in as many passes as there are lengths that
    have a frequent phrase. Repeated rows count each; an empty table gives empty results.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string")).toDF("lang", "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = _power(size // BYTES_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS)
    found, totals, full, parts = [], None, None, None
    for k in range(1, longest + 1):
        sent = [spark.sparkContext.broadcast(b) if b is not None else None for b in (full, parts)]
        rows = source.mapInArrow(_passed(k, longest, buckets, min_count, *sent), _ROWS)
        # a block of bucket counts travels as a key of its own, equal ones as one row
        rows = rows.groupBy("lang", "phrase", "h", "data").agg(F.sum("n").alias("n"))
        rows = common.store(rows.filter(F.col("phrase").isNull() | (F.col("n") >= min_count)), f"pass{k}")
        for b in sent:
            if b is not None:
                b.destroy()
        if k == 1:
            totals = rows.filter("phrase is null and data is null").select("lang", "n")
        frequent = rows.filter("phrase is not null")
        found.append(frequent.select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("f"), "h"))
        if k == longest or not frequent.take(1):
            break
        full, parts = _full_buckets(rows.filter("data is not null").select("h", "data", "n"), buckets, min_count), _bitmap(frequent)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # many passes' small files become few
    return common.store(out.drop("h").coalesce(max(1, out.count() // ROWS_A_FILE)), "frequent"), totals


def _slice(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


@common.settled
def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a is a phrase's frequency, l and r those of its parts at the cut that makes floor(1000 a n / (l r))
    least, of equal cuts the first; n counts the language's words. Phrases of which a longer one is as
    frequent are left out. Order: score and a descending, then the phrase by its bytes. Other columns
    are not read; see frequent_phrases() for odd rows.
    """
    f, totals = frequent_phrases(docs, text_col, lang_col, longest, min_count)
    words = F.split("phrase", " ", -1)
    whole = f.filter("k > 1").withColumnRenamed("f", "a").withColumn("words", words)
    # a phrase that is inside one some words longer and as frequent is inside one that is one word longer and as frequent
    longer = whole.filter("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(_slice(F.col("words"), 1, F.col("k") - 1), _slice(F.col("words"), 2, F.col("k") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = whole.join(longer, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a")
    cuts = kept.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _slice(F.col("words"), 1, F.col("cut")).alias("left"), _slice(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda side, n: f.select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    # exact to 38 digits; the quotient is at most 1000 n and so a long
    cuts = cuts.withColumn("u", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("v", exact("l") * exact("r")).withColumn("score", F.expr("u div v"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
