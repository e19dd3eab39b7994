"""Best-fit packing by the linear grouping scheme.

Tokens are counted once; from then on the plan needs only how many pieces have each length, at
most `capacity` numbers however large the corpus is. Large lengths are sorted, dealt into groups
of equal cardinality and rounded up to their group's largest; few-size configurations for the
rounded lengths come from a linear program with column generation; the actual pieces are then
substituted, and small ones go best-fit into what is left. The plan is a list of runs: pieces of
one length with ranks [r, r + n) go to sequences [s, s + n) at one offset.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END, GROUPS, SMALL = 4096, 1, 24, 8
#: Entries of each of the two generations of a worker's word cache.
CACHE = 400_000
#: Letters of the longest word that is kept there: the cache is bounded by bytes too, whatever the texts hold.
KEPT = 64
#: Rows of one (length, bucket) that one task ranks, about.
RANKED = 50_000
#: Runs of a plan that are broadcast; a longer plan is read by a join.
BROADCAST_RUNS = 1_000_000

#: White space of the tokenizer; str.split() also splits at U+001C to U+001F.
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]").search
_worker: dict = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Token ids of white-space-free words, as little-endian 32-bit numbers; computed once for each word.

    The tokenizer drops white space, never joins across it, and no special token holds any, so a
    text's ids are those of its words, one after the other. Words of plain Latin letters, digits
    and signs are merged by tiktoken from the same vocabulary and merge order: the end of a word
    is one more byte, 0xFF, which UTF-8 never uses. All other words go to the tokenizer itself.
    """

    def __init__(self, path: str, size: int = CACHE):
        import json
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.size, self.old = Tokenizer.from_file(path), size, {}
        model = json.loads(self.tokenizer.to_str())["model"]
        byte = _bytes_of_symbols()
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(byte[c] for c in (token[: -len(suffix)] if end else token)) + b"\xff" * end

        # merge order: single bytes, then a word's last byte with its end, then the tokenizer's merges
        order = [bytes([k]) for k in range(256)] + [bytes([k, 255]) for k in range(256)]
        seen = set(order)
        for merge in model["merges"]:
            token = raw("".join(merge if isinstance(merge, list) else merge.split(" ")))
            if token not in seen:
                seen.add(token)
                order.append(token)
        ids = {raw(t): k for t, k in model["vocab"].items() if t in model["vocab"]}
        # a merge that is no token would encode to nothing known; it fails where a text needs it
        self.ids = [ids.get(t, -1) for t in order]
        ranks = {t: k for k, t in enumerate(order)}
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        letters = "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "L" and c != "\u0130")
        numbers = "".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == "N")
        # fixed values: the tokenizer's own rule for parts of a word, for code points under U+0180
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        self.plain = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]+").fullmatch

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            if self.plain(word) and "<|" not in word:
                rank, piece = self.ids, self.core.encode_single_piece
                out = array("I", [rank[r] for p in self.parts(word.lower()) for r in piece(p.encode() + b"\xff")]).tobytes()
            else:
                out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= KEPT:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        words = _SPACE.split(text) if _ODD(text) else text.split()
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, words))


def _bytes_of_symbols() -> dict[str, int]:
    """Which byte a symbol of a byte-level vocabulary stands for: printable ones for themselves, the rest counted from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _words(path: str) -> Words:
    if path not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _worker[path] = Words(path)
    return _worker[path]


def _pieces(path: str, capacity: int):
    tail = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(docs), 64):
                rows = []
                for doc, text in zip(docs[lo : lo + 64], texts.slice(lo, 64).to_pylist(), strict=True):
                    raw = words.encode(text or "") + tail
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(ids) // 4, zlib.crc32(ids)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(items of each size, how often) of the linear program's basis, rounded down: few bins cover the counts but for leftovers."""
    n = len(sizes)
    pats = [np.eye(n)[k] * (capacity // sizes[k]) for k in range(n)]
    basis, need = np.array(pats).T, np.array(counts, float)
    for _ in range(60 * n):
        try:
            inverse = np.linalg.inv(basis)
        except np.linalg.LinAlgError:
            # a degenerate basis: one size a bin is a plan too, only with more left over
            basis = np.array(pats).T
            break
        x, price = inverse @ need, np.ones(n) @ inverse
        best, how = np.zeros(capacity + 1), np.zeros((n, capacity + 1), np.int16)
        for k, size in enumerate(sizes):
            base = best.copy()
            for m in range(1, capacity // size + 1):
                value = base[: capacity + 1 - m * size] + m * price[k]
                better = value > best[m * size :] + 1e-12
                best[m * size :][better] = value[better]
                how[k, m * size :][better] = m
        if best[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(n), capacity
        for k in range(n - 1, -1, -1):
            column[k] = how[k, room]
            room -= int(column[k]) * sizes[k]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.inv(basis) @ need
    return [(tuple(int(v) for v in basis[:, k]), int(x[k] + 1e-9)) for k in range(n) if x[k] >= 1 - 1e-9]


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Runs (length, rank, n, sequence, offset), sorted, and how many sequences they take. hist: pieces of each length."""
    runs, used = [], 0
    if n := hist.get(capacity, 0):
        runs.append((capacity, 0, n, 0, 0))
        used = n
    # the pieces of each length that are not placed yet: ranks [taken, hist)
    taken = dict.fromkeys(hist, 0)
    large = sorted((s for s in hist if capacity // small < s < capacity), reverse=True)
    total = sum(hist[s] for s in large)
    open_bins: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [first, end) of bins
    if total:
        # groups of equal cardinality; a length may be in two
        per, members, at = -(-total // groups), [], 0
        for s in large:
            left, rank = hist[s], 0
            while left:
                if at // per >= len(members):
                    members.append([])
                n = min(left, per - at % per)
                members[-1].append([s, rank, n])
                at, rank, left = at + n, rank + n, left - n
        found = configurations([m[0][0] for m in members], [sum(x[2] for x in m) for m in members], capacity)
        queue = [list(m) for m in members]
        for items, often in sorted(found, reverse=True):
            slots, first = [g for g, k in enumerate(items) for _ in range(k)], used
            avail = [sum(x[2] for x in q) for q in queue]
            often = min([often, *(avail[g] // items[g] for g in set(slots))])
            used += often
            # each slot draws `often` actual pieces of its group, as runs of one length
            drawn = []
            for g in slots:
                want, own = often, []
                while want:
                    s, rank, n = queue[g][0]
                    k = min(n, want)
                    own.append((s, rank, k))
                    want -= k
                    if k == n:
                        queue[g].pop(0)
                    else:
                        queue[g][0] = [s, rank + k, n - k]
                drawn.append(own)
            # cut the bins where any slot changes its length
            ends = sorted({e for own in drawn for e in np.cumsum([k for _, _, k in own]).tolist()})
            at, where = 0, [[0, 0] for _ in drawn]
            for end in ends:
                offset = 0
                for own, w in zip(drawn, where, strict=True):
                    s, rank, k = own[w[0]]
                    runs.append((s, rank + w[1], end - at, first + at, offset))
                    offset += s
                    w[1] += end - at
                    if w[1] == k:
                        w[0], w[1] = w[0] + 1, 0
                open_bins[capacity - offset].append((first + at, first + end))
                at = end
        rest = [tuple(x) for q in queue for x in q]
    else:
        rest = []
    rest += [(s, 0, hist[s]) for s in hist if s <= capacity // small]
    rooms = sorted(open_bins)

    def put(lo: int, hi: int, room: int) -> None:
        if room not in open_bins:
            bisect.insort(rooms, room)
        own = open_bins[room]
        if own and own[-1][1] == lo:
            own[-1] = (own[-1][0], hi)
        else:
            own.append((lo, hi))

    for s, rank, n in sorted(rest, reverse=True):
        while n:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                # no bin has room: open bins, each to be filled by further turns
                more = -(-n // (capacity // s))
                put(used, used + more, capacity)
                used += more
                continue
            room = rooms[k]
            lo, hi = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(k)
            m = min(n, hi - lo)
            runs.append((s, rank, m, lo, capacity - room))
            if m < hi - lo:
                put(lo + m, hi, room)
            put(lo, lo + m, room - s)
            rank, n = rank + m, n - m
    out = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return out, used


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        key = runs[:, 0] << 44 | runs[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = runs[np.searchsorted(key, length << 44 | rank, "right") - 1]
            cols = [batch.column(k) for k in range(5)]
            cols += [pa.array(r[:, 3] + rank - r[:, 1]), pa.array(r[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


@common.settled
def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str | None = None) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are its text's (null: empty) and then id 1, so every row has a piece. Only rows
    over `capacity` ids are cut, into full pieces and a rest. Pieces of a sequence lie one after
    the other from offset 0. An empty table gives an empty result; rows that repeat an id are
    packed like any others.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(vocab or vocabulary(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = common.store(pieces, "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not hist:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    runs, _ = plan(hist, capacity)
    # A length's pieces are ranked by (bucket, order in the bucket), so a length that many share is ranked by many tasks.
    many = common.buckets(sum(hist.values()), RANKED) * 2
    b = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(many)).cast("int"))
    counts = b.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = b.withColumn("own", own).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))
    if len(runs) <= BROADCAST_RUNS:
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
        return ranked.mapInArrow(_place(spark.sparkContext.broadcast(runs)), schema)
    # the same by a join: each run and each piece carry the run's number, found by an as-of window over both
    p = spark.createDataFrame([tuple(map(int, r)) for r in runs], "length long, rank long, n long, seq long, off long")
    p = p.withColumn("slab", F.explode(F.sequence(F.shiftright("rank", 10), F.shiftright(F.col("rank") + F.col("n") - 1, 10))))
    r = ranked.withColumn("slab", F.shiftright("rank", 10)).alias("r")
    p = p.alias("p")
    hit = (F.col("r.length") == F.col("p.length")) & (F.col("r.slab") == F.col("p.slab"))
    hit &= (F.col("r.rank") >= F.col("p.rank")) & (F.col("r.rank") < F.col("p.rank") + F.col("n"))
    return r.join(p, hit).select(
        "r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32",
        (F.col("seq") + F.col("r.rank") - F.col("p.rank")).alias("sequence_id"), F.col("off").alias("offset"),
    )
