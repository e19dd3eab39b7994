"""Word shingles of whole texts as arrays: the set of hashed shingles of every text of a batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Words of a shingle.
WIDTH = 5
#: Bytes that are hashed at once; a longer text is taken alone.
STEP = 1 << 20
_rng = np.random.Generator(np.random.PCG64(5))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        up = np.full(size, _M, np.uint64)
        down = np.full(size, _M_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and where each text's begin (one more entry).

    data: UTF-8 bytes of the texts; offsets: where each begins, and the end. A-Z are lower-cased
    and words are runs of bytes other than ASCII white space, which is the same as by code points.
    A text with one to four words has one shingle, its whole sequence; one without words has none.
    """
    n_docs = len(offsets) - 1
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    firsts = np.zeros(len(data) + 2, bool)
    firsts[offsets[:-1] + 1] = True
    firsts[offsets[-1] + 1] = True
    here, before = inside[1:], inside[:-1]
    begin = np.flatnonzero(here[:-1] & (~before[:-1] | firsts[1:-1]))
    end = np.flatnonzero(before & (~here | firsts[1:]))
    # a word's hash: its bytes' random numbers, each times a power of its place in the word
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    word = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    owner = np.searchsorted(offsets, begin, "right") - 1
    words = np.bincount(owner, minlength=n_docs)[:n_docs]
    first = np.concatenate([[0], np.cumsum(words)])
    count = np.where(words >= WIDTH, words - WIDTH + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    hashes = np.empty(at[-1], np.uint64)
    long = np.flatnonzero(words >= WIDTH)
    if len(long):
        rolled = word[: len(word) - WIDTH + 1] * _PLACE[0]
        for k in range(1, WIDTH):
            rolled += word[k : len(word) - WIDTH + 1 + k] * _PLACE[k]
        start = np.repeat(first[long] - at[long], count[long]) + np.concatenate([np.arange(at[k], at[k + 1]) for k in long])
        hashes[np.concatenate([np.arange(at[k], at[k + 1]) for k in long])] = mixed(rolled[start])
    for k in np.flatnonzero((words > 0) & (words < WIDTH)):
        own = word[first[k] : first[k + 1]]
        hashes[at[k] : at[k] + 1] = mixed((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    for k in np.flatnonzero(count > 1):
        hashes[at[k] : at[k + 1]].sort()
    doc = np.repeat(np.arange(n_docs), count)
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n_docs))])


def batches_of(texts: pa.Array, step: int = STEP):
    """(first row, rows, bytes, offsets) of slices of a string column of about `step` bytes, without copies; null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = pa.compute.fill_null(texts, b"") if texts.null_count else texts
    if not len(texts):
        return
    _, ends, body = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + step, "right")) - 1)
        yield lo, hi - lo, body[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi
