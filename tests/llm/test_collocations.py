"""op12: phrases against plain counting, windows of long texts, full buckets, odd rows."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from docketry.llm import op12_collocations as op

DOC = "doc_id long, text string, lang string, rank long, phrase string, k string, f string, h string, n string, a string, data string"


def counts(docs, longest=5):
    out = collections.Counter()
    for text, lang in docs:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    out[lang or "und", " ".join(ws[i : i + k])] += 1
    return out


def plain(docs, longest=5, min_count=100, top=2000):
    f = counts(docs, longest)
    n = collections.Counter()
    for (lang, p), c in f.items():
        n[lang] += c if " " not in p else 0
    cands = {key: c for key, c in f.items() if " " in key[1] and c >= min_count}
    inside = collections.defaultdict(int)
    for (lang, p), c in cands.items():
        ws = p.split(" ")
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                sub = (lang, " ".join(ws[i : i + k]))
                inside[sub] = max(inside[sub], c)
    rows = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        ws = p.split(" ")
        cuts = [(f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]) for k in range(1, len(ws))]
        score, _, l, r = min((1000 * a * n[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        rows[lang].append((-score, -a, p.encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, some in rows.items() for rank, (s, a, p, l, r) in enumerate(sorted(some)[:top], 1))


def mined(df, **options):
    return sorted(tuple(r) for r in op.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def frame(spark, docs):
    return spark.createDataFrame([(k, *d, *(0 if c.endswith("long") else "x" for c in DOC.split(", ")[3:])) for k, d in enumerate(docs)], DOC)


@pytest.mark.parametrize("min_count,top", [(2, 2000), (5, 7), (300, 50)])
def test_phrases_against_counting(spark, min_count, top):
    rng = random.Random(min_count)
    vocab = [f"w{k}" for k in range(12)] + ["É", "É𝄞", "A", "a", "B c", "\x00"]
    docs = [("".join(rng.choice(vocab) + rng.choice([" ", " ", " ", " ", "\t ", ", ", ".", "\n"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "en", "de", None])) for _ in range(120)]
    docs += [("One more Thing to say " * 40, "en")] * 9 + [(None, "en"), ("", "fr"), (" \t.,", None), ("alone", "xx")]
    got = mined(frame(spark, docs).repartition(3), min_count=min_count, top=top)
    assert got == plain(docs, min_count=min_count, top=top)
    assert got


def test_long_text_hot_phrase_and_no_rows(spark):
    docs = [("a a b " * 200_000, "en"), (" " * 300_000 + "x", "en"), ("." * 100_000 + "x y " * 150, None), ("z" * 500_000 + " q", "de")]
    assert mined(frame(spark, docs)) == plain(docs)
    assert mined(frame(spark, [])) == []


def test_windows_count_each_phrase_once():
    rng = random.Random(3)
    text = "".join(rng.choice(["aa", "b", "cé", "d" * 30]) + rng.choice([" ", "  ", ". ", "\t"]) for _ in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array([text, None, "x " + text])], ["lang", "text"])
    want = counts([(text, "en"), ("x " + text, "en")])
    got = collections.Counter()
    n = 0
    for words in op._chunks(iter([batch]), 5, chunk=300):
        n += 1
        for k in range(1, 6):
            for rows in words.counted(np.flatnonzero(words.whole(k) & words.begins), k):
                for lang, phrase, c in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist(), rows["n"].to_pylist(), strict=True):
                    got[lang, phrase] += c
    assert n > 100 and got == want


def test_equal_phrases_have_equal_hashes():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b c a b c", "a b c"])], ["lang", "text"])
    other = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["zz a b c"])], ["lang", "text"])
    (x,), (y,) = op._chunks(iter([batch]), 5), op._chunks(iter([other]), 5)
    h, g = x.hashes(3), y.hashes(3)
    assert h[0] == h[3] == g[1] and h[0] != h[6] and len(set(h[:3])) == 3


@pytest.mark.parametrize("top", [100, 1000])
def test_buckets_add_up_over_many_tasks(spark, top, monkeypatch):
    monkeypatch.setattr(op, "FAN", 64)
    kind = np.uint8 if top <= 255 else np.uint32
    rng = np.random.default_rng(1)
    rows, total = [], np.zeros((2, op.BLOCK), np.int64)
    for _ in range(op.FAN * 3):
        part = rng.integers(0, 3, op.BLOCK).astype(kind)
        part[0] = 0
        block, n = int(rng.integers(0, 2)), int(rng.integers(1, 3))
        rows.append((block, bytearray(part.tobytes()), n))
        total[block] += part.astype(np.int64) * n
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["h", "data", "n"]), "h long, data binary, n long")
    bits = np.frombuffer(op._full_buckets(df, 2 * op.BLOCK, top), np.uint8)
    assert (np.unpackbits(bits, bitorder="little").astype(bool) == (total >= top).ravel()).all()


def test_bitmap_of_frequent_phrases(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000)
    bits = np.frombuffer(op._bitmap(spark.createDataFrame(pd.DataFrame({"h": h}), "h long")), np.uint8)
    assert op._bit(bits, h.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    assert op._bit(bits, others.view(np.uint64)).mean() < 0.15
