"""op10's word cache: long words aren't kept, and their ids are those of the tokenizer."""

from __future__ import annotations

import tracemalloc

import numpy as np
from docketry.llm import op10_packing as op


def test_long_words_do_not_fill_the_cache():
    words = op.Words(op.vocabulary())
    words.encode("warm up")
    tracemalloc.start()
    for k in range(300):
        assert len(words.encode(f"{k:05d}" + "ab" * 20_000 + f" w{k}")) > 0
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 20 << 20 and max(map(len, words)) <= op.KEPT and "w7" in words


def test_words_around_the_bound_have_the_tokenizers_ids():
    words = op.Words(op.vocabulary())
    for n in (1, op.KEPT - 1, op.KEPT, op.KEPT + 1, 500):
        for word in ("a" * n, "é1" * n, "漢" * n):
            text = f"{word} x {word}"
            want = words.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(words.encode(text), "<u4").tolist() == want
            assert np.frombuffer(words.encode(text), "<u4").tolist() == want
