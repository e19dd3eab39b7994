"""Near copies among documents that share a template and are nearly as alike as linked pairs are."""

import random

import pytest

from docketry.llm import op06_minhash


def _words(r, k):
    return ["w%x" % r.getrandbits(40) for _ in range(k)]


@pytest.mark.parametrize("n, shared", [(1000, 340), (2000, 341)])
def test_planted_pairs_among_a_template(spark, n, shared):
    # any two share a template (similarity 0.737 or 0.741), a planted pair five words more
    r = random.Random(n)
    template, docs = _words(r, shared), []
    for k in range(0, n, 2):
        both = template + _words(r, 5)
        docs += [(k + j, " ".join(both + _words(r, 395 - shared))) for j in (0, 1)]
    r.shuffle(docs)
    got = {x.doc_id: x.component_id for x in op06_minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(n)}


def test_template_alone_links_the_smallest(spark):
    # sets of s and t shingles share the template's 296 alone: linked if 100 * 296 >= 75 * (s + t - 296)
    r = random.Random(5)
    template = _words(r, 300)
    more = {k: 60 + k % 60 for k in range(700)} | {5000: 45, 5001: 30}
    docs = [(k, " ".join(template + _words(r, m))) for k, m in more.items()]
    got = {x.doc_id: x.component_id for x in op06_minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    # whoever is linked with any is linked with the smallest, 5001
    linked = {k for k, m in more.items() if k == 5001 or 100 * 296 >= 75 * (296 + m + 296 + 30 - 296)}
    assert len(linked) > 1
    assert got == {k: min(linked) if k in linked else k for k in more}


def test_pairs_that_share_only_frequent_shingles(spark, monkeypatch):
    # documents of 18 of 24 passages, kept apart by a word of their own: no shingle of two documents is rare, and who
    # shares 17 passages (1122 shingles of 1278 each) is linked, who shares 16 (1056) isn't
    monkeypatch.setattr(op06_minhash, "NODE", 8)
    r = random.Random(1)
    passages, taken = [_words(r, 70) for _ in range(24)], []
    for _ in range(150):
        own = r.sample(range(24), 18)
        taken += [set(own), {*own[1:], r.choice([k for k in range(24) if k not in own])}]
    docs = [(k, " ".join(w for p in sorted(t) for w in [*passages[p], *_words(r, 1)])) for k, t in enumerate(taken)]
    want = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if len(taken[x] & taken[y]) >= 17 and want[x] != want[y]:
                low, high = sorted((want[x], want[y]))
                want = [low if k == high else k for k in want]
    r.shuffle(docs)
    got = {x.doc_id: x.component_id for x in op06_minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))
