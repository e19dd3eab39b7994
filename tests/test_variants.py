"""Other ways to the same or to a stated different answer: the whole sweep for misread labels, an older grader, reading approved cases only, dates without a form."""

from __future__ import annotations

import datetime
import difflib
import random
import re

from docketry import tables as T
from docketry.functions import text as X
from docketry.operators import resolve
from docketry.sources import ocr
from pyspark.sql import functions as F


def sweep(text, label, values=None, least=0.72):
    """Every window two shorter to two longer than the label, compared in full: no prescreen."""
    low, want = text.lower(), label.lower()
    best, end = 0.0, -1
    for size in range(max(3, len(want) - 2), len(want) + 3):
        for k in range(len(low) - size + 1):
            ratio = difflib.SequenceMatcher(None, low[k : k + size], want).ratio()
            if ratio > best:
                best, end = ratio, k + size
    if best < least:
        return ""
    value = re.match(T.P["after_label"], text[end : end + 80])
    found = value[1].strip() if value else ""
    if values is None or not found:
        return found
    for v in values:
        if v.lower() in found.lower():
            return v
    likeness = [difflib.SequenceMatcher(None, found.lower(), v.lower()).ratio() for v in values]
    return values[likeness.index(max(likeness))] if max(likeness) >= least else ""


def test_misread_labels_as_by_the_whole_sweep():
    rng = random.Random(8)
    garble = lambda t: "".join(rng.choice("l1I0O5S~ ") if rng.random() < 0.12 else c for c in t)
    for key, label, values in resolve.fuzzy_labels():
        texts = []
        for _ in range(12):
            lines = [garble(f"{name}: {rng.choice(T.VISAS + T.HOMES)}") for _, name, _ in rng.sample(resolve.FUZZY_LABELS, 3)]
            texts.append(rng.choice(["\n", " "]).join([garble(f"{label}: {(values or ['Ana Vel'])[0]}") if rng.random() < 0.7 else "Scan OK", *lines]))
        texts += ["", label, label.upper() + "\n" + (values or ["x"])[-1], "qq"]
        want = [sweep(t, label, values) for t in texts]
        assert resolve.label_search_all(texts, label, values) == want, key
        assert [resolve.label_search(t, label, values) for t in texts] == want


def test_the_older_grader_differs_where_it_is_said_to(spark):
    """Plain substrings, a review finding after flags, sponsors and homes, every stem a review of 0.65, and no phrases of reasons."""

    def older(text):
        low, up = text.lower(), text.upper()
        if re.search(T.P["ocr_denied"], text):
            return "DENIED", 0.95
        if any(f in low for f in T.DISQUALIFYING) or any(s in text for s in T.REVOKED) or any(h.lower() in low for h in T.HARD_EMBARGO):
            return "DENIED", 0.90
        if re.search(T.P["ocr_review"], text):
            return "NEEDS_REVIEW", 0.85
        if any(f in low for f in T.REVIEW_ONLY):
            return "NEEDS_REVIEW", 0.85
        return ("NEEDS_REVIEW", 0.65) if any(s in up for s in T.DENY_STEMS + T.REVIEW_STEMS) else None

    same = ["Finding: DENIED", "active_warrant here", "by SPN-0007", "on Eris Relay", "Finding: NEEDS REVIEW", "identity_conflict", "REVOKED", "", "nothing"]
    # what the older one says there, and what the grader says now
    other = [("Finding: NEEDS REVIEW, active_warrant", ("DENIED", 0.90), ("NEEDS_REVIEW", 0.85)), ("BIOHAZ", ("NEEDS_REVIEW", 0.65), ("DENIED", 0.85)), ("damaged registry evidence", None, ("DENIED", 0.92)), ("active warrant", None, ("DENIED", 0.90))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(same + [t for t, *_ in other])], "k int, t string").withColumn("g", X.ocr_grade(F.col("t")))
    now = {r.k: (r.g.adj, r.g.conf) if r.g else None for r in rows.collect()}
    assert [now[k] for k in range(len(same))] == [older(t) for t in same]
    for k, (text, before, after) in enumerate(other, len(same)):
        assert older(text) == before and now[k] == after, text


def test_only_approved_cases_are_read_when_filtered_first(spark):
    """A veto that reads images of approved cases alone: the filter is below the engine, so it sees no others."""
    asked = spark.sparkContext.accumulator(0)

    def engine(image, psm, flags):
        asked.add(1)
        return "Finding: DENIED", "ok"

    case = [(f"C{k}", "image_0", "IMAGE", bytes([k]) * 10, 200, 200, "APPROVED" if k % 4 == 0 else "DENIED") for k in range(20)]
    rows = spark.createDataFrame(case, "case_id string, source_id string, kind string, raw binary, width int, height int, adjudication string")
    read = ocr.recognize(ocr.with_passes(rows.filter("adjudication = 'APPROVED'")), engine).collect()
    assert len(read) == 5 and asked.value == 10  # two passes an image


def test_dates_need_their_form(spark):
    """20260527 is a date to a reader of any ISO form, and none here."""
    texts = ["2026-05-27", "20260527", "2026-W22-3", "2026-5-27", "2026-02-30", "0000-01-01"]
    loose = []
    for t in texts:
        try:
            loose.append(bool(datetime.date.fromisoformat(t)))
        except ValueError:
            loose.append(False)
    assert loose == [True, True, True, False, False, False]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.real_date(F.col("t")).isNotNull().alias("ok")).orderBy("k")
    assert [r.ok for r in rows.collect()] == [True, False, False, False, False, False]
