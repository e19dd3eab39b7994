"""The fixed patterns and words against texts with known answers, in Spark's dialect and in DuckDB's."""

from __future__ import annotations

import duckdb
import pytest
from docketry import tables as T
from docketry.operators import trust
from pyspark.sql import functions as F

#: (pattern, text, group, what the first match gives; '' for none)
CASES = [
    ("sponsor", "by SPN-0042, of", 0, "SPN-0042"), ("sponsor", "SPN-42 SPN_1234", 0, ""), ("date", "on 2026-02-13.", 1, "2026-02-13"), ("date", "id 12026-02-133", 1, ""),
    ("visa", "x\nVisa: xw-2", 1, "xw-2"), ("visa", "VISA  CLASS = TRANSIT-7\n", 1, "TRANSIT-7"), ("visa", "my visa: XW-1", 1, ""), ("visa", "Visa Class: XW-3", 1, ""),
    ("name", "Applicant: Ana Vel", 1, "Ana Vel"), ("name", "full name\nBo Li\nx", 1, "Bo Li"), ("name", "The applicant: Ana", 1, ""), ("registry_name", "Registry Name: Q R", 1, "Q R"),
    ("attests", "Sponsor SPN-0001 attests that Ana Vel Om is", 1, "Ana Vel Om"), ("attests", "Sponsor [SPONSOR ID BLANK] attests that Ana O'Neil", 1, "Ana O'Neil"), ("attests", "Sponsor SPN-1 attests that Ana Vel", 1, ""),
    ("purpose", "Declared Purpose = cargo inspection", 1, "cargo inspection"), ("sponsor_purpose", "is expected on Earth for medical research .", 1, "medical research"),
    ("fee", "Fee: WAIVED", 1, "WAIVED"), ("fee", "Fee Status\nunpaid", 1, "unpaid"), ("fee", "Fee Status: paidup", 1, ""), ("amount", "Amount: $1,250.00", 1, "1,250.00"), ("amount", "amount 5", 1, ""),
    ("waiver", "Waiver Code: WV-7", 1, "WV-7"), ("flags", "Risk Flag: a, b", 1, "a, b"), ("flags", "Flags: none", 1, "none"), ("placeholder", " [NAME CUT OUT] ", 0, " [NAME CUT OUT] "), ("placeholder", "[a] b", 0, ""),
    ("finding", "finding: needs review", 1, "needs review"), ("finding", "Finding: NEEDS_REVIEW", 1, "NEEDS_REVIEW"), ("finding", "Finding: NEEDS  REVIEW", 1, ""), ("finding", "FINDING:DENIED", 1, "DENIED"),
    ("correction", "Manual correction: visa class is XW-1.", 2, "XW-1"), ("correction", "manual  correction: FEE  STATUS is paid\n", 1, "FEE  STATUS"), ("correction", "Manual correction: home is X", 1, ""),
    ("redaction", "a [SPONSOR ID] b", 0, "[SPONSOR ID]"), ("redaction", "REDACTED? x", 0, "REDACTED?"), ("redaction", "[Sponsor] redacted", 0, ""), ("token", "9 b-13_x!", 0, "b-13_x"), ("any_date", "x2026-01-02x", 0, "2026-01-02"),
    ("any_id", "MIB-77", 0, "MIB-77"), ("any_id", "SPN-1", 0, "SPN-1"), ("any_id", "ABC-1", 0, ""), ("full_name", "Ana Vel", 0, "Ana Vel"), ("full_name", "Ana vel", 0, ""), ("full_purpose", "medical research", 0, "medical research"),
    ("full_purpose", "Medical", 0, ""), ("ocr_denied", "Finding - rejected", 0, "Finding - reject"), ("ocr_denied", "FINDING—DENIE", 0, "FINDING—DENIE"), ("ocr_denied", "Finding: APPROVED", 0, ""), ("ocr_review", "finding.needs-review", 0, "finding.needs-review"),
    ("ocr_review", "Finding NEEDSREVIEW", 0, "Finding NEEDSREVIEW"), ("ocr_registry", "Damaged  registry evidence", 0, "Damaged  registry evidence"), ("ocr_policy", "visible policy notes", 0, "visible policy notes"),
    ("split_home", "Gliese-581 g", 2, "g"), ("split_home", "Mars Dome-7", 2, ""),
]
#: (text, level)
LEVELS = [
    ("Manual Adjudicator Note", 1), ("adjudicatnor note", 1), ("manual correction : x", 1), ("finding — NEEDS—REVIEW", 1), ("FORM I-8090", 2), ("form |8090", 2), ("Extraterrestrial  Work Authorization", 2), ("Blometric scan slip", 3),
    ("form b–13", 3), ("sponsor  attestation", 4), ("Planetary Registry Extract", 5), ("planetary registry", 6), ("forma 8090", 6),
]


def test_patterns_give_known_answers_in_both_dialects(spark):
    con = duckdb.connect()
    for name in {c[0] for c in CASES}:
        mine = [c for c in CASES if c[0] == name]
        for _, text, group, want in mine:
            assert con.execute(f"SELECT regexp_extract(?, ?, {group})", [text, T.P[name]]).fetchone()[0] == want, (name, text)
    rows = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CASES)], "k int, t string")
    pick = F.coalesce(*[F.when(F.col("k") == k, F.regexp_extract("t", T.P[name], group)) for k, (name, _, group, _) in enumerate(CASES)])
    got = {r["k"]: r["v"] for r in rows.select("k", pick.alias("v")).collect()}
    assert [got[k] for k in range(len(CASES))] == [c[3] for c in CASES]


def test_levels_of_known_texts(spark):
    rows = spark.createDataFrame(LEVELS, "t string, want int").withColumn("got", trust.authority(F.col("t")))
    assert not rows.filter("got <> want").collect()
    con = duckdb.connect()
    for text, want in LEVELS:
        hits = [k + 1 for k, p in enumerate(T.LEVELS) if con.execute("SELECT regexp_matches(?, ?)", [text, p]).fetchone()[0]]
        assert min(hits, default=6) == want, text


@pytest.mark.parametrize("word,known", [("applicant", True), ("i-8090", True), ("jovian_gasform", True), ("europa", True), ("7", True), ("warrant", True), ("xw-2", True), ("blorf", False), ("Applicant", False)])
def test_legible_words(word, known):
    assert (word in set(trust.domain_words())) is known
