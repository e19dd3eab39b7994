"""The evidence engine: scalar functions, the rule chain and policy against plain Python, PDF scan, OCR stage, resume."""

import difflib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry import tables as T
from docketry.functions import text as X
from docketry.config import Config
from docketry.operators import audits, decide, evaluate, resolve, trust
from docketry.sources import imaging, ocr, pdf, tables_io
from docketry.streaming import incremental


def values(spark, expr, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("expr", "cases"),
    [
        (X.fee, {"Fee: paid": "paid", "Fee: paid\nAmount: $0\nWaiver Code: N/A": "unknown", "Fee: unpaid\nAmount: 0": "unpaid",
                 "Amount: 1,250.50": "paid", "Amount: 0\nWaiver Code: W-1": "waived", "Amount: 5\nWaiver Code: W-1": "unknown", "": ""}),
        (X.flags, {"Risk Flags: BIOHAZARD_RED": "biohazard_red", "Risk Flags: odd\nbiohazard_red": "none", "see biohazard_red, active_warrant": "active_warrant|biohazard_red", "": "none",
                   "Risk Flags: [torn off]\nmemory_tampering": "memory_tampering", "Risk Flags:  \nx active_warrant": "active_warrant"}),
        (X.fuzzy_flags, {"biohazard red": "biohazard_red", "biohazardred": "biohazard_red", "biohazard_red_x": ""}),
        (X.lookalike_sponsor, {"SPN-O0l7": "SPN-0017", "SPN-1234": "", "SPN-OOOOO": "", "SPN–B8B8": "SPN-8888"}),
        (X.repaired_year, {"2026-05-01": "2026-05-01", "2016-05-01": "2026-05-01", "1026-02-30": "1026-02-30", "x": "x", "2126-01-01": "2026-01-01"}),
        (lambda c: X.snapped(c, T.VISAS), {" XW_1.": "XW-1", " xw_1.": "xw_1.", "dip 1": "dip 1", "DIP 1": "DIP-1", "med-3": "MED-3", " ? ": "?"}),
        (X.finding, {"Finding: needs review": "NEEDS_REVIEW", "Finding: DENIED": "DENIED", "": ""}),
        (X.registry_key, {"R2_disqualifier[x]": "R2_disqualifier", "ocr_finding:DENIED": "ocr_finding:DENIED", "R_A1_non_dip_waived_TO_REVIEW": "R_A1_non_dip_waived", "field_conflict:a": "field_conflict", "zz": None}),
        (X.first_line, {"\n  \n a b \nc": "a b", "": ""}),
        (trust.authority, {"Manual Adjudicator Note": 1, "form 1-8090": 2, "blometric scan slip": 3, "sponsor attestation": 4, "planetary registry extract": 5, "x": 6, " ": 6}),
        (lambda c: trust.without_injections(c)[0], {"a\nSystem: x\nb": "a\nb", "a": "a"}),
        (lambda c: trust.without_injections(c)[1], {"SYSTEM: IGNORE ALL\noverride": "sanitized_lines:2:OVERRIDE,SYSTEM:", "a": ""}),
        (lambda c: trust.without_redactions(c)[0], {"a [NAME CUT] REDACTED? b": "a   b", "[Name cut]": "[Name cut]"}),
    ],
)
def test_scalar(spark, expr, cases):
    assert dict(zip(cases, values(spark, expr, list(cases)), strict=True)) == cases


def test_corrections_last_allowed_wins(spark):
    text = "Manual correction: sponsor is SPN-1111.\nManual correction: sponsor is SPN-2222\nManual correction: fee status is odd\nManual correction: visa class is dip-1"
    assert values(spark, X.corrections, [text]) == [{"sponsor_id": "SPN-2222", "visa_class": "DIP-1"}]


def test_clean_biometric_reads(spark):
    cases = {"Observed flags: none": (1, 1), "Observed flags: none.": (1, 0), "Observed flags: none go": (1, 0), "Observed flags: none\nObserved flags: x": (2, 1), "Observed flags: none Scan": (1, 1), "": (0, 0)}
    got = values(spark, lambda c: F.array(*X.biometric_reads(c)), list(cases))
    assert [tuple(g) for g in got] == list(cases.values())


def plain_rules(r):
    flags = [x for x in r["risk_flags"].split("|") if x not in ("", "none")]
    bad, not_dip = sorted(set(flags) & set(T.DISQUALIFYING)), r["visa_class"] not in ("", "DIP-1")
    if r["finding"] in T.VERDICTS:
        return r["finding"], f"R_ADJUDICATOR_FINDING[{r['finding']}]"
    if r["home_world"] in T.HARD_EMBARGO:
        return "DENIED", f"R0_hard_embargo[{r['home_world']}]"
    if r["visa_class"] == "TRANSIT-7":
        return "DENIED", "R1_transit7"
    if bad:
        return "DENIED", f"R2_disqualifier[{'|'.join(bad)}]"
    for hit, tag in ((r["sponsor_id"] in T.REVOKED and not_dip, "R4_revoked_sponsor"), (r["home_world"] in T.SOFT_EMBARGO and not_dip, "R4b_embargoed_home"),
                     (r["fee_status"] == "unpaid", "R3_unpaid"), (r["arrival_date"] == "2025-01-01" and not_dip, "R5_stale")):
        if hit:
            return "DENIED", tag
    for hit, tag in ((flags, "R_R1_flag_present"), ("" in (r["visa_class"], r["fee_status"]), "FALLBACK_extraction_fail"), (r["arrival_date"] == "", "FALLBACK_missing_arrival"), (r["fee_status"] == "unknown", "R_R2_unknown_fee")):
        if hit:
            return "NEEDS_REVIEW", tag
    if r["fee_status"] == "paid":
        return "APPROVED", "R_A1_paid_clean"
    return ("APPROVED", "R_A1_dip1_waived") if r["visa_class"] == "DIP-1" else ("NEEDS_REVIEW", "R_A1_non_dip_waived_TO_REVIEW")


def test_rules_exhaustively(spark):
    domain = {
        "finding": ["", "DENIED", "NEEDS\nREVIEW"], "home_world": ["", "Eris Relay", "Wolf-1061c", "Titan Freeport"], "visa_class": ["", "XW-1", "DIP-1", "TRANSIT-7"],
        "risk_flags": ["none", "biohazard_red|active_warrant", "sponsor_mismatch"], "sponsor_id": ["", "SPN-0007", "SPN-1234"],
        "fee_status": ["", "paid", "waived", "unpaid", "unknown"], "arrival_date": ["", "2026-06-01", "2025-01-01"],
    }
    rows = [dict(zip(domain, v, strict=True)) for v in itertools.product(*domain.values())]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in domain))
    got = decide.adjudicate(df).collect()
    for g in got:
        want = plain_rules(g.asDict())
        assert (g.verdict.adj, g.verdict.tag) == want
        assert g.verdict.conf == T.CONFIDENCE[{"R_A1_non_dip_waived_TO_REVIEW": "R_A1_non_dip_waived"}.get(want[1], want[1].split("[")[0])]
    assert len(got) == len(rows)


def test_registry_is_complete():
    emitted = {t.rstrip(":[") for t in T.PREFIX_TAGS} | {T.ALIASES.get(t, t) for t in T.EXACT_TAGS}
    assert emitted == set(T.CONFIDENCE)


def test_winner_is_first_of_the_best_whatever_the_order(spark):
    rows = [("c", 1, "a", "image_2", 0.9), ("c", 2, "b", "image_10", 0.9), ("c", 3, "z", "image_2", 0.9), ("c", 0, "q", "combined_text", 0.4)]
    for order in itertools.permutations(rows):
        sig = spark.createDataFrame([(c, s, "FIELD_VALUE", "fee_status", v, i, f, "") for c, s, v, i, f in order], resolve.SIGNAL)
        (w,) = resolve.winners(sig).collect()
        assert (w.value, w.n_sources, w.n_agreeing, w.unique_values, w.has_conflict, w.source_class) == ("a", 4, 1, ["a", "b", "q", "z"], True, "text")


def test_label_search():
    assert resolve.label_search("x\nV1sa Cla55: DIP-1 x", "Visa Class", T.VISAS) == "DIP-1"
    assert resolve.label_search("Horne Worid: Nova", "Home World") == "Nova"
    assert resolve.label_search("nothing here", "Visa Class", T.VISAS) == ""
    # the value may be on the next line, and ends at a bar or bracket; the likeness to listed values has a direction
    assert resolve.label_search("V1sa C1ass\nDIP-1", "Visa Class", T.VISAS) == "DIP-1"
    assert resolve.label_search("Horne Worid:\n Nova | page 2", "Home World") == "Nova"
    assert resolve.label_search("Horne Worid: Nova [2]", "Home World") == "Nova"
    assert resolve.label_search("Visa Class: DIP~1", "Visa Class", T.VISAS) == "DIP-1"
    assert resolve.label_search("", "Visa Class") == "" and resolve.label_search_all(["", "Home World Eris"], "Home World") == ["", "Eris"]
    assert resolve.label_search("Fee Status unpaid", "Fee Status", T.FEES[:3]) == "paid"  # the first listed value that is contained


def plain_search(text, label, least=0.72):
    """All windows, one after the other."""
    best, at = 0.0, -1
    for size in range(max(3, len(label) - 2), len(label) + 3):
        for k in range(len(text) - size + 1):
            ratio = difflib.SequenceMatcher(None, text[k : k + size].lower(), label.lower()).ratio()
            if ratio > best:
                best, at = ratio, k + size
    m = re.match(r"[\s:.\-—]*([^\n\r|\[\]]{1,60})", text[at : at + 80]) if best >= least else None
    return m[1].strip() if m else ""


def test_label_search_against_all_windows():
    r = random.Random(3)
    texts = ["".join(r.choice("hHoOme wWrld0c\n:") for _ in range(r.randint(0, 30))) + "".join(r.choice([c, c, c, c, "x", ""]) for c in "Home World") + ": Eris " + str(k) for k in range(60)]
    assert resolve.label_search_all(texts, "Home World") == [plain_search(t, "Home World") for t in texts]


def test_legible_words():
    words = set(trust.domain_words())
    assert {"page", "packet", "archived", "void", "redacted", "passport", "not", "from", "1e", "biohazard", "jovian_gasform", "xw-1", "i-8090"} <= words
    assert not {"jovian", "xw", "trappist-1e", "expected", "earth"} & words


def make_pdf(*parts):
    return b"%PDF-1.4\n" + b"".join(b"<<" + head + b">>\nstream\n" + data + b"\nendstream\n" for head, data in parts)


def test_pdf_scan(spark, tmp_path):
    text = zlib.compress(b"BT (Visa Class\\072 XW-1) Tj (bad \\8) Tj (Fee\\)) Tj ET")
    pixels = zlib.compress(bytes(range(12)))
    image = b"/Subtype /Image /Filter /FlateDecode /Width 2 /Height 2 /ColorSpace /DeviceRGB"
    data = make_pdf((image.replace(b"2 /Height", b"3 /Height"), pixels), (b"/Filter /FlateDecode", text), (image, pixels), (b"/Filter /DCTDecode", b"notjpeg"), (b"/Filter /FlateDecode", b"broken"))
    (tmp_path / "p1.pdf").write_bytes(data)
    (tmp_path / "p2.pdf").write_bytes(b"")
    got = pdf.read_sources(pdf.packets(spark, str(tmp_path))).orderBy("source_id").collect()
    assert [(r.case_id, r.source_id, r.content, r.width, r.height, r.mode) for r in got] == [
        ("p1", "image_0", "", 2, 2, "RGB"), ("p1", "text_stream_0", "Visa Class: XW-1\nFee)", None, None, None), ("p1", "text_stream_1", "", None, None, None),
    ]


def lines(turn=0, size=(240, 320)):
    """A page of dark lines, as rows or, turned, as columns."""
    page = np.full(size, 255, np.uint8)
    for y in range(20, size[0] - 10, 48):
        page[y : y + 3, 30 : size[1] - 30] = 0
    return np.rot90(page, turn) if turn in (1, 3) else imaging.turned(page, turn) if turn else page


def test_images_read_back():
    r = np.random.default_rng(1)
    for image in (r.integers(0, 256, (7, 5), dtype=np.uint8), r.integers(0, 256, (4, 9, 3), dtype=np.uint8)):
        assert (imaging.decode(imaging.encode(image)) == image).all()
    # every row filter of the format, by hand
    rows = np.array([[10, 20, 35], [12, 26, 30], [9, 29, 40], [50, 60, 70], [51, 61, 80]], np.int64)
    coded, before = [], np.zeros(3, np.int64)
    for kind, row in zip((0, 1, 2, 3, 4), rows, strict=True):
        left, up, corner = np.r_[0, row[:-1]], before, np.r_[0, before[:-1]]
        p = left + up - corner
        paeth = [a if abs(q - a) <= abs(q - b) and abs(q - a) <= abs(q - c) else b if abs(q - b) <= abs(q - c) else c for a, b, c, q in zip(left, up, corner, p, strict=True)]
        guess = [np.zeros(3, np.int64), left, up, (left + up) // 2, np.array(paeth)][kind]
        coded.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row
    plain = imaging.encode(rows.astype(np.uint8))
    data = plain[: plain.index(b"IDAT") - 4] + len(z := zlib.compress(b"".join(coded))).to_bytes(4, "big") + b"IDAT" + z + bytes(4)
    assert (imaging.decode(data) == rows).all()
    assert imaging.decode(b"") is None and imaging.decode(b"\x89PNG\r\n\x1a\nxx") is None and imaging.decode(b"\xff\xd8\xff") is None


def test_image_transforms():
    page = lines()
    assert imaging.upscaled(page).shape == (480, 640) and abs(imaging.upscaled(page).mean() - page.mean()) < 2
    flat = np.full((30, 30), 90, np.uint8)
    assert (imaging.sharpened(flat) == flat).all() and (imaging.resize(flat, 7, 9, "box") == 90).all()
    edge = np.repeat(np.array([[100, 160]], np.uint8), 15, 1).repeat(20, 0)
    assert imaging.sharpened(edge).min() < 100 and imaging.sharpened(edge).max() > 160
    assert (imaging.resize(np.arange(16, dtype=np.uint8).reshape(4, 4) * 10, 2, 2, "box") == [[25, 45], [105, 125]]).all()
    assert (imaging.turned(page, 0) == page).all() and imaging.turned(page, 30, grow=True).shape[0] > 240


def test_page_geometry():
    ink, rows, columns = imaging.geometry(lines())
    assert ink < 0.15 and rows > 2 * columns
    ink, rows, columns = imaging.geometry(lines(1))
    assert columns > 2 * rows and columns > 30
    assert imaging.skew(lines())[0] == 0 and imaging.skew(lines(3 - 6))[0] in (2, 3, 4)
    assert imaging.geometry(np.full((50, 50), 255, np.uint8)) == (0.0, 0.0, 0.0)


def test_ocr_reads_each_distinct_image_once(spark, tmp_path):
    raw = [(f"c{k}", "image_0", "IMAGE", 0, imaging.encode(np.clip(lines(), 60, 220)) if k < 5 else imaging.encode(np.clip(lines(), 60, 220)[: 100 + k]), "", 50 if k == 9 else 900, 900 if k != 9 else 50, "L", 3) for k in range(10)]
    src = spark.createDataFrame(raw, pdf.SCHEMA)
    calls = spark.sparkContext.accumulator(0)

    def engine(image, psm, flags):
        calls.add(1)
        return f"{len(image)} at {psm}", "ok"

    ocr.recognize(ocr.with_passes(src), engine).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    assert texts.count() == 5 and calls.value == 5 * 4  # the small image is not read
    out = ocr.read_images(src, texts)
    size = len(raw[0][4])
    parts = {r.case_id: r.content for r in out.collect()}["c0"].split("\n")
    assert parts[0] == f"{size} at 6" and parts[1].endswith("at 3") and parts[2].endswith("at 6") and parts[3] == f"{size} at 11" and len({p.split()[0] for p in parts}) == 3
    # a pass that the cache has is not read again, one that is new is
    ocr.write_cache(texts, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert cache.count() == 20 and set(r.tag for r in cache.collect()) == {"base", "big", "sharp", "sparse"}
    again = ocr.recognize(ocr.with_passes(src), engine, cache)
    assert sorted((r.sha, r.text) for r in again.collect()) == sorted((r.sha, r.text) for r in texts.collect()) and calls.value == 20
    ocr.recognize(ocr.with_passes(src), engine, cache.filter("tag != 'big'")).collect()
    assert calls.value == 25
    assert {(r.tag, r.status): r.n for r in ocr.statuses(texts).collect()} == {(t, "ok"): 5 for t in ("base", "big", "sharp", "sparse")}
    one = ocr.composed(texts, ["sparse", "none", "base"]).first().text.split("\n")
    assert one[0].endswith("at 11") and one[1].endswith("at 6") and len(one) == 2
    (tmp_path / "words").write_text("x")
    assert ocr.tag_of("base", Config(user_words=str(tmp_path / "words"))) == "base+words" and ocr.tag_of("base", Config(user_words="/none")) == "base"


def test_ocr_without_a_program(spark, monkeypatch):
    monkeypatch.setenv("PATH", "/nowhere")
    assert ocr.tesseract(b"x", 6, []) == ("", "no program")
    src = spark.createDataFrame([("c", "image_0", "IMAGE", 0, b"x", "", None, None, "L", 1)], pdf.SCHEMA)
    read = ocr.recognize(ocr.with_passes(src), lambda image, psm, flags: ("", "no program"))
    assert {r.status for r in ocr.statuses(read).collect()} == {"no program"} and ocr.cache_rows(read).count() == 0


@pytest.mark.parametrize(
    ("page", "text", "passes"),
    [
        (lines(), "few", {"base"}), (lines(1), "few", {"base", "turned"}), (lines(1), "word " * 12, {"base"}), (lines(-3), "few", {"base", "straight"}), (lines(-3), "word " * 40, {"base"}),
        (np.full((240, 320), 255, np.uint8), "", {"base"}), (np.random.default_rng(2).integers(0, 256, (240, 320), dtype=np.uint8), "", {"base"}),
    ],
)
def test_costly_passes_need_a_reason(page, text, passes):
    reader = ocr.Reader(lambda image, psm, flags: (text, "ok"), Config(sparse_text_pass=False, rotation_pass=True, deskew_pass=True))
    got, seen = reader.read(imaging.encode(page), False, {})
    assert {s[0] for s in seen} == passes
    assert got == "\n".join([text] + ["\n".join([text] * 3)] * ("turned" in passes) + [text] * ("straight" in passes))


def test_ocr_cache_folder(spark, tmp_path):
    src = spark.createDataFrame([(f"c{k}", "image_0", "IMAGE", 0, bytes([k % 2]), "", 200, 200, "L", 1) for k in range(4)], pdf.SCHEMA)
    calls, config = spark.sparkContext.accumulator(0), Config(ocr_cache_dir=str(tmp_path / "cache"))

    def engine(image, psm, flags):
        calls.add(1)
        return f"{image[0]} at {psm}", "ok"

    assert ocr.read_cache(spark, config) is None and ocr.read_cache(spark) is None
    first = ocr.read_all(ocr.with_passes(src), engine, str(tmp_path / "one"), config)
    again = ocr.read_all(ocr.with_passes(src), engine, str(tmp_path / "two"), config)
    assert calls.value == 4 and sorted(r.text for r in first.collect()) == sorted(r.text for r in again.collect()) == ["0 at 6\n0 at 11", "1 at 6\n1 at 11"]


def test_every_packet_has_a_prediction(spark):
    cases = spark.createDataFrame([("b",), ("a",), ("a",)], "case_id string")
    have = spark.createDataFrame([("b", *["x"] * 9, "DENIED", 0.9)], ", ".join(f"{c} string" for c in tables_io.PREDICTION[:-1]) + ", confidence double")
    a, b = decide.complete(cases, have).collect()
    assert (a.case_id, a.sponsor_id, a.adjudication, a.confidence) == ("a", "SPN-0000", "NEEDS_REVIEW", 0.34) and (b.case_id, b.adjudication) == ("b", "DENIED")


def test_parity_materialized_and_observed(spark, tmp_path):
    a, b = spark.range(5), spark.range(3, 6)
    assert {r.side: r.n for r in tables_io.parity(a, b).collect()} == {"left": 3, "right": 1} and tables_io.parity(a, a).count() == 0
    at = str(tmp_path / "t")
    assert [tables_io.materialized(spark, at, lambda n=n: spark.range(n), again).count() for n, again in ((3, False), (5, False), (5, True))] == [3, 3, 5]
    rows, seen = evaluate.observed(spark.range(10), "census", even=F.col("id") % 2 == 0, large=F.col("id") > 6)
    assert rows.count() == 10 and seen.get == {"even": 5, "large": 3}


def test_reread(spark):
    sig = spark.createDataFrame([("a", 1, "FIELD_VALUE", "sponsor_id", "SPN-1O4", "image_0", 0.9, ""), ("a", 2, "FIELD_VALUE", "sponsor_id", "SPN-1234", "image_0", 0.9, ""), ("a", 3, "FIELD_VALUE", "arrival_date", "2026-1", "text_stream_0", 0.9, ""),
                                 ("b", 1, "FIELD_VALUE", "arrival_date", "2026-O5", "image_0", 0.9, ""), ("b", 2, "FIELD_VALUE", "home_world", "?", "image_0", 0.9, "")], resolve.SIGNAL)
    images = spark.createDataFrame([("a", "image_0", b"SPN-0104 x"), ("b", "image_0", b"nothing")], "case_id string, source_id string, raw binary")
    calls = spark.sparkContext.accumulator(0)

    def engine(image, psm, flags):
        calls.add(1)
        assert flags[1].startswith("tessedit_char_whitelist=")
        return image.decode(), "ok"

    out = ocr.with_rereads(sig, ocr.reread(sig, images, engine)).collect()
    assert {(r.case_id, r.seq): r.value for r in out} == {("a", 1): "SPN-0104", ("a", 2): "SPN-1234", ("a", 3): "2026-1", ("b", 1): "2026-O5", ("b", 2): "?"} and calls.value == 2


def test_incremental_run_reads_nothing_twice(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    run = lambda: incremental.run_available(spark, src, "id long", lambda d: d, out, at)
    spark.range(100).write.parquet(src)
    assert run() == 100
    assert run() == 0
    spark.range(100, 150).write.mode("append").parquet(src)
    assert run() == 50 and spark.read.parquet(out).distinct().count() == 150


def test_scans_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2, "error": "x"}\nnot json\n')
    assert [r.a for r in tables_io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a long").collect()] == [1]
    df = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")], "k string, o int, v string")
    assert {r.k: r.v for r in tables_io.last_wins(df, "k", "o").collect()} == {"x": "new", "y": "only"}
    assert tables_io.sampled_ids(list("dcba"), 2, 1) == tables_io.sampled_ids(list("abcd"), 2, 1)
    (tmp_path / "l.csv").write_text("case_id," + ",".join(T.FIELDS) + ",adjudication\nc1,\"A, B\"" + ",x" * 8 + ",DENIED\n")
    (r,) = tables_io.read_labels(spark, str(tmp_path / "l.csv")).collect()
    assert (r.case_id, r.applicant_name, r.fee_status, r.adjudication) == ("c1", "A, B", "x", "DENIED")
    (tmp_path / "ids.txt").write_text(" a \n\n\u00a0b\n")
    assert [r.id for r in tables_io.read_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    cases, done = spark.createDataFrame([("a",), ("b",)], "case_id string"), spark.createDataFrame([("a",), ("a",)], "case_id string")
    assert [r.case_id for r in tables_io.pending(cases, done).collect()] == ["b"]
    runs = spark.createDataFrame([("x", 1), ("y", 3), ("z", 2)], "path string, modificationTime int")
    assert tables_io.newest(runs).first().path == "y"
    assert sorted((r.k, r.o, r.n) for r in tables_io.dense_number(df, ["k"], "o").collect()) == [("x", 1, 0), ("x", 2, 1), ("y", 1, 0)]


def test_predictions_are_written_in_case_order(spark, tmp_path):
    rows = [(f"c{(k * 37) % 100:03d}", *["é"] * 9, "DENIED", 0.5) for k in range(100)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in tables_io.PREDICTION[:-1]) + ", confidence double").repartition(7)
    tables_io.write_predictions(df, str(tmp_path / "p"))
    got = [json.loads(x) for f in sorted((tmp_path / "p").glob("part-*")) for x in f.read_text().splitlines()]
    assert [r["case_id"] for r in got] == [f"c{k:03d}" for k in range(100)] and list(got[0]) == sorted(tables_io.PREDICTION)
    tables_io.write_report({"counts": spark.createDataFrame([("a", 1), ("b", 5)], "x string, n int")}, str(tmp_path / "r"))
    assert [json.loads(x)["n"] for f in (tmp_path / "r/counts").glob("part-*") for x in f.read_text().splitlines()] == [5, 1]


def test_packets_are_listed_by_path(spark, tmp_path):
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_bytes(b"")
    assert [r.case_id for r in pdf.case_list(pdf.packets(spark, str(tmp_path))).collect()] == ["a", "b", "c"]


def test_audits_over_small_frames(spark):
    fired = spark.createDataFrame([(k, ["a", "b"] if k % 2 else ["a"], "x" if k % 3 else "y") for k in range(60)], "id int, fired array<string>, cls string")
    assert {(r.signal, r.n, r.x, r.y, r.majority) for r in audits.precision(fired, "cls", ["x", "y"]).collect()} == {("a", 60, 40, 20, "x"), ("b", 30, 20, 10, "x")}
    assert [(r.signal, r.n) for r in audits.precision(fired, "cls", ["x", "y"], solo=True).collect()] == [("a", 30)]
    assert [(r.a, r.b, r.n) for r in audits.pair_precision(fired, "cls", ["x", "y"]).collect()] == [("a", "b", 30)] and audits.pair_precision(fired, "cls", ["x", "y"], 31).count() == 0
    down = {r.cls: (r.n, r.examples) for r in audits.drill_down(fired, "a", "b", "cls", "id", 3).collect()}
    assert down == {"x": (20, [1, 5, 7]), "y": (10, [3, 9, 15])}
    acc = spark.createDataFrame([("R1_transit7", 40, 40, 10, 30, 0.25), ("R5_stale", 30, 30, 21, 9, 0.7), ("R3_unpaid", 2, 0, 0, 0, 0.0)], "family string, fires int, kept int, correct int, wrong int, accuracy double")
    assert [(r.family, r.note) for r in audits.error_ranking(acc).collect()] == [("R1_transit7", "needs work"), ("R5_stale", "")]
    reg = spark.createDataFrame([("R1_transit7", 0.97), ("R3_unpaid", 0.96), ("none", 0.5)], "key string, value double")
    assert {r.key: (r.empirical, r.far) for r in audits.current_and_empirical(reg, acc).collect()} == {"R1_transit7": (0.25, True), "R3_unpaid": (0.96, False), "none": (0.5, False)}
    layers = {"one": spark.createDataFrame([("c", 1), ("d", 2)], "case_id string, v int"), "two": spark.createDataFrame([("c", "x")], "case_id string, w string")}
    assert [(r.layer, r.row) for r in audits.inspect("c", layers).collect()] == [("one", '{"case_id":"c","v":1}'), ("two", '{"case_id":"c","w":"x"}')]
    n = spark.createDataFrame([(2.5,), (59.4,), (72.0,), (3780.0,)], "s double")
    assert [r[0] for r in n.select(audits.duration(F.col("s"))).collect()] == ["2s", "59s", "1m 12s", "1h 03m"]
    assert [r[0] for r in spark.range(2).select(audits.percent(F.lit(1), F.col("id") * 3)).collect()] == ["  0.0%", " 33.3%"]
    (b,) = audits.budget(spark.createDataFrame([(700.0, 100)], "seconds double, n int")).collect()
    assert (b.each, b.projected, b.fits) == (7.0, 35000.0, False)


def test_equality_of_values(spark):
    rows = [("risk_flags", "a|b", "b|a|c", True), ("risk_flags", "", "none", False), ("risk_flags", "none", "none", True), ("risk_flags", "a|z", "a", False), ("fee_status", " paid ", "paid", True), ("fee_status", "Paid", "paid", False)]
    df = spark.createDataFrame(rows, "f string, g string, t string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", X.same_value(F.col("f"), F.col("g"), F.col("t"))).collect())
    assert spark.range(1).select(X.same_for_score(F.lit(" A  b"), F.lit("a B "))).first()[0]


def test_config_reads_the_cache_folder_only(monkeypatch):
    monkeypatch.setenv("DOCKETRY_OCR_CACHE_DIR", " /x ")
    assert Config.from_env() == Config(ocr_cache_dir="/x")
    monkeypatch.delenv("DOCKETRY_OCR_CACHE_DIR")
    assert Config.from_env() == Config()
