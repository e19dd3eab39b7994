"""Plans of shared steps, and helpers that take the place of patterns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry import tables as T
from docketry.functions import text as X
from docketry.operators import joins, resolve, trust
from docketry.plans import audit_queries, catalogue, join_queries, scan_queries, synth

DATA = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_and_blank(spark):
    texts = ["", " ", "\u2003a b\u00a0\n", "\u0085\u3000", "\n\nx y\r\n", "a", None, "\u200bz"]
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(old.alias("a"), X.strip(F.col("t")).alias("b"), (old == "").alias("c"), X.blank(F.col("t")).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in rows)


def test_candidates_are_compiled(spark):
    """The signals' candidates, which hold all the patterns, are no argument of a lambda or a generator."""
    sig = resolve.signals(trust.bundles(trust.apply_filters(synth.sources(spark, DATA))))
    assert "Generate explode(concat(found" in _plan(sig)


def test_ranges_meet_days(spark, monkeypatch):
    """what meets the ranges is as many rows as there are days, and distinct bounds."""
    seen, real = [], joins.in_ranges
    monkeypatch.setattr(joins, "in_ranges", lambda rows, value, ranges: seen.append((rows, value, ranges)) or real(rows, value, ranges))
    join_queries.range_join(spark, DATA)
    ((rows, value, ranges),) = seen
    assert rows.count() == rows.select(value).distinct().count() and ranges.count() == ranges.select("lo", "hi").distinct().count()


def test_images_meet_texts_once(spark):
    """read_images joins by hash alone; it doesn't join the images with themselves."""
    plan = scan_queries.ocr_stage(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["signal_correctness", "field_detail", "field_changes", "feature_rows"])
def test_signals_are_made_once(spark, name):
    """F1, F2, F3, F9."""
    assert _plan(catalogue.QUERIES[name](spark, DATA)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("query", [audit_queries.worst_images, audit_queries.pass_composition])
def test_cases_are_not_broadcast(spark, query):
    """cases meet their truth as one row each, by a merge, whatever size a plan estimates."""
    plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin [case_id" in plan


def test_large_steps_are_small_methods(spark):
    """F13 to F30: no stage of the signals is one method over 8,000 bytes, which the JVM would interpret."""
    jvm = spark._jvm.org.apache.spark.sql.execution
    plan = catalogue.QUERIES["winner_by_family"](spark, DATA)._jdf.queryExecution().explainString(jvm.ExplainMode.fromString("codegen"))
    sizes = [int(x.split(";")[0]) for x in plan.split("maxMethodCodeSize:")[1:]]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalogue.QUERIES["winner_by_family"](spark, DATA)._jdf.queryExecution().explainString(jvm.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes += [int(x.split(";")[0]) for x in plan.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) <= 8000


def test_trimmed_is_strip(spark):
    texts = ["", " ", "a", " a", "a ", "~", "\x7f", "é", "é b ", " a b", "a\n", "\x85", "a.;\n", ",", None, "!x　", "\x1fa"]
    t, end = F.col("t"), F.regexp_replace(X.strip(F.col("t")), r"[.,;:]+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip(t).alias("a"), X.trimmed(t).alias("b"), end.alias("c"), X._without_end(t).alias("d"), X.stepwise(t).alias("e"), "t").collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.t for r in rows)


def test_flags_by_words(spark):
    """A pattern that runs only where the words of its flag stand finds what it finds everywhere."""
    texts = ["", None, "BIOHAZARD RED", "biohazard—red active_warrant", "biohazardred", "xbiohazard_red", "identity-conflict, sponsor mismatch", "İdentity_conflict", "red biohazard", "memory_tamperıng"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.fuzzy_flags(F.col("t")).alias("a"), X.fuzzy_flags(F.col("t"), F.lower("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and rows[2].a == "biohazard_red"


def test_likeness_is_asked_once(monkeypatch):
    """F13 to F30: windows that come again aren't compared again."""
    made, real = [], resolve.difflib.SequenceMatcher
    monkeypatch.setattr(resolve.difflib, "SequenceMatcher", lambda *a: made.append(a) or real(*a))
    resolve._likeness.cache_clear()
    once = resolve.label_search_all(["q V1sa Clas5: DIP-1"], "Visa Class")
    n = len(made)
    assert n and resolve.label_search_all(["q V1sa Clas5: DIP-1"] * 50, "Visa Class") == once * 50 and len(made) == n


def test_patterns_at_lines(spark):
    """F13 to F30: with a line end before the text, a pattern finds the same first group as at the text's start or a line end."""
    lines = ["", "Visa Class: DIP-1", "visa\nXW-1", "Applicant: A\tB", "Full Name = C", "\n\nRegistry Name:\nD", "xPurpose: e", "Purpose: f", "fee: paid", "Amount: $1,2.5", " Waiver Code\nN/A", "flags=none", "Risk Flag: [x]", "\r\nfee status\n\nunpaid"]
    texts = [a + sep + b for a in lines for b in lines for sep in ("", "\n", "\r\n", " ")]
    made = [k for k, p in T.P.items() if r"(?:^|\n)" in p]
    old = [F.regexp_extract("t", T.P[k], 1).alias(k) for k in made]
    new = [F.regexp_extract(F.concat(F.lit("\n"), F.col("t")), X.at_lines(T.P[k]), 1).alias(k) for k in made]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.struct(*old).alias("a"), F.struct(*new).alias("b")).collect()
    assert len(made) == 8 and all(r.a == r.b for r in rows) and all(any(r.a[k] for r in rows) for k in made)


@pytest.mark.parametrize("name", ["adjudicate_final", "verdict_flow", "provenance"])
def test_cases_are_shuffled_once(spark, name):
    """F14 to F29: sources meet by case once; nothing is gathered or joined by case again, and no case is made twice."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_cases_in_rows_are_cases_by_signals(spark):
    """F14 to F29: signals resolved in the case's row are those that are gathered from the signals of the bundles."""
    filtered = trust.apply_filters(synth.sources(spark, DATA)).filter("substring(case_id, -1) = '3'").localCheckpoint()
    bundle, made = trust.bundles(filtered), resolve.emitted(filtered)
    old = [repr(sorted(r.asDict(True).items())) for r in resolve.consolidate(resolve.signals(bundle), bundle).withColumn("agreement", F.array_sort(F.map_entries("agreement"))).collect()]
    new = [repr(sorted(r.asDict(True).items())) for r in resolve.consolidated(made).withColumn("agreement", F.array_sort(F.map_entries("agreement"))).collect()]
    assert len(old) == 150 and sorted(old) == sorted(new)
    assert sorted(resolve.signals(made).collect()) == sorted(resolve.signals(bundle).collect())


@pytest.mark.parametrize("field", ["fee_status", "sponsor_id", "risk_flags"])
def test_one_field_makes_no_filter(spark, field):
    """Of a plan that asks for one field Spark infers no filter, which it would write out once more for each mention down to the sources."""
    none = ", ".join(f"'{k}', array()" for k in resolve.KEYS if k != field)
    one = "array(named_struct('confidence', 0.5D, 'source_id', 'text_stream_0', 'order', id, 'value', 'x', 'tag', '', 'text', true))"
    of = ", ".join(f"{k}:{resolve._CANDIDATES}" for k in resolve.KEYS)
    cases = spark.range(3).selectExpr("string(id) AS case_id", f"cast(named_struct({none}, '{field}', CASE WHEN id > 0 THEN {one} ELSE array() END) AS struct<{', '.join(f'{k}:{resolve._CANDIDATES}' for k in [x for x in resolve.KEYS if x != field] + [field])}>) AS s")
    cases = cases.select("case_id", F.struct(*[F.col(f"s.{k}").alias(k) for k in resolve.KEYS]).cast(f"struct<{of}>").alias("signals"))
    got = resolve.consolidated(cases).select(field)
    assert "Filter" not in _plan(got)
    assert sorted(r[0] for r in got.collect()) == [{"risk_flags": "none"}.get(field, ""), "x", "x"]


def test_tags_are_keyed_after_they_are_distinct(spark):
    """the join's filter on a tag's key doesn't go down to the cases, which it would decide again for each mention of the tag."""
    plan = _plan(catalogue.tag_registry_join(spark, DATA))
    filters = [x for x in plan.splitlines() if "Filter " in x]
    assert any("tag#" in x for x in filters) and not any("resolved#" in x or "final#" in x for x in filters)


def test_packets_are_read_by_all_cores_and_decided_once(spark):
    """orders are dealt out before their packets are written, the list of cases writes none, and what is sorted comes from a shuffle, as a sort reads it twice."""
    plan = join_queries.predictions_of_packets(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" +-:") for x in plan.splitlines() if "Exchange" in x or "MapInArrow" in x]
    assert plan.count("MapInArrow") == 1 and lines[0].startswith("Exchange rangepartitioning") and lines[1].startswith("Exchange hashpartitioning(xxhash64")
    assert lines[[x.startswith("MapInArrow") for x in lines].index(True) + 1].startswith("Exchange hashpartitioning(o_orderkey")


def test_signals_are_rated_in_their_case(spark):
    """signals aren't grouped by field again; cases meet their truth before their signals become rows."""
    plan = _plan(catalogue.QUERIES["signal_correctness"](spark, DATA))
    assert plan.count("Aggregate [case_id#") == 1 and plan.index("Generate explode(concat(found") < plan.index("Join Inner")


def test_features_come_from_one_pass(spark):
    """sources are made, filtered and gathered once; what is counted of them comes along in their case."""
    plan = _plan(catalogue.QUERIES["feature_rows"](spark, DATA))
    assert plan.count("Aggregate [case_id#") == 1 and plan.count("Join Inner") == 1 and plan.count("Relation [") == 2
