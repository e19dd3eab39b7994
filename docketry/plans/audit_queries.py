"""Registered audits and their SQL; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import tables as T
from docketry.config import Config
from docketry.operators import audits, decide, evaluate, resolve, trust

from . import oracle as O
from . import pipeline, synth
from .catalogue import _JUDGED, _PROBED, _filtered, _probed, _signals, _t, query, rule_accuracy

_TL = "tl AS (" + " UNION ALL ".join(f"SELECT case_id, '{f}' AS key, {f} AS t FROM tr" for f in T.FIELDS) + ")"
_SAME = lambda key, v, t: f"CASE WHEN {key} = 'risk_flags' THEN {v} <> '' AND list_has_all(string_split({t}, '|'), string_split({v}, '|')) ELSE {v} = {t} END"
_ROWS = f"""{O.TO_SIGNALS}, {O.TRUE}, {_TL}, sr AS (SELECT s.case_id, s.key AS field, s.value, t AS truth_value, {_SAME('s.key', 's.value', 't')} AS is_correct, source_id,
CASE WHEN source_id LIKE 'image%' THEN 'ocr' ELSE 'text' END AS source_class, s.confidence, n_sources AS agreement_n, n_agreeing, has_conflict, a.value = s.value AS won_consolidation
FROM sig s JOIN agree a ON s.case_id = a.case_id AND s.key = a.key JOIN tl ON tl.case_id = s.case_id AND tl.key = s.key)"""


def _rows(s, d):
    return audits.signal_correctness(resolve.emitted(_filtered(s, d)), synth.truth(s, d))


@query(f"{_ROWS} SELECT * FROM sr")
def signal_correctness(s, d):
    return _rows(s, d)


@query(f"""{_ROWS}, b AS (SELECT field, source_class, CASE WHEN agreement_n <= 1 THEN '1' WHEN agreement_n = 2 THEN '2' WHEN agreement_n <= 4 THEN '3-4' ELSE '5+' END AS bucket,
CASE WHEN has_conflict THEN 'conflict' ELSE 'no conflict' END AS conflict, is_correct FROM sr)
SELECT field, coalesce(source_class, 'all') AS source_class, coalesce(bucket, 'all') AS bucket, coalesce(conflict, 'all') AS conflict, count(*)::BIGINT AS n, (count(*) FILTER (WHERE is_correct))::BIGINT AS correct
FROM b GROUP BY GROUPING SETS ((field), (field, source_class, bucket), (field, conflict))""")
def field_detail(s, d):
    return audits.field_detail(_rows(s, d))


_IMAGES = f"""{O.TO_SIGNALS}, {O.TRUE}, {_TL}, im AS ({' UNION ALL '.join(f"SELECT case_id, source_id, level, '{f}' AS field, {f} AS value FROM we WHERE kind = 'IMAGE'" for f in T.FIELDS)}),
fi AS (SELECT im.*, value <> '' AND NOT (field = 'risk_flags' AND value = 'none') AS present, {_SAME('field', 'value', 't')} AS same FROM im JOIN tl ON tl.case_id = im.case_id AND tl.key = field)"""
_EXPECTED = "CASE level " + " ".join(f"WHEN {k} THEN field IN ({', '.join(map(O.q, v))})" for k, v in audits.EXPECTED.items()) + " ELSE false END"


@query(f"""{_IMAGES}, a AS (SELECT level::INTEGER AS level, field, count(*)::BIGINT AS n, (count(*) FILTER (WHERE present))::BIGINT AS extracted, (count(*) FILTER (WHERE present AND same))::BIGINT AS correct FROM fi GROUP BY 1, 2)
SELECT level, field, {_EXPECTED} AS expected, n, extracted, correct, round(extracted / n, 9) AS extracted_share, round(coalesce(correct / nullif(extracted, 0), 0), 9) AS correct_share FROM a""")
def level_field_coverage(s, d):
    out = audits.level_coverage(audits.image_fields(_filtered(s, d), synth.truth(s, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("extracted_share", "correct_share")})


@query(f"{_IMAGES} SELECT case_id, source_id, (count(*) FILTER (WHERE present))::BIGINT AS extracted, 9::BIGINT AS expected FROM fi WHERE level = 2 GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 20")
def worst_images(s, d):
    """The 20 images of level 2 that show the fewest fields; the limit is the feature."""
    return audits.worst_images(audits.image_fields(_filtered(s, d), synth.truth(s, d)), 2)


_SPREAD = "count(*)::BIGINT AS n, (count(*) FILTER (WHERE quality = 0))::BIGINT AS bad, (count(*) FILTER (WHERE quality = 1))::BIGINT AS good"
_TOP = "CASE WHEN bad >= good THEN 'bad' ELSE 'good' END AS majority, greatest(bad, good) / n AS share"


def _classed(s, d):
    return _probed(s, d).withColumn("class", F.when(F.col("quality") == 1, "good").otherwise("bad"))


@query(f"WITH {_PROBED}, u AS (SELECT p AS signal, {_SPREAD} FROM (SELECT unnest(fired) AS p, quality FROM pr) GROUP BY 1) SELECT *, {_TOP} FROM u")
def probe_precision(s, d):
    return audits.precision(_classed(s, d), "class", ["bad", "good"])


@query(f"WITH {_PROBED}, u AS (SELECT fired[1] AS signal, {_SPREAD} FROM pr WHERE len(fired) = 1 GROUP BY 1) SELECT *, {_TOP} FROM u")
def probe_solo_precision(s, d):
    return audits.precision(_classed(s, d), "class", ["bad", "good"], solo=True)


@query(f"WITH {_PROBED}, e AS (SELECT doc_id, quality, unnest(fired) AS p FROM pr), u AS (SELECT a.p AS a, b.p AS b, {_SPREAD.replace('quality', 'a.quality')} FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 5) SELECT *, {_TOP} FROM u")
def probe_pair_precision(s, d):
    return audits.pair_precision(_classed(s, d), "class", ["bad", "good"])


@query(f"WITH {_PROBED}, b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS cls FROM pr WHERE list_contains(fired, 'email') AND list_contains(fired, 'ip')) SELECT cls, count(*)::BIGINT AS n, array_to_string(list_sort(list(doc_id))[1:20], ',') AS examples FROM b GROUP BY 1")
def probe_drill_down(s, d):
    """Documents with mail and network addresses; the first 20 ids of each class are the feature."""
    return audits.drill_down(_classed(s, d), "email", "ip", "class", "doc_id").withColumn("examples", F.array_join("examples", ","))


@query(f"""{_JUDGED} SELECT f.final.tag AS tag, CASE WHEN g IS NULL THEN 'no_signal' ELSE split_part(g.tag, ':', 1) END AS family, coalesce(g.adj, '') AS adj, coalesce(g.adj = truth, false) AS agrees, count(*)::BIGINT AS n
FROM final f JOIN jt ON f.case_id = jt.case_id WHERE f.final.tag IN ({', '.join(map(O.q, audits.UNCOVERED))}) GROUP BY 1, 2, 3, 4""")
def uncovered_signals(s, d):
    return audits.uncovered(pipeline.synthetic(s, d), pipeline.synthetic_truth(s, d))


@query(f"""{O.TO_SIGNALS}, {O.TRUE}, w AS (SELECT case_id, bool_or(source_id = 'combined_text' AND value = 'unknown') AS said, arg_max(source_id, {{'a': confidence, 'b': source_id, 'c': -seq}}) AS src, arg_max(value, {{'a': confidence, 'b': source_id, 'c': -seq}}) AS v FROM sig WHERE key = 'fee_status' GROUP BY 1)
SELECT CASE WHEN v = fee_status THEN 'outvote_right' WHEN fee_status = 'unknown' THEN 'outvote_wrong_truth_unknown' ELSE 'outvote_wrong_other' END AS outcome, count(*)::BIGINT AS n FROM w JOIN tr USING (case_id) WHERE said AND src <> 'combined_text' GROUP BY 1""")
def fee_outvotes(s, d):
    return audits.outvoted(_signals(s, d), synth.truth(s, d))


#: Which emission steps a composition leaves out.
_WITHOUT = {"all": [], "no_flags": [1], "no_sponsors": [2], "no_labels": [3], "strict": [1, 2, 3]}
_USES = " UNION ALL ".join(f"SELECT '{n}' AS config, case_id, key, value, source_id, confidence, seq FROM sig" + (f" WHERE (seq // 100) % 10 NOT IN ({', '.join(map(str, x))})" if x else "") for n, x in _WITHOUT.items())


@query(f"""{O.TO_SIGNALS}, {O.TRUE}, {_TL}, u AS ({_USES}), w AS (SELECT config, case_id, key, arg_max(value, {{'a': confidence, 'b': source_id, 'c': -seq}}) AS v FROM u GROUP BY 1, 2, 3),
c AS (SELECT unnest([{', '.join(map(O.q, _WITHOUT))}]) AS config), r AS (SELECT c.config, tl.case_id, tl.key, t, coalesce(v, CASE WHEN tl.key = 'risk_flags' THEN 'none' ELSE '' END) AS v FROM tl JOIN bundle USING (case_id) CROSS JOIN c LEFT JOIN w ON w.config = c.config AND w.case_id = tl.case_id AND w.key = tl.key)
SELECT r.config, (count(*) FILTER (WHERE r.v = r.t))::BIGINT AS matched, ((count(*) FILTER (WHERE r.v = r.t)) - (count(*) FILTER (WHERE b.v = r.t)))::BIGINT AS delta, (count(*) FILTER (WHERE r.v <> b.v))::BIGINT AS fields_differ,
count(DISTINCT CASE WHEN r.v <> b.v THEN r.case_id END)::BIGINT AS cases_differ FROM r JOIN r b ON b.config = 'all' AND b.case_id = r.case_id AND b.key = r.key GROUP BY 1""")
def pass_composition(s, d):
    """What each way of reading adds: the signals are made once, and each composition leaves some out."""
    bundle = resolve.emitted(_filtered(s, d))
    won = resolve.compositions(resolve.signals(bundle), _WITHOUT).hint("merge")
    return audits.composition(bundle.select("case_id").join(won, "case_id", "left"), synth.truth(s, d), list(_WITHOUT), "all")


_CONFIGS = {
    "production": (Config(), {}), "no_fallback": (Config(fallback_ocr_upgrade=False), {"fallback": False}), "no_biometric": (Config(biometric_upgrade=False), {"biometric": False}),
    "unpaid_waiver": (Config(unpaid_waiver_upgrade=True), {"unpaid": True}), "no_ocr_guard": (Config(ocr_only_guard=False), {"ocr_only": False}),
    "no_bypass": (Config(finding_bypass=False), {"bypass": False}), "defensive": (Config(defensive_downgrade=True), {"defensive": True}),
}
_SWEPT = " UNION ALL ".join(f"SELECT '{n}' AS config, case_id, {O.final(**o)} AS fin FROM graded" for n, (_, o) in _CONFIGS.items())
_PAID = "CASE " + " ".join(f"WHEN truth = '{a}' AND fin.adj = '{b}' THEN {v}" for (a, b), v in T.PAYOFF.items()) + " END"


@query(f"""{_JUDGED}, sw AS ({_SWEPT}) SELECT config, count(*)::BIGINT AS n, (count(*) FILTER (WHERE fin.adj = 'APPROVED'))::BIGINT AS approved, (count(*) FILTER (WHERE fin.adj = truth))::BIGINT AS agreed, sum({_PAID})::BIGINT AS points,
(count(*) FILTER (WHERE truth = 'DENIED' AND fin.adj = 'APPROVED'))::BIGINT AS false_approvals, round(avg(fin.conf), 9) AS mean_confidence FROM sw JOIN jt USING (case_id) GROUP BY 1""")
def config_sweep(s, d):
    """The policy's switches one by one, over cases that are made once."""
    x = decide.sweep(pipeline.synthetic(s, d), {n: c for n, (c, _) in _CONFIGS.items()})
    j = x.select("case_id", "config", "final").join(pipeline.synthetic_truth(s, d).select("case_id", "truth"), "case_id")
    adj, truth = F.col("final.adj"), F.col("truth")
    return j.groupBy("config").agg(
        F.count("*").alias("n"), F.count_if(adj == "APPROVED").alias("approved"), F.count_if(adj == truth).alias("agreed"), F.sum(evaluate.payoff(truth, adj)).alias("points"),
        F.count_if((truth == "DENIED") & (adj == "APPROVED")).alias("false_approvals"), F.round(F.avg("final.conf"), 9).alias("mean_confidence"),
    )


_MANUAL = [*T.SPECIES[2:], *T.VISAS, *T.FEES[:3], "XW-9", "NEVER_SEEN"]


@query(f"""WITH {O.TRUE}, m AS (SELECT unnest({O.lst(_MANUAL)}) AS value), c AS (SELECT field, trim(value) AS value, count(*)::BIGINT AS n FROM (SELECT unnest([{{'field': 'visa_class', 'value': visa_class}}, {{'field': 'fee_status', 'value': fee_status}}, {{'field': 'species_code', 'value': species_code}}], recursive := true) FROM tr) GROUP BY 1, 2)
SELECT field, value, n, value IN (SELECT value FROM m) AS in_manual FROM c UNION ALL SELECT '', value, 0, true FROM m WHERE value NOT IN (SELECT value FROM c)""")
def vocab_audit(s, d):
    return audits.vocab_audit(synth.truth(s, d), s.createDataFrame([(v,) for v in _MANUAL], "value string"))


_ACC = f"{_JUDGED}, a AS (SELECT split_part(f.verdict.tag, '[', 1) AS family, count(*)::BIGINT AS fires, count(*) FILTER (WHERE f.verdict.adj = f.final.adj) AS kept, count(*) FILTER (WHERE f.verdict.adj = f.final.adj AND f.final.adj = truth) AS correct, (count(*) FILTER (WHERE f.verdict.adj = f.final.adj AND f.final.adj <> truth))::BIGINT AS wrong FROM final f JOIN jt USING (case_id) GROUP BY 1), ac AS (SELECT *, round(coalesce(correct / nullif(kept, 0), 0), 9) AS accuracy FROM a)"


@query(f"{_ACC} SELECT family, fires, accuracy, wrong, CASE WHEN accuracy < 0.5 AND wrong >= 20 THEN 'needs work' WHEN accuracy < 0.75 AND wrong >= 20 THEN 'split further' ELSE '' END AS note FROM ac WHERE kept > 0")
def error_ranking(s, d):
    return audits.error_ranking(rule_accuracy(s, d))


@query(f"""{_ACC}, r(key, value) AS (VALUES {', '.join(f"({O.q(k)}, {v}::DOUBLE)" for k, v in T.CONFIDENCE.items())}), x AS (SELECT key, value, coalesce(kept > 0, false) AS has_data, CASE WHEN kept > 0 THEN least(0.99, round(accuracy, 2)) ELSE value END AS e FROM r LEFT JOIN ac ON key = family)
SELECT key, value AS current, e::DOUBLE AS empirical, has_data, abs(round(e - value, 9)) > 0.10 AS far FROM x""")
def current_vs_empirical(s, d):
    reg = s.createDataFrame(list(T.CONFIDENCE.items()), "key string, value double")
    return audits.current_and_empirical(reg, rule_accuracy(s, d))


@query(f"{O.TO_BUNDLE}, l AS (SELECT substr(trim(coalesce(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1], '')), 1, 80) AS line FROM f WHERE trusted AND level = 2) SELECT line, count(*)::BIGINT AS n FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def first_line_counts(s, d):
    """The 30 commonest first lines of level 2; the limit is the feature."""
    return audits.first_line_counts(_filtered(s, d), 2)


@query(f"{O.TO_BUNDLE}, {O.TRUE}, g AS (SELECT case_id, array_to_string(list_sort(list(source_id)), ',') AS sources FROM f WHERE trusted AND level = 1 GROUP BY 1) SELECT case_id, verdict.adj AS truth, sources FROM g JOIN judged USING (case_id)")
def cases_at_level_1(s, d):
    return audits.cases_at_level(_filtered(s, d), pipeline.synthetic_truth(s, d)).withColumn("sources", F.array_join("sources", ","))


@query("SELECT count(*)::BIGINT AS listed, (count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)))::BIGINT AS scored, (count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)))::BIGINT AS missing FROM (SELECT DISTINCT doc_id FROM documents)")
def split_coverage(s, d):
    key = F.col("doc_id").alias("case_id")
    return audits.split_coverage(_t(s, d, "documents").select(key), _t(s, d, "labels").select(key))


@query("""WITH c AS (SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1), b AS (SELECT status, n, n * 3.5::DOUBLE AS seconds, sum(n) OVER () AS total FROM c)
SELECT status, n, seconds, 3.5::DOUBLE AS each, 17500.0::DOUBLE AS projected, 12500.0::DOUBLE AS headroom, true AS fits, printf('%5.1f%%', 100.0 * n / total) AS share,
CASE WHEN round_even(seconds, 0) < 60 THEN printf('%ds', round_even(seconds, 0)::BIGINT) WHEN round_even(seconds, 0) < 3600 THEN printf('%dm %02ds', (round_even(seconds, 0)::BIGINT // 60), round_even(seconds, 0)::BIGINT % 60)
ELSE printf('%dh %02dm', round_even(seconds, 0)::BIGINT // 3600, (round_even(seconds, 0)::BIGINT // 60) % 60) END AS took FROM b""")
def budget_projection(s, d):
    """Orders by status as runs of 3.5 seconds an order, projected to 5,000."""
    orders = _t(s, d, "orders")
    runs = orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).withColumn("seconds", F.col("n") * 3.5)
    total = orders.agg(F.count("*").alias("total"))
    # one row meets three
    out = audits.budget(runs, keep=["status"]).crossJoin(F.broadcast(total))
    return out.select("status", "n", "seconds", "each", "projected", "headroom", "fits", audits.percent(F.col("n"), F.col("total")).alias("share"), audits.duration(F.col("seconds")).alias("took"))


_HAS = ", ".join(f"contains(lower(array_to_string(images, ' ')), {O.q(w)}) AS \"ocr_has_{w.replace(' ', '_')}\"" for w in T.PROBES)


@query(f"""{_JUDGED}, fs AS (SELECT case_id, count(*)::BIGINT AS n_sources, (count(*) FILTER (WHERE trusted AND kind = 'TEXT_STREAM'))::BIGINT AS n_trusted_text, (count(*) FILTER (WHERE trusted AND kind = 'IMAGE'))::BIGINT AS n_trusted_image,
(count(*) FILTER (WHERE NOT trusted))::BIGINT AS n_untrusted, bool_or(len(hits) > 0) AS any_injection_sanitized, bool_or(gone > 0) AS any_redaction_sanitized, bool_or(NOT trusted) AS any_illegibility_excluded FROM f GROUP BY 1),
ns AS (SELECT case_id, count(*)::BIGINT AS n_field_signals FROM sig GROUP BY 1), ag AS (SELECT case_id, {', '.join(f"coalesce(max(n_sources) FILTER (WHERE key = '{f}'), 0)::BIGINT AS n_{f}" for f in audits.FEATURED)} FROM agree GROUP BY 1)
SELECT case_id, final.verdict.tag AS rule_tag, final.verdict.conf AS rule_confidence, final.final.adj AS adjudication, final.final.conf AS confidence, n_sources, n_trusted_text, n_trusted_image, n_untrusted, any_injection_sanitized,
any_redaction_sanitized, any_illegibility_excluded, coalesce(n_field_signals, 0)::BIGINT AS n_field_signals, (final.finding <> '')::BIGINT AS n_finding_signals, length(array_to_string(images, ' '))::BIGINT AS ocr_total_chars, {_HAS},
{', '.join(f"final.c_{f} AS src_{f}, coalesce(n_{f}, 0)::BIGINT AS agree_{f}_n, final.x_{f} AS agree_{f}_conflict" for f in audits.FEATURED)}, {' OR '.join(f'final.x_{f}' for f in audits.FEATURED)} AS any_field_conflict,
truth AS truth_adjudication, tr.risk_flags AS truth_flags, tr.fee_status AS truth_fee_status, tr.visa_class AS truth_visa_class, tr.species_code AS truth_species, {', '.join(f"list_contains(string_split(tr.risk_flags, '|'), '{f}') AS truth_has_{f}" for f in T.FLAGS)},
final.final.adj = truth AS prediction_correct FROM final JOIN fs USING (case_id) JOIN tr USING (case_id) JOIN jt USING (case_id) LEFT JOIN ns USING (case_id) LEFT JOIN ag USING (case_id)""")
def feature_rows(s, d):
    return audits.feature_rows(pipeline.decided_of(audits.noted(_filtered(s, d))), pipeline.synthetic_truth(s, d))
