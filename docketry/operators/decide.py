"""Decisions: the ordered rule chain and the staged review policy, as one nested expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import tables as T
from docketry.config import CONFIG, Config
from docketry.functions import text as X


def rules() -> list[tuple[str, Column]]:
    """(id, verdict or null) in order, over the nine fields and finding."""
    c, v = F.col, X.verdict
    flags = X.flag_set(c("risk_flags"))
    bad = F.array_sort(F.array_intersect(flags, F.array(*map(F.lit, T.DISQUALIFYING))))
    not_dip = (c("visa_class") != "") & (c("visa_class") != "DIP-1")
    tagged = lambda key, x: F.concat(F.lit(key + "["), x, F.lit("]"))
    found = F.struct(c("finding").alias("adj"), F.lit(T.CONFIDENCE["R_ADJUDICATOR_FINDING"]).alias("conf"), tagged("R_ADJUDICATOR_FINDING", c("finding")).alias("tag"))
    deny, review, fine = "DENIED", "NEEDS_REVIEW", "APPROVED"
    plain = lambda adj, key: v(adj, key, key)
    return [
        ("R_FIND", F.when(c("finding").isin(*T.VERDICTS), found)),
        ("R0", F.when(c("home_world").isin(*T.HARD_EMBARGO), v(deny, tagged("R0_hard_embargo", c("home_world")), "R0_hard_embargo"))),
        ("R1", F.when(c("visa_class") == "TRANSIT-7", plain(deny, "R1_transit7"))),
        ("R2", F.when(F.size(bad) > 0, v(deny, tagged("R2_disqualifier", F.array_join(bad, "|")), "R2_disqualifier"))),
        ("R4", F.when(c("sponsor_id").isin(*T.REVOKED) & not_dip, plain(deny, "R4_revoked_sponsor"))),
        ("R4b", F.when(c("home_world").isin(*T.SOFT_EMBARGO) & not_dip, plain(deny, "R4b_embargoed_home"))),
        ("R3", F.when(c("fee_status") == "unpaid", plain(deny, "R3_unpaid"))),
        ("R5", F.when((c("arrival_date") != "") & X.stale(c("arrival_date")) & not_dip, plain(deny, "R5_stale"))),
        ("R_R1", F.when(F.size(flags) > 0, plain(review, "R_R1_flag_present"))),
        ("FB", F.when((c("visa_class") == "") | (c("fee_status") == ""), plain(review, "FALLBACK_extraction_fail"))),
        ("FB2", F.when(c("arrival_date") == "", plain(review, "FALLBACK_missing_arrival"))),
        ("R_R2", F.when(c("fee_status") == "unknown", plain(review, "R_R2_unknown_fee"))),
        ("A1", F.when(c("fee_status") == "paid", plain(fine, "R_A1_paid_clean"))),
        ("A2", F.when((c("fee_status") == "waived") & (c("visa_class") == "DIP-1"), plain(fine, "R_A1_dip1_waived"))),
        ("A3", F.when(c("fee_status") == "waived", v(review, "R_A1_non_dip_waived_TO_REVIEW", "R_A1_non_dip_waived"))),
        ("FLOOR", plain(review, "FALLBACK_extraction_fail")),
    ]


def adjudicate(cases: DataFrame) -> DataFrame:
    return cases.withColumn("verdict", F.coalesce(*[x for _, x in rules()]))


def guards(config: Config = CONFIG) -> list[tuple[str, Column]]:
    """(name, verdict or null) of the guards of an approval, over fields, source_class, agreement, grade and tag."""
    c, review = F.col, "NEEDS_REVIEW"
    named = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    by_ocr = named([F.when(F.try_element_at("source_class", F.lit(f)) == "ocr_only", f) for f in T.APPROVE_RELEVANT])
    rec = lambda f: F.try_element_at("agreement", F.lit(f))
    split = named([F.when(rec(f)["has_conflict"], F.concat(F.lit(f + "("), F.array_join(rec(f)["unique_values"], "/"), F.lit(")"))) for f in T.APPROVE_RELEVANT])
    gone = lambda f: F.lower(X.strip(c(f))).isin("", "unknown")
    lacks = named([F.when(gone("home_world"), "home_world"), F.when((c("visa_class") != "DIP-1") & gone("sponsor_id"), "sponsor_id")])
    listed = lambda key, xs, sep: F.when(F.size(xs) > 0, X.verdict(review, F.concat(F.lit(key + ":"), F.array_join(xs, sep)), key))
    out = [("ocr_risk", c("grade"))]
    if config.ocr_only_guard:
        out.append(("ocr_only", listed("ocr_only_downgrade", by_ocr, ",")))
    out += [("conflict", listed("field_conflict", split, ";")), ("missing", listed("missing_required", lacks, ","))]
    if config.defensive_downgrade:
        thin = c("verdict.tag").isin("R_A1_paid_clean", "R_A1_dip1_waived") & (F.try_element_at("source_class", F.lit("risk_flags")) == "absent") & ~c("any_illegible")
        key = "defensive_downgrade_thin_evidence"
        out.append(("defensive", F.when(thin, X.verdict(review, F.concat(F.lit(key + ":"), c("verdict.tag")), key))))
    return out


def clean_biometric() -> Column:
    """Whether there is a biometric reading and every reading of every trusted text is clean."""
    texts = F.concat(F.array("combined_text"), F.col("image_ocr.text"))
    count = lambda k: F.aggregate(texts, F.lit(0), lambda s, t: s + X.biometric_reads(t)[k])
    return (count(0) > 0) & (count(0) == count(1))


def final(config: Config = CONFIG) -> Column:
    """The final verdict over fields, verdict, bundle and grade: upgrades first, then guards of approvals."""
    tag, grade, up = F.col("verdict.tag"), F.col("grade"), []
    key = "R_A1_non_dip_waived_biometric_clean"
    if config.biometric_upgrade:
        up.append(F.when((tag == "R_A1_non_dip_waived_TO_REVIEW") & clean_biometric(), X.verdict("APPROVED", key, key)))
    if config.unpaid_waiver_upgrade:
        key = "R3_unpaid_biometric_waiver"
        up.append(F.when((tag == "R3_unpaid") & clean_biometric(), X.verdict("APPROVED", key, key)))
    if config.fallback_ocr_upgrade:
        up.append(F.when((tag == "FALLBACK_extraction_fail") & ~grade["tag"].startswith("ocr_revoked_sponsor"), grade))
    stop = F.col("verdict.adj") != "APPROVED"
    if config.finding_bypass:
        stop = stop | tag.startswith("R_ADJUDICATOR_FINDING")
    return F.coalesce(*up, F.when(stop, F.col("verdict")), *[g for _, g in guards(config)], F.col("verdict"))


def apply_policy(rows: DataFrame, config: Config = CONFIG) -> DataFrame:
    """rows (fields, verdict and bundle) with `grade` and `final`."""
    # several stages look at the grade: it is made once
    return rows.withColumn("grade", X.ocr_grade(F.col("ocr_text"))).withColumn("final", final(config))


def sweep(rows: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """rows with `config` and its `final`, a row for each config: the cases are made once."""
    each = F.array(*[F.struct(F.lit(n).alias("config"), final(c).alias("final")) for n, c in configs.items()])
    return rows.drop("final").withColumn("__each", F.explode(each)).select("*", "__each.config", "__each.final").drop("__each")


def complete(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """One prediction for each of cases, in case order: those that have none (no source could be read) get the defaults, review, and the confidence of a failure."""
    out = cases.select("case_id").distinct().join(predictions, "case_id", "left")
    none = T.DEFAULTS | {"adjudication": "NEEDS_REVIEW", "confidence": T.CONFIDENCE["FALLBACK_extraction_fail"]}
    rows = out.select("case_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])
    # a sort reads its rows twice, for their bounds first: dealt out before, they are read again, not decided again
    return rows.repartition(F.xxhash64("case_id")).orderBy("case_id")


def predictions(decided: DataFrame) -> DataFrame:
    """The product's rows: fields with defaults for what is missing, adjudication and confidence."""
    return decided.select(
        "case_id", *[X.or_else(F.col(f), F.lit(T.DEFAULTS[f])).alias(f) for f in T.FIELDS],
        F.coalesce("final.adj", F.lit("NEEDS_REVIEW")).alias("adjudication"),
        F.coalesce("final.conf", F.lit(T.CONFIDENCE["FALLBACK_extraction_fail"])).alias("confidence"),
    )
