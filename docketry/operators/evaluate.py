"""Evaluation: cross-tabs, calibration, scores, confusion, co-fire and shadow matrices, flows, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docketry import tables as T


#: Classes that every value of a feature is held against.
MOST_CLASSES = 1000


def base_rates(rows: DataFrame, cls: str) -> DataFrame:
    """(class, n, rate); the total is one row, which every class meets."""
    out = rows.groupBy(F.coalesce(F.col(cls).cast("string"), F.lit("?")).alias("class")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total")).withColumn("one", F.lit(1))
    return out.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select("class", "n", (F.col("n") / F.col("total")).alias("rate"))


def crosstab(rows: DataFrame, features: list[str], cls: str) -> DataFrame:
    """(feature, value, class, n); null features don't count."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])
    long = rows.select(F.coalesce(F.col(cls).cast("string"), F.lit("?")).alias("class"), F.explode(pairs).alias("p")).filter("p.value is not null")
    return long.groupBy("p.feature", "p.value", "class").agg(F.count("*").alias("n"))


def discrimination(tab: DataFrame, rates: DataFrame, least: int = 5) -> DataFrame:
    """(feature, score): the largest |p - base| * sqrt(n) of its values with enough rows.

    Every value meets every class, so classes have to be few; more than MOST_CLASSES are an error.
    """
    if rates.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    total = tab.groupBy("feature", "value").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    # a class that a value never has counts with p = 0
    cells = total.crossJoin(F.broadcast(rates.select("class", "rate")))
    p = cells.join(tab, ["feature", "value", "class"], "left").withColumn("p", F.coalesce("n", F.lit(0)) / F.col("total"))
    return p.groupBy("feature").agg(F.max(F.abs(F.col("p") - F.col("rate")) * F.sqrt("total")).alias("score"))


def lift(tab: DataFrame, rates: DataFrame, least: int = 3) -> DataFrame:
    total = tab.groupBy("feature", "value").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    p = tab.join(total, ["feature", "value"]).join(F.broadcast(rates.select("class", "rate")), "class").withColumn("p", F.col("n") / F.col("total"))
    out = p.groupBy("feature", "value").agg(F.max("total").alias("n"), F.max(F.abs(F.col("p") - F.col("rate"))).alias("max_lift"))
    return out.withColumn("starred", F.col("max_lift") > 0.30)


def rule_accuracy(rows: DataFrame) -> DataFrame:
    """rows: tag, rule_adj, final_adj, truth. Fires, kept, correct and wrong by tag, accuracy and empirical confidence."""
    kept = F.col("rule_adj") == F.col("final_adj")
    right = F.col("final_adj") == F.col("truth")
    out = rows.groupBy(F.substring_index("tag", "[", 1).alias("family")).agg(
        F.count("*").alias("fires"), F.count_if(kept).alias("kept"), F.count_if(kept & right).alias("correct"), F.count_if(kept & ~right).alias("wrong")
    )
    acc = F.coalesce(F.try_divide("correct", "kept"), F.lit(0.0))
    return out.withColumn("accuracy", acc).withColumn("empirical", F.least(F.lit(0.99), acc))


def brier(rows: DataFrame) -> DataFrame:
    """rows: confidence, truth, verdict. Mean squared error of the confidence, and 20 * max(0, 1 - 2 * it)."""
    hit = (F.col("verdict") == F.col("truth")).cast("double")
    b = F.avg((F.col("confidence") - hit) * (F.col("confidence") - hit))
    return rows.agg(F.count("*").alias("n"), b.alias("brier"), (20 * F.greatest(F.lit(0.0), 1 - 2 * b)).alias("calibration"))


def brier_delta(rows: DataFrame) -> DataFrame:
    """rows: key, confidence, is_correct. Mean squared error over all rows with each key's confidence, and with its accuracy (0.99 at most) instead."""
    per = rows.groupBy("key", "confidence").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("hit"))
    # a key's rows may differ in confidence, its accuracy is one
    acc = per.groupBy("key").agg((F.sum("hit") / F.sum("n")).alias("acc"), F.collect_list(F.struct("confidence", "n", "hit")).alias("c"))
    x = acc.select(F.least(F.lit(0.99), "acc").alias("e"), F.explode("c").alias("c")).select("e", "c.*")
    loss = lambda c: F.sum(F.col("hit") * (c - 1) * (c - 1) + (F.col("n") - F.col("hit")) * c * c) / F.sum("n")
    out = x.agg(F.sum("n").alias("n"), loss(F.col("confidence")).alias("before"), loss(F.col("e")).alias("after"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def weighted_loss(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, wrong, wrong_default, lost): rows that differ from the truth, those of them that show the default, and the points they cost of 50."""
    p = preds.select("case_id", *[F.col(f).alias(f"p_{f}") for f in T.FIELDS]).join(truth.select("case_id", *T.FIELDS), "case_id")
    cell = [
        F.struct(F.lit(f).alias("field"), (F.col(f"p_{f}") != F.col(f)).alias("bad"), (F.col(f"p_{f}") == T.DEFAULTS[f]).alias("default"), F.lit(float(T.WEIGHTS[f])).alias("w"))
        for f in T.FIELDS
    ]
    x = p.select(F.explode(F.array(*cell)).alias("x")).select("x.*")
    out = x.groupBy("field").agg(F.count_if("bad").alias("wrong"), F.count_if(F.col("bad") & F.col("default")).alias("wrong_default"), F.max("w").alias("w"), F.count("*").alias("n"))
    lost = F.col("wrong") / F.col("n") * F.col("w") / float(sum(T.WEIGHTS.values())) * 50
    # nine rows: the fields, the dearest first
    rank = F.rank().over(Window.orderBy(F.desc(F.col("wrong") * F.col("w"))))
    return out.select("field", "wrong", "wrong_default", lost.alias("lost"), rank.alias("rank"))


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and what is counted of them as they pass: `observation.get` holds it after an action, without another one."""
    seen = Observation(name)
    return rows.observe(seen, *[F.count_if(c).alias(n) for n, c in counts.items()]), seen


def with_counters(rows: DataFrame, seen: Observation) -> DataFrame:
    """rows with what a finished run counted, the same numbers in each row."""
    return rows.select("*", *[F.lit(v).cast("long").alias(k) for k, v in seen.get.items()])


def case_scores(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """What section_scores takes, and case_id: weights of the right fields, points of the verdict, squared error of the confidence."""
    p = preds.select("case_id", *[F.col(f).alias(f"p_{f}") for f in T.FIELDS], F.col("adjudication").alias("pred"), "confidence")
    j = truth.select("case_id", *T.FIELDS, "truth").join(p, "case_id", "left")
    right = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{f}") == F.col(f), w).otherwise(0) for f, w in T.WEIGHTS.items()])
    miss = F.col("confidence") - (F.col("pred") == F.col("truth")).cast("double")
    return j.select(
        "case_id", F.col("pred").isNotNull().alias("present"), right.alias("extraction_raw"), F.lit(sum(T.WEIGHTS.values())).alias("extraction_max"),
        payoff(F.col("truth"), F.col("pred")).alias("classification_raw"), F.lit(8).alias("classification_max"), (miss * miss).alias("confidence_brier"), "truth", "pred",
    )


def payoff(truth: Column, verdict: Column) -> Column:
    return reduce(lambda a, kv: a.when((truth == kv[0][0]) & (verdict == kv[0][1]), kv[1]), T.PAYOFF.items(), F.when(F.lit(False), 0)).otherwise(0)


def section_scores(scores: DataFrame, by: str = "split") -> DataFrame:
    """scores: split, present, extraction (+max), classification (+max), confidence_brier, truth, pred."""
    part = lambda a, b, k: k * F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), F.lit(0.0))
    missing = 10 * F.count_if(~F.col("present")) / F.count("*")
    mean = F.coalesce(F.avg("confidence_brier"), F.lit(1.0))
    out = scores.groupBy(by).agg(
        F.count("*").alias("n"), part("extraction_raw", "extraction_max", 50).alias("extraction"), part("classification_raw", "classification_max", 80).alias("classification"),
        (20 * F.greatest(F.lit(0.0), 1 - 2 * mean)).alias("calibration"), missing.alias("penalty"),
        F.count_if((F.col("truth") == "DENIED") & (F.col("pred") == "APPROVED")).alias("false_approvals"),
    )
    return out.withColumn("total", F.col("extraction") + F.col("classification") + F.col("calibration") - F.col("penalty"))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(truth).pivot(pred, T.VERDICTS).agg(F.count(F.lit(1))).na.fill(0)


def calibration_cube(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """rows: keys and is_correct. Support, accuracy and confidence (0.50 at least) of each cell with enough support."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct")).filter(F.col("n") >= least)
    return out.withColumn("accuracy", F.col("correct") / F.col("n")).withColumn("confidence", F.greatest(F.lit(0.5), F.col("correct") / F.col("n")))


def correctness_cube(rows: DataFrame, field: str, source: str, bucket: str) -> DataFrame:
    """Correctness by field, and by field, source and bucket, in one pass of grouping sets."""
    g = rows.groupingSets([[F.col(field)], [F.col(field), F.col(source), F.col(bucket)]], F.col(field), F.col(source), F.col(bucket))
    return g.agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct")).select(field, F.coalesce(source, F.lit("all")).alias(source), F.coalesce(bucket, F.lit("all")).alias(bucket), "n", "correct")


def cofire(rows: DataFrame, named: list[tuple[str, Column]], key: str = "fired") -> DataFrame:
    """rows with the sorted array of names that hold."""
    return rows.withColumn(key, F.array_sort(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())))


def pairs(fired: DataFrame, least: int = 1, extra: list[str] | None = None) -> DataFrame:
    """(a, b, n) of names that fire together, a < b: pairs within a row's few names, no self-join."""
    e = fired.select(F.explode("fired").alias("a"), "fired", *(extra or []))
    e = e.select("a", F.explode(F.filter("fired", lambda x: x > F.col("a"))).alias("b"), *(extra or []))
    return e.groupBy("a", "b", *(extra or [])).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def length_stats(rows: DataFrame, col: str, by: list[str]) -> DataFrame:
    n = F.length(col)
    return rows.filter(F.coalesce(F.col(col), F.lit("")) != "").groupBy(*by).agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.avg(n).alias("mean"))


def edges(rows: DataFrame, col: str, n: int, k: int) -> DataFrame:
    """The k commonest prefixes and suffixes of n characters."""
    ends = F.array(F.struct(F.lit("prefix").alias("side"), F.substring(col, 1, n).alias("gram")), F.struct(F.lit("suffix").alias("side"), F.right(F.col(col), F.lit(n)).alias("gram")))
    c = rows.filter(F.length(col) >= n).select(F.explode(ends).alias("e")).groupBy("e.side", "e.gram").agg(F.count("*").alias("n"))
    # counts first: the window ranks distinct grams, not rows, and keeps k of them by task before
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= k).drop("rank")


def flow(old: DataFrame, new: DataFrame, truth: DataFrame, verdict: str = "adjudication") -> DataFrame:
    """(truth, was, now, n) of cases whose verdict differs between two runs."""
    j = old.select("case_id", F.col(verdict).alias("was")).join(new.select("case_id", F.col(verdict).alias("now")), "case_id").join(truth.select("case_id", "truth"), "case_id")
    return flowed(j)


def flowed(rows: DataFrame) -> DataFrame:
    """The same of rows (truth, was, now) that hold both verdicts of a case already."""
    return rows.filter("was <> now").groupBy("truth", "was", "now").agg(F.count("*").alias("n"))


def field_changes(old: DataFrame, new: DataFrame, truth: DataFrame) -> DataFrame:
    """(field, outcome, n) of the fields that differ between two runs."""
    wide = lambda d, n: d.select("case_id", F.struct(*T.FIELDS).alias(n)).hint("merge")
    return outcomes(wide(old, "a").join(wide(new, "b"), "case_id").join(wide(truth, "t"), "case_id"))


def outcomes(rows: DataFrame) -> DataFrame:
    """The same of rows (a, b, t), structs of a case's old, new and true fields: cases meet as one row, only fields that differ become rows."""
    cells = F.array(*[F.when(F.col(f"a.{f}") != F.col(f"b.{f}"), F.struct(F.lit(f).alias("field"), *[F.col(f"{n}.{f}").alias(n) for n in "abt"])) for f in T.FIELDS])
    j = rows.select(cells.alias("cells")).select(F.explode(F.concat("cells")).alias("x")).filter("x is not null").select("x.*")
    out = F.when(F.col("b") == F.col("t"), "right").when(F.col("a") == F.col("t"), "was_right_now_wrong").otherwise("wrong_to_wrong")
    return j.groupBy("field", out.alias("outcome")).agg(F.count("*").alias("n"))


def emission_violations(preds: DataFrame) -> DataFrame:
    """(rule, n) of approvals that a denying condition contradicts."""
    c = F.col
    conds = [
        ("hard_embargo", c("home_world").isin(*T.HARD_EMBARGO)), ("transit", c("visa_class") == "TRANSIT-7"),
        ("disqualifier", c("risk_flags").rlike("|".join(T.DISQUALIFYING))), ("revoked", c("sponsor_id").isin(*T.REVOKED) & (c("visa_class") != "DIP-1")),
        ("unpaid", c("fee_status") == "unpaid"),
    ]
    e = preds.filter("adjudication = 'APPROVED'").select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), x.cast("long").alias("hit")) for n, x in conds])).alias("e"))
    return e.groupBy("e.rule").agg(F.sum("e.hit").alias("n"))
