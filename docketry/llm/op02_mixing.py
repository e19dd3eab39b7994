"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length in words). Each source's budget takes every
document floor(target / size) times; what is left is fitted on the counts: first the same share
of every length, then the longest that still fit, then a bounded-knapsack dynamic program over
the lengths that are left. The counts so chosen are turned into documents by a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The dynamic program runs over budgets up to this many words; more is taken greedily before.
DP_WORDS = 1 << 15
#: A document is taken at most so many times.
MOST = 3
#: Rows of one (source, length, bucket) that one task ranks, about.
RANKED = 50_000


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length (distinct, positive) to take so that the sum comes near the budget, never above it."""
    order = np.argsort(-lengths, kind="stable")
    length, left = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    whole = int((length * left).sum())
    budget = max(0, min(int(budget), whole))
    take = np.array([int(c) * budget // whole for c in left], np.int64) if whole else np.zeros(len(left), np.int64)
    left = left - take
    rest = budget - int((length * take).sum())
    for k, size in enumerate(length.tolist()):
        if rest <= dp_words:
            break
        n = min(int(left[k]), (rest - dp_words) // size + (size <= rest))
        n = min(n, rest // size)
        take[k], left[k], rest = take[k] + n, left[k] - n, rest - n * size
    if rest:
        take += knapsack(length, left, rest)
    out = np.empty(len(order), np.int64)
    out[order] = take
    return out


def knapsack(length: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Counts whose sum is the largest one that does not exceed the budget: the bounded subset-sum program over bits."""
    mask, sums, items = (1 << (budget + 1)) - 1, 1, []
    for k in range(len(length)):
        size = int(length[k])
        n, part = min(int(left[k]), budget // size), 1
        while n > 0 and not sums >> budget:
            part = min(part, n)
            items.append((k, part, sums))
            sums |= (sums << (part * size)) & mask
            n, part = n - part, part * 2
        if sums >> budget:
            break
    at, take = sums.bit_length() - 1, np.zeros(len(length), np.int64)
    for k, part, before in reversed(items):
        if not before >> at & 1:
            take[k] += part
            at -= part * int(length[k])
    return take


def _fit_source(dp_words: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0]
        times = np.int64(pdf["whole_times"].iloc[0]) if len(pdf) else 0
        budget = int(round(pdf["target"].iloc[0])) - times * int(pdf["source_size"].iloc[0]) if len(pdf) else 0
        extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget, dp_words)
        return pd.DataFrame({"s": pdf["s"], "gone": pdf["gone"], "size": pdf["size"], "extra": extra})

    return run


def _ranked_sources(per_source: DataFrame) -> DataFrame:
    """per_source with `rank`, from 0, by code point of s (nulls, which `gone` marks, last); any number of sources."""
    spark = per_source.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = common.store(per_source.repartitionByRange(parts, "gone", "s").withColumn("part", F.spark_partition_id()), "sources")
    # one number for each partition
    before, at = {}, 0
    for r in sorted(dealt.groupBy("part").count().collect()):
        before[r["part"]], at = at, at + r["count"]
    start = F.coalesce(*[F.when(F.col("part") == k, F.lit(n)) for k, n in before.items()], F.lit(0))
    own = F.row_number().over(Window.partitionBy("part").orderBy("gone", "s"))
    return dealt.withColumn("rank", (start + own - 1).cast("long")).drop("part")


def _plan(per_source: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """per_source (s, gone, n, source_size) with target and whole_times: shares of all words by weight, none above `most` times its source, the excess dealt again."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1).cast("long")
    ranked = common.store(_ranked_sources(per_source).withColumn("w", weight).withColumn("cap", F.col("source_size") * most), "weights")
    total, rest_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    full = F.lit(False)
    rest = total
    while rest_w:
        # what a free source would get, until none of them gets more than it can hold
        over = F.lit(float(rest)) * F.col("w") / F.lit(float(rest_w)) > F.col("cap")
        if not ranked.filter(~full & over).take(1):
            break
        full = full | over
        caps, free = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("w")))).first()
        rest, rest_w = total - caps, free
    share = F.lit(float(rest)) * F.col("w") / F.lit(float(rest_w or 1))
    target = F.when(full, F.col("cap").cast("double")).otherwise(share)
    times = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(target / F.col("source_size")))).otherwise(0).cast("long")
    return common.store(ranked.select("s", "gone", "n", "source_size", target.alias("target"), times.alias("whole_times")), "plan")


@common.settled
def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    dp_words: int = DP_WORDS,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, times.

    size counts words; null text has 0 and is never taken more than 0 words (its `times` follow
    its source's whole part only). Sources are ordered by code point, null last and a source of
    its own; there may be any number of them. `taken` is times * size. What a source takes is short
    of its target, rounded, by less than the shortest of its documents that could be taken once more;
    of a rest of over `dp_words` words, what lies beyond them is filled in proportion and greedily first.
    Ties in length are broken by a seeded hash of the id; rows that repeat an id count alike. Texts
    are read whole. An empty table gives an empty result, and other columns are not read.
    """
    sized = common.store(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"),
            F.col(source_col).isNull().alias("gone"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )
    of = ["s", "gone"]
    counts = common.store(sized.groupBy(*of, "size").agg(F.count("*").alias("n")), "lengths")
    rows_in = counts.agg(F.sum("n")).first()[0] or 0
    if not rows_in:
        return sized.selectExpr("doc_id", "size", "size source_size", "cast(0 as double) target", "size taken", "cast(0 as long) times")
    plan = _plan(counts.groupBy(*of).agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, MOST)
    # a source's lengths meet in one task: as many rows as it has different lengths
    with_plan = common.skew_join(counts.withColumnRenamed("n", "many"), plan.select(*of, "source_size", "target", "whole_times", "n"), of, "n", rows_in)
    chosen = common.store(
        with_plan.withColumnRenamed("many", "n").groupBy(*of).applyInPandas(_fit_source(dp_words), "s string, gone boolean, size long, extra long"), "chosen"
    )
    # Documents of one (source, length) are ordered by a seeded hash. Its top bits are the bucket, so
    # buckets are in order and each one is ranked alone, however many documents share a length.
    fine = max(1, (rows_in // RANKED).bit_length())
    h = F.xxhash64(F.lit(seed), "doc_id")
    hashed = sized.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - fine))
    per_bucket = hashed.groupBy(*of, "size", "bucket").agg(F.count("*").alias("b"))
    before = F.sum("b").over(Window.partitionBy(*of, "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_bucket.withColumn("before", F.coalesce(before, F.lit(0)))
    # what a bucket takes is known before its documents are ranked
    starts = starts.join(chosen, [*of, "size"], "left")
    quota = F.greatest(F.lit(0), F.least(F.col("b"), F.coalesce("extra", F.lit(0)) - F.col("before")))
    starts = starts.select(*of, "size", "bucket", quota.alias("quota"))
    rank = F.row_number().over(Window.partitionBy(*of, "size", "bucket").orderBy("h", "doc_id"))
    out = hashed.withColumn("rank", rank).join(starts, [*of, "size", "bucket"])
    taken = common.store(out.select(*of, "doc_id", "size", (F.col("rank") <= F.col("quota")).alias("more")), "taken")
    out = common.skew_join(taken, plan, of, "n", rows_in)
    times = (F.col("whole_times") + F.when(F.col("more"), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, each row as often as the mix takes it (0 to 3 times).

    docs must hold each doc_id once; rows that repeat an id are all repeated alike.
    """
    often, own, turn = (common.fresh(docs, x) for x in ("times", "id", "turn"))
    times = mix(docs, **options).groupBy("doc_id").agg(F.max("times").alias(often)).withColumnRenamed("doc_id", own)
    out = docs.join(times.hint("merge"), docs[options.get("id_col", "doc_id")] == F.col(own)).filter(F.col(often) > 0)
    out = out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(often).cast("int"))))
    return out.select(*[f"`{c}`" for c in docs.columns])


__all__ = ["fit", "knapsack", "mix", "repeated"]
