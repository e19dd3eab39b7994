"""Line dedup by distinct-site spread.

Every line is hashed; a HyperLogLog sketch of the sites that have it merges by aggregation. Lines
whose estimate is far below or above the threshold are decided by it; lines near the threshold
get an exact distinct count. Lines that stand on `min_sites` sites or more are boilerplate and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Sites from which a line is boilerplate, the sketch's registers (2 ** LG_K), and the band around
#: the threshold (in standard errors of the sketch) within which sites are counted exactly.
MIN_SITES, LG_K, BAND = 10, 10, 8


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_dropped, text (what stays, joined by newlines).

    Lines are separated by newlines and compared after trimming ASCII spaces and tabs; lines empty
    by that stay and never count. A null site counts as no site. Null text counts as empty and
    gives empty text. Rows that repeat an id, or have none, are handled alone. Texts with any number
    of lines, all of them dropped or not, take time in proportion. An empty table gives an empty result.
    """
    rows = common.store(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(site_col).cast("string").alias("site"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).withColumn("at", F.monotonically_increasing_id()),
        "rows",
    )
    gone = _dropped(rows, min_sites, lg_k, band)
    parts = F.split("text", "\n", -1)
    out = rows.join(gone, "at", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    out = out.select("doc_id", "text", "gone", parts.alias("parts"))
    # what lies between two dropped lines stays: a walk along both, no search for each line
    begin = lambda k: F.when(k > 0, F.get("gone", k - 1) + 2).otherwise(1)
    end = lambda k: F.coalesce(F.get("gone", k), F.size("parts"))
    between = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("parts", begin(k), end(k) - begin(k) + 1))
    stays, parts = F.array_join(F.flatten(between), "\n"), F.col("parts")
    return out.select(
        "doc_id", F.size(parts).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(stays).alias("text"),
    )


@common.settled
def _dropped(rows: DataFrame, min_sites: int, lg_k: int, band: float) -> DataFrame:
    """(at, gone) of the rows (at, site, text) that lose lines: the places of these lines, from 0, in order."""
    key = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.when(F.btrim(x, F.lit(" \t")) == "", None).otherwise(F.struct(F.xxhash64(F.btrim(x, F.lit(" \t"))).alias("a"), F.xxhash64(F.lit(1), F.btrim(x, F.lit(" \t"))).alias("b"))),
    )
    lines = common.store(rows.select("at", "site", F.posexplode(key).alias("pos", "k")).filter("k is not null").select("at", "site", "pos", "k.a", "k.b"), "lines")
    error = 1.1 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - band * error), min_sites / max(1e-9, 1 - band * error) if band * error < 1 else float("inf")
    spread = lines.filter("site is not null").groupBy("a", "b").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("uses"))
    # fewer rows than sites can't reach the threshold
    spread = spread.filter(F.col("uses") >= min_sites).select("a", "b", "uses", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = common.store(spread.filter(F.col("sites") >= int(low)), "spread")
    sure = spread.filter(F.col("sites") > high).select("a", "b")
    near = spread.filter(F.col("sites") <= high)
    total = lines.count()
    exact = (
        common.skew_join(lines, near.select("a", "b", "uses"), ["a", "b"], "uses", total)
        .filter("site is not null").groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
        .groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("a", "b")
    )
    boiler = common.store(sure.unionByName(exact).join(spread.select("a", "b", "uses"), ["a", "b"]), "boiler")
    return common.skew_join(lines, boiler, ["a", "b"], "uses", total).groupBy("at").agg(F.array_sort(F.collect_list("pos")).alias("gone"))
