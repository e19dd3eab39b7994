"""Joins by prefix and by range as equi joins, for tables of any size and without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a range are powers of this many bits: a value lies in one cell of each size, a range in few.
BITS = 4
LEVELS = 64 // BITS


def longest_prefix(rows: DataFrame, key: str, table: DataFrame, prefix: str = "prefix") -> DataFrame:
    """rows with the columns of the table's row whose prefix is the longest that key begins with, null if there is none.

    Only the distinct keys are cut, at the lengths that prefixes have, and what is found joins the rows
    again by key. A whole key is its own longest prefix; an empty prefix fits every key that isn't null. Of
    rows of the table with one prefix the least counts. The table's other columns must not be named like
    those of rows; null keys and null prefixes match nothing.
    """
    rest = [c for c in table.columns if c != prefix]
    entry = F.struct(F.lit(True).alias("__hit"), *rest)
    known = table.filter(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("__p")).agg(F.min(entry).alias("__e"))
    # as many numbers as there are lengths
    lengths = sorted(r[0] for r in known.select(F.length("__p")).distinct().collect())
    keys = rows.select(F.col(key).alias("__k")).filter("__k is not null").distinct()
    sizes = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("__k"))
    cut = keys.withColumn("__n", F.explode(sizes)).withColumn("__p", F.substr("__k", F.lit(1), F.col("__n")))
    best = cut.join(known, "__p").groupBy("__k").agg(F.max_by("__e", "__n").alias("__e"))
    out = rows.join(best, rows[key] == F.col("__k"), "left")
    return out.select(*[rows[c] for c in rows.columns], *[F.col(f"__e.{c}").alias(c) for c in rest])


def _number(c: Column, kind: str, step: float) -> Column:
    """A whole number in the order of the values; different values may share one."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.floor(c / F.lit(step)).cast("long")


def _cells(first: Column, last: Column) -> Column:
    """(level, cell) of the few cells that together make up the whole numbers from first to last, each of them once."""

    def at(level: Column) -> tuple[Column, Column]:
        # the first cell that begins in the range, and the first that doesn't end in it
        bits = level * BITS
        return -F.call_function("shiftright", -first, bits.cast("int")), F.call_function("shiftright", last + 1, bits.cast("int"))

    none = F.array().cast("array<bigint>")

    def level_cells(level: Column) -> Column:
        lo, end = at(level)
        up, up_end = at(level + 1)
        deeper = (level < LEVELS - 1) & (up < up_end)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
        left = run(lo, F.when(deeper, F.shiftleft(up, BITS)).otherwise(end))
        right = F.when(deeper, run(F.shiftleft(up_end, BITS), end)).otherwise(none)
        return F.transform(F.concat(left, right), lambda c: F.struct(level.alias("level"), c.alias("cell")))

    # a level counts if the one below leaves something to it
    def used(level: Column) -> Column:
        lo, end = at(level)
        return lo < end

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda n: F.when(used(n), level_cells(n)).otherwise(F.array().cast("array<struct<level:int,cell:bigint>>"))))


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi", step: float = 1.0) -> DataFrame:
    """The pairs of rows and ranges with lo <= value < hi: the columns of both, which must differ.

    A range is cut into few cells of 16 ** level numbers, a value lies in one cell of each level, and rows
    and ranges meet by an equi join on their cells; the exact bounds are looked at last. So ranges may
    overlap and be as long as they like. Small tables of ranges are broadcast, which Spark decides by
    their size; else both sides are shuffled by cell, and cells with many rows are split as skewed.
    Values are dates, timestamps, whole numbers, or others in steps of `step`. Empty ranges, null
    bounds and null values match nothing.
    """
    kind = dict(rows.dtypes)[value]
    fit = ranges.filter(F.col(lo) < F.col(hi))
    cells = fit.withColumn("__c", F.explode(_cells(_number(F.col(lo), kind, step), _number(F.col(hi), kind, step)))).select(*ranges.columns, "__c.level", "__c.cell")
    cells = cells.withColumnsRenamed({"level": "__level", "cell": "__cell"})
    # at most as many numbers as there are levels
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())
    number = _number(F.col(value), kind, step)
    each = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(number, n * BITS).alias("cell")) for n in levels]) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    points = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.explode(each))
    hit = (F.col("__v.level") == F.col("__level")) & (F.col("__v.cell") == F.col("__cell"))
    return points.join(cells, hit).filter((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).select(*rows.columns, *ranges.columns)
