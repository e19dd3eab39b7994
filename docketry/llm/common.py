"""Shared parts: scratch tables, joins on skewed keys, connected components.

Scratch tables are Parquet folders under ``spark.checkpoint.dir``, which every executor
and the driver share, so a lost executor never takes intermediate rows with it.
"""

from __future__ import annotations

import contextlib
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.shared import shared_dir

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys above this share of all rows (and above HOT_ROWS rows) are hot: at most 1 / HOT_SHARE keys.
HOT_SHARE, HOT_ROWS = 1e-3, 1000

#: Bytes of a batch that goes to Python, about; rows alone would let long texts make batches of any size.
BATCH_BYTES = 4 << 20

_state = threading.local()


def _tables() -> list[tuple[SparkSession, str]]:
    """The scratch tables that this thread has made and not deleted."""
    if not hasattr(_state, "tables"):
        _state.tables = []
    return _state.tables


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one batch hands to Python by bytes, unless the session already does."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "2147483647")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docketry-{name}-{uuid.uuid4().hex}"
    _tables().append((spark, path))
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to a scratch table and read it back: cuts the lineage and computes it once."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scope() -> Iterator[list[tuple[SparkSession, str]]]:
    """Lists the scratch tables that this thread makes inside, and keeps them out of any scope around.

    Whoever opened the scope may release() them when every frame built on them has been written; what
    was made outside stays.
    """
    outer, mine = _tables(), []
    _state.tables = mine
    try:
        yield mine
    finally:
        _state.tables = outer


def release(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete these scratch tables."""
    while tables:
        delete(*tables.pop())


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written to one scratch table and all its other ones deleted.

    What a run leaves behind is then as large as its result, and other frames' tables stay.
    """

    @functools.wraps(operator)
    def run(*args, **options) -> DataFrame:
        begin = len(_tables())
        out = operator(*args, **options)
        out = store(out, operator.__name__)
        for k in range(len(_tables()) - 2, begin - 1, -1):
            delete(*_tables().pop(k))
        return out

    return run


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def with_ids(docs: DataFrame, id_col: str = "doc_id", last: bool = True) -> tuple[DataFrame, Callable[[Column], Column]]:
    """docs with an id of its own for each row that has none, and a function that makes these ids null again.

    The new ids are after all others, or before them if not `last`. Ids at the very end of the long
    range leave no room, which is an error and no silent loss.
    """
    none = docs.filter(F.col(id_col).isNull())
    if not none.take(1):
        return docs, lambda c: c
    end = docs.agg(F.max(id_col) if last else F.min(id_col)).first()[0] or 0
    n = F.monotonically_increasing_id()
    made = F.lit(end).cast("long") + 1 + n if last else F.lit(end).cast("long") - 1 - n
    # stored, so that a row keeps its id
    own = store(none.withColumn(id_col, made), "ids")
    return docs.filter(F.col(id_col).isNotNull()).unionByName(own), lambda c: F.when(c <= end if last else c >= end, c)


def hot_limit(total: int) -> int:
    """More rows than this make a key hot; fewer than 1 / HOT_SHARE keys can have so many."""
    return max(HOT_ROWS, int(total * HOT_SHARE))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row for each key and the key's rows in left as `size`.

    The hot keys, of which there are fewer than 1 / HOT_SHARE whatever the input, are broadcast,
    so their left rows stay where they are; all other rows meet in a shuffle. `size` is dropped.
    left is read twice and should be cheap to read. Null keys match nothing.
    """
    limit = hot_limit(total)
    hot = right.filter(F.col(size) > limit).drop(size)
    cold = right.filter(F.col(size) <= limit).drop(size)
    if total <= limit:
        return left.join(cold, on)
    there = left.join(F.broadcast(hot), on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return there.unionByName(rest.join(cold, on))


def components(edges: DataFrame, total: int | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b: long); component is the smallest node reached.

    Large-star and small-star steps alternate until all edges are stars; each step's edges go to a
    scratch table. The number of edges never grows, and a hub's edges are spread by skew_join.
    """
    e = store(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges"
    )

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        low = low.withColumn("m", F.least("m", "a")) if large else low
        out = skew_join(both, low, ["a"], "k", rows)
        if large:
            # every neighbour above the node moves to the smallest one around it
            out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            # every neighbour below, and the node itself, move to the smallest one
            out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.filter("a > b").distinct()

    def state(e: DataFrame) -> tuple:
        """Edges, and whether each is part of a star around its smallest node, which is what the steps end in."""
        ends = F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = e.select(F.inline(ends)).groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        count, most = seen.agg(F.sum("up"), F.max(F.col("up") + F.col("down"))).first()
        return count or 0, (most or 0) < 2

    while True:
        count, done = state(e)
        if done:
            break
        rows = 2 * count
        e = store(star(store(star(e, True), "large"), False), "small")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()


def scan(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """The states of a machine after each item, in order: step(state, item) makes the next one from `start`.

    `kind` is a state's type. Items are gone through in blocks, so that the states found so far are
    not copied for each item.
    """
    none = F.array().cast(f"array<{kind}>")
    one = lambda s, x: F.transform(F.array(step(s["at"], x)), lambda t: F.struct(t.alias("at"), F.array_append(s["out"], t).alias("out")))[0]
    part = lambda s, b: F.aggregate(F.slice(items, b * block + 1, F.lit(block)), F.struct(s["at"].alias("at"), none.alias("out")), one)
    many = lambda s, b: F.transform(F.array(part(s, b)), lambda p: F.struct(p["at"].alias("at"), F.array_append(s["out"], p["out"]).alias("out")))[0]
    blocks = F.sequence(F.lit(0), F.floor(F.size(items) / block).cast("int"))
    return F.aggregate(blocks, F.struct(start.cast(kind).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out")), many, lambda s: F.flatten(s["out"]))


def buckets(rows: int, each: int) -> int:
    """How many buckets keep about `each` rows in one."""
    return max(1, -(-rows // each))
