"""A corpus pipeline of five stages, each one operator of docketry.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All stages but the last return the columns of docs. Rows with
a null doc_id are documents of their own: where rows with an id are their equals, those stay.
"""

from __future__ import annotations

import functools
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common, op02_mixing, op03_langid, op05_exact, op06_minhash, op10_packing


_own = threading.local()


def _clear() -> None:
    """Delete the scratch tables of this thread's stages before: their results have been written."""
    common.release(_own.__dict__.setdefault("tables", []))


def staged(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose scratch tables go when the next stage begins; tables of anything else stay."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear()
        with common.scope() as made:
            out = stage(spark, docs, sf_dir)
        _own.tables += made
        return out

    return run


@staged
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; others, null texts and texts without letters go.

    Empty tables give empty ones. Each row is judged alone, so repeated rows and rows without an id
    stay or go alike. Without any labelled text no language is known and no row stays.
    """
    return op03_langid.accepted(docs, op03_langid.train(docs.filter(~op03_langid.held_out())))


@staged
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts, null counting as empty.

    Rows that repeat an id and a text, where that id is the largest, all stay. Empty tables give
    empty ones; texts of any length are compared whole.
    """
    docs, own_id = common.with_ids(docs, last=False)
    key, sha = common.fresh(docs, "id"), common.fresh(docs, "sha")
    stays = op05_exact.exact_groups(docs).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    # a doc_id may repeat with other texts, so a row is known by its id and its text
    same = (docs["doc_id"] == F.col(key)) & (F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col(sha))
    # the same plan at every size: ids that fit a broadcast here don't on a corpus
    return docs.join(stays.hint("merge"), same, "left_semi").withColumn("doc_id", own_id(F.col("doc_id")))


@staged
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null, empty and wordless texts are near nothing and stay; rows that repeat an id stay or go
    together. Empty tables give empty ones; texts of any length are compared whole.
    """
    docs, own_id = common.with_ids(docs)
    key = common.fresh(docs, "id")
    stays = op06_minhash.near_groups(docs).filter("kept").select(F.col("doc_id").alias(key))
    return docs.join(stays.hint("merge"), docs["doc_id"] == F.col(key), "left_semi").withColumn("doc_id", own_id(F.col("doc_id")))


@staged
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, 0 to 3 times.

    A null source is a source of its own; of equal lengths a seeded hash of the id decides. Rows
    that repeat an id are taken alike; empty tables give empty ones.
    """
    docs, own_id = common.with_ids(docs)
    return op02_mixing.repeated(docs).withColumn("doc_id", own_id(F.col("doc_id")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 4096 tokens.

    Null texts count as empty and have one piece, their end; longer texts than a sequence are cut.
    Repeated rows are packed each; empty tables give empty ones.
    """
    _clear()
    return op10_packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Language models, seeded choices and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{common.shared_dir(spark)}/docketry-pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        # a stage's table is needed by the next one only
        if last:
            common.delete(spark, last)
        docs, last = spark.read.parquet(f"{at}/{name}"), f"{at}/{name}"
    _clear()
    out = STAGES[-1][1](spark, docs, sf_dir)
    # the last stage's rows are in a table of their own
    common.delete(spark, at)
    return out
