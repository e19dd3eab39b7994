"""From sources to decided cases: packets, sources, signals, cases, one module for each change of grain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.config import CONFIG, Config
from docketry.operators import decide, resolve, trust
from docketry.sources import ocr

from . import synth


@dataclass(frozen=True)
class Rereads:
    """What failed image values are read again with: the engine, and images as ocr.late_images() takes them."""

    engine: ocr.Engine
    images: DataFrame
    folder: str | None = None


def decided(sources: DataFrame, config: Config = CONFIG, rereads: Rereads | None = None) -> DataFrame:
    """One row for each case: fields, provenance, agreement, bundle, verdict and final.

    The sources are searched where they are and shuffled once, by case; all that follows is in the case's row. With `rereads`, image values
    that lack their form are read again before the signals of their case are resolved, so each case
    is decided once; only the failing keys meet the images.
    """
    return decided_of(trust.apply_filters(sources), config, rereads)


def decided_of(filtered: DataFrame, config: Config = CONFIG, rereads: Rereads | None = None) -> DataFrame:
    """`decided` of sources that are filtered already."""
    bundle = resolve.emitted(filtered, config)
    if rereads is not None and config.reread:
        signals = resolve.signals(bundle, config)
        signals = ocr.with_rereads(signals, ocr.reread(signals, rereads.images, rereads.engine, rereads.folder))
        cases = resolve.consolidate(signals, bundle.drop("signals"))
    else:
        cases = resolve.consolidated(bundle)
    return decide.apply_policy(decide.adjudicate(cases), config)


def synthetic(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> DataFrame:
    return decided(synth.sources(spark, sf_dir), config)


def synthetic_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, the true fields and the rules' verdict of them as truth."""
    return decide.adjudicate(synth.truth(spark, sf_dir)).withColumn("truth", F.col("verdict.adj")).drop("verdict", "finding")
