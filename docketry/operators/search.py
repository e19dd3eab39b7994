"""Many fixed phrases in many texts: one automaton, one walk over each text, whatever the number of phrases."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in one automaton; more phrases make more automata, and each text is walked once for each of them.
AUTOMATON = 16 << 20
_numbers = itertools.count()
_built: dict[int, object] = {}


def _automaton(number: int, phrases: list[str]):
    """The automaton of broadcast phrases; a worker builds it once and keeps the last one."""
    if number not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases):
            made.add_word(f" {phrase} ", k)
        made.make_automaton()
        _built[number] = made
    return _built[number]


def _walked(sent: Broadcast):
    number = next(_numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        if not phrases:
            return
        automaton = _automaton(number, phrases)
        for batch in batches:
            uses, texts = Counter(), Counter()
            for text in batch.column(0).to_pylist():
                here = Counter(k for _, k in automaton.iter(f" {text} "))
                uses.update(here)
                texts.update(here.keys())
            if uses:
                keys = list(uses)
                columns = [pa.array([phrases[k] for k in keys]), pa.array([uses[k] for k in keys], pa.int64()), pa.array([texts[k] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["phrase", "n", "texts"])

    return run


def spaced(c: Column) -> Column:
    """A text with one space for each run of white space, none at its ends."""
    return F.btrim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))


def count_phrases(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """(phrase, n, texts) of the phrases that occur: all occurrences, overlaps too, and the texts that have some.

    A phrase is found where white space or an end of the text is on both sides; runs of white space
    count as one space. Empty and null phrases and texts match nothing, repeated phrases count once.
    Phrases are dealt to automata of AUTOMATON bytes, so what is broadcast has that bound.
    """
    spark = texts.sparkSession
    known = phrases.select(spaced(F.col(phrase)).alias("phrase")).filter("phrase <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    parts = max(1, -(-size // AUTOMATON))
    rows = texts.select(spaced(F.col(text)).alias("t")).filter("t <> ''")
    found = None
    for part in range(parts):
        mine = known.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        one = rows.mapInArrow(_walked(spark.sparkContext.broadcast([r["phrase"] for r in mine.collect()])), "phrase string, n long, texts long")
        found = one if found is None else found.unionByName(one)
    return found.groupBy("phrase").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
