"""Signals: emission in tiers, and consolidation of competing signals to one value a field."""

from __future__ import annotations

import difflib
import functools
import re
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import tables as T
from docketry.config import CONFIG, Config
from docketry.functions import text as X

from . import trust

#: (field, label, allowed values) of the labels that are searched when they are misread.
FUZZY_LABELS = [
    ("visa_class", "Visa Class", T.VISAS), ("home_world", "Home World", None), ("species_code", "Species Code", None),
    ("applicant_name", "Applicant", None), ("arrival_date", "Arrival Date", None), ("declared_purpose", "Declared Purpose", None),
]
#: What signals are of.
KEYS = [*T.FIELDS, "finding"]
#: A text's candidates of a key: what decides comes first, so the largest wins. text: whether its source is a text.
_CANDIDATES = "array<struct<confidence:double,source_id:string,order:bigint,value:string,tag:string,text:boolean>>"
SIGNAL = "case_id string, seq long, type string, key string, value string, source_id string, confidence double, tag string"


def _seq(tier: int, ordinal: Column | int, step: int, key: Column | int) -> Column:
    ordinal, key = (F.lit(x) if isinstance(x, int) else x for x in (ordinal, key))
    return ((F.lit(tier).cast("long") * 100_000 + ordinal) * 10 + step) * 100 + key


def signals(bundle: DataFrame, config: Config = CONFIG) -> DataFrame:
    """All signals of all cases, from the bundles: those that `emitted` gave them, else every text is searched once, and one array of candidates a text is exploded."""
    rows = bundle
    if "signals" not in bundle.columns:
        whole = F.struct(F.lit("COMBINED").alias("kind"), F.lit(0).alias("ordinal"), F.lit("combined_text").alias("source_id"), F.col("combined_text").alias("content"), F.lit(0).alias("level"))
        texts = bundle.select("case_id", F.explode(F.concat(F.array(whole), "sources")).alias("s")).select("case_id", "s.*")
        rows = candidates(texts, "content", config).withColumnRenamed("found", "signals")
    # a column of its own, and exploded by concat: Spark compiles no argument of a generator, and from a plain column it would infer a filter and make the signals again for it
    keyed = [F.arrays_zip(F.col(f"signals.{k}").alias("c"), F.array_repeat(F.lit(k), F.size(_last(f"signals.{k}"))).alias("key")) for k in KEYS]
    rows = rows.select("case_id", F.concat(*keyed).alias("found"))
    one = rows.select("case_id", F.explode(F.concat("found")).alias("x"))
    type_ = F.when(F.col("x.key") == "finding", "ADJUDICATOR_FINDING").otherwise("FIELD_VALUE")
    return one.select("case_id", (-F.col("x.c.order")).alias("seq"), type_.alias("type"), "x.key", "x.c.value", "x.c.source_id", "x.c.confidence", "x.c.tag")


def _last(name: str) -> Column:
    """A column, that of findings by `stepwise`: one of a step is enough to make small methods of it."""
    return X.stepwise(F.col(name)) if name.endswith(".finding") else F.col(name)


def emitted(filtered: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Bundles with `signals`, a struct of the candidates of each key in all texts of the case.

    Sources are searched before the shuffle by case and bring what was found with them, the combined text after
    it, in the case's row: nothing has to be gathered again, and the Python search, behind which Spark
    forgets how rows are spread, comes before there is anything to forget.
    """
    live = F.col("trusted") & ~X.blank(F.col("content"))
    rows = candidates(filtered.withColumn("__text", F.when(live, F.col("content")).otherwise("")), "__text", config)
    bundle = trust.bundles(rows.drop("__text"))
    kept = [c for c in bundle.columns if c != "found"]
    whole = {"kind": F.lit("COMBINED"), "ordinal": F.lit(0), "source_id": F.lit("combined_text"), "level": F.lit(0)}
    cases = candidates(bundle.withColumnRenamed("found", "__found").withColumns(whole), "combined_text", config, images=False)
    of = lambda k: F.concat(f"found.{k}", F.flatten(f"__found.{k}"))
    return cases.select(*kept, F.struct(*[of(k).alias(k) for k in KEYS]).alias("signals"))


def candidates(rows: DataFrame, text: str, config: Config = CONFIG, images: bool = True) -> DataFrame:
    """rows (kind, ordinal, source_id, level and the column `text`) with `found`, a struct of the text's candidates of each key.

    images=False: no row is an image, so what is looked for in images only is left out.
    """
    kept = rows.columns
    level = F.create_map(*[F.lit(x) for kv in T.LEVEL_CONFIDENCE.items() for x in kv])
    rows = X.with_fields(rows.withColumn("low", F.lower(text)), text, low="low")
    content, kind, low = F.col(text), F.col("kind"), F.col("low")
    combined, image = kind == "COMBINED", kind == "IMAGE"
    own = F.when(combined, 1.0).otherwise(level[F.col("level")])
    at = lambda step, k: _seq(2, F.when(image, F.col("ordinal") + 1000).otherwise(F.col("ordinal")), step, k)

    out: dict[str, list[Column]] = {k: [] for k in KEYS}

    def signal(when: Column, seq: Column, key: str, value: Column, conf: Column, tag: Column | str = "") -> None:
        # arrays of one or none: together they hold no nulls, which only a lambda would take out
        tag, source = F.lit(tag) if isinstance(tag, str) else tag, F.col("source_id")
        one = F.struct(conf.alias("confidence"), source.alias("source_id"), (-seq).alias("order"), value.alias("value"), tag.alias("tag"), (X.source_class(source) == "text").alias("text"))
        out[key].append(F.when(when, F.array(one)).otherwise(F.array().cast(_CANDIDATES)))

    if config.fuzzy_flags and images:
        rows = rows.withColumn("seen", F.when(image & (F.col("fields.risk_flags") == "none"), X.stepwise(X.fuzzy_flags(content, low))).otherwise(""))
    if config.fuzzy_sponsor and images:
        unread = image & ~(F.contains(content, F.lit("SPN-")) & content.rlike(T.P["sponsor"]))
        rows = rows.withColumn("restored", F.when(unread, X.lookalike_sponsor(content)).otherwise(""))
    for k, f in enumerate(T.FIELDS):
        v = F.col(f"fields.{f}")
        value = X.normalized(f, v) if config.normalize_values else v
        conf = F.when(combined & (value == "unknown"), T.UNKNOWN_FEE_CONFIDENCE).otherwise(own) if f == "fee_status" else own
        signal(X.valid(f, v), F.when(combined, _seq(0, 0, 0, k)).otherwise(at(0, k)), f, value, conf)
    signal(combined & (F.col("fields.finding") != ""), _seq(1, 0, 0, 0), "finding", X.stepwise(F.col("fields.finding")), F.lit(T.FINDING_CONFIDENCE))
    if config.fuzzy_flags and images:
        v = F.col("seen")
        signal(v != "", at(1, 0), "risk_flags", v, F.lit(T.FUZZY_CONFIDENCE), F.concat(F.lit("fuzzy_flags:"), v))
    if config.fuzzy_sponsor and images:
        v = F.col("restored")
        signal(v != "", at(2, 0), "sponsor_id", v, F.lit(T.FUZZY_CONFIDENCE), F.concat(F.lit("fuzzy_sponsor:"), v))
    if config.fuzzy_labels and images:
        labels = fuzzy_labels(config)
        # one bit for each label that a text lacks
        missing = reduce(lambda a, b: a + b, [F.when(F.lower(X.strip(F.col(f"fields.{k}"))).isin("", "unknown"), 1 << i).otherwise(0) for i, (k, _, _) in enumerate(labels)])
        # the only Python here; texts that lack nothing, and those that are no images, don't travel
        rows = rows.withColumn("missing", F.when(image, missing)).withColumn("sought", F.when(F.col("missing") > 0, content))
        rows = rows.withColumn("late", _label_udf(config)("sought", "missing"))
        for i, (key, _, _) in enumerate(labels):
            v = F.coalesce(F.col(f"late.{key}"), F.lit(""))
            value = X.normalized(key, v) if config.normalize_values else v
            signal(X.valid(key, v), at(3, i), key, value, own, F.concat(F.lit(f"image_ocr_fuzzy_{key}:"), F.substring(v, 1, 20)))
    # made in a step of its own and without a lambda around it: Spark compiles no argument of a lambda or a generator
    return rows.select(*kept, F.struct(*[F.concat(*x).alias(k) for k, x in out.items()]).alias("found"))


def fuzzy_labels(config: Config = CONFIG) -> list[tuple[str, str, list[str] | None]]:
    return FUZZY_LABELS + ([("fee_status", "Fee Status", T.FEES[:3])] if config.fee_fuzzy_recovery else [])


def _windows(texts: list[str], label: str, least: float) -> dict[int, list[tuple[int, int, float]]]:
    """For each text, the windows (size, start, bound) that may be as like the label as `least`, by the letters they have in common.

    Windows are as long as the label, two shorter to two longer. All texts are gone through at once.
    """
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    ends = np.cumsum([len(c) for c in codes])
    all_, start = np.concatenate(codes), ends - [len(c) for c in codes]
    # counts of a window are differences, which are right in any number of bits that hold the longest window
    small = np.uint8 if len(label) + 2 < 256 else np.int64
    upto = {c: np.concatenate([np.zeros(1, small), np.cumsum(all_ == ord(c), dtype=small)]) for c in set(label)}
    out: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
    for size in range(max(3, len(label) - 2), len(label) + 3):
        if size > len(all_):
            break
        common = np.zeros(len(all_) - size + 1, small)
        for c, n in upto.items():
            common += np.minimum(n[size:] - n[:-size], small(label.count(c)))
        enough = next((k for k in range(len(label) + 1) if 2.0 * k / (size + len(label)) >= least), None)
        at = np.flatnonzero(common >= enough) if enough is not None else np.zeros(0, np.int64)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + size <= ends[owner]
        for k, i, n in zip(owner[inside].tolist(), (at - start[owner])[inside].tolist(), common[at[inside]].tolist(), strict=True):
            out[k].append((size, i, 2.0 * n / (size + len(label))))
    return out


@functools.lru_cache(maxsize=100_000)
def _likeness(window: str, want: str) -> float:
    """How like two short texts are; the same misreadings come again and again."""
    return difflib.SequenceMatcher(None, window, want).ratio()


def label_search_all(texts: list[str], label: str, values: list[str] | None = None, least: float = 0.72) -> list[str]:
    """For each text the value after the window that is most like the label, if it is like it enough; the first of the best wins."""
    low, want, out = [t.lower() for t in texts], label.lower(), [""] * len(texts)
    for k, windows in _windows(low, want, least).items() if any(low) else ():
        best, at = 0.0, -1
        for size, begin, bound in windows:
            # the bound is never below the likeness
            if bound > best and (ratio := _likeness(low[k][begin : begin + size], want)) > best:
                best, at = ratio, begin + size
        value = re.match(T.P["after_label"], texts[k][at : at + 80]) if best >= least else None
        out[k] = _snapped(value[1].strip(), values, least) if value else ""
    return out


def _snapped(value: str, values: list[str] | None, least: float) -> str:
    """value as it is, or the listed value that it contains or, by likeness, comes nearest to."""
    if values is None or not value:
        return value
    hit = next((v for v in values if v.lower() in value.lower()), None)
    if hit is None:
        score = [(difflib.SequenceMatcher(None, value.lower(), v.lower()).ratio(), -k) for k, v in enumerate(values)]
        top = max(score)
        hit = values[-top[1]] if top[0] >= least else ""
    return hit


def label_search(text: str, label: str, values: list[str] | None = None, least: float = 0.72) -> str:
    return label_search_all([text], label, values, least)[0]


def _label_udf(config: Config):
    """A text and the labels it lacks, one bit each, to a struct of the values found. Texts are null where nothing is sought, values where nothing is found."""
    labels = fuzzy_labels(config)

    @F.arrow_udf("struct<" + ",".join(f"{key}:string" for key, _, _ in labels) + ">")
    def search(content: pa.Array, missing: pa.Array) -> pa.Array:
        at = np.flatnonzero(pc.is_valid(content).to_numpy(zero_copy_only=False))
        texts, bits = content.take(pa.array(at)).to_pylist(), missing.take(pa.array(at)).to_pylist()
        out: dict[str, list[str | None]] = {key: [None] * len(content) for key, _, _ in labels}
        for i, (key, label, values) in enumerate(labels):
            rows = [k for k, m in enumerate(bits) if m >> i & 1]
            for k, v in zip(rows, label_search_all([texts[k] for k in rows], label, values) if rows else [], strict=True):
                out[key][at[k]] = v or None
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in out.values()], list(out))

    return search.asNondeterministic()


def winners(sig: DataFrame) -> DataFrame:
    """One row for each (case, field): the winner, and how far the signals agree. Partial aggregation; where the cases are together already, no shuffle."""
    return _winners(sig.filter("type = 'FIELD_VALUE'"))


def _winners(sig: DataFrame) -> DataFrame:
    order = F.struct("confidence", "source_id", -F.col("seq"))
    g = sig.groupBy("case_id", "key").agg(
        F.max_by(F.struct("value", "tag"), order).alias("w"), F.max("confidence").alias("confidence"),
        F.count("*").alias("n_sources"), F.collect_list("value").alias("all"), F.bool_or(X.source_class(F.col("source_id")) == "text").alias("has_text"),
    )
    values = F.array_sort(F.array_distinct("all"))
    return g.select(
        "case_id", "key", "w.value", "confidence", "w.tag", "n_sources",
        F.size(F.filter("all", lambda x: x == F.col("w.value"))).cast("long").alias("n_agreeing"), values.alias("unique_values"),
        (F.size(values) > 1).alias("has_conflict"), F.when(F.col("has_text"), "text").otherwise("ocr_only").alias("source_class"),
    )


def resolved(cases: DataFrame) -> DataFrame:
    """cases (with `signals`, as `emitted` makes them) with `resolved` in their place: what `winners` says of each key, findings too, null where there is none. Within the case's row: no shuffle, no lambda."""
    def record(k: str) -> Column:
        g, won, value = F.col(f"signals.{k}"), F.col(f"__w.{k}"), F.col(f"signals.{k}.value")
        unique = F.sort_array(F.array_distinct(value))
        rec = F.struct(
            won["value"].alias("value"), won["confidence"].alias("confidence"), won["tag"].alias("tag"), F.size(_last(f"signals.{k}")).cast("long").alias("n_sources"),
            (F.size(g) - F.size(F.array_remove(value, won["value"]))).cast("long").alias("n_agreeing"), unique.alias("unique_values"), (F.size(unique) > 1).alias("has_conflict"),
            F.when(F.array_contains(F.col(f"signals.{k}.text"), True), "text").otherwise("ocr_only").alias("source_class"),
        )
        return F.when(F.size(g) > 0, rec)

    out = cases.withColumn("__w", F.struct(*[F.array_max(_last(f"signals.{k}")).alias(k) for k in KEYS]))
    return out.withColumn("resolved", F.struct(*[record(k).alias(k) for k in KEYS])).drop("signals", "__w")


def winners_of(cases: DataFrame) -> DataFrame:
    """`winners` of cases as `emitted` makes them."""
    keyed = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"resolved.{k}").alias("r")) for k in T.FIELDS])
    one = resolved(cases.select("case_id", "signals")).select("case_id", F.explode(keyed).alias("x")).filter("x.r is not null")
    return one.select("case_id", "x.key", "x.r.*")


def rated(cases: DataFrame, told: DataFrame) -> DataFrame:
    """Each field signal (case_id, key, value, source_id, confidence) of cases as `emitted` makes them, with winner, n_sources, n_agreeing and has_conflict of its field and, of told (case_id, t), its truth_value.

    Cases meet what is told of them as one row each, signals are rated in the case's row: nothing is grouped.
    """
    out = resolved(cases.select("case_id", "signals", F.col("signals").alias("rows")).join(told, "case_id"))
    of = lambda k: F.struct(
        F.lit(k).alias("key"), F.col(f"resolved.{k}.value").alias("winner"), F.col(f"resolved.{k}.n_sources").alias("n_sources"), F.col(f"resolved.{k}.n_agreeing").alias("n_agreeing"),
        F.col(f"resolved.{k}.has_conflict").alias("has_conflict"), F.col(f"t.{k}").alias("truth_value"),
    )
    # exploded by concat from a column of its own, as in signals()
    keyed = [F.arrays_zip(F.col(f"rows.{k}").alias("c"), F.array_repeat(of(k), F.size(f"rows.{k}")).alias("r")) for k in T.FIELDS]
    one = out.select("case_id", F.concat(*keyed).alias("found")).select("case_id", F.explode(F.concat("found")).alias("x"))
    return one.select("case_id", "x.r.*", "x.c.value", "x.c.source_id", "x.c.confidence")


def compositions(sig: DataFrame, without: dict[str, list[int]]) -> DataFrame:
    """(case_id, won): of each case a map from field to a struct of the values that win if the emission steps listed for a name are left out; signals are made once."""
    step = F.pmod(F.floor(F.col("seq") / 100), F.lit(10))
    order = F.struct("confidence", "source_id", -F.col("seq"))
    # what has no order takes no part
    won = [F.max_by("value", F.when(~step.isin(*x), order) if x else order).alias(n) for n, x in without.items()]
    g = sig.filter("type = 'FIELD_VALUE'").groupBy("case_id", "key").agg(*won)
    return g.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct(*without)))).alias("won"))


_RECORD = ["value", "n_sources", "n_agreeing", "unique_values", "has_conflict"]
_AGREEMENT = "map<string,struct<value:string,n_sources:bigint,n_agreeing:bigint,unique_values:array<string>,has_conflict:boolean>>"


def consolidate(sig: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each of cases, with their columns: the nine fields, finding, source_class and agreement maps; fields without signal are ''.

    A finding is resolved like a field, so the signals are gone through once.
    """
    rec = F.struct(*_RECORD)
    wide = _winners(sig).groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("key").alias("k"), F.struct(rec.alias("r"), F.col("source_class").alias("c"))))).alias("m")
    )
    # both sides are where the bundles' shuffle put them; an estimate that is too low must not send all cases through the driver
    out = cases.join(wide.hint("merge"), "case_id", "left")
    at = lambda k: F.try_element_at("m", F.lit(k))
    agreement = F.transform_values(F.map_filter("m", lambda k, v: k != "finding"), lambda k, v: v["r"]).cast(_AGREEMENT)
    return _cases(out, cases.columns, lambda k: at(k)["r"]["value"], lambda k: at(k)["c"], agreement)


def consolidated(cases: DataFrame) -> DataFrame:
    """The same of cases as `emitted` makes them: each case's signals are in its row, so nothing is grouped or joined."""
    # one row as before; filters on what is made of the records stay behind it, where Spark would make them again for each mention.
    # The outer form, as of the plain one Spark infers a filter if only one record is asked for, and makes that record again for it
    out = resolved(cases).withColumn("resolved", F.explode_outer(F.array("resolved")))
    at = lambda k: F.col(f"resolved.{k}")
    none = F.array().cast("array<struct<k:string,v:struct<value:string,n_sources:bigint,n_agreeing:bigint,unique_values:array<string>,has_conflict:boolean>>>")
    entry = lambda k: F.struct(F.lit(k).alias("k"), F.struct(*[at(k)[c].alias(c) for c in _RECORD]).alias("v"))
    agreement = F.map_from_entries(F.concat(*[F.when(at(k).isNotNull(), F.array(entry(k))).otherwise(none) for k in T.FIELDS])).cast(_AGREEMENT)
    return _cases(out, [c for c in cases.columns if c != "signals"], lambda k: at(k)["value"], lambda k: at(k)["source_class"], agreement)


def _cases(out: DataFrame, kept: list[str], value_of: Callable[[str], Column], class_of: Callable[[str], Column], agreement: Column) -> DataFrame:
    """The fields and maps of cases, from each key's value and class and the map of records."""
    value = {k: F.coalesce(value_of(k), F.lit("")) for k in KEYS}
    value["finding"] = X.stepwise(value["finding"])
    value["risk_flags"] = X.or_else(value["risk_flags"], F.lit("none"))
    return out.select(
        *kept, *[v.alias(k) for k, v in value.items()],
        F.map_from_arrays(F.array(*map(F.lit, T.FIELDS)), F.array(*[F.coalesce(class_of(k), F.lit("absent")) for k in T.FIELDS])).alias("source_class"),
        F.coalesce(agreement, F.map_from_entries(F.array().cast("array<struct<k:string,v:struct<value:string,n_sources:bigint,n_agreeing:bigint,unique_values:array<string>,has_conflict:boolean>>>"))).alias("agreement"),
    )
