"""The trust boundary: sanitizers, the legibility detector, the authority level, the trusted bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import tables as T
from docketry.functions import text as X


def marker_of(line: Column, markers: list[str], up: Column | None = None) -> Column:
    """The first marker that a line holds, in any case; up is the line in upper case, if that is a column already."""
    up = F.upper(line) if up is None else up
    return F.coalesce(*[F.when(F.contains(up, F.lit(m)), m) for m in markers])


def without_injections(c: Column, markers: list[str] = T.MARKERS, up: Column | None = None) -> tuple[Column, Column]:
    """The text without lines that hold a marker, and the audit: how many, and which markers. up: the text in upper case, if that is a column already."""
    lines = F.split(c, "\n", -1)
    hits = F.filter(F.transform(lines, lambda x: marker_of(x, markers)), lambda m: m.isNotNull())
    kept = F.array_join(F.filter(lines, lambda x: marker_of(x, markers).isNull()), "\n")
    audit = F.concat(F.lit("sanitized_lines:"), F.size(hits).cast("string"), F.lit(":"), F.array_join(F.array_sort(F.array_distinct(hits)), ","))
    # few texts hold a marker at all: the whole text decides whether its lines are looked at
    some = marker_of(c, markers, up).isNotNull()
    return F.when(some, kept).otherwise(c), F.when(some & (F.size(hits) > 0), audit).otherwise("")


def without_redactions(c: Column) -> tuple[Column, Column]:
    out = F.when(X.has(c, "[", "REDACTED"), F.regexp_replace(c, T.P["redaction"], "")).otherwise(c)
    gone = F.length(c) - F.length(out)
    return out, F.when(gone > 0, F.concat(F.lit("sanitized_redactions:"), gone.cast("string"), F.lit("_chars"))).otherwise("")


def domain_words() -> list[str]:
    """Words that make a text legible: the listed ones and those of the vocabularies, all in lower case."""
    words = {x.lower() for x in T.SPECIES + T.VISAS + T.FEES + T.FLAGS} | set(T.LEGIBLE.split())
    words |= {w for h in T.HOMES for w in h.lower().replace("-", " ").split()} | {w for f in T.FLAGS for w in f.split("_")}
    return sorted(words)


def legibility(c: Column, words: list[str]) -> tuple[Column, Column]:
    """(recognized, total) of tokens, dates and ids; an id counts as a token too."""
    tokens = F.regexp_extract_all(c, F.lit(T.P["token"]), F.lit(0))
    other = F.regexp_count(c, F.lit(T.P["any_date"])) + F.regexp_count(c, F.lit(T.P["any_id"]))
    return F.size(F.filter(tokens, lambda t: F.lower(t).isin(*words))) + other, F.size(tokens) + other


def authority(c: Column, low: Column | None = None) -> Column:
    """1 (adjudicator) to 6 (unknown): the first level whose marker the text shows. low: the text in lower case, if that is a column already."""
    low, out = F.lower(c) if low is None else low, F.when(X.blank(c), 6)
    for k, (p, words) in enumerate(zip(T.LEVELS, T.LEVEL_WORDS, strict=True)):
        out = out.when(X.has(low, *words) & c.rlike(p), k + 1)
    return out.otherwise(6)


def apply_filters(sources: DataFrame) -> DataFrame:
    """sources with content cleaned, and trusted, exclusion_reason, sanitize_audit and level added."""
    # a text's other case is a column of its own: Spark would make it again for each word it is searched for
    one, audit1 = without_injections(F.col("content"), up=F.col("__up"))
    s = sources.withColumn("__up", F.upper("content")).withColumns({"__a": audit1, "content": one}).drop("__up")
    two, audit2 = without_redactions(F.col("content"))
    s = s.withColumns({"__b": audit2, "content": two}).withColumn("__low", F.lower("content"))
    got, total = legibility(F.col("content"), domain_words())
    # only images can be illegible: other texts aren't taken apart
    image = F.col("kind") == "IMAGE"
    s = s.withColumns({"__got": F.when(image, got), "__total": F.when(image, total)})
    ratio = F.col("__got") / F.col("__total")
    bad = image & (F.col("__total") >= T.LEAST_TOKENS) & (ratio < T.LEAST_RATIO)
    why = F.format_string("Illegibility:real_word_ratio:%.2f (%d/%d)", ratio, "__got", "__total")
    s = s.withColumns({
        "trusted": ~F.coalesce(bad, F.lit(False)), "exclusion_reason": F.when(bad, why).otherwise(""),
        "sanitize_audit": F.filter(F.array("__a", "__b"), lambda x: x != ""), "level": authority(F.col("content"), F.col("__low")),
    })
    return s.drop("__a", "__b", "__got", "__total", "__low")


def bundles(filtered: DataFrame) -> DataFrame:
    """One row for each case: combined_text, ocr_text, image_ocr, any_illegible, and its live sources (trusted, not blank). One shuffle by case.

    All columns come from one collected array, so whatever part of a bundle a plan needs, it is the
    same exchange, and a plan that needs two parts reads it twice instead of making it twice. If the
    sources bring a column `found`, a struct of what was found in each, a case has the array of them; so with `noted`.
    """
    illegible = F.coalesce(~F.col("trusted") & F.contains("exclusion_reason", F.lit("Illegibility")), F.lit(False)).alias("illegible")
    found = [c for c in filtered.columns if c in ("found", "noted")]
    out = filtered.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("kind", "ordinal", "source_id", "content", "level", "trusted", illegible, *found))).alias("all"))
    rows = F.filter("all", lambda x: x["trusted"])
    of = lambda kind: F.filter(rows, lambda x: x["kind"] == kind)
    image_ocr = F.transform(of("IMAGE"), lambda x: F.struct(x["source_id"].alias("source_id"), x["content"].alias("text")))
    live = F.transform(F.filter(rows, lambda x: ~X.blank(x["content"])), lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "ordinal", "source_id", "content", "level")]))
    return out.select(
        "case_id", F.array_join(F.transform(of("TEXT_STREAM"), lambda x: x["content"]), "\n").alias("combined_text"), F.array_join(F.transform(of("IMAGE"), lambda x: x["content"]), "\n").alias("ocr_text"),
        image_ocr.alias("image_ocr"), F.exists("all", lambda x: x["illegible"]).alias("any_illegible"), live.alias("sources"),
        *[F.col(f"all.{c}").alias(c) for c in found],
    )
