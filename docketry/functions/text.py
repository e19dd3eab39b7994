"""Scalar functions of the evidence engine as Column expressions: extraction, repair, normalization, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import tables as T


#: The characters of Unicode's White_Space.
_WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """All white space off both ends; trim() alone takes spaces only."""
    return F.btrim(c, F.lit(_WHITE))


def trimmed(c: Column) -> Column:
    """strip(c), cheaper where both ends are printable ASCII; for columns that cost little to read, as it reads c more than once."""
    plain = lambda x: (x >= "!") & (x < "\x7f")
    return F.when((c == "") | (plain(c) & plain(F.substring(c, -1, 1))), c).otherwise(strip(c))


def blank(c: Column) -> Column:
    """Whether c is empty or white space only; looks no further than the first other character."""
    return ~c.rlike(r"(?U)\S")


def has(low: Column, *words: str) -> Column:
    """Whether a text in lower case contains one of the words: a cheap test of whether a pattern can match at all."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def or_else(*values: Column) -> Column:
    """The first value that isn't empty, else ''."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def stepwise(c: Column) -> Column:
    """c itself, by a lambda. Of a step with a lambda Spark makes many small methods; of others one, which the JVM interprets if it is over 8,000 bytes long."""
    return F.element_at(F.transform(F.array(c), lambda x: x), 1)


def no_placeholder(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("[")) & c.rlike(T.P["placeholder"]), "").otherwise(c)


def _without_end(c: Column) -> Column:
    """c stripped, without the marks at its end."""
    s = trimmed(c)
    # what is stripped has no line end, so the pattern matches at the very end only
    return F.when(F.substring(s, -1, 1).isin(*".,;:"), F.regexp_replace(s, r"[.,;:]+$", "")).otherwise(s)


def first_group(c: Column, pattern: str) -> Column:
    """The first match's first group, stripped; '' for none or for a bracketed placeholder."""
    return no_placeholder(strip(F.regexp_extract(c, pattern, 1)))


def first_of(c: Column, words: list[str]) -> Column:
    """The first word of the list, in list order, that c contains; '' for none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), w) for w in words], F.lit(""))


def _listed(c: Column, pattern: dict[str, str], low: Column | None = None) -> Column:
    """The names, sorted and joined by |, whose pattern c matches. low: c in lower case, where a pattern runs only if all parts of its name are in it."""
    part = lambda name: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in name.split("_")])
    hit = lambda name, p: c.rlike(p) if low is None else part(name) & c.rlike(p)
    # leaves out nulls without a lambda, whose array Spark would make without compiled code
    hits = F.concat_ws("|", *[F.when(hit(name, p), F.lit(name)) for name, p in sorted(pattern.items())])
    return F.when(c.isNotNull(), hits).otherwise("")


def flags(c: Column) -> Column:
    """Flags of the labelled line if it says anything, else of the whole text; 'none' if there are none."""
    scan = or_else(first_group(c, T.P["flags"]), c)
    return or_else(_listed(scan, {f: rf"(?i)\b{f}\b" for f in T.FLAGS}), F.lit("none"))


def fuzzy_flag(flag: str) -> str:
    return r"(?i)\b" + flag.replace("_", r"[_ \-—]?") + r"\b"


def fuzzy_flags(c: Column, low: Column | None = None) -> Column:
    return _listed(c, {f: fuzzy_flag(f) for f in T.FLAGS}, low)


def fee(c: Column) -> Column:
    """What amount and waiver imply, else what is stated."""
    parts = F.struct(
        F.lower(first_group(c, T.P["fee"])).alias("stated"),
        F.replace(F.regexp_extract(c, T.P["amount"], 1), F.lit(","), F.lit("")).try_cast("double").alias("amount"),
        F.upper(strip(F.regexp_extract(c, T.P["waiver"], 1))).alias("code"),
    )
    return F.element_at(F.transform(F.array(parts), lambda x: implied_fee(x["stated"], x["amount"], x["code"])), 1)


def implied_fee(stated: Column, amount: Column, code: Column) -> Column:
    waiver = (code != "") & (code != "N/A")
    return (
        F.when(amount.isNull(), stated)
        .when((amount > 0) & ~waiver, "paid")
        .when((amount == 0) & waiver, "waived")
        .when((amount == 0) & stated.isin("unpaid", "unknown"), stated)
        .otherwise("unknown")
    )


def finding(c: Column) -> Column:
    return F.replace(F.upper(F.regexp_extract(c, T.P["finding"], 1)), F.lit(" "), F.lit("_"))


def corrections(c: Column) -> Column:
    """map(field, value) of the manual corrections that are allowed; the last one of a field wins."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(c, F.lit(T.P["correction"]), F.lit(1)).alias("label"),
        F.transform(F.regexp_extract_all(c, F.lit(T.P["correction"]), F.lit(2)), strip).alias("value"),
    )
    label = lambda p: F.lower(F.regexp_replace(p["label"], r"\s+", ""))
    entry = lambda field, v: F.struct(F.lit(field).alias("key"), v.alias("value"))
    made = F.transform(
        pairs,
        lambda p: F.when((label(p) == "sponsor") & p["value"].rlike(f"^{T.P['sponsor']}$"), entry("sponsor_id", p["value"]))
        .when(label(p) == "applicant", entry("applicant_name", p["value"]))
        .when((label(p) == "visaclass") & F.upper(p["value"]).isin(*T.VISAS), entry("visa_class", F.upper(p["value"])))
        .when((label(p) == "feestatus") & F.lower(p["value"]).isin(*T.FEES), entry("fee_status", F.lower(p["value"]))),
    )
    kept = F.filter(made, lambda x: x.isNotNull())
    last = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


#: What a text is searched for once, with words of which every match holds one in some case; the fields are made of these.
_RAW = {
    "registry_name": ["registry"], "attests": ["attests"], "name": ["applicant", "full"], "purpose": ["purpose"], "sponsor_purpose": ["expected"], "visa": ["visa"], "fee": ["fee"], "date": ["-"],
}


def at_lines(pattern: str) -> str:
    """A pattern that begins at the text's start or a line end, for the text with a line end put before it: one character to look for instead of a choice at each place."""
    return pattern.replace(r"(?:^|\n)", r"\n", 1)


def with_fields(rows: DataFrame, text: str, to: str = "fields", low: str | None = None) -> DataFrame:
    """rows with a struct of the nine fields of a text, corrections applied, and its finding. low: the column of the text in lower case, if there is one.

    In stages, each of which is used by the next more than once: every pattern runs once a text, and
    only where the text in lower case has a word of it.
    """
    c, given, low = F.col(text), low, F.col(low or "__low")
    unless = lambda words, none, x: F.when(~has(low, *words), none).otherwise(x)
    search = lambda k: F.regexp_extract(F.col("__lines") if r"(?:^|\n)" in T.P[k] else c, at_lines(T.P[k]), 1)
    found = {k: unless(words, "", search(k)) for k, words in _RAW.items()}
    found |= {
        "species": first_of(c, T.SPECIES), "home": first_of(c, T.HOMES), "any_visa": first_of(c, T.VISAS), "sponsor": unless(["spn-"], "", F.regexp_extract(c, T.P["sponsor"], 0)),
        "amount": unless(["amount"], F.lit(None).cast("double"), F.replace(search("amount"), F.lit(","), F.lit("")).try_cast("double")),
        "code": unless(["waiver"], "", F.upper(strip(search("waiver")))),
        "line": unless(["flag"], "", no_placeholder(strip(search("flags")))), "finding": unless(["finding"], "", finding(c)),
        "fixed": F.when(has(low, "correction:") & c.rlike(r"(?i)Manual\s*correction:"), corrections(c)),
    }
    out = (rows if given else rows.withColumn("__low", F.lower(c))).withColumn("__lines", F.concat(F.lit("\n"), c))
    out = out.select("*", F.struct(*[v.alias(k) for k, v in found.items()]).alias("__f")).drop("__lines")
    f = lambda k: F.col(f"__f.{k}")
    clean = {k: no_placeholder(trimmed(f(k))) for k in _RAW}
    # every flag has a _, and a text whose lower case lacks a flag's words lacks the flag
    scan, low_scan = or_else(f("line"), c), F.when(f("line") != "", F.lower(f("line"))).otherwise(low)
    clean |= {"flags": F.when(has(scan, "_"), _listed(scan, {x: rf"(?i)\b{x}\b" for x in T.FLAGS}, low_scan)).otherwise(""), "letter": F.when(f("sponsor_purpose") == "", "").otherwise(no_placeholder(F.regexp_replace(strip(f("sponsor_purpose")), r"\s+", " ")))}
    clean["visa"] = stepwise(clean["visa"])
    out = out.select("*", F.struct(*[v.alias(k) for k, v in clean.items()]).alias("__g"))
    g = lambda k: F.col(f"__g.{k}")
    raw = {
        "applicant_name": or_else(g("registry_name"), g("attests"), g("name")), "species_code": f("species"), "home_world": f("home"),
        "visa_class": or_else(F.upper(g("visa")), f("any_visa")), "sponsor_id": f("sponsor"), "arrival_date": g("date"),
        "declared_purpose": or_else(g("purpose"), g("letter")), "risk_flags": or_else(g("flags"), F.lit("none")),
        "fee_status": implied_fee(F.lower(g("fee")), f("amount"), f("code")),
    }
    for k in ("sponsor_id", "applicant_name", "visa_class", "fee_status"):
        raw[k] = F.coalesce(F.try_element_at(f("fixed"), F.lit(k)), raw[k])
    raw["finding"] = stepwise(f("finding"))
    return out.select("*", F.struct(*[v.alias(k) for k, v in raw.items()]).alias(to)).drop("__f", "__g", "__low")


def lookalike_sponsor(c: Column) -> Column:
    """The first sponsor number whose digits were read as letters, restored."""
    raw = F.regexp_extract_all(c, F.lit(T.P["lookalike"]), F.lit(1))
    restored = F.transform(F.filter(raw, lambda x: ~x.rlike(r"^\d{4}$")), lambda x: F.translate(x, *T.LOOKALIKES))
    fine = F.filter(restored, lambda x: x.rlike(r"^\d{4}$"))
    return F.when(F.size(fine) > 0, F.concat(F.lit("SPN-"), F.try_element_at(fine, F.lit(1)))).otherwise("")


def real_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~c.startswith("0000"), F.try_to_date(c, "yyyy-MM-dd"))


def repaired_year(c: Column) -> Column:
    """A date outside 2020 to 2030 with one digit of its year changed: the first that is a real date there."""
    fine = lambda d: real_date(d).isNotNull() & F.substring(d, 1, 4).between("2020", "2030")
    made = [F.concat(F.substring(c, 1, p), F.lit(d), F.substr(c, F.lit(p + 2))) for p in range(4) for d in "0123456789"]
    # the candidates are made only for dates that need them
    found = F.try_element_at(F.filter(F.array(*made), fine), F.lit(1))
    return F.when(~c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(fine(c), c).otherwise(F.coalesce(found, c))


def snapped(c: Column, values: list[str], lower: bool = False) -> Column:
    """c as one of the values: as it is, with another separator, or in another case; else c stripped."""
    s = _without_end(c)
    s = F.lower(s) if lower else s
    tries = [s, *(F.replace(s, F.lit(sep), F.lit("-")) for sep in "_ .")]
    same = [F.when(t.isin(*values), t) for t in tries] + [F.when(F.upper(s) == v.upper(), F.lit(v)) for v in values]
    return F.coalesce(*same, strip(c))


def _by_key(key: Column | str, made: dict, other) -> Column:
    """made[key](), or other(): a known key makes its own expression only, a column makes all of them."""
    if isinstance(key, str):
        return made.get(key, other)()
    out = F.when(F.lit(False), F.lit(None))
    for k, f in made.items():
        out = out.when(key == k, f())
    return out.otherwise(other())


def normalized(key: Column | str, c: Column) -> Column:
    ends = lambda: _without_end(c)
    made = {
        "sponsor_id": lambda: F.regexp_replace(ends(), r"\s+", ""), "home_world": lambda: F.regexp_replace(ends(), T.P["split_home"], "$1$2"),
        "arrival_date": lambda: repaired_year(F.regexp_replace(trimmed(c), r"^[.,;:]+|[.,;:]+$", "")), "visa_class": lambda: snapped(c, T.VISAS),
        "fee_status": lambda: snapped(c, T.FEES, lower=True), "risk_flags": lambda: c,
    }
    return F.when(c == "", "").otherwise(_by_key(key, made, lambda: trimmed(c)))


def valid(key: Column | str, c: Column) -> Column:
    """Whether a value is evidence at all."""
    v = trimmed(c)
    made = {
        "risk_flags": lambda: v != "none", "arrival_date": lambda: real_date(v).isNotNull(), "applicant_name": lambda: v.rlike(T.P["full_name"]),
        "declared_purpose": lambda: v.rlike(T.P["full_purpose"]), "sponsor_id": lambda: v.rlike(f"^{T.P['sponsor']}$"),
    }
    return (v != "") & _by_key(key, made, lambda: F.lit(True))


def stale(c: Column) -> Column:
    return F.coalesce(F.datediff(F.lit(T.RECEIPT_DATE).cast("date"), real_date(c)) > T.STALE_DAYS, F.lit(False))


def flag_set(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(c, r"[|]"), strip), lambda x: x != "")
    return F.when(c.isin("", "none"), F.array().cast("array<string>")).otherwise(parts)


def biometric_reads(c: Column) -> tuple[Column, Column]:
    """How many biometric readings a text has, and how many of them are clean."""
    return tuple(F.regexp_count(c, F.lit(T.P[k])) for k in ("observed", "observed_clean"))


def verdict(adj: str, tag: Column | str, key: str) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.struct(F.lit(adj).alias("adj"), F.lit(T.CONFIDENCE[key]).alias("conf"), tag.alias("tag"))


def ocr_grade(c: Column) -> Column:
    """struct(adj, conf, tag) of the first family of risk signals that the text shows, or null."""
    deny, review, up, low = "DENIED", "NEEDS_REVIEW", F.upper(c), F.lower(c)
    rows = [
        (c.rlike(T.P["ocr_denied"]), deny, "ocr_finding:DENIED", ""), (c.rlike(T.P["ocr_review"]), review, "ocr_finding:REVIEW", ""),
        (c.rlike(T.P["ocr_registry"]), deny, "ocr_reason:damaged_registry", ""), (c.rlike(T.P["ocr_policy"]), deny, "ocr_reason:visible_policy_notes", ""),
        *((c.rlike(fuzzy_flag(f)), deny, "ocr_disq_flag", f) for f in T.DISQUALIFYING),
        *((F.contains(c, F.lit(s)), deny, "ocr_revoked_sponsor", s) for s in T.REVOKED),
        *((F.contains(low, F.lit(h.lower())), deny, "ocr_embargo_home", h) for h in T.HARD_EMBARGO),
        *((F.contains(up, F.lit(s)), deny, "ocr_deny_stem", s) for s in T.DENY_STEMS),
        *((c.rlike(fuzzy_flag(f)), review, "ocr_review_flag", f) for f in T.REVIEW_ONLY),
        *((F.contains(up, F.lit(s)), review, "ocr_review_stem", s) for s in T.REVIEW_STEMS),
    ]
    # most cases have no such text, and then nothing is searched
    return F.when(c != "", F.coalesce(*[F.when(hit, verdict(adj, f"{key}:{what}" if what else key, key)) for hit, adj, key, what in rows]))


def registry_key(tag: Column) -> Column:
    """The registry's key of an emitted tag: exact tags first, then families by prefix; null if there is none."""
    exact = F.when(tag.isin(*T.EXACT_TAGS), reduce(lambda a, kv: F.when(tag == kv[0], kv[1]).otherwise(a), T.ALIASES.items(), tag))
    return F.coalesce(exact, *[F.when(tag.startswith(p), p[:-1]) for p in T.PREFIX_TAGS])


def base_tag(tag: Column) -> Column:
    return F.substring_index(tag, "[", 1)


def first_line(c: Column, most: int = 80) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.substring(strip(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))), 1, most)


def agreement_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 4, "3-4").otherwise("5+")


def source_class(source: Column) -> Column:
    return F.when((source == "combined_text") | source.startswith("text_stream_"), "text").when(source.startswith("image_"), "ocr").otherwise("other")


def same_value(field: Column, got: Column, truth: Column) -> Column:
    """Stripped equality; for flags, a non-empty subset of the truth."""
    named = lambda c: F.filter(F.split(strip(c), r"[|]"), lambda x: x != "")
    g, t = named(got), named(truth)
    return F.when(field == "risk_flags", (F.size(g) > 0) & (F.size(F.array_except(g, t)) == 0)).otherwise(strip(got) == strip(truth))


def same_for_score(got: Column, truth: Column) -> Column:
    """Equality after collapsing white space and folding case."""
    flat = lambda c: F.lower(F.regexp_replace(strip(c), r"\s+", " "))
    return flat(got) == flat(truth)


def probes(c: Column) -> dict[str, Column]:
    return {"ocr_has_" + w.replace(" ", "_"): F.contains(F.lower(c), F.lit(w)) for w in T.PROBES}
