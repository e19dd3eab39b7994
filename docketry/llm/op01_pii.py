r"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Card numbers (Luhn), account numbers (IBAN, mod 97), phone numbers, social security numbers, IPv4
and IPv6 addresses and dates are validated and permuted within their format by a keyed Feistel
network over Z_a x Z_b or over letters and digits: the result is a valid value of the same format,
and the same value gets the same pseudonym in every document. A date has one pseudonym whatever
way it is written. E-mail local parts (without regard to case) and credentials are permuted letter
by letter, each within its own alphabet (digits, lower, upper case).

Formats: mail addresses; AKIA..., sk-... and the like; password, passwd, secret, token or api key
followed by = or : and 8 characters or more, with a digit or mixed case among them if it isn't a
password; dotted IPv4 not after a word for version; IPv6 in full or with :: inside; dates as
2024-01-31, 31.01.2024, 01/31/2024 and 1/31/2024; 123-45-6789; North American phones with
separators, with +1 or, after a word for phone, without separators; other phones after + and a
country code; IBANs with or without spaces; runs of 13 to 19 digits that pass the Luhn test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: The session setting that holds the key if no argument does.
KEY_SETTING = "spark.docketry.pii.key"
#: Dates are permuted within 200 years of 365 days, counted from FIRST_DAY; what the calendar's ends leave is permuted apart.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 365, 200

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
# Repeated groups are possessive: a group that may give back takes a stack frame for each turn, and long texts would end the JVM.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk|rk|ghp)[_-](?:live[_-]|test[_-]|proj[_-])?[A-Za-z0-9]{16,}+"
    r"|(?i:\bpassw(?:or)?d\s*+[=:]\s*+\"?[a-z0-9+/_-]{8,}+)|(?i:\b(?:secret|token|api_?key)\s*+[=:]\s*+\"?)(?=[A-Za-z+/_-]*+\d|[a-z0-9+/_-]*+(?<=[a-z])[A-Z])[A-Za-z0-9+/_-]{8,}+",
    "ip": rf"(?<![\d.])(?<!(?i:\bver|version|release|v)[ .]?)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:[0-9A-Fa-f]*+:){{2,7}}+[0-9A-Fa-f]*+(?![0-9A-Za-z:]))(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:]|\.\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)\b",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\d|[/.-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<=(?i:phone|tel|call|cell|mobile|fax)[.: ]{0,3})\d{10}(?!\d)|(?<![\d+])\+1\d{10}(?!\d)",
    "abroad": r"(?<![\d+])\+(?!1[ .(-]|1\d{10}(?!\d))(?:[2-9]\d{0,2}(?:[ .-]\(?\d{2,4}\)?){2,4}+|[2-9]\d{7,14}+)(?!\d)",
}
#: A run of groups of 4 digits or more and at most a shorter one at its end, up to a group that starts another value.
_OTHER = "|".join([PATTERNS["email"], PATTERNS["ip"], r"\d\d[./]\d\d[./]\d{4}(?!\d)", r"\d{4}-\d{2}-\d{2}(?!\d|[/.-]\d)", r"\d{3}-\d{2}-\d{4}(?![\d-])", r"(?:1[ -]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"])
PATTERNS["card"] = rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d{{4,}}+(?:(?![ -](?:{_OTHER}))[ -]\d{{4,}}+)*+(?:(?![ -](?:{_OTHER}))[ -]\d{{1,3}}(?!\d|[./]\d))?+"
#: Groups that cards are written in, and how the numbers in use begin.
LAYOUT = r"^[ -]?(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4}(?:[ -]\d{1,3})?|(?:\d{4}[ -]){3}\d{1,3}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{6}[ -]\d{7,13}|\d{8}[ -]\d{8})$"
ISSUED = r"^[ -]?(?:[3-6]|2[2-7])"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What can stand between the cards of a run.
BESIDE = "|".join(f"(?:{PATTERNS[k]})" for k in ("date", "ssn", "phone"))


def _prf(key: str, kind: str, i: Column, x: Column) -> Column:
    """A keyed 60-bit number of a round and the other half."""
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substr(h, F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b as struct(l, r): the halves are shifted in turn by a number drawn from the other."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(s["l"] + F.pmod(_prf(key, kind, i, s["r"]), a), a)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(_prf(key, kind, i, s["l"]), b), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _chars(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.split(x, "", -1)).otherwise(F.array().cast("array<string>"))


def _shift(c: Column, by: Column, letters: int) -> Column:
    code = F.ascii(c)
    into = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return (
        F.when(c.between("0", "9"), into(48, 10)).when(c.between("a", "z"), into(97, letters)).when(c.between("A", "Z"), into(65, letters)).otherwise(c)
    )


def feistel_text(x: Column, key: str, kind: str, letters: int = 26) -> Column:
    """Letters (the first `letters` of the alphabet) and digits of x permuted, each within its alphabet, by the same network over the halves of x."""

    def half(one: Column, other: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)
        by = lambda h, j: F.conv(F.substr(h, F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return _let(h, lambda h: F.array_join(F.transform(_chars(one), lambda c, j: _shift(c, by(h, j), letters)), ""))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, half(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(half(s["r"], s["l"], i)).alias("r"),
        )

    n = F.floor((F.length(x) + 1) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), n).alias("l"), F.substr(x, n + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _without_case(x: Column, make) -> Column:
    """make(x in lower case) with x's own case put back."""
    return _let(F.struct(x.alias("x"), make(F.lower(x)).alias("y")), lambda s: F.array_join(F.zip_with(_chars(s["x"]), _chars(s["y"]), lambda o, c: F.when(o.between("A", "Z"), F.upper(c)).otherwise(c)), ""))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits, in order, replaced by those of `digits`."""
    nth = lambda j: F.length(_digits(F.substr(form, F.lit(1), j + 1)))
    return F.array_join(F.transform(_chars(form), lambda c, j: F.when(c.between("0", "9"), F.substr(digits, nth(j), F.lit(1))).otherwise(c)), "")


def luhn_digit(prefix: Column) -> Column:
    """The check digit that makes prefix valid."""
    n = F.length(prefix)

    def add(s: Column, j: Column) -> Column:
        d = F.substr(prefix, j, F.lit(1)).cast("int") * F.when((n - j) % 2 == 0, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10, F.lit(10))


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _is_card(d: Column) -> Column:
    return luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)).cast("string") == F.right(d, F.lit(1))


def _card(m: Column, key: str) -> Column:
    """The pseudonym of a card."""
    d = _digits(m)
    body = F.substr(d, F.lit(1), F.length(d) - 1)
    n = F.floor(F.length(body) / 2).cast("int")
    k = F.length(body) - n
    p = feistel(F.substr(body, F.lit(1), n), F.substr(body, n + 1), _power(n), _power(k), key, "card")
    made = _let(p, lambda s: F.concat(_pad(s["l"], n), _pad(s["r"], k)))
    whole = _let(made, lambda b: F.concat(b, luhn_digit(b).cast("string")))
    return _refill(m, whole)


#: Windows of a run that are gone through at a time; what is found in them is put together once.
_BLOCK = 512


def _in_run(groups: Column, usual: bool) -> Column:
    """The cards in a run, as structs (i, k) of the first group and the number of groups, in order.

    A card is some whole groups with 13 to 19 digits in all that pass the Luhn test: `usual` ones
    have a card's layout and begin like one, others have only the layout, or groups of 4 digits or
    more that begin like a card. Where cards overlap the earlier one counts, then the longer.
    """
    n = F.size(groups)

    def window(i: Column, j: Column) -> Column:
        x = F.array_join(F.slice(groups, i, j - i + 1), "")
        fits = x.rlike(LAYOUT) & x.rlike(ISSUED) if usual else x.rlike(LAYOUT) | (x.rlike(r"^[ -]?\d{4,}(?:[ -]\d{4,})*$") & x.rlike(ISSUED))
        return F.struct(i.alias("i"), (-F.length(_digits(x))).alias("less"), (j - i + 1).alias("k"), fits.alias("fits"), _digits(x).alias("d"))

    # 19 digits are 5 groups at most
    of = lambda i: F.transform(F.sequence(i, F.least(i + 4, n)), lambda j: window(i, j))
    fit = lambda w: w["less"].between(-19, -13) & w["fits"] & _is_card(w["d"])
    all_ = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.filter(of(i), fit)))
    place = F.transform(F.array_sort(all_), lambda w: F.struct(w["i"].alias("i"), w["k"].alias("k")))
    none = F.array().cast("array<struct<i:int,k:int>>")
    after = lambda s, w: F.when(w["i"] >= s["at"], F.struct((w["i"] + w["k"]).alias("at"), F.array_append(s["out"], w).alias("out"))).otherwise(s)

    def chosen(all_: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size(all_) / _BLOCK).cast("int"))
        part = lambda s, b: F.aggregate(F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(s["at"].alias("at"), none.alias("out")), after)
        step = lambda s, b: _let(part(s, b), lambda p: F.struct(p["at"].alias("at"), F.array_append(s["out"], p["out"]).alias("out")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<i:int,k:int>>>").alias("out"))
        return F.aggregate(blocks, start, step, lambda s: F.flatten(s["out"]))

    return F.when(n > 0, _let(place, chosen)).otherwise(none)


def _run(m: Column, key: str) -> Column:
    """A run as struct(text, n): its cards, and dates and other numbers beside them, replaced."""

    def beside(x: Column) -> Column:
        hits = F.regexp_extract_all(x, F.lit(BESIDE), F.lit(0))
        put = F.transform(hits, lambda v: _number(v, key))
        text = F.array_join(F.zip_with(F.split(x, BESIDE, -1), F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return F.struct(text.alias("text"), F.size(F.filter(F.arrays_zip(hits.alias("a"), put.alias("b")), lambda v: v["a"] != v["b"])).alias("n"))

    def pieces(groups: Column, cards: Column, rest) -> Column:
        text = lambda i, k: F.array_join(F.slice(groups, i, k), "")
        end = lambda x: F.when(x > 0, F.get(cards, x - 1)["i"] + F.get(cards, x - 1)["k"]).otherwise(1)
        to = lambda x: F.coalesce(F.get(cards, x)["i"], F.size(groups) + 1)
        between = F.transform(F.sequence(F.lit(0), F.size(cards)), lambda x: rest(text(end(x), to(x) - end(x))))
        made = F.transform(cards, lambda c: _let(text(c["i"], c["k"]), lambda o: _let(_card(o, key), lambda v: F.struct(v.alias("text"), (v != o).cast("int").alias("n")))))
        all_ = F.flatten(F.zip_with(between, made, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
        return _let(all_, lambda p: F.struct(F.array_join(F.transform(p, lambda q: q["text"]), "").alias("text"), F.aggregate(p, F.lit(0), lambda s, q: s + q["n"]).alias("n")))

    def searched(x: Column, usual: bool, rest) -> Column:
        # each group goes with the separator before it
        return _let(F.regexp_extract_all(x, F.lit(r"[ -]?\d+"), F.lit(0)), lambda g: _let(_in_run(g, usual), lambda c: pieces(g, c, rest)))

    # usual cards first, then others between them
    return searched(m, True, lambda x: searched(x, False, beside))


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _phone(m: Column, key: str) -> Column:
    d = F.right(_digits(m), F.lit(10))
    at = lambda lo, n: F.substr(d, F.lit(lo), F.lit(n)).cast("int")
    area, swap, line = at(1, 3), at(4, 3), at(7, 4)
    # codes from 200 on are permuted among themselves, and so are those below, which no exchange gives out but texts hold
    low = lambda code: F.when(code >= 200, 200).otherwise(0)
    many = lambda code: F.when(code >= 200, 80_000).otherwise(20_000).cast("long")
    p = feistel((area - low(area)) * 100 + F.floor(line / 100), (swap - low(swap)) * 100 + line % 100, many(area), many(swap), key, "phone")
    made = _let(p, lambda s: F.concat(
        _pad(F.floor(s["l"] / 100) + low(area), 3), _pad(F.floor(s["r"] / 100) + low(swap), 3), _pad(s["l"] % 100, 2), _pad(s["r"] % 100, 2)
    ))
    lead = F.substr(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _refill(m, F.concat(lead, made))


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    at = lambda lo, n: F.substr(d, F.lit(lo), F.lit(n)).cast("int")
    area, group, serial = at(1, 3), at(4, 2), at(6, 4)
    p = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    made = _let(p, lambda s: F.concat(
        _pad(s["l"] + 1 + (s["l"] >= 665).cast("int"), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4)
    ))
    fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(fine, _refill(m, made)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = lambda k: F.split(m, r"\.")[k].cast("int")
    p = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), 65_536, 65_536, key, "ip")
    byte = lambda x: F.floor(x / 256).cast("string")
    return _let(p, lambda s: F.concat_ws(".", byte(s["l"]), (s["l"] % 256).cast("string"), byte(s["r"]), (s["r"] % 256).cast("string")))


def _date(m: Column, key: str) -> Column:
    first = F.lit(FIRST_DAY).cast("date")
    span = DAYS_A * DAYS_B
    # whole spans before and after the first day that the calendar has, and the days left at its ends, as a * b
    before, after = 9, 40
    left = [(-before * span - 36_595, 65, 563), (after * span, 64, 601)]

    def of(form: Column | str, parse: str) -> Column:
        day = F.datediff(F.try_to_date(m, parse), first)
        index = F.floor(day / span)
        begin = F.when(index < -before, left[0][0]).when(index >= after, left[1][0]).otherwise(index * span).cast("int")
        a = F.when(index < -before, left[0][1]).when(index >= after, left[1][1]).otherwise(DAYS_A).cast("long")
        b = F.when(index < -before, left[0][2]).when(index >= after, left[1][2]).otherwise(DAYS_B).cast("long")
        parts = F.struct(begin.alias("begin"), (day - begin).alias("d"), a.alias("a"), b.alias("b"))
        made = lambda q: _let(feistel(F.floor(q["d"] / q["b"]), q["d"] % q["b"], q["a"], q["b"], key, "date"), lambda s: (q["begin"] + s["l"] * q["b"] + s["r"]).cast("int"))
        new = _let(parts, lambda q: F.date_add(first, made(q)))
        return F.when(day.isNotNull(), F.date_format(new, form)).otherwise(m)

    two = m.rlike(r"^\d\d/\d\d/")
    us = F.try_to_date(m, "M/d/yyyy").isNotNull()
    slashed = F.when(us & two, of("MM/dd/yyyy", "M/d/yyyy")).when(us, of("M/d/yyyy", "M/d/yyyy")).when(two, of("dd/MM/yyyy", "d/M/yyyy")).otherwise(of("d/M/yyyy", "d/M/yyyy"))
    return F.when(m.rlike("^\\d{4}-"), of("yyyy-MM-dd", "yyyy-MM-dd")).when(F.contains(m, F.lit(".")), of("dd.MM.yyyy", "dd.MM.yyyy")).otherwise(slashed)


def _power(x: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), x)).cast("long")


def _abroad(m: Column, key: str) -> Column:
    """The digits after the country code, which is the first group or, without groups, the first two digits."""
    lead = F.regexp_extract(m, r"^\+(\d{1,3})(?=[ .-])|^\+(\d\d)", 0)
    d, n = _digits(F.substr(m, F.length(lead) + 1)), F.length(_digits(F.substr(m, F.length(lead) + 1)))
    half = F.floor(n / 2).cast("int")
    p = feistel(F.substr(d, F.lit(1), half), F.substr(d, half + 1), _power(half), _power(n - half), key, "abroad")
    made = _let(p, lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], n - half)))
    return F.concat(lead, _refill(F.substr(m, F.length(lead) + 1), made))


def _mod97(x: Column) -> Column:
    """x read as a number, A as 10 to Z as 35, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(x), F.lit(0), lambda s, c: F.pmod(s * F.when(c.between("0", "9"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    """The account permuted letter by letter, with its check digits; what fails the test stays."""
    flat = F.replace(m, F.lit(" "), F.lit(""))

    def put(x: Column) -> Column:
        country, body = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5))
        made = _let(feistel_text(body, key, "iban"), lambda y: F.concat(country, _pad(98 - _mod97(F.concat(y, country, F.lit("00"))), 2), y))
        # spaces go where they were
        nth = lambda j: F.length(F.replace(F.substr(m, F.lit(1), j + 1), F.lit(" "), F.lit("")))
        spaced = lambda y: F.array_join(F.transform(_chars(m), lambda c, j: F.when(c == " ", c).otherwise(F.substr(y, nth(j), F.lit(1)))), "")
        return F.when(_mod97(F.concat(body, F.substr(x, F.lit(1), F.lit(4)))) == 1, _let(made, spaced)).otherwise(m)

    return _let(flat, put)


def _number(m: Column, key: str) -> Column:
    """The pseudonym of an address, date, security or phone number, null for other runs of digits."""
    # lookarounds see the match alone here, so they hold
    kind = lambda k: m.rlike(f"^(?:{_BARE.get(k, PATTERNS[k])})$")
    return (
        F.when(m.startswith("+") & kind("abroad"), _abroad(m, key)).when(kind("ip"), _ip(m, key)).when(kind("date"), _date(m, key))
        .when(kind("ssn"), _ssn(m, key)).when(kind("phone"), _phone(m, key))
    )


#: Patterns without what must stand before.
_BARE = {"phone": PATTERNS["phone"].replace("(?<=(?i:phone|tel|call|cell|mobile|fax)[.: ]{0,3})", "")}


def _pseudonym(m: Column, key: str) -> Column:
    """What replaces a match, as struct(text, n): n values in it were changed."""
    local, keep = F.substring_index(m, "@", 1), F.regexp_extract(m, r'^(AKIA|(?:sk|pk|rk|ghp)[_-](?:live[_-]|test[_-]|proj[_-])?|[^=:]*[=:]\s*"?)', 1)
    one = (
        F.when(F.contains(m, F.lit("@")), F.concat(_without_case(local, lambda x: feistel_text(x, key, "email")), F.substr(m, F.length(local) + 1)))
        .when(m.rlike(f"^(?:{PATTERNS['ip6']})$"), feistel_text(m, key, "ip6", 6))
        .when(m.rlike(f"^(?:{PATTERNS['iban']})$"), _iban(m, key))
        .when(m.rlike("^[A-Za-z]"), F.concat(keep, feistel_text(F.substr(m, F.length(keep) + 1), key, "secret")))
        .otherwise(_number(m, key))
    )
    return _let(one, lambda v: F.when(v.isNull(), _run(m, key)).otherwise(F.struct(v.alias("text"), (v != m).cast("int").alias("n"))))


def pseudonymise(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_found, text.

    The key is the argument or the session's KEY_SETTING; without either there is an error, since
    whoever has the key can undo every pseudonym. n_found counts values of the patterns that were
    changed; what fails its validation stays as it is. Phone numbers have none: whatever has their form gets a pseudonym, with codes from 200 on
    for such codes and lower ones for lower ones. Cards are looked for in whole runs of
    digit groups, so numbers beside them don't hide them. Null text stays null with 0. Texts of any
    length are read whole, in time in proportion to their length. Rows with a null id are treated like any others. An empty table gives an
    empty result; repeated rows are treated alike. Other columns of docs are not read.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one or set {KEY_SETTING}")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = source.select("*", F.when(F.col("text").rlike("[0-9@]|AKIA|[=:]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("hits"))
    put = found.select("*", F.transform("hits", lambda m: _pseudonym(m, key)).alias("put"))
    between = F.split("text", ANY, -1)
    text = F.array_join(F.zip_with(between, F.concat("put.text", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.aggregate("put", F.lit(0), lambda s, p: s + p["n"]).cast("long")
    has = F.coalesce(F.size("hits") > 0, F.lit(False))
    return put.select("doc_id", F.when(has, changed).otherwise(F.lit(0).cast("long")).alias("n_found"), F.when(has, text).otherwise(F.col("text")).alias("text"))
