"""Personal data to format-preserving pseudonyms, by keyed Feistel networks in SQL expressions.

Every finding is permuted within its own format: a valid card number gives a
valid card number, a date a date, an address an address. The permutation depends
on the key, the kind and the value alone, so equal values stay equal in all
documents and different ones stay different. Nothing runs outside the JVM.

Two networks do all the work. Numbers of a domain a x b are split into a part
modulo a and a part modulo b, to which keyed digests of the other part are added
in turn. Strings are split into halves, and each character is shifted within its
class (digits, small and capital letters) by a keyed digest of the other half;
characters of no class stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: Lengths of IBANs by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """The length of the country first, so that no further word is taken; then any length."""
    out = ""
    for n, names in _IBAN_LENGTHS.items():
        last = " ?[A-Z0-9]{%d}" % (n % 4) if n % 4 else ""
        out += r"(?:%s)\d{2}(?: ?[A-Z0-9]{4}){%d}%s%s|" % ("|".join(names.split()), n // 4 - 1, last, _NO_WORD_AFTER)
    return "(?:" + out + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"


#: What a card number doesn't go on with: a date, an address, a security or telephone number of its own.
_NEXT = r"(?!(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]?\d[./][0-3]?\d[./](?:19|20)\d\d|(?:\d{1,3}\.){3}\d{1,3}|\d{3}-\d{2}-\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})(?![\p{L}\p{N}_\-]))"

#: What is looked for, in this order of preference at the same place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,125}\.\p{L}{2,24}(?![\p{L}\p{N}\-])",
    "secret": _NO_WORD_BEFORE + r"(?:AKIA[0-9A-Z]{16}|(?:[Pp]assword|[Pp]asswd|[Tt]oken|[Ss]ecret|[Aa]pi_?[Kk]ey) ?[=:] ?\"?[A-Za-z0-9_\-]{8,})" + _NO_WORD_AFTER,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[\-. ]\d{4}|\d{3}[\-.]\d{3}[\-.]\d{4})" + _NO_WORD_AFTER,
    "ip": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}_])(?!\.\d)",
    "date": _NO_WORD_BEFORE + r"(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]?\d([./])[0-3]?\d\1(?:19|20)\d\d)(?:" + _NO_WORD_AFTER + r"|(?=T\d\d:\d\d))",
    "ssn": r"(?<![\p{L}\p{N}_\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_\-])",
    "iban": _NO_WORD_BEFORE + _ibans() + _NO_WORD_AFTER,
    "card": r"(?<![\p{L}\p{N}_\-])\d(?:(?:[ \-]" + _NEXT + r")?\d){12,18}(?![\p{N}_])",
}
#: What every finding has: a cheap test that most texts fail.
_HINT = r"[0-9@]|AKIA[A-Z]{16}|[=:] ?\"?[A-Za-z0-9_\-]{8}"
ROUNDS = 6


def _any() -> str:
    return "|".join(p.replace(r"\1", r"\k<sep>").replace("([./])", "(?<sep>[./])") for p in PATTERNS.values())


def _digest(key: str, kind: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value.cast("string")), 256)


def feistel_number(a: int, b: int, left: Column, right: Column, key: str, kind: str, out: Callable[[Column, Column], Column]) -> Column:
    """``out(left', right')`` of the permuted pair; 0 <= left < a and 0 <= right < b."""

    def step(s: Column, i: Column) -> Column:
        def moved(to: Column, by: Column, m: int) -> Column:
            return F.pmod(to + F.conv(F.substring(_digest(key, kind, i, by), 1, 15), 16, 10).cast("long"), F.lit(m))

        even = F.struct(moved(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), moved(s["r"], s["l"], b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.lit(list(range(ROUNDS))), start, step, lambda s: out(s["l"], s["r"]))


def _shifted(text: Column, digest: Column) -> Column:
    """Each character shifted within its class by the digest."""

    def one(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(digest, (j % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")

        def within(low: str, n: int) -> Column:
            return F.chr(F.lit(ord(low)) + (F.ascii(c) - ord(low) + by) % n)

        classes = F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26))
        return classes.when(c.between("A", "Z"), within("A", 26)).when(c.between("", ""), _private(c, by)).otherwise(c)

    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), one), ""))


_DIGIT29, _PRIVATE = "23456789", "".join(chr(0xE000 + d) for d in range(2, 10))


def _private(c: Column, by: Column) -> Column:
    """The class of digits from 2 to 9, held as private-use characters."""
    digit = F.translate(c, _PRIVATE, _DIGIT29).cast("int")
    return F.translate(((digit - 2 + by) % 8 + 2).cast("string"), _DIGIT29, _PRIVATE)


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """``text`` permuted among the texts with the same classes of characters."""
    half = F.floor(F.length(text) / 2).cast("int")

    def step(s: Column, i: Column) -> Column:
        even = F.struct(_shifted(s["l"], _digest(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), _shifted(s["r"], _digest(key, kind, i, s["l"])).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.lit(list(range(ROUNDS))), start, step, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, first_weight: int) -> Column:
    """Weighted digit sum from the right, the last digit having ``first_weight``."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * s["w"]
        return F.struct((s["t"] + d - F.when(d > 9, 9).otherwise(0)).alias("t"), (3 - s["w"]).alias("w"))

    start = F.struct(F.lit(0).alias("t"), F.lit(first_weight).alias("w"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["t"])


#: Groupings by which a part of a match is read as a card: the usual ones, which go first, and others.
_USUAL, _GROUPED = r"^(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{4,5}|\d{13,19})$", r"^\d{4,}(?:[ \-]\d{4,})*(?:[ \-]\d+)?$"


def _ends(x: Column, breaks: str) -> Column:
    """The places in ``x`` where a group of characters ends."""
    return F.filter(F.sequence(F.lit(1), F.length(x)), lambda i: (i == F.length(x)) | F.substring(x, i + 1, F.lit(1)).isin(*breaks))


def _card(x: Column, key: str) -> Column:
    """The best valid reading in ``x`` permuted, what is around it kept: a match may hold further numbers."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")

    def reading(s: Column, e: Column) -> Column:
        c = F.substring(x, s, e - s + 1)
        rank = F.when(c.rlike(_USUAL), 0).when(c == x, 1).when(c.rlike(_GROUPED), 2)
        return F.struct(rank.alias("rank"), (s - e).alias("less"), s.alias("s"), c.alias("c"))

    def new(c: Column) -> Column:
        body = F.substring(c, F.lit(1), F.length(c) - 1)
        front = F.concat(F.substring(body, 1, 1), feistel_text(F.substring(body, F.lit(2), F.length(body)), key, "card"))
        return F.concat(front, F.pmod(-_luhn_sum(digits(front), 2), F.lit(10)).cast("string"))

    def valid(r: Column) -> Column:
        return r["rank"].isNotNull() & F.length(digits(r["c"])).between(13, 19) & (_luhn_sum(digits(r["c"]), 1) % 10 == 0)

    starts = F.concat(F.array(F.lit(1)), F.transform(F.filter(_ends(x, " -"), lambda i: i < F.length(x)), lambda i: i + 2))
    all_of = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(_ends(x, " -"), lambda e: e - s >= 12), lambda e: reading(s, e))))
    best = F.array(F.array_min(F.filter(all_of, valid)))
    around = lambda r: F.concat(F.substring(x, F.lit(1), r["s"] - 1), new(r["c"]), F.substring(x, r["s"] + F.length(r["c"]), F.length(x)))
    return F.coalesce(F.get(F.transform(best, around), F.lit(0)), x)


def _mod97(text: Column) -> Column:
    """An alphanumeric text as a number, letters from 10 to 35, modulo 97."""

    def add(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _iban(x: Column, key: str) -> Column:
    """The longest valid reading from the start of ``x`` permuted, words after it kept."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))

    def valid(c: Column) -> Column:
        b = bare(c)
        return F.length(b).between(15, 34) & (_mod97(F.concat(F.substring(b, F.lit(5), F.length(b)), F.substring(b, 1, 4))) == 1)

    def new(c: Column) -> Column:
        front, rest = F.substring(c, 1, 2), feistel_text(F.substring(c, F.lit(5), F.length(c)), key, "iban")
        check = 98 - _mod97(F.concat(bare(rest), front, F.lit("00")))
        return F.concat(front, F.lpad(check.cast("string"), 2, "0"), rest, F.substring(x, F.length(c) + 1, F.length(x)))

    readings = F.filter(F.transform(_ends(x, " "), lambda e: F.substring(x, F.lit(1), e)), valid)
    return F.coalesce(F.get(F.transform(F.slice(F.reverse(readings), 1, 1), new), F.lit(0)), x)


def _phone(x: Column, key: str) -> Column:
    code = F.regexp_extract(x, r"^(\+\d{1,3}(?:[ .\-]|(?=\()))?", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    plan = r"^(\(?)([2-9])(\d\d\)?[ .\-]?)([2-9])(\d\d[ .\-]?\d{4})$"
    part = [F.regexp_extract(rest, plan, k) for k in range(1, 6)]
    marked = F.concat(part[0], F.translate(part[1], _DIGIT29, _PRIVATE), part[2], F.translate(part[3], _DIGIT29, _PRIVATE), part[4])
    marked = F.when(rest.rlike(plan), marked).otherwise(rest)
    return F.concat(code, F.translate(feistel_text(marked, key, "phone"), _PRIVATE, _DIGIT29))


def _ip(x: Column, key: str) -> Column:
    o = [F.element_at(F.split(x, r"\."), k).cast("int") for k in range(1, 5)]

    def text(left: Column, right: Column) -> Column:
        return F.concat_ws(".", F.floor(left / 256).cast("string"), (left % 256).cast("string"), F.floor(right / 256).cast("string"), (right % 256).cast("string"))

    return feistel_number(1 << 16, 1 << 16, o[0] * 256 + o[1], o[2] * 256 + o[3], key, "ip", text)


#: The years 1900 to 2099, which the patterns find, have 73,049 = 17 x 4,297 days.
_DAYS_A, _DAYS_B, _DAY_ONE = 17, 4297, "1900-01-01"


def _date(x: Column, key: str) -> Column:
    """Day before month where that is a date, else month before day; where one of the two is written with one digit, both are without leading zero, unless they had one."""
    iso = x.rlike("^[0-9]{4}-")
    part = F.split(F.translate(x, "./", "--"), "-")
    read = lambda y, m, d: F.datediff(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), F.lit(_DAY_ONE).cast("date"))
    n = read(*(F.when(iso, part[i]).otherwise(part[j]) for i, j in ((0, 2), (1, 1), (2, 0))))
    american = F.when(~iso, read(part[2], part[0], part[1]))
    date = lambda n: F.date_add(F.lit(_DAY_ONE).cast("date"), n.cast("int"))
    moved = lambda n: feistel_number(_DAYS_A, _DAYS_B, F.floor(n / _DAYS_B), n % _DAYS_B, key, "date", lambda left, right: left * _DAYS_B + right)

    def walked(n: Column) -> Column:
        """Permuted among the dates that can't be read as day and month: again until one is met."""
        return F.aggregate(F.lit(list(range(80))), moved(n), lambda m, i: F.when(F.day(date(m)) <= 12, moved(m)).otherwise(m))

    bare = (F.length(part[0]) == 1) | (F.length(part[1]) == 1)
    two = lambda v, old: F.when(bare & ~old.startswith("0"), v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
    sep = F.when(x.contains("/"), "/").otherwise(".")
    spelt = lambda d, a, b: F.concat(two(a(d), part[0]), sep, two(b(d), part[1]), sep, F.year(d).cast("string"))
    new = F.when(iso, F.date_format(date(moved(n)), "yyyy-MM-dd")).otherwise(spelt(date(moved(n)), F.day, F.month))
    return F.when(n.isNotNull(), new).when(american.isNotNull(), spelt(date(walked(american)), F.month, F.day)).otherwise(x)


def _ssn(x: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = F.substring(x, 1, 3).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 8, 4).cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    left = area - F.when(area > 666, 2).otherwise(1)

    def text(a: Column, r: Column) -> Column:
        number = a + F.when(a + 1 >= 666, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((F.floor(r / 9999) + 1).cast("string"), 2, "0"), F.lpad((r % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, feistel_number(898, 99 * 9999, left, (group - 1) * 9999 + serial - 1, key, "ssn", text)).otherwise(x)


def _email(x: Column, key: str) -> Column:
    local, host = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    end = F.substring_index(host, ".", -1)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(end) - 1)
    return F.concat(feistel_text(local, key, "local"), F.lit("@"), feistel_text(front, key, "host"), F.lit("."), end)


def _secret(x: Column, key: str) -> Column:
    front = F.regexp_extract(x, "^(?:AKIA|[A-Za-z_]+ ?[=:] ?\"?)", 0)
    return F.concat(front, feistel_text(F.substring(x, F.length(front) + 1, F.length(x)), key, "secret"))


_BY_KIND = {"email": _email, "secret": _secret, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card}


def _kind(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(x.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one finding, or the finding itself if it isn't valid in its kind."""
    kind, out = _kind(x), x
    for name in reversed(PATTERNS):
        out = F.when(kind == name, _BY_KIND[name](x, key)).otherwise(out)
    return out


#: The setting of the session that holds the key.
KEY = "spark.geolith.pii.key"


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, n_found, n_replaced, kinds``.

    Who has the key can invert the pseudonyms. It is the session's setting ``KEY``
    unless given; without either nothing is done. It stands in the plan, so keep
    plans and event logs as safe as the key.

    ``text`` has all valid findings replaced and is otherwise unchanged, byte for
    byte; ``n_found`` counts what looked like personal data, ``n_replaced`` what
    was valid, ``kinds`` lists the kinds found, sorted, once each.

    Null text stays null with counts of 0; empty text stays empty. A text is
    handled on its own, in one pass over the table without a shuffle, so neither
    repeated rows nor common values matter. Other columns are not read.
    """
    key = key or docs.sparkSession.conf.get(KEY, None)
    if not key:
        raise ValueError(f"give a key or set {KEY}: pseudonyms without a secret key can be inverted")
    pattern = _any()
    t = F.col(text)
    found = F.when(t.rlike(_HINT) & t.rlike(pattern), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", t.alias("_t"), found.alias("_f"))
    rows = rows.withColumn("_p", F.transform("_f", lambda x: F.struct(x.alias("o"), pseudonym(x, key).alias("n"), _kind(x).alias("k"))))
    merged = F.array_join(F.zip_with(F.split("_t", pattern, -1), "_p", lambda a, b: F.concat(a, F.coalesce(b["n"], F.lit("")))), "")
    return rows.select(
        "doc_id",
        F.when(F.size("_f") > 0, merged).otherwise(F.col("_t")).alias("text"),
        F.size("_f").alias("n_found"),
        F.size(F.filter("_p", lambda x: x["n"] != x["o"])).alias("n_replaced"),
        F.array_sort(F.array_distinct(F.transform("_p", lambda x: x["k"]))).alias("kinds"),
    )


def op5_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """With the session's key, or the open one of tests."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY, None) or "an open key for tests")
