"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Method.  Personal numbers, dates, addresses and secrets are found by pattern and
validated (card numbers by issuer prefix and check digit, internet addresses by
octet, social security numbers by range, dates by calendar).  A valid value is
read as a number below ``a * b``, the size of its format, and sent through ten
Feistel rounds on the pair (mod a, div a) whose round function is SHA-256 under
a key.  That is a permutation of the format: the result is a valid value of the
same format, different values stay different, and equal values get the same
pseudonym in every document.  With the key, :func:`reveal` undoes it.

Formats: e-mail (the name before the @, at most 64 characters and longer ones are none; letters
and digits keep their class; at most 128 labels of 63 characters after it),
phone (any ten digits; the country code stays), IPv4, payment card (issuer digits
stay, the check digit is made anew), social security number, date (days of 1700
to 2099; the way of writing stays, with two digits for day and month; a day has the same
pseudonym in every way of writing; with dots or slashes the day is read first, unless only the month can be) and
hexadecimal secrets of 32 to 64 digits.  What isn't valid stays as it is.

Defined results: a null text stays null with no finds; an empty text stays
empty.  Rows are independent, so ties and repeated rows get equal results; an
empty table gives an empty result.  Texts are taken whole, in time that grows with
their length.  Columns of the input may have any name; the struct's name gets
underscores until it is free.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import free_name, named

ROUNDS = 10
BLOCK = 12
DAYS = 146_097  # of 400 Gregorian years
FIRST_DAY = -98_615  # 1700-01-01

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FREE = r"(?<![0-9A-Za-z])(?<![0-9][.,])"
_END = r"(?![0-9A-Za-z])"
#: In the order in which they are tried at a place.
PATTERNS = {
    # with bounds, and tried at the first character of a run only: no text takes more than linear time
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){0,126}\.[A-Za-z]{2,63}",
    "secret": _FREE + r"[0-9a-fA-F]{32,64}" + _END,
    # signs of lists and tables may stand between the parts of a number with a bracketed area code
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+[0-9]{1,3}[^0-9A-Za-z]{0,6})?\([0-9]{3}\)[^0-9A-Za-z]{0,6}|(?:\+[0-9]{1,3}[ .\-]?)?[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}" + _END,
    "ip": r"(?<![0-9A-Za-z.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "card": _FREE + r"(?:[0-9]{13,19}|(?:[0-9]{4}[ \-]){3}[0-9]{4})" + _END,
    "ssn": _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "date": _FREE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _round(key: Column, tweak: Column, i: Column, half: Column) -> Column:
    """60 bits of SHA-256 under the key."""
    data = F.concat_ws("|", key, tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(data.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def feistel(x: Column, a: Column, b: Column, key: Column, tweak: Column, back: bool = False) -> Column:
    """Permutation of the numbers below ``a * b`` (which must be below 2 ** 62)."""
    a, b = a.cast("long"), b.cast("long")

    def there(x: Column, i: Column) -> Column:
        half = _div(x, a)
        return b * ((x % a + _round(key, tweak, i, half) % a) % a) + half

    def undo(x: Column, i: Column) -> Column:
        half = x % b
        return a * half + F.pmod(_div(x, b) - _round(key, tweak, i, half) % a, a)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x.cast("long"), undo if back else there)


def _symbols(s: Column, hexadecimal: bool) -> Column:
    """For each character: the first of its class, the size of the class (1: stays) and its place in it."""

    def symbol(c: Column) -> Column:
        code = F.ascii(c)
        digit, lower, upper = (c >= "0") & (c <= "9"), (c >= "a") & (c <= "z"), (c >= "A") & (c <= "Z")
        if hexadecimal:
            return F.struct(F.lit("").alias("c"), F.lit(16).alias("n"), (F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1).alias("v"))
        n = F.when(digit, 10).when(lower | upper, 26).otherwise(1)
        first = F.when(digit, 48).when(lower, 97).when(upper, 65).otherwise(code)
        return F.struct(c.alias("c"), n.alias("n"), F.when(n > 1, code - first).otherwise(0).alias("v"))

    return F.transform(F.split(s, ""), symbol)


def _product(symbols: Column) -> Column:
    return F.aggregate(symbols, F.lit(1).cast("long"), lambda n, c: n * c["n"])


def _block(s: Column, key: Column, tweak: Column, hexadecimal: bool, back: bool) -> Column:
    """At most ``BLOCK`` characters as a number in mixed radix, permuted, and written again."""
    # the steps are chained by one-element arrays, so that each is evaluated once
    first = F.transform(F.array(_symbols(s, hexadecimal)), lambda c: F.struct(c.alias("c"), _div(F.size(c), F.lit(2)).cast("int").alias("h")))
    second = F.transform(
        first,
        lambda t: F.struct(
            t["c"].alias("c"),
            F.aggregate(t["c"], F.lit(0).cast("long"), lambda x, c: x * c["n"] + c["v"]).alias("x"),
            _product(F.slice(t["c"], F.lit(1), t["h"])).alias("a"),
            _product(F.slice(t["c"], t["h"] + 1, F.lit(BLOCK))).alias("b"),
        ),
    )
    third = F.transform(second, lambda t: F.struct(t["c"].alias("c"), feistel(t["x"], t["a"], t["b"], key, tweak, back).alias("y")))

    def written(t: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            v = (_div(t["y"], _product(F.slice(t["c"], i + 2, F.lit(BLOCK)))) % c["n"]).cast("int")
            if hexadecimal:
                return F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1))
            base = F.when((c["c"] >= "0") & (c["c"] <= "9"), 48).when((c["c"] >= "a") & (c["c"] <= "z"), 97).otherwise(65)
            return F.when(c["n"] == 1, c["c"]).otherwise(F.char(base + v))

        return F.array_join(F.transform(t["c"], one), "")

    return F.get(F.transform(third, written), F.lit(0))


def permuted(s: Column, key: Column, kind: str, hexadecimal: bool = False, back: bool = False) -> Column:
    """ASCII text with its letters and digits permuted within their classes, block after block.

    The tweak of a block has the length and the enciphered blocks before it, in lower case, so that names which differ in case only stay linked.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(BLOCK))

    def step(done: Column, at: Column) -> Column:
        part = F.substring(s, at, F.lit(BLOCK))
        before = F.substring(s, F.lit(1), at - 1) if back else done
        return F.concat(done, _block(part, key, F.concat_ws("|", F.lit(kind), F.length(s).cast("string"), F.lower(before)), hexadecimal, back))

    return F.when(F.length(s) > 0, F.aggregate(starts, F.lit(""), step)).otherwise(s)


def luhn(digits: Column) -> Column:
    """Sum of the check: a multiple of 10 for a valid number."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _card(m: Column, key: Column, back: bool) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(d)
    issuer = d.rlike("^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35|30[0-5]|36|38|6011|65|64[4-9])")
    fixed = F.when(d.startswith("4"), 1).otherwise(4)
    middle = permuted(F.substring(d, fixed + 1, n - fixed - 1), key, "card", back=back)
    body = F.concat(F.substring(d, F.lit(1), fixed), middle)
    new = F.concat(body, ((F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    pieces = [x for i in range(4) for x in (F.substring(new, 4 * i + 1, 4), F.substring(m, 5 * i + 5, 1))][:-1]
    return F.when(issuer & (luhn(d) % 10 == 0), F.when(F.length(m) == n, new).otherwise(F.concat(*pieces)))


def _phone(m: Column, key: Column, back: bool) -> Column:
    shape = r"^(.*?)([0-9]{3})([^0-9]*)([0-9]{3})([^0-9]*)([0-9]{4})$"
    g = [F.regexp_extract(m, shape, i) for i in range(1, 7)]
    new = permuted(F.concat(g[1], g[3], g[5]), key, "phone", back=back)
    return F.concat(g[0], F.substring(new, 1, 3), g[2], F.substring(new, 4, 3), g[4], F.substring(new, 7, 4))


def _numbers(m: Column, separator: str, scale: list[int]) -> Column:
    parts = F.transform(F.split(m, separator), lambda p: p.cast("long"))
    return sum((F.get(parts, F.lit(i)) * s for i, s in enumerate(scale)), F.lit(0).cast("long"))


def _ip(m: Column, key: Column, back: bool) -> Column:
    y = feistel(_numbers(m, "[.]", [1 << 24, 1 << 16, 1 << 8, 1]), F.lit(1 << 16), F.lit(1 << 16), key, F.lit("ip"), back)
    return F.get(F.transform(F.array(y), lambda y: F.concat_ws(".", *((F.shiftright(y, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)))), F.lit(0))


def _ssn(m: Column, key: Column, back: bool) -> Column:
    area, group, serial = (F.get(F.transform(F.split(m, "-"), lambda p: p.cast("long")), F.lit(i)) for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    y = feistel((a * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"), back)

    def written(y: Column) -> Column:
        high = _div(y, F.lit(9999 * 99).cast("long")) + 1
        high = F.when(high >= 666, high + 1).otherwise(high)
        return F.concat_ws("-", F.lpad(high.cast("string"), 3, "0"), F.lpad((_div(y, F.lit(9999).cast("long")) % 99 + 1).cast("string"), 2, "0"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, F.get(F.transform(F.array(y), written), F.lit(0)))


def _date(m: Column, key: Column, back: bool) -> Column:
    iso = m.contains("-")
    dots = F.split(m, "[./]")
    part = lambda i: F.lpad(F.get(dots, F.lit(i)), 2, "0")
    month_first = m.contains("/") & (F.get(dots, F.lit(1)).cast("int") > 12)
    text = F.when(iso, m).when(month_first, F.concat_ws("-", F.get(dots, F.lit(2)), part(0), part(1))).otherwise(F.concat_ws("-", F.get(dots, F.lit(2)), part(1), part(0)))
    # a date that the calendar doesn't have is null here, and later unchanged
    day = F.unix_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")) - FIRST_DAY

    def step(x: Column) -> Column:
        return feistel(x, F.lit(773), F.lit(DAYS // 773), key, F.lit("date"), back)

    def late(x: Column) -> Column:  # can be read in one way only, whichever of day and month is first
        return F.dayofmonth(F.date_from_unix_date((x + FIRST_DAY).cast("int"))) > 12

    # the permutation is followed until the result is of the same kind: one pseudonym for a day, however it is written
    def walked(day: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), day, lambda x, i: F.when((i > 1) & (late(x) == late(day)), x).otherwise(step(x)))

    y = F.get(F.transform(F.array(day.cast("long")), walked), F.lit(0))

    def written(y: Column) -> Column:
        d = F.date_from_unix_date((y + FIRST_DAY).cast("int"))
        sep = F.regexp_extract(m, "[./]", 0)
        own = F.when(month_first, F.concat(F.date_format(d, "MM"), sep, F.date_format(d, "dd"))).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM")))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(own, sep, F.date_format(d, "yyyy")))

    return F.when((day >= 0) & (day < DAYS), F.get(F.transform(F.array(y), written), F.lit(0)))


def _email(m: Column, key: Column, back: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted(F.substring(m, F.lit(1), at - 1), key, "email", back=back), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: Column, back: bool) -> Column:
    new = permuted(F.lower(m), key, "secret", True, back)
    return F.when(m == F.lower(m), new).otherwise(F.upper(new))


MAKE = {"email": _email, "secret": _secret, "phone": _phone, "ip": _ip, "card": _card, "ssn": _ssn, "date": _date}


def replacement(m: Column, key: Column, back: bool = False) -> Column:
    """(kind, new) of a match; null if it isn't valid."""
    chain = F.lit(None)
    for kind in reversed(PATTERNS):
        mine = m.rlike(f"^(?:{PATTERNS[kind]})$")
        new = MAKE[kind](m, key, back)
        chain = F.when(mine, F.struct(F.lit(kind).alias("kind"), new.alias("new"))).otherwise(chain)
    return chain


def _schedule(spark: SparkSession, key: str) -> Column:
    """What the rounds use of a key, a digest, as a scalar that is read when the query runs: a plan names the row that holds it, not its value."""
    held = spark.sparkContext.parallelize([(hashlib.sha256(b"feistel key|" + key.encode()).hexdigest(),)], 1)
    return spark.createDataFrame(held, "schedule string").scalar()


def pseudonyms(docs: DataFrame, key: str, text: str = "text", out: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with a struct ``out``: ``text`` with pseudonyms, ``finds`` (kind and original of each, in order) and their number ``n``."""
    at, found, whole = free_name(docs, out), free_name(docs, "_matches"), named(docs, text).cast("string")
    none = F.expr("cast(array() as array<struct<was:string,kind:string,new:string>>)")
    # texts without a digit or an @ have nothing that the patterns could match
    likely = whole.rlike("[0-9@]|[a-fA-F]{32}")
    step = F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))
    secret = free_name(docs, "_schedule")
    made = F.transform(step, lambda m: F.struct(m.alias("was"), replacement(m, F.col(secret), back).alias("r")))
    made = F.transform(made, lambda x: F.struct(x["was"].alias("was"), x["r"]["kind"].alias("kind"), x["r"]["new"].alias("new")))
    rows = docs.withColumn(secret, _schedule(docs.sparkSession, key)).withColumn(found, F.when(likely, made).otherwise(none)).drop(secret)
    between = F.split(whole, ANY, -1)
    texts = F.zip_with(between, F.col(found), lambda a, x: F.concat(a, F.coalesce(x["new"], x["was"], F.lit(""))))
    finds = F.filter(F.col(found), lambda x: x["new"].isNotNull())
    new = F.when(F.size(found) > 0, F.array_join(texts, "")).otherwise(whole)
    fields = F.struct(new.alias("text"), F.transform(finds, lambda x: F.struct(x["kind"].alias("kind"), x["was"].alias("was"))).alias("finds"), F.size(finds).cast("long").alias("n"))
    return rows.withColumn(at, fields).drop(found)


def reveal(docs: DataFrame, key: str, text: str = "text", out: str = "pii") -> DataFrame:
    """The inverse of :func:`pseudonyms` under the same key."""
    return pseudonyms(docs, key, text, out, back=True)
