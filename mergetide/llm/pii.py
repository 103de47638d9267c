"""Format-preserving pseudonyms for personal data in text.

Mail addresses, IPv4 addresses, telephone numbers, dates, social security and payment
card numbers are found, validated (Luhn's check digit, calendar, octets, areas) and
replaced by a keyed Feistel permutation of the same format. Equal values get equal
pseudonyms in every document, different values different ones, and nobody without the
key can tell which. Numbers that fail validation are no such data and stay.

A value is split into two halves, each taken in turn by a keyed function of the other:
numbers modulo the halves' sizes, the letters and digits of a mail name each within
its class. Every step is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ipv4", "phone", "date", "ssn", "card")
ROUNDS = 8
# The formats, in the order in which they are tried at a place.
_FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\+[2-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}"
    r"|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9A-Za-z/-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
_ANY = "|".join(_FORMATS.values())
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
# Dates from 1900-01-01 to 2100-05-01: 270 * 271 days.
_FIRST_DAY, _DAYS = "1900-01-01", (270, 271)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def permute(a: Column, b: Column, a_size: Column, b_size: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the pairs (a, b) with a < a_size and b < b_size."""

    def keyed(r: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), kind, a_size.cast("string"), b_size.cast("string"), r.cast("string"), x.cast("string")), 256)
        return F.pmod(_number(F.substring(digest, 1, 15)), size)

    def turn(s: Column, r: Column) -> Column:
        first = r % 2 == 1
        return F.struct(
            F.when(first, F.pmod(s["a"] + keyed(r, s["b"], a_size), a_size)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(F.pmod(s["b"] + keyed(r, s["a"], b_size), b_size)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_name(name: Column, key: str) -> Column:
    """A keyed permutation of lower-case names: letters go to letters, digits to digits, the rest stays."""
    half = F.floor(F.length(name) / 2).cast("int")

    def shifted(text: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), r.cast("string"), other), 256)

        def shift(c: Column, i: Column) -> Column:
            by = _number(F.substring(digest, i * 2 + 1, F.lit(2)))
            letter, digit = F.instr(F.lit(_LETTERS), c), F.instr(F.lit(_DIGITS), c)
            return (
                F.when((c != "") & (letter > 0), F.substring(F.lit(_LETTERS), (F.pmod(letter - 1 + by, F.lit(26)) + 1).cast("int"), F.lit(1)))
                .when((c != "") & (digit > 0), F.substring(F.lit(_DIGITS), (F.pmod(digit - 1 + by, F.lit(10)) + 1).cast("int"), F.lit(1)))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), shift), "")

    def turn(s: Column, r: Column) -> Column:
        first = r % 2 == 1
        return F.struct(
            F.when(first, shifted(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(first, s["b"]).otherwise(shifted(s["b"], s["a"], r)).alias("b"),
        )

    start = F.struct(F.substring(name, F.lit(1), half).alias("a"), F.substring(name, half + 1, F.length(name)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a number's digits, the last one counted once."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _fill(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced by ``digits``, one after another."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, s["at"] + 1).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(F.split(match, ""), start, put, lambda s: s["out"])


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _ten_to(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _kind(m: Column) -> Column:
    """The kind of a match, or null where it fails validation."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    octets = F.split(m, r"\.")
    out = F.when(m.contains("@"), F.lit("email"))
    is_ip = m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    out = out.when(is_ip, F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ipv4")))
    is_date = m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})$")
    day = _day(m)
    out = out.when(is_date, F.when((day >= 0) & (day < _DAYS[0] * _DAYS[1]), F.lit("date")))
    area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    real = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = out.when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(real, F.lit("ssn")))
    is_phone = m.startswith("+") | m.startswith("(") | m.rlike(r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$")
    out = out.when(is_phone, F.when(F.length(digits).between(8, 15), F.lit("phone")))
    return out.when((luhn_sum(digits) % 10 == 0) & (F.regexp_replace(digits, "0", "") != ""), F.lit("card"))


def _day(m: Column) -> Column:
    """Days since _FIRST_DAY; a slash puts the month first if it can be one, a dot the day. Null if there is no such day."""
    p = F.split(F.translate(m, "/.", "--"), "-")
    first, second, third = (F.get(p, i).cast("int") for i in range(3))
    year = F.when(m.contains("/") | m.contains("."), third).otherwise(first)
    day_first = m.contains(".") | (m.contains("/") & (first > 12))
    month = F.when(m.contains("-"), second).when(day_first, second).otherwise(first)
    day = F.when(m.contains("-"), third).when(day_first, first).otherwise(second)
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    date = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.datediff(date, F.lit(_FIRST_DAY).cast("date"))


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The replacement of a valid match."""
    digits = F.regexp_replace(m, "[^0-9]", "")

    def numbers(a: Column, b: Column, a_size: Column, b_size: Column, then) -> Column:
        made = F.transform(F.array(permute(a, b, a_size, b_size, key, kind)), then)
        return F.get(made, 0)

    # email: the name before the @, capitals put back where they stood
    name = F.substring_index(m, "@", 1)
    lower = permute_name(F.lower(name), key)
    cased = F.array_join(
        F.zip_with(F.split(name, ""), F.split(lower, ""), lambda old, new: F.when(old.rlike("[A-Z]"), F.upper(new)).otherwise(new)), ""
    )
    email = F.concat(cased, F.substring(m, F.length(name) + 1, F.length(m)))

    octet = [F.get(F.split(m, r"\."), i).cast("long") for i in range(4)]
    half = F.lit(1 << 16)
    ipv4 = numbers(
        octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], half, half,
        lambda s: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]),
    )

    # phone: all digits but the country's
    country = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1))).otherwise(0)
    country = F.when(m.startswith("+") & (country == 0), 1).otherwise(country).cast("int")
    phone = _split_digits(m, digits, country, F.length(digits) - country, numbers, lambda head, body: F.concat(head, body))

    day = _day(m)
    sizes = [F.lit(n) for n in _DAYS]
    date = numbers(
        F.floor(day / _DAYS[1]), day % _DAYS[1], *sizes,
        lambda s: _write_date(m, F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["a"] * _DAYS[1] + s["b"]).cast("int"))),
    )

    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    ssn = numbers(
        place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999),
        lambda s: F.concat_ws("-", _padded(F.floor(s["a"] / 99) + 1 + F.when(F.floor(s["a"] / 99) >= 665, 1).otherwise(0), F.lit(3)),
                              _padded(s["a"] % 99 + 1, F.lit(2)), _padded(s["b"] + 1, F.lit(4))),
    )

    # card: the first digit stays, the last is computed anew
    def with_check(head: Column, body: Column) -> Column:
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(head, body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(head, body, check.cast("string"))

    card = _split_digits(m, digits, F.lit(1), F.length(digits) - 2, numbers, with_check)
    return (
        F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "phone", phone)
        .when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "card", card)
    )


def _split_digits(m: Column, digits: Column, head: Column, n: Column, numbers, joined) -> Column:
    """``m`` with ``n`` digits after its first ``head`` permuted."""
    low = F.floor(n / 2).cast("int")
    high = (n - low).cast("int")
    a = F.substring(digits, head + 1, low).cast("long")
    b = F.substring(digits, head + 1 + low, high).cast("long")
    start = F.substring(digits, F.lit(1), head)
    return numbers(
        a, b, _ten_to(low), _ten_to(high), lambda s: _fill(m, joined(start, F.concat(_padded(s["a"], low), _padded(s["b"], high))))
    )


def _write_date(m: Column, date: Column) -> Column:
    parts = F.split(F.translate(m, "/.", "--"), "-")
    day_first = m.contains(".") | (m.contains("/") & (F.get(parts, 0).cast("int") > 12))

    def two(pattern: str, i: int) -> Column:  # a leading zero if the part had two digits
        text = F.date_format(date, pattern)
        return F.when(F.length(F.get(parts, i)) == 2, text).otherwise(F.regexp_replace(text, "^0", ""))

    separator = F.when(m.contains("/"), "/").otherwise(".")
    month_then_day = F.concat(two("MM", 0), separator, two("dd", 1), separator, F.date_format(date, "yyyy"))
    day_then_month = F.concat(two("dd", 0), separator, two("MM", 1), separator, F.date_format(date, "yyyy"))
    return F.when(m.contains("-"), F.date_format(date, "yyyy-MM-dd")).when(day_first, day_then_month).otherwise(month_then_day)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` rewritten and, if asked for, ``n_`` + kind counting what was replaced of each kind.

    A null text stays null, with counts of 0. A slash date's order of day and month is
    told from its first number. Dates outside 1900-01-01 to 2100-05-01 stay. Of a mail
    address the domain stays. Columns named like a count give way to it; all others and
    the number of rows are untouched.
    """
    key = str(key)
    columns = [c for c in docs.columns if not (counts and c in [f"n_{k}" for k in KINDS])]
    own = [c for c in columns if c != text]
    prefix = "pii_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    body = F.col(text).cast("string")
    found = F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.lit(_ANY), 0))
    matched = docs.select(*own, body.alias(text), found.alias(f"{prefix}m"))
    judged = F.transform(f"{prefix}m", lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    valid = matched.select(*own, text, F.when(F.size(f"{prefix}m") > 0, judged).alias(f"{prefix}m"))
    new = F.transform(
        f"{prefix}m", lambda x: F.when(x["kind"].isNull(), x["m"]).otherwise(_pseudonym(x["m"], x["kind"], key))
    )
    gaps = F.split(F.col(text), _ANY, -1)
    put = F.array_join(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda gap, value: F.concat(gap, value)), "")
    touched = F.exists(f"{prefix}m", lambda x: x["kind"].isNotNull())
    rewritten = F.when(touched, put).otherwise(F.col(text)).alias(text)

    def count(kind: str) -> Column:
        of_kind = F.filter(f"{prefix}m", lambda x: x["kind"] == kind)
        return F.coalesce(F.size(of_kind), F.lit(0)).cast("long").alias(f"n_{kind}")

    return valid.select(*[rewritten if c == text else c for c in columns], *([count(k) for k in KINDS] if counts else []))
