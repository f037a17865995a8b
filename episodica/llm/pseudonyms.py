"""Format-preserving pseudonyms for personal numbers, dates and addresses, in DataFrame functions only.

Candidates are found by one pattern, validated by kind (check digits, calendar, ranges) and replaced by a keyed
permutation within their own format: a Feistel network whose round function is SHA-256 of key, kind, round and the
other half.  A permutation maps equal values to equal pseudonyms in every document and never merges two values; who
holds the key can invert it (``inverse=True``).  What fails validation stays as it is.

Kinds: e-mail (its local part), payment card (Luhn), phone (8 to 15 digits; a country code stays), social security
number, IPv4 address, date 1900 to 2099 (ISO, or day and month with / or .), IBAN (mod 97), hexadecimal secret of 32
to 64 digits.

Defined cases: a null text stays null with no pseudonyms, an empty one empty; repeated and tied values get the same
pseudonym; texts of any length go through one split; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31, as the product of the two halves' sizes.
DAY_HALVES = (17, 4297)
#: Steps in which a permuted day and month become a date; one in fifty does not at each.
WALKS = 24

#: Patterns by kind, tried in this order.  Possessive and anchored by lookbehind, so that no text is quadratic.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}+|[0-9A-F]{32,64}+)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)


def _steps(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _shifted(half: Column, digest: Column, sign: int, letters: int) -> Column:
    """Each digit and letter moved within its class by two hexadecimal digits of the digest; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        by = sign * F.conv(F.substring(digest, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        moved = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
        return (
            F.when(code.between(48, 57), moved(48, 10))
            .when(code.between(97, 96 + letters), moved(97, letters))
            .when(code.between(65, 64 + letters), moved(65, letters))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permute_characters(value: Column, key: str, kind: str, letters: int = 26, inverse: bool = False) -> Column:
    """Feistel network over the two halves of a string; every character stays in its class."""
    sign = -1 if inverse else 1

    def step(a: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, _bound(_digest(key, kind, r, a["r"]), lambda d: _shifted(a["l"], d, sign, letters))).otherwise(a["l"])
        right = F.when(r % 2 == 1, _bound(_digest(key, kind, r, a["l"]), lambda d: _shifted(a["r"], d, sign, letters))).otherwise(a["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    def of(v: Column) -> Column:
        cut = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), cut).alias("l"), F.substring(v, cut + 1, F.length(v) - cut).alias("r"))
        return F.aggregate(_steps(inverse), start, step, lambda a: F.concat(a["l"], a["r"]))

    return _bound(value, of)


def permute_number(value: Column, sizes: tuple[int | Column, int | Column], key: str, kind: str, inverse: bool = False) -> Column:
    """Feistel network over 0 to ``sizes[0] * sizes[1] - 1``."""
    sign = -1 if inverse else 1
    one, two = (s if isinstance(s, Column) else F.lit(s) for s in sizes)
    many = lambda d: F.conv(F.substring(d, 1, 14), 16, 10).cast("long")

    def step(a: Column, r: Column) -> Column:
        left = F.when(r % 2 == 0, F.pmod(a["l"] + sign * many(_digest(key, kind, r, a["r"])), one)).otherwise(a["l"])
        right = F.when(r % 2 == 1, F.pmod(a["r"] + sign * many(_digest(key, kind, r, a["l"])), two)).otherwise(a["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    start = F.struct(F.floor(value / two).cast("long").alias("l"), F.pmod(value, two).cast("long").alias("r"))
    return F.aggregate(_steps(inverse), start, step, lambda a: a["l"] * two + a["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(pattern: Column, symbols: Column, at: str) -> Column:
    """``pattern`` with its characters of the class ``at`` replaced in order by those of ``symbols``."""
    return F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit("").alias("s"), F.lit(1).alias("k")),
        lambda a, c: F.struct(
            F.concat(a["s"], F.when(c.rlike(at), F.substring(symbols, a["k"], F.lit(1))).otherwise(c)).alias("s"),
            (a["k"] + F.when(c.rlike(at), 1).otherwise(0)).alias("k"),
        ),
        lambda a: a["s"],
    )


def luhn_sum(digits: Column) -> Column:
    def add(a: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((a["s"] + F.when(a["k"] % 2 == 1, twice).otherwise(d)).alias("s"), (a["k"] + 1).alias("k"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), add, lambda a: a["s"])


def _card(m: Column, key: str, inverse: bool) -> Column:
    def of(d: Column) -> Column:
        body = permute_characters(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", 26, inverse)
        whole = _bound(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), _refill(m, whole, "[0-9]")).otherwise(m)

    return _bound(_digits(m), of)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9]", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    valid = F.length(_digits(m)).between(8, 15)
    return F.when(valid, F.concat(code, _refill(rest, permute_characters(_digits(rest), key, "phone", 26, inverse), "[0-9]"))).otherwise(m)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    """Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999: the numbers that are given out, and no others."""
    area, group, serial = (F.substring(m, k, n).cast("long") for k, n in ((1, 3), (5, 2), (8, 4)))
    valid = ~m.rlike("^(000|666|9)|-00-|-0000$")
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written(n: Column) -> Column:
        place = F.floor(n / (99 * 9999))
        parts = (place + F.when(place >= 665, 2).otherwise(1), F.pmod(F.floor(n / 9999), F.lit(99)) + 1, F.pmod(n, F.lit(9999)) + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), k, "0") for x, k in zip(parts, (3, 2, 4), strict=True)])

    return F.when(valid, _bound(permute_number(number, (898 * 99, 9999), key, "ssn", inverse), written)).otherwise(m)


def _ip(m: Column, key: str, inverse: bool) -> Column:
    octet = lambda k: F.split_part(m, F.lit("."), F.lit(k)).cast("long")
    valid = m.rlike(r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}")
    number = octet(1) * 16777216 + octet(2) * 65536 + octet(3) * 256 + octet(4)
    part = lambda n, by: F.pmod(F.floor(n / by), F.lit(256)).cast("string")
    moved = _bound(permute_number(number, (65536, 65536), key, "ip", inverse), lambda n: F.concat_ws(".", part(n, 16777216), part(n, 65536), part(n, 256), part(n, 1)))
    return F.when(valid, moved).otherwise(m)


def _date(m: Column, key: str, inverse: bool) -> Column:
    """ISO dates are permuted by their day since 1900; others by :func:`_written_date`."""
    first = F.to_date(F.lit("1900-01-01"))
    value = F.try_to_date(m)
    moved = F.date_format(F.date_add(first, permute_number(F.datediff(value, first), DAY_HALVES, key, "date", inverse).cast("int")), "yyyy-MM-dd")
    iso = F.when(value.between(first, F.to_date(F.lit("2099-12-31"))), moved).otherwise(m)
    return F.when(m.rlike("^[0-9]{4}-"), iso).otherwise(_written_date(m, key, inverse))


def _written_date(m: Column, key: str, inverse: bool) -> Column:
    """Two fields and a year: the mark, the length of each field and their order stay.

    A value that is a date with the day first is so; else one with the month first, whose day is then 13 or more.  The
    format is thus told from the value and from its pseudonym alike.  Days and months of the fields' lengths are
    permuted together with the year, again and again until they are a date (one in fifty is not).
    """
    mark = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    field = lambda k: F.split_part(m, mark, F.lit(k))
    year = field(3).cast("long")
    is_date = lambda d, mo, y: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))).isNotNull()
    one, two = field(1).cast("long"), field(2).cast("long")

    def of(day_first: bool) -> Column:
        day, month = (one, two) if day_first else (two, one)
        day_size, month_size = (F.length(field(1)), F.length(field(2))) if day_first else (F.length(field(2)), F.length(field(1)))
        least = 1 if day_first else 13
        days, months = F.when(day_size == 1, 9).otherwise(32 - least).cast("long"), F.when(month_size == 1, 9).otherwise(12).cast("long")
        day_of = lambda n: F.floor(n / (months * 200)) + least
        month_of = lambda n: F.pmod(F.floor(n / 200), months) + 1
        year_of = lambda n: F.pmod(n, F.lit(200)) + 1900
        moved = lambda n: permute_number(n, (days * months, 200), key, f"date{least}", inverse)
        holds = lambda n: is_date(day_of(n), month_of(n), year_of(n))
        number = ((day - least) * months + month - 1) * 200 + year - 1900
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), moved(number), lambda n, _: F.when(holds(n), n).otherwise(moved(n)))
        parts = lambda n: (F.lpad(day_of(n).cast("string"), day_size, "0"), F.lpad(month_of(n).cast("string"), month_size, "0"))[:: 1 if day_first else -1]
        return _bound(walked, lambda n: F.concat(parts(n)[0], mark, parts(n)[1], mark, year_of(n).cast("string")))

    known = year.between(1900, 2099)
    return F.when(known & is_date(one, two, year), of(True)).when(known & is_date(two, one, year), of(False)).otherwise(m)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def rest(text: Column) -> Column:
        """The remainder by 97 of the number that the text stands for, letters as 10 to 35."""
        return F.aggregate(
            F.split(text, ""),
            F.lit(0),
            lambda a, c: F.when(c == "", a).when(F.ascii(c) < 58, (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
        )

    def of(v: Column) -> Column:
        country, account = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
        # Check digits are 02 to 98: others leave the same remainder, and two values would have one pseudonym.
        valid = F.length(v).between(15, 34) & F.substring(v, 3, 2).between("02", "98") & (rest(F.concat(account, F.substring(v, 1, 4))) == 1)
        moved = _bound(
            permute_characters(account, key, "iban", 26, inverse),
            lambda b: F.concat(country, F.lpad((98 - rest(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b),
        )
        return F.when(valid, _refill(m, moved, "[A-Z0-9]")).otherwise(m)

    return _bound(F.replace(m, F.lit(" "), F.lit("")), of)


def _email(m: Column, key: str, inverse: bool) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_characters(F.substring(m, F.lit(1), at - 1), key, "email", 26, inverse), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str, inverse: bool) -> Column:
    return permute_characters(m, key, "secret", 6, inverse)


_KINDS = {"email": _email, "iban": _iban, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value, or the value itself where it is not valid."""
    out = F.when(F.lit(False), match)
    for kind, permute in _KINDS.items():
        whole = f"^(?:{PATTERNS[kind]})$"
        out = out.when(match.rlike(whole), permute(match, key, inverse))
    return out.otherwise(match)


def pseudonymize(df: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``df`` with ``text`` replaced, and ``n_pseudonyms``: how many values were (a name clash gets underscores)."""
    found, moved, count = fresh(df, "found", "moved", "n_pseudonyms")
    source = F.col(text)
    with_found = df.withColumn(found, F.when(source.rlike("[0-9@]"), F.regexp_extract_all(source, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    with_moved = with_found.withColumn(moved, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key, inverse))).otherwise(F.col(found)))
    pieces = F.zip_with(F.split(source, ANY), moved, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return (
        with_moved.withColumn(text, F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(source))
        .withColumn(count, F.coalesce(F.size(F.filter(F.zip_with(found, moved, lambda a, b: a != b), lambda x: x)), F.lit(0)))
        .drop(found, moved)
    )
