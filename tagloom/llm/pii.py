"""PII pseudonyms that keep their format, in DataFrame operations only.

Card numbers (Luhn), dates (calendar) and IPv4 addresses (octets) are
validated, phone and social security numbers are taken by their form; all are
permuted within their own format by a keyed Feistel network: a card number stays one with a right check digit, a
date stays a date in its notation, and separators stay where they are. Mail
addresses and long hexadecimal secrets get keyed hashes of their form (128 bits
for mail, as many as the secret has for hexadecimal). The
permutation depends on the key and the format only, so equal values stay linked
across documents and different ones stay apart. What does not validate is left
alone; of matches that begin together the kind named first in ``KINDS`` counts.
There is no public key: a session without one gets a key of its own.

Everything is one projection: the text is split at the matches, every match is
mapped, and both lists are put together again.

Defined results: null texts stay null with no findings; empty texts stay empty;
a very long text is split and put together whole, in one
task; rows are independent, so repeated rows get equal results; an empty table gives
no rows. Extra columns are ignored. Dates outside 1900 to 2099 and numbers of
other lengths are not validated and stay.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import keyed, plain_id

#: The session setting that holds the secret key.
KEY_SETTING = "spark.tagloom.pii.key"
#: Drawn once for the driver, where the session names none: such pseudonyms link within one application and nobody can reverse them.
_drawn = secrets.token_hex(32)
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31.
DAYS = 73_049
#: Steps of cycle walking; a day is still outside after them with probability 1e-36.
WALK = 64

# starts at the start of a token only and gives nothing back, so a long token costs its length once
MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
ISO = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
SLASH = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"
HEX = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
KINDS = {"mail": MAIL, "hex": HEX, "date": f"{ISO}|{SLASH}", "ssn": SSN, "phone": PHONE, "ipv4": IPV4, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _keyed(parts: list[Column], key: str) -> Column:
    """A number below 2**52 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256), 1, 13), 16, 10).cast("long")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def feistel_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the decimal strings of this length (2 to 18 digits)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, n).alias("b"))

    def step(s: Column, r: Column) -> Column:
        size = F.length(s["a"])
        mixed = F.pmod(s["a"].cast("long") + _keyed([F.lit(kind), n.cast("string"), r.cast("string"), s["b"]], key), _power(size))
        return F.struct(s["b"].alias("a"), F.lpad(mixed.cast("string"), size, F.lit("0")).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))


def feistel_bits(number: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers below 2**32."""
    start = F.struct(F.floor(number / 65536).cast("long").alias("a"), F.pmod(number, F.lit(65536)).cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _keyed([F.lit(kind), r.cast("string"), s["b"].cast("string")], key), F.lit(65536)).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * 65536 + s["b"])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def step(s: Column, ch: Column) -> Column:
        is_digit = (ch >= "0") & (ch <= "9")
        return F.struct(F.concat(s["s"], F.when(is_digit, F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(ch)).alias("s"), (s["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["s"])


def luhn_sum(digits: Column) -> Column:
    """Luhn sum, the last digit counting once."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise((2 * ch.cast("int")) % 10 + F.floor(2 * ch.cast("int") / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = F.concat(F.substring(d, 1, 1), feistel_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, refill(m, F.concat(body, check)))


def _day(date: Column, key: str) -> Column:
    """Another day between 1900 and 2099; null outside."""
    day = F.datediff(date, F.lit("1900-01-01").cast("date"))
    start = F.struct(day.alias("v"), F.lit(False).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        moved = feistel_digits(F.lpad(s["v"].cast("string"), 5, "0"), key, "date").cast("int")
        return F.when(s["ok"], s).otherwise(F.struct(moved.alias("v"), (moved < DAYS).alias("ok")))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda s: F.when(s["ok"], s["v"]))
    return F.when(day.between(0, DAYS - 1), F.date_add(F.lit("1900-01-01").cast("date"), walked))


def _date(m: Column, key: str) -> Column:
    """ISO, else month first, else day first."""
    out = F.lit(None).cast("string")
    for pattern, shape in (("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"), ("MM/dd/yyyy", r"^(0[1-9]|1[0-2])/\d{2}/\d{4}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$")):
        y, mo, d = (F.substring(m, pattern.index(c) + 1, pattern.count(c)) for c in ("y", "M", "d"))
        real = F.try_to_date(F.concat_ws("-", y, mo, d), "yyyy-MM-dd")
        out = F.when(m.rlike(shape) & real.isNotNull(), F.date_format(_day(real, key), pattern)).otherwise(out)
    return out


def _ipv4(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    new = feistel_bits(number, key, "ipv4")
    octet = [F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(F.forall(parts, lambda x: x.cast("int") <= 255), F.concat_ws(".", *octet))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the ten digits after it are permuted."""
    d = digits_of(m)
    code = F.length(d) - 10
    return refill(m, F.concat(F.substring(d, F.lit(1), code), feistel_digits(F.substring(d, code + 1, F.lit(10)), key, "phone")))


def kind_of(m: Column) -> Column:
    out = F.lit("card")
    for kind in reversed([k for k in KINDS if k != "card"]):
        # look-around needs no context here: the match stands alone
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of one match, null where it does not validate."""
    low = F.lower(m)
    hexed = F.substring(F.sha2(F.concat(F.lit(key), low).cast("binary"), 256), F.lit(1), F.length(m))
    return (
        F.when(kind == "mail", F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), low).cast("binary"), 256), 1, 32), F.lit("@"), F.lit("mail.example")))
        .when(kind == "hex", F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(hexed)).otherwise(hexed))
        .when(kind == "date", _date(m, key))
        .when(kind == "ssn", refill(m, feistel_digits(digits_of(m), key, "ssn")))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "ipv4", _ipv4(m, key))
        .otherwise(_card(m, key))
    )


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or _drawn


def pseudonymize(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``text`` with pseudonyms, ``found`` (kind and pseudonym of each validated match, in order). Without ``key`` the session's is taken."""
    key = key or session_key(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    some = F.col("_text").rlike("[0-9@]") & F.col("_text").isNotNull()
    parts = rows.select("_id", "_text", F.when(some, F.split("_text", ANY, -1)).alias("between"), F.when(some, F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).alias("m"))
    mapped = parts.withColumn("m", F.transform("m", lambda x: F.struct(x.alias("old"), kind_of(x).alias("kind"))))
    mapped = mapped.withColumn("m", F.transform("m", lambda x: F.struct(x["old"].alias("old"), x["kind"].alias("kind"), pseudonym(x["old"], x["kind"], key).alias("new"))))
    pieces = F.transform("between", lambda x, i: F.concat(F.when(i > 0, F.coalesce(F.col("m")[i - 1]["new"], F.col("m")[i - 1]["old"])).otherwise(F.lit("")), x))
    text = F.when(F.col("between").isNull(), F.col("_text")).otherwise(F.array_join(pieces, ""))
    found = F.transform(F.filter(F.coalesce("m", F.array().cast("array<struct<old:string,kind:string,new:string>>")), lambda x: x["new"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym")))
    return mapped.select(plain_id(), text.alias("text"), found.alias("found"))


def contract(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, the number of validated values by kind, and the rewritten ``text``."""
    out = pseudonymize(docs)
    of_kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, "text")
