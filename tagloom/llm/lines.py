"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line of at least ``LEAST`` characters is removed where an earlier line
(smaller document, or earlier in the same one) is at most ``EDITS`` edits away;
lines are judged on the input, not on what is left. Equal lines, by a 128-bit
hash, collapse first.

Every line is split into ``EDITS`` + 1 segments; two lines within the threshold
share a segment at nearly the same place, so a line probes the segment index of
each admissible length with its substrings at the positions that the
multi-match bound leaves. No pass moves the texts: the first reduces the lines
to their hashes, keys and first places; keys that more than one line has come
from an aggregate that is combined before the shuffle, and of keys with the
same lines one stays; a second pass fetches the few lines to compare and the
places of all that may go.

The lines of one key are compared inside a row: a key with many lines is dealt
out as blocks of about ``BLOCK``, one row for each pair of blocks, so no row
grows with the key and no row is made for a pair of lines. Pairs that lengths
and letter parities leave are verified by the banded bit-parallel edit
distance, a few bits for each character of the line.

Documents that lose nothing are passed on without a shuffle. The broadcast
filters hold numbers modulo ``FILTER``, so at most that many.

Defined results: null texts have no lines and stay null; empty texts are one
empty line; a very long text is split like any other, one task holding it
whole; rows that share an identifier are told apart by text; rows equal in both
are one document; null identifiers sort before all others; an empty table gives
no rows. Extra columns are ignored by the contract and kept by the other forms,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import NULL_ID, keyed, plain_id
from .scratch import Scratch

LEAST = 20
EDITS = 2
#: Numbers that a broadcast filter holds, at most.
FILTER = 1 << 22
#: Lines of a crowded key that one block holds, on average.
BLOCK = 48
#: Characters whose counts, odd or even, are compared before the texts: an edit turns at most two of them.
LETTERS = string.ascii_lowercase + string.digits + " .,"


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment i (from 0) of a line of this length; the last ones are longer."""
    n = edits + 1
    base = F.floor(length / n).cast("int")
    longer = (length % n).cast("int")
    before = F.greatest(F.lit(0), longer - (n - i))
    return (base * i + before + 1).cast("int"), (base + F.when(F.lit(i) >= n - longer, 1).otherwise(0)).cast("int")


def line_keys(edits: int) -> Column:
    """Segments of the line itself, and its substrings that meet the segments of other lines, no longer than this one."""
    n, out = F.col("n"), []
    for delta in range(edits + 1):
        length = n - delta
        for i in range(edits + 1):
            start, size = _segment(length, i, edits)
            lo, hi = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            for shift in range(lo, hi + 1):
                at = start + shift
                fits = (length >= 0) & (at >= 1) & (at + size - 1 <= n)
                out.append(F.when(fits, F.xxhash64(F.lit(i), length, F.col("line").substr(at, size))))
    return F.array(*out)


def parities(line: Column) -> Column:
    """One bit for each of ``LETTERS``: whether it occurs an odd number of times."""
    odd = [F.shiftleft((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(1).cast("long"), i) for i, c in enumerate(LETTERS)]
    out = odd[0]
    for o in odd[1:]:
        out = out.bitwiseOR(o)
    return out


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of characters are at most ``edits`` edits apart: Hyyrö's bit-vectors, cut to the band.

    Bit t at column j stands for row j - edits + t. The distance follows the
    lowest row of the band down to the last row, then goes along that one.
    Before the first difference the vectors stay as they start, and once no row
    of the band can be within ``edits`` they are left alone: both cost little.
    """
    every, top = (1 << 2 * edits + 1) - 1, 1 << 2 * edits
    above, below = (1 << edits) - 1, ((1 << edits + 1) - 1) << edits
    flip = lambda x: x.bitwiseXOR(F.lit(every))

    def over(a: Column, b: Column) -> Column:
        rows = F.size(a)

        def step(s: Column, j: Column) -> Column:
            own, slanted = F.get(b, j - 1), j + edits <= rows

            def turned(match: Column) -> Column:
                d0 = (match.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(match).bitwiseOR(s["vn"]).bitwiseAND(F.lit(every))
                return _let(d0, rest)

            def rest(d0: Column) -> Column:
                hp, hn, down = s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))), d0.bitwiseAND(s["vp"]), F.shiftright(d0, 1)
                last = F.call_function("shiftleft", F.lit(1), rows - j + edits)
                along = F.when(hp.bitwiseAND(last) != 0, 1).when(hn.bitwiseAND(last) != 0, -1).otherwise(0)
                slant = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
                return F.struct(hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + F.when(slanted, slant).otherwise(along)).alias("d"))

            match = sum((F.when(F.get(a, j - 1 + t - edits) == own, F.lit(1 << t)).otherwise(F.lit(0)) for t in range(2 * edits + 1)), F.lit(0))
            equal = (s["vn"] == above) & (s["vp"] == below) & slanted & (F.get(a, j - 1) == own)
            lost = s["d"] - F.bit_count(s["vp"]) > edits
            return F.when(equal | lost, s).otherwise(_let(match, turned))

        first = F.struct(F.lit(below).alias("vp"), F.lit(above).alias("vn"), F.least(F.lit(edits), rows).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), first, step, lambda s: s["d"] <= edits)

    return (F.abs(F.size(a) - F.size(b)) <= edits) & F.when(F.size(b) == 0, F.size(a) <= edits).otherwise(_let(a, lambda x: _let(b, lambda y: over(x, y))))


def _lines(rows: DataFrame, least: int) -> DataFrame:
    each = rows.where("_text is not null").select("_id", "_h", F.posexplode(F.split("_text", "\n", -1)).alias("no", "line"))
    return each.withColumn("n", F.length("line")).where(F.col("n") >= least)


def _place(c: Column | str) -> Column:
    return F.pmod(c if isinstance(c, Column) else F.col(c), F.lit(FILTER)).cast("int").alias("f")


def late_lines(each: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """Of lines at their places (_id, _h, no, line, n): the places of those with an earlier one within ``edits``."""
    hashed = each.select(F.xxhash64("line").alias("k"), F.xxhash64(F.lit(1), "line").alias("k2"), F.struct("_id", "no", "_h").alias("at"), line_keys(edits).alias("keys"))
    firsts = scratch.put(hashed.groupBy("k", "k2").agg(F.min("at").alias("at"), F.count("*").alias("c"), F.first("keys").alias("keys")), "firsts")
    keys = firsts.select("k", "k2", "at", F.explode_outer("keys").alias("key")).where("key is not null")
    mixed = keys.groupBy("key").agg(F.min("k").alias("x"), F.max("k").alias("y")).where("x <> y")
    sieve = scratch.put(mixed.select(_place("key")).distinct(), "sieve")
    # what the sieve lets through beyond the mixed keys ends as keys of one line
    met = scratch.put(keys.withColumn("f", _place("key")).join(F.broadcast(sieve), "f", "left_semi").drop("f").dropDuplicates(["key", "k", "k2"]), "met")
    # of keys with the same lines one is enough
    groups = met.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor("k").alias("a"), F.bit_xor(F.xxhash64("k2", "k")).alias("b")).where("m > 1")
    groups = scratch.put(groups.groupBy("m", "a", "b").agg(F.min("key").alias("key")).select("key", "m", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "groups")
    met = scratch.put(met.join(groups, "key"), "crowd")
    # one more pass finds the texts of the lines to compare and every place of lines that may go
    wanted = scratch.put(met.select(_place("k"), F.lit(True).alias("told")).union(firsts.where("c > 1").select(_place("k"), F.lit(False))).groupBy("f").agg(F.max("told").alias("told")), "wanted")
    spots = each.select(F.xxhash64("line").alias("k"), F.xxhash64(F.lit(1), "line").alias("k2"), "_id", "_h", "no", "line").withColumn("f", _place("k")).join(F.broadcast(wanted), "f")
    spots = scratch.put(spots.select("k", "k2", "_id", "_h", "no", F.when(F.col("told"), F.col("line")).alias("line")), "spots")
    texts = spots.where("line is not null").groupBy("k", "k2").agg(F.first("line").alias("line"))
    crowd = met.join(texts, ["k", "k2"]).withColumn("b", F.pmod(F.xxhash64("k", "k2"), F.col("blocks")).cast("int"))
    odd = F.when(F.col("m") > 4, parities(F.col("line"))).otherwise(F.lit(0).cast("long"))
    dealt = crowd.select("key", F.struct("k", "k2", "at", "b", F.length("line").alias("n"), odd.alias("odd"), "line").alias("m"), "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c"))
    rows = dealt.groupBy("key", F.least("b", "c").alias("p"), F.greatest("b", "c").alias("q")).agg(F.collect_list("m").alias("ms"))

    def near(y: Column):
        def run(x: Column) -> Column:
            apart = (F.col("p") == F.col("q")) | (x["b"] != y["b"])
            like = (F.abs(x["n"] - y["n"]) <= edits) & (F.bit_count(x["odd"].bitwiseXOR(y["odd"])) <= 2 * edits)
            return apart & like & (x["at"] < y["at"]) & within(F.split(x["line"], ""), F.split(y["line"], ""), edits)

        return run

    late = F.transform(F.filter("ms", lambda y: F.exists("ms", near(y))), lambda y: F.struct(y["k"], y["k2"]))
    late = scratch.put(rows.select(F.explode(late).alias("y")).select("y.*").distinct(), "late")
    bad = firsts.where("c > 1").select("k", "k2", "at").join(late, ["k", "k2"], "left_anti").union(late.select("k", "k2", F.lit(None).cast("struct<_id:bigint,no:int,_h:bigint>")))
    lost = spots.select("k", "k2", "_id", "_h", "no").join(bad, ["k", "k2"])
    return lost.where(F.col("at").isNull() | (F.col("at") != F.struct("_id", "no", "_h"))).select("_id", "_h", "no")


def _marked(docs: DataFrame, scratch: Scratch, least: int, edits: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, _h, numbers of lines to cut) of documents that lose lines, and the filter of their identifiers."""
    each = _lines(keyed(docs, id_col, text_col), least)
    losing = scratch.put(late_lines(each, edits, scratch).groupBy("_id", "_h").agg(F.collect_set("no").alias("gone")), "losing")
    return losing, losing.select(_place(F.xxhash64("_id", "_h"))).distinct()


def _cut(docs: DataFrame, least: int, edits: int, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns of ``docs``, the text rewritten), ``n_lines``, ``n_removed``: the caller's columns travel as one, so that no name can clash."""
    scratch = Scratch(docs.sparkSession)
    losing, sieve = _marked(docs, scratch, least, edits, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(text).alias("_h"),
        F.split(text, "\n", -1).alias("lines"),
    )
    rows = rows.withColumn("f", _place(F.xxhash64("_id", "_h")))
    n_lines = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines")
    shape = lambda new: F.struct(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]).alias("row")
    whole = rows.join(F.broadcast(sieve), "f", "left_anti").select(shape(F.col("row").getField(text_col).cast("string")), n_lines, F.lit(0).cast("long").alias("n_removed"))
    cut = rows.join(F.broadcast(sieve), "f", "left_semi").join(losing, ["_id", "_h"], "left")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    cut = cut.withColumn("left", left)
    removed = F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed")
    return whole.unionByName(cut.select(shape(F.when(F.col("lines").isNotNull(), F.array_join("left", "\n"))), n_lines, removed))


def repeated_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and ``_n_lines``, ``_n_removed``, which replace columns of those names."""
    out = _cut(docs, least, edits, id_col, text_col)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return out.select(*own, F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))


def contract(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed``, ``kept_sha256`` of the lines that stay."""
    out = repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Pipeline form: repeated lines are cut, documents left without a word go if they lost lines; ``n_chars`` follows the text."""
    out = _cut(docs, LEAST, EDITS, "doc_id", "text")
    text, lost = F.col("row").getField("text"), F.col("n_removed") > 0
    out = out.where(~lost | (F.length(F.trim(text)) > 0))
    chars = lambda c: F.when(lost, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("row").getField(c)).alias(c)
    return out.select(*[chars(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])
