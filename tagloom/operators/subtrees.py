"""Equal subtrees by prefix hashes, and trees back to markup.

Every node but attributes has a code: a hash of its kind, name, value,
attributes and size. Codes times powers of a base, by the node's number, are
summed up once over the document; a subtree's hash is the difference of two
sums, moved to a common place by a power of the base's inverse. Numbers and
sizes within equal subtrees differ by one offset only, and sizes say the whole
structure, so equal subtrees have equal hashes. Two moduli near 2**31 make the
hash that subtrees meet by, two more the one that they are verified by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.stored import store
from .staircase import RANGE, running

#: Primes below 2**31, so that products of two remainders stay below 2**62, with a base for each.
MODULI = ((2147483647, 1000003), (2147483629, 16777619), (2147483587, 69069691), (2147483579, 362437069))
_DIGIT = 6


def power(base: int, modulus: int, exponent: str, bits: int = 42) -> Column:
    """``base`` to a column's power: a table of powers for every six bits of the exponent."""
    out = F.lit(1).cast("long")
    for k in range(0, bits, _DIGIT):
        table = ", ".join(f"{pow(base, d << k, modulus)}L" for d in range(1 << _DIGIT))
        digit = F.expr(f"array({table})[cast(shiftright({exponent}, {k}) & {(1 << _DIGIT) - 1} as int)]")
        out = digit if k == 0 else out * digit % modulus
    return out


def token() -> Column:
    """Text of what makes a node equal to another: each field with its length; attributes in the order of their names."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    attrs = F.array_sort(F.map_entries(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))))
    fields = [part(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("kind", "local_name", "ns_uri", "value", "size")]
    return F.concat(*fields, F.array_join(F.transform(attrs, lambda e: F.concat(part(e["key"]), part(e["value"]))), ""))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, size, local_name, meet, verify): the hashes of every element's subtree.

    Documents within one range of numbers move once and are summed up there, a
    batch of whole documents at a time; larger ones by running sums.
    """
    ship(nodes.sparkSession)
    rows = nodes.where("kind not in ('ATT', 'DOC')").select("doc_id", "pre", "size", "kind", "local_name", "ns_uri", "value", "attrs")
    large = store(rows.where(f"pre >= {RANGE} or pre < 0").select("doc_id").distinct())
    near = rows.where(f"doc_id is not null and pre >= 0 and pre < {RANGE}").unionByName(large.select("doc_id", F.lit("").alias("kind")), allowMissingColumns=True)
    # hashes are made behind the shuffle: texts and maps shrink there, hashes do not
    near = near.repartition("doc_id").sortWithinPartitions("doc_id", "pre").withColumn("token", token())
    near = near.select("doc_id", "pre", "size", "kind", "local_name", *[F.pmod(F.xxhash64(F.lit(k), "token"), F.lit(m)).alias(f"h{k}") for k, (m, _) in enumerate(MODULI)])
    found = near.mapInArrow(_sums, "doc_id long, pre long, size long, local_name string, meet long, verify long")
    found = found.select(*[F.col(c).cast(rows.schema[c].dataType) if c in rows.columns else F.col(c) for c in found.columns])
    return found if large.isEmpty() else found.unionByName(_summed(rows.join(large, "doc_id", "left_semi")))


def _tables(base: int, m: int) -> np.ndarray:
    """Powers of ``base`` for all numbers of a range."""
    out = np.ones(RANGE, np.int64)
    for i in range(1, RANGE):
        out[i] = int(out[i - 1]) * base % m
    return out


def _sums(batches):
    """Rows of whole documents in order to hashes of elements; the last document of a batch waits for the next."""
    powers = [(m, _tables(base, m), _tables(pow(base, -1, m), m)) for m, base in MODULI]
    names = ["doc_id", "pre", "size", "local_name", "meet", "verify"]

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        skip = pc.equal(rows.column("kind"), "")
        if pc.any(skip).as_py():
            rows = rows.filter(pc.invert(pc.is_in(rows.column("doc_id"), rows.column("doc_id").filter(skip))))
        doc, pre, size = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "pre", "size"))
        new = np.zeros(len(doc), np.int64)
        new[1:] = doc[1:] != doc[:-1]
        key = np.cumsum(new) * RANGE + pre
        own = np.flatnonzero(pc.equal(rows.column("kind"), "ELT").to_numpy(zero_copy_only=False))
        end = np.searchsorted(key, key[own] - pre[own] + np.minimum(pre[own] + size[own], RANGE))
        start = np.searchsorted(key, key[own])
        hashes = []
        for k, (m, power_, back) in enumerate(powers):
            sums = np.concatenate([[0], np.cumsum(rows.column(f"h{k}").to_numpy(zero_copy_only=False).astype(np.int64) * power_[pre] % m)])
            hashes.append((sums[end] - sums[start]) % m * back[pre[own]] % m)
        told = [rows.column(c).take(pa.array(own)) for c in names[:4]]
        return pa.RecordBatch.from_arrays([told[0].cast("int64"), told[1].cast("int64"), told[2].cast("int64"), told[3], *(pa.array(a << 31 | b) for a, b in (hashes[:2], hashes[2:]))], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False)
        if held and held[-1].column("doc_id")[-1].as_py() != doc[0]:
            yield whole(pa.concat_batches(held))
            held = []
        turns = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        if len(turns):
            yield whole(pa.concat_batches([*held, batch.slice(0, turns[-1])]))
            held = [batch.slice(turns[-1])]
        else:
            held.append(batch)
    if held:
        yield whole(pa.concat_batches(held))


def _summed(rows: DataFrame) -> DataFrame:
    """:func:`fingerprints` by running sums, for documents of any size."""
    rows = rows.withColumn("token", token())
    for k, (m, base) in enumerate(MODULI):
        rows = rows.withColumn(f"c{k}", F.pmod(F.xxhash64(F.lit(k), "token"), F.lit(m)) * power(base, m, "pre") % m)
    codes = [f"c{k}" for k in range(len(MODULI))]
    # a node and the end of its subtree: sums up to before the first and up to the second
    ends = rows.where("kind = 'ELT'").select("doc_id", "pre", "size", "local_name", (F.col("pre") * 2 + F.col("size") * 2 - 1).alias("_at"), F.lit(True).alias("end"), *[F.lit(0).cast("long").alias(c) for c in codes])
    starts = rows.select("doc_id", "pre", "size", "local_name", (F.col("pre") * 2).alias("_at"), F.lit(False).alias("end"), *codes)
    sums = running(starts.unionByName(ends), {c: f"s{k}" for k, c in enumerate(codes)})
    before = sums.where("not end").select("doc_id", "pre", *[(F.col(f"s{k}") - F.col(c)).alias(f"b{k}") for k, c in enumerate(codes)])
    out = sums.where("end").join(before, ["doc_id", "pre"])
    own = [F.pmod(F.col(f"s{k}") - F.col(f"b{k}"), F.lit(m)) * power(pow(base, -1, m), m, "pre") % m for k, (m, base) in enumerate(MODULI)]
    pair = lambda a, b: F.shiftleft(a, 31).bitwiseOR(b)
    return out.select("doc_id", "pre", "size", "local_name", pair(own[0], own[1]).alias("meet"), pair(own[2], own[3]).alias("verify"))


def equal_subtrees(nodes: DataFrame) -> DataFrame:
    """(meet, verify, local_name, size, copies, first_doc, first_pre): subtrees that stand more than once."""
    found = fingerprints(nodes).groupBy("meet", "verify").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "pre", "local_name", "size")).alias("x"))
    return found.where("copies > 1").select("meet", "verify", "x.local_name", "x.size", "copies", F.col("x.doc_id").alias("first_doc"), F.col("x.pre").alias("first_pre"))


def escaped(c: Column, attribute: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for raw, shown in [("\r", "&#13;"), *([('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")] if attribute else [])]:
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def joined(events: DataFrame) -> DataFrame:
    """(doc_id, markup) from events (doc_id, e: place, turn, order, text): they move once, to their document; its ranges are joined first, then the document."""
    ranges = events.repartition("doc_id").groupBy("doc_id", F.floor(F.col("e.place") / RANGE).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "").alias("piece"))
    return ranges.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "piece"))), lambda r: r["piece"]), "").alias("markup"))


def serialized(nodes: DataFrame) -> DataFrame:
    """(doc_id, markup): every document's markup from its node rows, empty elements with both tags.

    Starts, attributes, texts and ends are events sorted by place; ranges of a
    document are joined first and the document from its ranges.
    """
    value = F.coalesce("value", F.lit(""))
    decls = F.array_sort(F.map_entries(F.coalesce("decls", F.expr("cast(map() as map<string,string>)")))) if "decls" in nodes.columns else F.array().cast("array<struct<key:string,value:string>>")
    spaces = F.array_join(F.transform(decls, lambda d: F.concat(F.lit(" xmlns"), F.when(d["key"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), d["key"])), F.lit('="'), escaped(d["value"], True), F.lit('"'))), "")
    at = lambda place, turn, order, text: F.struct(place.cast("long").alias("place"), F.lit(turn).alias("turn"), order.cast("long").alias("order"), text.alias("text"))
    pre, zero = F.col("pre"), F.lit(0)
    element = F.array(at(pre, 0, zero, F.concat(F.lit("<"), "qname", spaces)), at(pre, 2, zero, F.lit(">")), at(pre + F.col("size") - 1, 3, -F.col("level"), F.concat(F.lit("</"), "qname", F.lit(">"))))
    pi = F.concat(F.lit("<?"), "qname", F.when(value != "", F.concat(F.lit(" "), value)).otherwise(F.lit("")), F.lit("?>"))
    one = (
        F.when(F.col("kind") == "ATT", F.array(at(F.col("parent"), 1, F.col("sib_ord"), F.concat(F.lit(" "), "qname", F.lit('="'), escaped(value, True), F.lit('"')))))
        .when(F.col("kind") == "TXT", F.array(at(pre, 0, zero, escaped(value))))
        .when(F.col("kind") == "COM", F.array(at(pre, 0, zero, F.concat(F.lit("<!--"), value, F.lit("-->")))))
        .when(F.col("kind") == "PI", F.array(at(pre, 0, zero, pi)))
    )
    events = nodes.where("kind <> 'DOC'").select("doc_id", F.explode(F.when(F.col("kind") == "ELT", element).otherwise(one)).alias("e"))
    return joined(events)
