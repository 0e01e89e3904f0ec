"""Repeated byte strings: a sampled set of suffixes first, exact windows after.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed. Sorting every suffix would move some twenty times the input,
so the suffixes are sampled by content: each window of ``length`` bytes picks
the suffix in it whose leading ``GRAM`` bytes have the least hash, and equal
windows pick alike. Neighbouring windows with one pick form a run (about 180
bytes long on average). Runs meet by the leading bytes of their suffix; those
that meet nobody are unique, equal runs are repeated as a whole, and only where
different runs share a suffix are their windows hashed and counted one by one.

Map tasks settle what repeats within their batch, so a passage in a third of
all rows meets once per batch and different run. Strings are told apart by
64-bit hashes: two different ones among n are taken for equal with probability
n squared / 2**65.

Defined results: null texts are empty; texts shorter than a string lose
nothing; a very long text is hashed whole, in one task at a time; rows equal in identifier and text are one document; rows that share
an identifier only are told apart by text; null identifiers sort first; an
empty table gives no rows. Extra columns are ignored. What is left may cut a
character, so it is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as tk
from .rows import keyed, plain_id
from .scratch import Scratch
from .windows import FILTER, PACK, bucket_count, packed, starts_by_document, table_of, task_of

GRAM = 32


def _byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte string follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tk.BYTE_CODES[data] * tk._power_table(len(data) + 1, tk._P)[: len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return tk.mix((total[hi] - total[lo]) * tk._power_table(len(total), tk._P_INV)[lo])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive entries, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    before = np.minimum.accumulate(y, axis=1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def runs_of(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, suffix hash, run hash) of every run."""
    n = len(data)
    gram = min(GRAM, length)
    starts = tk.window_starts(offs, length, n)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    total = _byte_sums(data)
    at = np.arange(n - gram + 1)
    grams = _hash(total, at, at + gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pick = (sliding_min(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(starts)))
    s0, p = starts[lead], pick[lead]
    row = np.searchsorted(offs, s0, side="right") - 1
    whole = tk.mix(_hash(total, s0, s0 + count - 1 + length) + (p - s0).astype(np.uint64) * tk._P + count.astype(np.uint64))
    return row, s0 - offs[row], count, grams[p], whole


def _run_maker(length: int):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts: list[list] = [[], [], [], [], []]
            for lo, _, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                row, s0, count, suffix, whole = runs_of(data, offs, length)
                for c, v in zip(parts, (row + lo, s0, count, suffix, whole), strict=True):
                    c.append(v)
            if not parts[0]:
                continue
            row, s0, count, suffix, whole = (np.concatenate(p) for p in parts)
            i, h = ids[row], keys[row]
            order = np.lexsort((s0, h, i, whole, suffix))
            row, s0, count, suffix, whole, i, h = (x[order] for x in (row, s0, count, suffix, whole, i, h))
            same = np.zeros(len(row), bool)
            same[1:] = (suffix[1:] == suffix[:-1]) & (whole[1:] == whole[:-1])
            twin = np.zeros(len(row), bool)
            twin[1:] = same[1:] & (i[1:] == i[:-1]) & (h[1:] == h[:-1]) & (s0[1:] == s0[:-1])
            keep = ~twin  # the same place in a repeated row
            row, s0, count, suffix, whole, i, h, same = (x[keep] for x in (row, s0, count, suffix, whole, i, h, same))
            many = same.copy()
            many[:-1] |= same[1:]
            # all but the first of equal runs are settled here; they travel on their own
            suffix = np.where(same, tk.mix(i.view(np.uint64) + s0.astype(np.uint64)), suffix)
            yield pa.RecordBatch.from_arrays(
                [pa.array(suffix.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(i), pa.array(h), pa.array(s0), pa.array(count), pa.array(many), pa.array(same)],
                ["suffix", "whole", "_id", "_h", "s0", "n", "many", "settled"],
            )

    return run


def _window_hasher(length: int, buckets: int):
    """Windows of the runs that share a suffix with different ones."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hs, rs, ps = [], [], []
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                total = _byte_sums(data)
                for k in range(hi - lo):
                    for run in batch.column(3)[lo + k].as_py():
                        at = np.arange(run["s0"], run["s0"] + run["n"])
                        hs.append(_hash(total, at + offs[k], at + offs[k] + length))
                        rs.append(np.full(len(at), lo + k, np.int32))
                        ps.append(at.astype(np.uint32))
            if not hs:
                continue
            h, r, p = np.concatenate(hs), np.concatenate(rs), np.concatenate(ps)
            by = np.argsort(h, kind="stable")
            same = h[by][1:] == h[by][:-1]
            late = np.zeros(len(h), bool)
            late[by[1:][same]] = True
            known = late.copy()
            known[by[:-1][same]] = True
            task = task_of(ids, keys)
            yield table_of(task, ids, keys)
            at = _ordered(np.flatnonzero(known), r, p)
            yield from packed(np.full(len(at), -1), task, r[at], p[at], 1)
            at = _ordered(np.flatnonzero(~late), r, p)
            yield from packed((h[at] % np.uint64(buckets)).astype(np.int64), task, r[at], p[at], 0, h[at])

    return run


def _ordered(at: np.ndarray, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    return at[np.lexsort((p[at], r[at]))]


def _repeated(ids: np.ndarray, d: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Windows whose hash stands more than once."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return np.flatnonzero(again)


def _remover(length: int):
    def run(batches):
        for batch in batches:
            data, offs = tk.string_buffer(batch.column(1))
            whole, starts = batch.column(2), batch.column(3)
            size, lost, spans, kept, ids_at = 0, [], [], [], 0
            for k in range(len(batch)):
                own = data[offs[k] : offs[k + 1]]
                edge = np.zeros(len(own) + 1, np.int64)
                for r in whole[k].as_py() or ():
                    edge[r["s0"]] += 1
                    edge[r["s0"] + r["n"] - 1 + length] -= 1
                at = np.unique(np.frombuffer(starts[k].as_py() or b"", np.uint32)).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in turn.reshape(-1, 2)])
                lost.append(int(gone.sum()))
                kept.append(own[~gone].tobytes())
                size += len(own)
                if size > tk.CHUNK_BYTES or k + 1 == len(batch):
                    n = len(lost)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(ids_at, n), pa.array(np.diff(offs[ids_at : ids_at + n + 1])), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.binary())],
                        ["_id", "n_bytes", "n_removed", "spans", "kept"],
                    )
                    size, lost, spans, kept, ids_at = 0, [], [], [], k + 1

    return run


def repeated_strings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (first and last byte of each removed run), ``kept`` (binary)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    buckets = bucket_count(rows)
    runs = rows.mapInArrow(_run_maker(length), "suffix long, whole long, _id long, _h long, s0 long, n long, many boolean, settled boolean")
    meet, equal = W.partitionBy("suffix"), W.partitionBy("suffix", "whole")
    place = F.struct("_id", "_h", "s0")
    runs = (
        runs.repartition("suffix")
        .withColumn("mixed", F.min("whole").over(meet) != F.max("whole").over(meet))
        .withColumn("again", F.max(F.col("many")).over(equal) | (F.min(place).over(equal) != F.max(place).over(equal)))
        .withColumn("lead", F.row_number().over(equal.orderBy("_id", "_h", "s0")) == 1)
    )
    full = F.col("settled") | F.col("again")
    told = F.col("mixed") & F.col("lead") & ~F.col("settled")
    found = scratch.put(runs.where(full | told).select("_id", "_h", "s0", "n", full.alias("full"), told.alias("told")), "runs")
    run = F.struct("s0", "n")
    sieve = lambda df: F.broadcast(df.select(F.pmod(F.xxhash64("_id", "_h"), F.lit(FILTER)).cast("int").alias("f")).distinct())
    rows = rows.withColumn("f", F.pmod(F.xxhash64("_id", "_h"), F.lit(FILTER)).cast("int"))
    tell = found.where("told").groupBy("_id", "_h").agg(F.collect_list(run).alias("runs"))
    asked = rows.join(sieve(found.where("told")), "f", "left_semi").dropDuplicates(["_id", "_h"]).join(tell, ["_id", "_h"]).select("_id", "_h", "_text", "runs")
    late = starts_by_document(asked.mapInArrow(_window_hasher(length, buckets), PACK), buckets, _repeated)
    whole = found.where("full").groupBy("_id", "_h").agg(F.collect_list(run).alias("runs"))
    cuts = scratch.put(whole.join(late, ["_id", "_h"], "full_outer"), "cuts")
    touched = rows.join(sieve(cuts), "f", "left_semi").join(cuts, ["_id", "_h"], "left").select("_id", "_text", "runs", "starts")
    out = touched.mapInArrow(_remover(length), "_id long, n_bytes long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept binary")
    rest = rows.join(sieve(cuts), "f", "left_anti").select("_id", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"), F.coalesce("_text", F.lit("")).cast("binary").alias("kept"))
    return out.unionByName(rest).select(plain_id(), "n_bytes", "n_removed", "spans", "kept")


def contract(docs: DataFrame) -> DataFrame:
    """The digest columns of ``op6``."""
    return repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
