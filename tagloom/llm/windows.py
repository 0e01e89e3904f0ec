"""Substring dedup over words: Rabin-Karp hashes of every window, counted in Spark.

A window of ``window`` words is removed where the same words also start
earlier (smaller document, or earlier in the same one). Map tasks hash every
window and keep the first occurrence within their batch, so a passage in a
third of all rows reaches a counting bucket once per batch at most. Buckets of
hashes then name every occurrence but the globally first one, and each
document merges its windows into maximal removal intervals.

Defined results: null texts have no words; texts shorter than a window lose
nothing; a very long text is hashed whole, in one task at a time; rows equal in
identifier and text get equal results, and rows that
share an identifier only are compared by text hash; null identifiers sort
before all others; an empty table gives no rows. Extra columns are ignored.
Windows are told apart by 64-bit hashes: two different ones among n are taken
for equal with probability n squared / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .rows import keyed, plain_id
from .scratch import Scratch, estimated_bytes, shuffle_partitions

#: Input bytes (as stored) behind one counting bucket, a shuffle partition of its own.
BUCKET_BYTES = 128 << 20
#: Windows that a map task holds before it hands them on: eight a bucket, within these.
HOLD, MOST_HELD = 1 << 20, 1 << 22
#: Windows that a bucket sorts at once.
SORTED = 1 << 21
#: Numbers that a broadcast filter of documents holds, at most.
FILTER = 1 << 20
#: Rows that travel: a bucket's windows (kind 0), windows known to be late (1), the documents that a map task's numbers stand for (2).
PACK = "bucket int, kind int, task long, rows binary, ids binary, many binary, steps binary, far binary, hashes binary"
_COLUMNS = [c.split(" ")[0] for c in PACK.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _u(x, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def steps_of(x: np.ndarray) -> bytes:
    """Ascending numbers as the first one and steps of the least width that holds them all."""
    x = np.asarray(x, np.int64)
    if not len(x):
        return b""
    step = np.diff(x)
    most = int(step.max()) if len(step) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + x[:1].tobytes() + step.astype(f"<u{width}").tobytes()


def from_steps(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    step = np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.int64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.int64, 1, 1), step]))


def small(x: np.ndarray) -> bytes:
    """Numbers from 0 in the least width that holds them all."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + np.asarray(x).astype(f"<u{width}").tobytes()


def from_small(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.zeros(0, np.int64)


def task_of(ids: np.ndarray, keys: np.ndarray) -> int:
    """A number for these documents in this order; equal ones are the same task."""
    one = tk.mix(ids.view(np.uint64) ^ tk.mix(keys.view(np.uint64)))
    return int(tk.mix(np.add.reduce(one * (np.arange(len(one), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), keepdims=True)).view(np.int64)[0])


def table_of(task: int, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return _batch([(-1, 2, task, ids.tobytes(), keys.tobytes(), b"", b"", b"", b"")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _COLUMNS)


def bucket_count(rows: DataFrame) -> int:
    """The session's shuffle partitions, or as many as keep a bucket's windows in memory; map tasks pack by this number."""
    return max(shuffle_partitions(rows.sparkSession), -(-estimated_bytes(rows, "_text") // BUCKET_BYTES))


def _hasher(window: int, buckets: int):
    hold = min(max(HOLD, 8 * buckets), MOST_HELD)

    def run(batches):
        table = tk.space_table()
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hs, rs, ps, held = [], [], [], 0
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                words = tk.Words(data, offs, table)
                at = tk.window_starts(words.ptr, window, words.n)
                if len(at):
                    row = words.row_of()[at]
                    hs.append(tk.rolling(words.hashes(), window)[at])
                    rs.append((row + lo).astype(np.int32))
                    ps.append((at - words.ptr[row]).astype(np.uint32))
                    held += len(at)
                if held and (held >= hold or hi == len(batch)):
                    yield from _known_and_open(np.concatenate(hs), np.concatenate(rs), np.concatenate(ps), ids, keys, buckets)
                    hs, rs, ps, held = [], [], [], 0

    return run


def _known_and_open(h, r, p, ids, keys, buckets):
    """Late occurrences known from these rows alone, then the rest by bucket; rows are in identifier order."""
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    first = np.ones(len(h), bool)
    first[by[1:][same]] = False
    # a repeated row is no earlier occurrence: it goes on to the buckets with its twin
    twin = np.zeros(len(ids), bool)
    twin[1:] = ids[1:] == ids[:-1]
    first |= twin[r]
    own = slice(int(r[0]), int(r[-1]) + 1)
    ids, keys, r = ids[own], keys[own], r - r[0]
    task = task_of(ids, keys)
    yield table_of(task, ids, keys)
    at = np.flatnonzero(~first)
    yield from packed(np.full(len(at), -1), task, r[at], p[at], 1)
    at = np.flatnonzero(first)
    yield from packed((h[at] % np.uint64(buckets)).astype(np.int64), task, r[at], p[at], 0, h[at], ids)


def packed(bucket, task, r, p, kind, h=None, ids=None):
    """Rows of one bucket each; within a row, windows are grouped by document, told by its place in the task's table, and starts are steps."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, r, p = bucket[order], r[order], p[order].astype(np.int64)
    h = None if h is None else h[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    lead = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (r[1:] != r[:-1])])
    step = np.where(lead, p, p - np.concatenate([[0], p[:-1]]))
    short = np.minimum(step, 255).astype(np.uint8)
    docs = np.flatnonzero(lead)
    row, many = r[docs], np.diff(np.append(docs, len(p)))
    at = np.searchsorted(docs, cut)
    out = []
    for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own = row[at[k] : at[k + 1]]
        far = step[lo:hi][short[lo:hi] == 255]
        out.append((int(bucket[lo]), kind, task, steps_of(own), b"" if ids is None else steps_of(ids[own]), small(many[at[k] : at[k + 1]]), _u(short[lo:hi], np.uint8), _u(far, np.uint32), b"" if h is None else _u(h[lo:hi], np.uint64)))
    yield _batch(out)


def unpacked(table: pa.Table):
    """Tasks, places in their tables and identifiers of the documents; document, start and hash of each window."""
    task, rows, ids, many, steps, far, hashes = [], [], [], [], [], [], []
    for t, r, i, m, s, f, h in zip(*(table.column(c).to_pylist() for c in ("task", "rows", "ids", "many", "steps", "far", "hashes")), strict=True):
        own = from_steps(r)
        task.append(np.full(len(own), t, np.int64))
        rows.append(own)
        ids.append(from_steps(i) if i else np.zeros(len(own), np.int64))
        many.append(from_small(m))
        step = np.frombuffer(s, np.uint8).astype(np.int64)
        step[step == 255] = np.frombuffer(f, np.uint32)
        steps.append(step)
        hashes.append(np.frombuffer(h, np.uint64))
    if not task:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, np.zeros(0, np.uint64)
    task, rows, ids, many, step = (np.concatenate(x) for x in (task, rows, ids, many, steps))
    total = np.cumsum(step)
    begin = np.cumsum(many) - many
    d = np.repeat(np.arange(len(rows)), many)
    starts = total - (total[begin] - step[begin])[d] if len(total) else total
    return task, rows, ids, d, starts, np.concatenate(hashes)


def _late(ids: np.ndarray, d: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Windows that are not the first of their hash, by identifier and start."""
    found = []
    # the bits above those that chose the bucket split a large bucket
    parts = -(-len(h) // SORTED) or 1
    part = ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int64) if parts > 1 else None
    for k in range(parts):
        at = np.arange(len(h)) if part is None else np.flatnonzero(part == k)
        own = h[at]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        again = np.zeros(len(own), bool)
        again[1:] |= same
        again[:-1] |= same
        order = at[order[again]]
        order = order[np.lexsort((p[order], ids[d[order]], h[order]))]
        if len(order):
            lead = np.ones(len(order), bool)
            lead[1:] = h[order][1:] != h[order][:-1]
            head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            found.append(order[(ids[d[order]] != ids[d[head]]) | (p[order] != p[head])])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def counter(choose):
    """The windows of a bucket that ``choose`` picks (identifiers, documents, starts, hashes), by task; rows of the other kinds pass."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        task, rows, ids, d, p, h = unpacked(table.filter(pa.array(kind == 0)))
        at = choose(ids, d, p, h)
        out = table.filter(pa.array(kind != 0)).cast(pa.schema(list(zip(_COLUMNS, _KINDS, strict=True)))).to_batches()
        names, back = np.unique(task, return_inverse=True)
        own = back[d[at]]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        for k in np.unique(own):
            some = at[own == k]
            by = np.lexsort((p[some], rows[d[some]]))
            out += packed(np.zeros(len(some), np.int64), int(names[k]), rows[d[some]][by], p[some][by], 1)
        return pa.Table.from_batches(out, pa.schema(list(zip(_COLUMNS, _KINDS, strict=True))))

    return run


def gather(table: pa.Table) -> pa.Table:
    """One row for each document of a task: its window starts from all buckets."""
    kind = table.column("kind").to_numpy()
    _, rows, _, d, p, _ = unpacked(table.filter(pa.array(kind == 1)))
    known = table.filter(pa.array(kind == 2))
    if not len(rows):
        return pa.table({"_id": pa.array([], pa.int64()), "_h": pa.array([], pa.int64()), "starts": pa.array([], pa.binary())})
    ids, keys = (np.frombuffer(known.column(c)[0].as_py(), np.int64) for c in ("rows", "ids"))
    row = rows[d]
    order = np.lexsort((p, row))
    row, p = row[order], p[order]
    name, begin = np.unique(row, return_index=True)
    return pa.table({"_id": ids[name], "_h": keys[name], "starts": pa.array([_u(x, np.uint32) for x in np.split(p, begin[1:])], pa.binary())})


def starts_by_document(rows: DataFrame, buckets: int, choose) -> DataFrame:
    """(_id, _h, starts) of the windows that ``choose`` picks in each bucket of packed ``rows``."""
    # what is known already and the tasks' tables are spread over the buckets and pass through
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("task", "kind"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    chosen = rows.withColumn("bucket", spread).groupBy("bucket").applyInArrow(counter(choose), PACK)
    found = chosen.groupBy("task").applyInArrow(gather, "_id long, _h long, starts binary")
    # a repeated row has the same starts in every task that it is in
    return found.groupBy("_id", "_h").agg(F.first("starts").alias("starts"))


def _remover(window: int):
    def run(batches):
        table = tk.space_table()
        for batch in batches:
            starts = batch.column(batch.schema.get_field_index("starts"))
            text = batch.column(batch.schema.get_field_index("_text"))
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(text)):
                words = tk.Words(data, offs, table)
                raw = data.tobytes()
                spans, kept, lost = [], [], []
                for i in range(hi - lo):
                    a, b = words.ptr[i], words.ptr[i + 1]
                    own = starts[lo + i].as_py()
                    runs = tk.union_length(np.unique(np.frombuffer(own, np.uint32)).astype(np.int64), window) if own else np.zeros((0, 2), np.int64)
                    keep = np.ones(b - a, bool)
                    for x, y in runs:
                        keep[x:y] = False
                    at = np.flatnonzero(keep) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]).decode())
                    lost.append(int(b - a - len(at)))
                    spans.append([{"first": int(x), "last": int(y) - 1} for x, y in runs])
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.diff(words.ptr)), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array(kept, pa.string())],
                    ["_id", "n_words", "n_removed", "spans", "kept"],
                )

    return run


def repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (first and last word of each removed run), ``kept`` (text)."""
    scratch = Scratch(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    buckets = bucket_count(rows)
    late = scratch.put(starts_by_document(rows.mapInArrow(_hasher(window, buckets), PACK), buckets, _late), "late")
    # only the texts that lose something are moved to meet their windows
    place = F.pmod(F.xxhash64("_id", "_h"), F.lit(FILTER)).cast("int").alias("f")
    sieve = F.broadcast(late.select(place).distinct())
    placed = rows.withColumn("f", place)
    touched = placed.join(sieve, "f", "left_semi").join(late, ["_id", "_h"], "left").select("_id", "_text", "starts")
    rest = placed.join(sieve, "f", "left_anti").select("_id", "_text", F.lit(None).cast("binary").alias("starts"))
    kind = "_id long, n_words long, n_removed long, spans array<struct<first:bigint,last:bigint>>, kept string"
    out = touched.mapInArrow(_remover(window), kind).unionByName(rest.mapInArrow(_remover(window), kind))
    return out.select(plain_id(), "n_words", "n_removed", "spans", "kept")


def contract(docs: DataFrame) -> DataFrame:
    """The digest columns of ``op10``."""
    return repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
