"""MinHash near-dedup: universal hash minima, banding, verification, components.

Documents are sets of distinct word shingles. Equal sets collapse first (by a
128-bit set hash), so copies cost one row each. Of the different sets, those
that share a band meet in a bucket; every bucket links its members to its
centre, the member that meets most others over all its bands. Those pairs are
verified on the full sets, and components are taken by alternating large-star
and small-star. A second round takes the buckets whose members still lie in
several components, one of those with the same members, and compares all
members of different components on their full sets. A large bucket is dealt out
as pairs of blocks; one task holds two blocks and answers with a spanning
forest of the links it found. So no row is made for a pair, no link between
different components that shares a band is left out, and no task or row grows
with a bucket.

With 32 bands of 4 minima a pair exactly at similarity 0.75 is missed with
probability 5e-6, less above it.

Defined results: null, empty and blank texts have an empty set, are linked
with nothing and are kept; a text with fewer words than a shingle is one
shingle; a very long text is one set, of eight bytes a shingle, in one task at
a time; rows that share an identifier are one document, and a link of any of
them counts; null identifiers sort first. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .components import connected_components
from .rows import NULL_ID, keyed, plain_id
from .scratch import Scratch

BANDS, ROWS = 32, 4
#: Members verified against one copy of their bucket's centre.
FAN = 128
#: Members, and shingles, of a bucket that one block holds, on average.
BLOCK, WIDE = 384, 1 << 20
#: Places that one copy of a document's text is sent to, about.
SENT = 256
#: Numbers that a broadcast filter holds, at most.
FILTER = 1 << 22
#: Shingles that are compared at once inside a task.
_COLUMNS = 1 << 12
_GEN = np.random.Generator(np.random.PCG64(77))
_MULT = _GEN.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _GEN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, concatenated, and their row pointers."""
    words = tk.Words(data, offs, tk.lower_space_table())
    codes = words.hashes()
    at = tk.window_starts(words.ptr, size, words.n)
    h, row = tk.rolling(codes, size)[at] if len(at) else np.zeros(0, np.uint64), words.row_of()[at]
    count = np.diff(words.ptr)
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            h = np.concatenate([h, tk.rolling(codes, k)[words.ptr[short]]])
            row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)))


def _signer(size: int):
    def run(batches):
        tk.release()
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                h, ptr = shingle_sets(data, offs, size)
                n = np.diff(ptr)
                full = np.flatnonzero(n > 0)
                sig = np.zeros((len(n), BANDS * ROWS), np.uint64)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(full):
                    begin = ptr[:-1][full]
                    for j in range(BANDS * ROWS):
                        sig[full, j] = np.minimum.reduceat((h * _MULT[j] + _PLUS[j]) >> np.uint64(32), begin)
                    s1[full] = np.add.reduceat(tk.mix(h), begin)
                    s2[full] = np.add.reduceat(tk.mix(h ^ np.uint64(0x5DEECE66D)), begin)
                band = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    band = tk.mix(band * np.uint64(31) + sig[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x1000003))
                many = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(band[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (s1, s2)), lists],
                    ["_id", "n", "s1", "s2", "bands"],
                )

    return run


def _sender(size: int):
    """Sets of documents, one row for each place where they are compared."""

    def run(batches):
        tk.release()
        for batch in batches:
            goals = batch.column(2)
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(1))):
                h, ptr = shingle_sets(data, offs, size)
                ids, out, held = batch.column(0).slice(lo, hi - lo).to_pylist(), [], 0
                for i in range(hi - lo):
                    blob = h[ptr[i] : ptr[i + 1]].tobytes()
                    for g in goals[lo + i].as_py():
                        out.append((g["place"], g["side"], g["label"], ids[i], blob))
                        held += len(blob)
                        if held > tk.CHUNK_BYTES:
                            yield _sent(out)
                            out, held = [], 0
                if out:
                    yield _sent(out)

    return run


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"place": pa.int64(), "side": pa.int32(), "label": pa.int64(), "id": pa.int64(), "set": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets of sorted distinct hashes, counted over slices of the shingles that two of them have."""
    n = len(sets)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    many = np.bincount(column)[column] > 1 if len(every) else new
    column, owner = column[many], owner[many]
    out = np.zeros((n, n), np.int64)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
        for lo in range(0, int(column[-1]) + 1, _COLUMNS):
            a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
            part = np.zeros((n, _COLUMNS), np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            out += (part @ part.T).astype(np.int64)
    return out


def _verifier(percent: int):
    """A spanning forest of the links between different labels, of pairs with different sides or with side -1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("side", "ascending")])
        ids, side, label = (table.column(c).to_numpy() for c in ("id", "side", "label"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        size = np.array([len(s) for s in sets])
        both = overlaps(sets)
        linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
        linked &= (label[:, None] != label[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] < 0)) & (ids[:, None] < ids[None, :])
        root = {int(x): int(x) for x in label}
        a, b = [], []
        for i, j in np.argwhere(linked):
            x, y = int(label[i]), int(label[j])
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _place(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int").alias("f")


def _verified(rows: DataFrame, placed: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links (a, b) found where documents are placed (id, place, side, label, slot) together."""
    goals = scratch.put(placed.groupBy("id", "slot").agg(F.collect_list(F.struct("place", "side", "label")).alias("goals")).drop("slot"), "goals")
    near = rows.select("*", _place("_id")).join(F.broadcast(goals.select(_place("id")).distinct()), "f", "left_semi")
    sets = near.hint("merge").join(goals, near["_id"] == goals["id"]).select("_id", "_text", "goals").mapInArrow(_sender(size), "place long, side int, label long, id long, set binary")
    edges = scratch.put(sets.groupBy("place").applyInArrow(_verifier(percent), "a long, b long"), "links")
    scratch.drop(goals)
    return edges


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest identifier reachable by links), ``kept``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = keyed(docs, id_col, text_col)
    feats = scratch.put(rows.mapInArrow(_signer(size), "_id long, n long, s1 long, s2 long, bands array<long>"), "signatures")
    some = feats.where("n > 0")
    sets = scratch.put(some.groupBy("s1", "s2").agg(F.min("_id").alias("rep")), "sets")
    reps = some.join(sets, ["s1", "s2"]).where("_id = rep").select("rep", "n", "bands").dropDuplicates(["rep", "n", "bands"])
    keys = scratch.put(reps, "reps").select("rep", "n", F.explode("bands").alias("key"))
    crowded = scratch.put(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "crowded")
    crowd = keys.withColumn("f", _place("key")).join(F.broadcast(crowded.select(_place("key")).distinct()), "f", "left_semi").drop("f")
    crowd = scratch.put(crowd.join(crowded, "key"), "crowd")
    # a bucket's centre is its member that meets most others over all its bands: of a group of near copies, the original
    score = crowd.groupBy("rep").agg(F.sum("m").alias("score"))
    low = scratch.put(crowd.join(score, "rep").groupBy("key").agg(F.max_by("rep", F.struct("score", F.bitwise_not("rep"))).alias("low")), "low")
    pairs = scratch.put(crowd.join(low, "key").where("rep <> low").select("low", "rep").distinct(), "pairs")
    hub = scratch.put(pairs.groupBy("low").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts")), "hub")
    tagged = pairs.join(hub, "low").select(F.col("rep").alias("id"), "low", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
    heads = hub.select(F.col("low").alias("id"), "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    slot = F.when(F.col("side") == 0, F.floor(F.col("salt") / SENT)).otherwise(0).cast("int").alias("slot")
    links = _verified(rows, tagged.union(heads).select("id", F.xxhash64("low", "salt").alias("place"), "side", F.col("id").alias("label"), slot), scratch, size, percent)
    # an identifier whose rows have different texts stands for several sets: they are one document
    same = some.join(sets, ["s1", "s2"]).where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    shared = some.groupBy("_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select(F.col("_id").alias("a"))
    same = same.join(shared, "a", "left_semi")
    links = scratch.put(links.union(same), "links")
    final = first = scratch.put(connected_components(links, scratch), "first")

    inside = scratch.put(crowd.join(first, crowd["rep"] == first["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("label")), "inside")
    groups = inside.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rep")).alias("a"), F.bit_xor(F.xxhash64("rep", "n")).alias("b"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / WIDE)).cast("int").alias("blocks")
    groups = scratch.put(groups.groupBy("m", "w", "a", "b").agg(F.min("key").alias("key")).select("key", blocks), "groups")
    if not groups.isEmpty():
        b, c = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("c")
        dealt = inside.join(groups, "key").select("key", "rep", "label", "blocks", b).select("*", c)
        place = F.xxhash64("key", F.least("b", "c"), F.greatest("b", "c")).alias("place")
        side = F.when(F.col("b") == F.col("c"), -1).when(F.col("b") < F.col("c"), 0).otherwise(1).alias("side")
        slot = F.pmod("c", F.ceil(F.col("blocks") * BANDS / SENT)).cast("int").alias("slot")
        found = _verified(rows, dealt.select(F.col("rep").alias("id"), place, side, "label", slot), scratch, size, percent)
        if not found.isEmpty():
            final = scratch.put(connected_components(links.union(found), scratch), "final")
    by_set = scratch.put(sets.join(final, sets["rep"] == final["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component")), "by_set")
    out = feats.select("_id", "n", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    shown = F.when(component != F.lit(NULL_ID), component)
    return out.select(plain_id(), F.col("n").alias("n_shingles"), shown.alias("component_id"), (F.col("_id") == component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline form: one row of each group stays, the smallest identifier; columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
