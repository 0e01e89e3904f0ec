"""Vector code compression: product codes by integer k-means, nearest entries found in kd-trees.

Components become whole numbers, floor(``SCALE`` * x); vectors are cut into
equal consecutive parts, and each position has a codebook of its own, started
with that part of the vectors with the smallest identifiers. Every round a
kd-tree of each codebook is broadcast; tasks search it for all parts of a batch
at once and return integer sums and counts for each entry, which are added up
in Spark; the new entry is the floor of their quotient, and one that nothing
chose stays. The search goes down the near side first and enters a far side
whenever its bound is at most the best distance: with equal bounds too, so that
of entries equally far the lower index is found.

What the driver holds is the codebooks (entries x components), whatever the
number of vectors. All arithmetic is on 64-bit integers and so the same in any
order.

Defined results: vectors that are null or hold null or non-finite components
are dropped; vectors shorter than the longest, and such whose length the parts
do not divide, count as followed by zeros, an empty vector as zeros only;
scaled components beyond +-2**26 count as +-2**26; fewer vectors than entries
give smaller codebooks; identifiers start codebooks in ascending order, equal
ones by their vectors, null ones last; repeated rows are vectors each; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMIT = 1 << 26
#: Vectors searched at once.
SLICE = 1 << 14


class KdTree:
    """Entries of one codebook; each node holds one entry and splits the rest at one of its components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries)))

    def _build(self, own: np.ndarray):
        if not len(own):
            return None
        axis = int(np.ptp(self.entries[own], axis=0).argmax()) if self.entries.shape[1] else -1
        if axis >= 0:
            own = own[np.lexsort((own, self.entries[own, axis]))]
        mid = len(own) // 2
        return int(own[mid]), axis, self._build(own[:mid]), self._build(own[mid + 1 :])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equally near ones, and the squared distance."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries))
        self._visit(self.root, x, np.arange(len(x)), np.zeros(len(x), np.int64), best, index)
        return index, best

    def _visit(self, node, x, rows, bound, best, index):
        if node is None or not len(rows):
            return
        entry, axis, low, high = node
        gap = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
        better = (gap < best[rows]) | ((gap == best[rows]) & (entry < index[rows]))
        best[rows[better]] = gap[better]
        index[rows[better]] = entry
        if low is None and high is None:
            return
        off = x[rows, axis] - self.entries[entry, axis] if axis >= 0 else np.zeros(len(rows), np.int64)
        beyond = np.maximum(bound, off * off)
        for near, far, side in ((low, high, off < 0), (high, low, off >= 0)):
            own, plane = rows[side], beyond[side]
            self._visit(near, x, own, bound[side], best, index)
            still = plane <= best[own]
            self._visit(far, x, own[still], plane[still], best, index)


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _searched(sent, column):
    """(part, its columns, rows, nearest entries, squared distances) of a batch, a slice at a time."""
    x = _matrix(column)
    trees = sent.value
    width = x.shape[1] // len(trees)
    for lo in range(0, len(x), SLICE):
        for p, tree in enumerate(trees):
            own = np.ascontiguousarray(x[lo : lo + SLICE, p * width : (p + 1) * width])
            yield p, own, slice(lo, lo + len(own)), *tree.nearest(own)


def _summer(sent):
    """Sums and counts of the parts that chose each entry, over all of a task's rows."""

    def run(batches):
        sums = [np.zeros((len(t.entries), t.entries.shape[1] + 1), np.int64) for t in sent.value]
        for batch in batches:
            for p, own, _, index, _ in _searched(sent, batch.column(0)):
                np.add.at(sums[p], index, np.concatenate([own, np.ones((len(own), 1), np.int64)], axis=1))
        part, entry, place = np.indices((len(sums), *sums[0].shape)).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(np.stack(sums).ravel())], ["part", "entry", "place", "total"])

    return run


def _coder(sent):
    def run(batches):
        for batch in batches:
            n = len(batch)
            code, error = np.zeros((n, len(sent.value)), np.uint8), np.zeros(n, np.int64)
            for p, _, rows, index, gap in _searched(sent, batch.column(2)):
                code[rows, p] = index
                error[rows] += gap
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["_id", "_label", "code", "error"])

    return run


def scaled(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scratch: Scratch) -> DataFrame:
    """``_id``, ``_label`` and ``v`` (whole numbers, all of one length that ``parts`` divides) of the vectors that are kept."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").alias("_label"), vec.alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), c * F.lit(float(SCALE))))).cast("long"))
    rows = scratch.put(rows.select("_id", "_label", whole.alias("v")), "scaled")
    least, most = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    length = -(-max(most or 0, 1) // parts) * parts
    if least == length:
        return rows
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))))


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes (``_id``, ``_label``, ``code``, ``error``) and the codebooks (part, entry, component); at most 256 entries."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scaled(vectors, id_col, vec_col, label_col, parts, scratch)
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = len(first[0].v) // parts if first else 0
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    send = lambda: spark.sparkContext.broadcast([KdTree(b) for b in books])
    for _ in range(rounds if first else 0):
        found = rows.select("v").mapInArrow(_summer(send()), "part long, entry long, place long, total long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
        part, entry, place, total = (found.column(c).to_numpy() for c in ("part", "entry", "place", "total"))
        sums = np.zeros((parts, len(first), width + 1), np.int64)
        sums[part, entry, place] = total
        count = sums[:, :, width:]
        books = np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)
    coded = rows.select("_id", "_label", "v").mapInArrow(_coder(send()), f"_id {rows.schema['_id'].dataType.simpleString()}, _label {rows.schema['_label'].dataType.simpleString()}, code string, error long")
    return scratch.put(coded, "coded"), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The vector of whole numbers that a code stands for."""
    return np.concatenate([book[i] for book, i in zip(books, bytes.fromhex(code), strict=True)])


def contract(vectors: DataFrame) -> DataFrame:
    """The columns of ``op13``."""
    coded, books = product_codes(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy(F.col("_label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("_label").eqNullSafe(F.col("of")))
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
