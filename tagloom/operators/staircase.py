"""Joins of intervals and points in document order, by one sweep over sorted rows.

Intervals (subtrees, scopes) and points (nodes) of a document are cut into
ranges of ``RANGE`` numbers; an interval goes to every range that it touches.
Each range is sorted by position and swept once: the intervals that are open
when a batch ends are carried on, like the ancestors on a stack, so every pair
that is made is a pair of the answer, whatever the subtrees' sizes. As
subtrees nest, a range sees its own intervals and the ancestors of its first
node at most; a large document is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of a document that are swept together.
RANGE = 4096
#: Pairs handed on at once.
PAIRS = 1 << 16
_OWN = ["doc_id", "_range", "_at", "_point", "_to"]


def _stream(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Both sides as one table, sorted by document, range and position; intervals (``_lo`` to below ``_hi``) before points (``_at``)."""
    ranges = F.sequence(F.floor(F.col("_lo") / RANGE), F.floor((F.col("_hi") - 1) / RANGE))
    left = intervals.where("_hi > _lo").withColumn("_range", F.explode(ranges)).withColumn("_at", F.greatest(F.col("_lo"), F.col("_range") * RANGE))
    left = left.withColumn("_point", F.lit(False)).withColumnRenamed("_hi", "_to")
    right = points.withColumn("_range", F.floor(F.col("_at") / RANGE)).withColumn("_point", F.lit(True)).withColumn("_to", F.lit(None).cast("long"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_at", F.col("_at").cast("long")).withColumn("_to", F.col("_to").cast("long"))
    # of intervals that begin together the longer is the outer one
    return both.repartition("doc_id", "_range").sortWithinPartitions("doc_id", "_range", "_at", "_point", F.col("_lo"), F.col("_to").desc())


class _Sweep:
    """Rows of a batch with the intervals still open before it, by position in the stream."""

    def __init__(self, batch: pa.RecordBatch, kept: pa.Table | None):
        n_kept = 0 if kept is None else len(kept)
        self.rows = pa.concat_tables([kept, pa.Table.from_batches([batch])]) if n_kept else pa.Table.from_batches([batch])
        doc, rng, at, to = (self.rows.column(c).to_numpy() for c in ("doc_id", "_range", "_at", "_to"))
        point = self.rows.column("_point").to_numpy(zero_copy_only=False).astype(bool)
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (rng[1:] != rng[:-1])])
        # carried intervals belong to the group that goes on
        group = np.cumsum(new) - 1
        place = group.astype(np.int64) << 44 | np.where(np.arange(len(doc)) < n_kept, 0, at - rng * RANGE)
        self.points = np.flatnonzero(point)
        self.spans = np.flatnonzero(~point)
        spot = place[self.points]
        end = group[self.spans].astype(np.int64) << 44 | np.minimum(to[self.spans].astype(np.int64) - rng[self.spans] * RANGE, RANGE)
        self.first = np.searchsorted(spot, place[self.spans])
        self.last = np.maximum(np.searchsorted(spot, end), self.first)
        same = group[self.spans] == group[-1] if len(group) else np.zeros(0, bool)
        # what is open at the end of the last group goes on
        self.open = self.spans[same & (to[self.spans] > at[-1])] if len(at) else self.spans

    def kept(self) -> pa.Table:
        return self.rows.take(pa.array(self.open))


def interval_join(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """All pairs of an interval (``doc_id``, ``_lo``, ``_hi`` and more) and a point (``doc_id``, ``_at`` and more) in it; the sides' other columns have different names."""
    left = [c for c in intervals.columns if c not in ("doc_id", "_lo", "_hi")]
    right = [c for c in points.columns if c not in ("doc_id", "_at")]
    stream = _stream(intervals, points)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = [f"`{c}` {kinds[c]}" for c in ("doc_id", *left, *right)]

    def run(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            sweep = _Sweep(batch, kept)
            many = sweep.last - sweep.first
            edge = np.cumsum(many)
            lo = 0
            while lo < len(many):
                hi = max(lo + 1, int(np.searchsorted(edge, (edge[lo - 1] if lo else 0) + PAIRS, side="right")))
                n = many[lo:hi]
                who = np.repeat(sweep.spans[lo:hi], n)
                where = sweep.points[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sweep.first[lo:hi], n)] if n.sum() else np.zeros(0, np.int64)
                if len(who):
                    spans, found = sweep.rows.select(["doc_id", *left]).take(pa.array(who)), sweep.rows.select(right).take(pa.array(where))
                    yield from pa.table([*spans.columns, *found.columns], names=["doc_id", *left, *right]).combine_chunks().to_batches()
                lo = hi
            kept = sweep.kept()

    return stream.mapInArrow(run, ", ".join(out))


def innermost(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Each point (``doc_id``, ``_at`` and more) with each ``key`` of the intervals (``doc_id``, ``_lo``, ``_hi``, ``key``, ``value``) around it, and the innermost one's ``value``.

    Intervals nest; of those of one key that begin together the shorter is the inner one.
    """
    right = [c for c in points.columns if c not in ("doc_id", "_at")]
    stream = _stream(intervals.select("doc_id", "_lo", "_hi", "key", "value"), points)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(batches):
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            sweep = _Sweep(batch, kept)
            names = sweep.rows.column("key").take(pa.array(sweep.spans)).to_pylist()
            by: dict = {}
            for i, name in enumerate(names):
                by.setdefault(name, []).append(i)
            for own in by.values():
                cover = np.full(len(sweep.points), -1)
                for i in own:  # outer ones come first
                    cover[sweep.first[i] : sweep.last[i]] = sweep.spans[i]
                hit = np.flatnonzero(cover >= 0)
                if len(hit):
                    marks, found = sweep.rows.select(["key", "value"]).take(pa.array(cover[hit])), sweep.rows.select(["doc_id", *right]).take(pa.array(sweep.points[hit]))
                    yield from pa.table([*found.columns, *marks.columns], names=["doc_id", *right, "key", "value"]).combine_chunks().to_batches()
            kept = sweep.kept()

    return stream.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *right, "key", "value")))


def subtree(rows: DataFrame, pre: str = "pre", size: str = "size", inside: bool = True) -> DataFrame:
    """``rows`` with the bounds of their subtrees, themselves left out if ``inside``."""
    return rows.withColumn("_lo", (F.col(pre) + F.lit(1 if inside else 0)).cast("long")).withColumn("_hi", (F.col(pre) + F.col(size)).cast("long"))


def pruned(contexts: DataFrame, axis: str) -> DataFrame:
    """(doc_id, edge): what is left of ``contexts`` (doc_id, pre, size) on the axes following and preceding, one number a document.

    Whatever follows any context follows the one that ends first, and whatever precedes any precedes the one that begins last.
    """
    edge = F.min(F.col("pre") + F.col("size")) if axis == "following" else F.max("pre")
    return contexts.groupBy("doc_id").agg(edge.alias("edge"))


def beyond(nodes: DataFrame, contexts: DataFrame, axis: str) -> DataFrame:
    """The rows of ``nodes`` that follow (or precede) any context, each once: a scan with one number a document."""
    edge = pruned(contexts, axis)
    side = F.col("pre") >= F.col("edge") if axis == "following" else F.col("pre") + F.col("size") <= F.col("edge")
    return nodes.where("kind <> 'ATT'").join(edge, "doc_id").where(side).drop("edge")


def running(rows: DataFrame, sums: dict[str, str], at: str = "_at", by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``rows`` with running sums over the document (or what ``by`` names) up to and with each row, by ``at``: column to be summed to name of its sum.

    Sums within ranges first, then the ranges' totals, so no document is one task.
    """
    rows = rows.withColumn("_range", F.floor(F.col(at) / RANGE))
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums)])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    own = W.partitionBy(*by, "_range").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = rows.select("*", *[F.sum(c).over(own).alias(f"_s{k}") for k, c in enumerate(sums)]).join(before, [*by, "_range"])
    out = inner.withColumns({name: F.col(f"_s{k}") + F.col(f"_b{k}") for k, name in enumerate(sums.values())})
    return out.drop("_range", *[f"_{x}{k}" for x in "sb" for k in range(len(sums))])
