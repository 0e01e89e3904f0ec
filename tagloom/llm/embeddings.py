"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Equal vectors collapse first. Centroids are fitted on a bounded sample (the
``SAMPLE`` vectors with the smallest hashes); every vector is then assigned to
its nearest cell, its home. A pair with cosine >= t is at most d = sqrt(2 - 2t)
apart, so the vectors of one cell that may link into another are those whose
distance to the plane that bisects both centroids is at most d: no link can be
missed, whatever the clustering. Of two cells only one takes such vectors of
the other in, as guests, and counts the links for both sides. Where vectors
have many dimensions hardly any plane is farther than d, and nearly every pair
is computed; cells of about ``SPREAD`` * sqrt(rows) vectors keep the number of
guests low then. A cell is dealt out as pairs of blocks, so a cell with a third of
all rows is many tasks of bounded size; each returns link counts and a spanning
forest of its links, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing and are kept; vectors of different
lengths do not link; repeated rows with one identifier are one vector each but
share a component; null identifiers sort first; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rows import NULL_ID, plain_id
from .scratch import Scratch

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 16_384
#: Vectors per cell aimed at, in square roots of their number; cells at most.
SPREAD, MAX_CELLS = 9, 4096
#: Vectors in a block of members and in one of all that a cell sees; members multiplied at once.
LEFT, RIGHT, SLICE = 4096, 8192, 1024
ROUNDS = 8


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` unit centroids of unit rows ``x``; deterministic."""
    gen = np.random.Generator(np.random.PCG64(11))
    c = x[gen.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c)
    return np.unique(c, axis=0)


def _vectors(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _assigner(sent, radius: float):
    """(rep, low, dim, vector) to one row per cell that must see it; ``home`` marks its own."""

    def hosts(k: int) -> np.ndarray:
        """Of two cells, which one (column) takes guests from the other (row): half of the pairs each; and each itself."""
        own, cell = np.arange(k)[:, None], np.arange(k)[None, :]
        return ((cell < own) == ((cell + own) % 2 == 1)) | (cell == own)

    def run(batches):
        cells = sent.value
        for batch in batches:
            rep, low, dim, vec, weight = (batch.column(i) for i in range(5))
            dims = dim.to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                c = cells.get(int(d))
                host = None if c is None else hosts(len(c[0]))
                for lo in range(0, len(at), 1024):
                    own = pa.array(at[lo : lo + 1024])
                    v = vec.take(own)
                    if c is None:
                        cell, who = np.zeros(len(own), np.int64), np.arange(len(own))
                        home = np.zeros(len(own), np.int64)
                    else:
                        sim = _unit(_vectors(v)) @ c[0].T
                        home = sim.argmax(axis=1)
                        margin = sim[np.arange(len(own)), home][:, None] - sim
                        who, cell = np.nonzero((margin <= radius * c[1][home] + 1e-9) & host[home])
                    take = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), d, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home[who] == cell), rep.take(own).take(take), low.take(own).take(take), v.take(take), weight.take(own).take(take)],
                        ["dim", "cell", "home", "rep", "low", "vec", "n"],
                    )

    return run


def _blocks(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between a block of a cell's members (left) and one of all it sees (right)."""
        left, home = (np.array(table.column(c).to_pylist(), bool) for c in ("left", "home"))
        ids, low, n = (table.column(c).to_numpy() for c in ("rep", "low", "n"))
        v = _unit(_vectors(table.column("vec")))
        members, b = np.flatnonzero(left), np.flatnonzero(~left)
        found: list[tuple] = []
        for lo in range(0, len(members), SLICE):
            a = members[lo : lo + SLICE]
            linked = (v[a] @ v[b].T) >= least
            linked &= ids[a][:, None] != ids[b][None, :]
            some_a, some_b = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
            linked = linked[np.ix_(some_a, some_b)]
            if not linked.size:
                continue
            own, other = a[some_a], b[some_b]
            # members are on the left in turn; guests are not
            guest = ~home[other]
            counted = [(ids[own], linked @ n[other]), (ids[other][guest], n[own] @ linked[:, guest])]
            # connected parts of this block by the smallest identifier, then a star for each
            xa, xb = low[own], low[other]
            far = np.iinfo(np.int64).max
            while True:
                ya = np.minimum(xa, np.where(linked, xb[None, :], far).min(axis=1))
                yb = np.minimum(xb, np.where(linked, ya[:, None], far).min(axis=0))
                if (ya == xa).all() and (yb == xb).all():
                    break
                xa, xb = ya, yb
            edge_id, edge_to = np.concatenate([low[own], low[other]]), np.concatenate([xa, xb])
            one = edge_id != edge_to
            found += [(rep, links, np.zeros(len(rep), np.int64), np.zeros(len(rep), bool)) for rep, links in counted]
            found.append((edge_id[one], np.zeros(one.sum(), np.int64), edge_to[one], np.ones(one.sum(), bool)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.table(dict(zip(("rep", "links", "other", "is_edge"), map(pa.array, columns), strict=True)))

    return run


def cosine_links(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    kind = "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    vec = F.col(f"`{vec_col}`").cast(f"array<{kind}>")
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite, F.lit(False)))
    # adding 0.0 turns -0.0 into 0.0, so that equal vectors hash alike
    rows = rows.withColumn("vec", F.when(F.col("ok"), F.transform("vec", lambda x: (x + F.lit(0.0)).cast(kind))))
    rows = scratch.put(rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec")), "rows")
    good = rows.where("ok")
    # a number of its own for each distinct vector: an identifier, null above all, can have several
    distinct = good.groupBy("h1", "h2").agg(F.min("_id").alias("low"), F.count("*").alias("n"), F.min("vec").alias("vec"))
    distinct = scratch.put(distinct.select("h1", "h2", F.monotonically_increasing_id().alias("rep"), "low", F.size("vec").alias("dim"), "vec", "n"), "distinct")
    reps = distinct.select("h1", "h2", "rep", "low", "n")

    cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, total in ((r.dim, r.total) for r in distinct.groupBy("dim").agg(F.count("*").alias("total")).orderBy(F.desc("total")).limit(64).collect()):
        sample = distinct.where(F.col("dim") == dim).select("vec", F.xxhash64("h1", "h2").alias("o")).orderBy("o").limit(SAMPLE).toArrow()
        k = max(1, min(MAX_CELLS, int(total**0.5) // SPREAD, sample.num_rows // 4))
        c = spherical_kmeans(_unit(_vectors(sample.column("vec"))), k)
        # distances of unit vectors from their products, with a margin for rounding
        cells[dim] = (c, np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) + 1e-6)
    sent = spark.sparkContext.broadcast(cells)
    radius = (2 - 2 * least) ** 0.5 if least < 1 else 0.0
    seen = scratch.put(distinct.select("rep", "low", "dim", "vec", "n").mapInArrow(_assigner(sent, radius), f"dim int, cell int, home boolean, rep long, low long, vec array<{kind}>, n long"), "cells")
    size = scratch.put(seen.groupBy("dim", "cell").agg(F.ceil(F.count("*") / RIGHT).cast("int").alias("rights"), F.ceil(F.count(F.when(F.col("home"), 1)) / LEFT).cast("int").alias("lefts")), "sizes")
    dealt = seen.join(F.broadcast(size) if len(cells) * MAX_CELLS <= 1 << 18 else size, ["dim", "cell"])
    pick = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    lefts = dealt.where("home").select("dim", "cell", pick("lefts").alias("i"), to("rights").alias("j"), F.lit(True).alias("left"), "home", "rep", "low", "vec", "n")
    rights = dealt.where("lefts > 0").select("dim", "cell", to("lefts").alias("i"), pick("rights").alias("j"), F.lit(False).alias("left"), "home", "rep", "low", "vec", "n")
    found = scratch.put(lefts.union(rights).groupBy("dim", "cell", "i", "j").applyInArrow(_blocks(least), "rep long, links long, other long, is_edge boolean"), "found")
    # an identifier whose rows have different vectors joins them
    shared = good.groupBy("_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x <> y").select("_id")
    same = good.join(shared, "_id").select("_id", "h1", "h2").distinct().join(reps, ["h1", "h2"]).where("_id <> low").select(F.col("_id").alias("a"), F.col("low").alias("b"))
    edges = found.where("is_edge").select(F.col("rep").alias("a"), F.col("other").alias("b")).union(same)
    part = scratch.put(connected_components(edges, scratch), "components")
    count = found.where("not is_edge").groupBy("rep").agg(F.sum("links").alias("links"))
    per = reps.join(count, "rep", "left").join(part, F.col("low") == part["node"], "left")
    per = scratch.put(per.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "low").alias("component")), "per")
    out = rows.select("_id", "ok", "h1", "h2").join(per, ["h1", "h2"], "left")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("_id"))
    return out.select(
        plain_id("vec_id"),
        F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(component != F.lit(NULL_ID), component).alias("component_id"),
        (F.col("_id") == component).alias("kept"),
    )


def contract(vectors: DataFrame) -> DataFrame:
    return cosine_links(vectors)
