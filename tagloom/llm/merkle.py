"""Merkle manifest of a dataset, with membership proofs by parent preimages.

A row's leaf is the SHA-256 of its fields, each with its byte count. The leaves
of a group ascend by identifier; every ``ARITY`` consecutive nodes become the
hash of their concatenated hexadecimal hashes (the parent's preimage) until one
node, the group's subroot, is left; the subroots, ordered by group, make the
root in the same way. A leaf's path holds the preimages of all its ancestors:
the siblings on a level are the preimage without the leaf's own slot of 64
characters, and a replaced leaf folds to a root by splicing each new hash into
that slot of the next preimage.

How it is spread: rows get their place within the group from a range sort and
the counts of its partitions, so a group with a third of all rows is many
tasks. ``BLOCK`` leaves (four levels) are one row, in which four levels of
preimages are built as arrays; the blocks' roots are nodes of the next tree, so
each further round has an 81st of the rows. Paths come back down by an equi-join
of blocks, not of leaves, and only hashes are moved, never texts.

Defined results: a null field counts as ``-``, an empty one as ``0:``; null
identifiers ascend first, and so does the null group; rows that share an
identifier ascend by their leaves, and equal rows stand side by side, each with
a path of its own; a group of one leaf has that leaf as its subroot, and one
group alone has its subroot as the root; a very long text is hashed by one
task; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_partitions

ARITY = 3
LEVELS = 4
BLOCK = ARITY**LEVELS


def leaf_hash(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of all fields, each as its byte count, a colon and the value, or a dash where it is null."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def ranked(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with ``pos`` (from 0, by ``order`` within the column ``g``) and ``n`` (rows of that ``g``), whatever the groups' sizes."""
    spark = df.sparkSession
    keys = ["g", *order, "tie"]
    rows = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    rows = scratch.put(rows.withColumn("at", F.monotonically_increasing_id()).drop("tie"), "ranked")
    part = F.shiftright("at", 33)
    pieces = rows.groupBy(F.col("g").alias("of"), part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = W.partitionBy("of").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("of", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy("of")).alias("n"))
    pieces = scratch.put(pieces, "pieces")
    return rows.join(pieces, F.col("g").eqNullSafe(F.col("of")) & (part == F.col("part"))).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "of", "part", "first", "before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (g, n, pos, h, own) by block: the items in order, the preimages of each level and the block's last hash."""
    out = nodes.groupBy("g", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "h", "own"))).alias("items"))
    out = out.withColumn("h0", F.col("items.h"))
    for k in range(LEVELS):
        runs = f"transform(sequence(0, (size(h{k}) - 1) div {ARITY}), i -> array_join(slice(h{k}, cast(i * {ARITY} + 1 as int), {ARITY}), ''))"
        out = out.withColumn(f"pre{k}", F.expr(f"if(n > {ARITY**k}, {runs}, cast(array() as array<string>))"))
        out = out.withColumn(f"h{k + 1}", F.expr(f"if(n > {ARITY**k}, transform(pre{k}, x -> sha2(x, 256)), h{k})"))
    return out.select("g", "n", "block", "items", *(f"pre{k}" for k in range(LEVELS)), F.col(f"h{LEVELS}")[0].alias("top"))


def _path(item: str) -> str:
    """SQL of the preimages and slots above item number ``item`` of a block, nearest first."""
    steps = [f"if(n > {ARITY**k}, array(named_struct('pre', pre{k}[cast({item} div {ARITY ** (k + 1)} as int)], 'slot', cast(({item} div {ARITY**k}) % {ARITY} as int))), cast(array() as array<struct<pre:string,slot:int>>))" for k in range(LEVELS)]
    return f"concat({', '.join(steps)})"


def climbed(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks of ``nodes`` with ``path`` (preimages above the block) and ``root`` of their tree."""
    blocks = scratch.put(_blocks(nodes), "blocks")
    if (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        return blocks.withColumn("path", F.expr("cast(array() as array<struct<pre:string,slot:int>>)")).withColumn("root", F.col("top"))
    above = blocks.select("g", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("pos"), F.col("top").alias("h"), F.struct("block").alias("own"))
    up = leaves(climbed(above, scratch)).select(F.col("g").alias("of"), F.col("own.block").alias("at"), "path", "root")
    up = scratch.put(up, "above")
    return blocks.join(up, F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")


def leaves(blocks: DataFrame) -> DataFrame:
    """One row a node: ``g``, ``h``, ``own``, its whole ``path`` and ``root``."""
    items = F.expr(f"transform(items, (x, i) -> named_struct('h', x.h, 'own', x.own, 'path', concat({_path('i')}, path)))")
    return blocks.select("g", "root", F.inline(items)).select("g", "h", "own", "path", "root")


def siblings(path: str) -> Column:
    """All siblings on a path, concatenated: each preimage without its own slot."""
    return F.expr(f"aggregate({path}, '', (a, s) -> concat(a, substring(s.pre, 1, 64 * s.slot), substring(s.pre, 64 * s.slot + 65)))")


def folded(leaf: str, path: str) -> Column:
    """The root that a leaf leads to: its hash takes its slot of each preimage in turn."""
    return F.expr(f"aggregate({path}, {leaf}, (a, s) -> sha2(concat(substring(s.pre, 1, 64 * s.slot), a, substring(s.pre, 64 * s.slot + 65)), 256))")


def manifest(rows: DataFrame) -> DataFrame:
    """``g`` (group), ``id``, ``leaf`` and ``own`` (any struct) to ``g``, ``leaf``, ``own``, ``subroot``, ``root`` and ``path`` (``pre``, ``slot`` of every ancestor)."""
    scratch = Scratch(rows.sparkSession)
    placed = ranked(scratch.put(rows, "leaves"), ["id", "leaf"], scratch)
    blocks = scratch.put(climbed(placed.select("g", "n", "pos", F.col("leaf").alias("h"), "own"), scratch), "groups")
    tops = blocks.where("block = 0").select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("h"), F.struct(F.col("g").alias("name")).alias("own"))
    tops = ranked(tops, ["name"], scratch).select("g", "n", "pos", "h", "own")
    tops = leaves(climbed(tops, scratch)).select(F.col("own.name").alias("of"), F.col("path").alias("above"), F.col("root").alias("whole"))
    tops = scratch.put(tops, "tops")
    both = blocks.join(tops, F.col("g").eqNullSafe(F.col("of"))).withColumnRenamed("root", "subroot")
    items = F.expr(f"transform(items, (x, i) -> named_struct('leaf', x.h, 'own', x.own, 'path', concat({_path('i')}, path, above)))")
    return both.select("g", "subroot", F.col("whole").alias("root"), F.inline(items))


def contract(docs: DataFrame) -> DataFrame:
    """The columns of ``op12``: rows of an even checksum are verified with their line ends deleted."""
    fields = [F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("`text`").cast("string")
    even = F.crc32(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    leaf, bad = leaf_hash([*fields, text]), leaf_hash([*fields, F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)])
    rows = docs.select(fields[1].cast("string").alias("g"), fields[0].cast("long").alias("id"), leaf.alias("leaf"), F.struct(fields[0].alias("doc_id"), bad.alias("shown")).alias("own"))
    out = manifest(rows).select("*", folded("own.shown", "path").alias("folded_root"))
    return out.select("own.doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
