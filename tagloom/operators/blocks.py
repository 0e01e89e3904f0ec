"""Which elements of a document become divisions and which spans, over node rows.

An element holds a division if a descendant is one with no override of
direction between them: an override is a name of its own and passes nothing
up. So every element belongs to the scope of the innermost override around it,
and holds a division exactly if its interval has a block of its own scope.
That is a difference of two running sums in the scope, summed in ranges, so
there is no walk from the leaves up and no join for each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staircase import innermost, running, subtree


def block_names(nodes: DataFrame, overrides: DataFrame | None = None, inline: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, name): ``div``, ``span`` or ``bdo`` for every element.

    ``nodes`` has ``block``, an element's own flag (null is false). ``overrides`` (doc_id,
    pre) become ``bdo``, and elements right below them are no blocks by
    themselves, nor are ``inline`` (doc_id, pre) ones; both become divisions
    all the same if they hold one.
    """
    none = nodes.select("doc_id", "pre").limit(0)
    bdo = (none if overrides is None else overrides.select("doc_id", "pre")).distinct()
    inline = (none if inline is None else inline.select("doc_id", "pre")).distinct()
    rows = nodes.where("kind = 'ELT'").select("doc_id", "pre", "size", "parent", F.coalesce("block", F.lit(False)).alias("block"))
    rows = rows.join(bdo.withColumn("bdo", F.lit(True)), ["doc_id", "pre"], "left").join(inline.withColumn("inline", F.lit(True)), ["doc_id", "pre"], "left")
    rows = rows.join(bdo.select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("below")), ["doc_id", "parent"], "left")
    spans = subtree(rows.where("bdo").select("doc_id", "pre", "size"), inside=False).select("doc_id", "_lo", "_hi", F.lit("bdo").alias("key"), F.col("pre").alias("value"))
    scopes = innermost(spans, rows.select("doc_id", "pre", F.col("pre").alias("_at"))).select("doc_id", "pre", F.col("value").alias("scope"))
    rows = rows.join(scopes, ["doc_id", "pre"], "left").withColumn("scope", F.coalesce("scope", F.lit(-1).cast("long")))
    own = F.col("block") & F.col("bdo").isNull() & F.col("inline").isNull() & F.col("below").isNull()
    own = own.cast("long")
    events = F.array(F.struct((F.col("pre") * 2).alias("_at"), own.alias("own"), F.lit(False).alias("end")), F.struct((F.col("pre") * 2 + F.col("size") * 2 - 1).alias("_at"), F.lit(0).cast("long").alias("own"), F.lit(True).alias("end")))
    sums = running(rows.select("doc_id", "pre", "scope", "bdo", F.explode(events).alias("e")).select("doc_id", "pre", "scope", "bdo", "e.*"), {"own": "blocks"}, by=("doc_id", "scope"))
    held = sums.groupBy("doc_id", "pre").agg((F.max(F.when(F.col("end"), F.col("blocks"))) - F.max(F.when(~F.col("end"), F.col("blocks") - F.col("own")))).alias("held"), F.max("bdo").alias("bdo"))
    return held.select("doc_id", "pre", F.when(F.col("bdo"), "bdo").when(F.col("held") > 0, "div").otherwise("span").alias("name"))
