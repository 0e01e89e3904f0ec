"""Metadata that is inherited, and units of flowing text, over node rows.

What a rule or local markup says of an element holds below it until an inner
element says otherwise: the innermost open value, found by one sweep over the
document order. An element whose content is not within the text breaks the
flow where it begins and where it ends; the breaks counted up to a text number
its unit, by sums within ranges and over ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staircase import innermost, running, subtree


def inherited(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, pre, name, value): what ``values`` (doc_id, pre, name, value), set on elements, means for every element and text."""
    marks = values.select("doc_id", "pre", F.col("name").alias("key"), "value").join(nodes.select("doc_id", "pre", "size"), ["doc_id", "pre"])
    points = nodes.where("kind in ('ELT', 'TXT')").select("doc_id", "pre", F.col("pre").alias("_at"))
    return innermost(subtree(marks, inside=False).drop("pre", "size"), points).select("doc_id", "pre", F.col("key").alias("name"), "value")


def units(nodes: DataFrame, within: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, first_pre, parts, source): units of text in document order, blank ones left out, numbered from 1.

    ``within`` (doc_id, pre) names the elements that stand within the text
    around them; all others break it. ``values`` (doc_id, pre, value), as
    inherited by texts, breaks it too where it changes, and is a column then.
    """
    flowing = within.select("doc_id", "pre", F.lit(True).alias("flows")).distinct()
    elements = nodes.where("kind = 'ELT'").select("doc_id", "pre", "size").join(flowing, ["doc_id", "pre"], "left_anti")
    # three places a number: what begins there, the text, what ends there
    edges = elements.select("doc_id", F.explode(F.array(F.col("pre") * 3, (F.col("pre") + F.col("size") - 1) * 3 + 2)).alias("_at"), F.lit(1).cast("long").alias("breaks"))
    edges = edges.groupBy("doc_id", "_at").agg(F.sum("breaks").alias("breaks"))
    texts = nodes.where("kind = 'TXT'").select("doc_id", "pre", (F.col("pre") * 3 + 1).alias("_at"), F.lit(0).cast("long").alias("breaks"), F.col("value").alias("text"))
    if values is not None:
        texts = texts.join(values.select("doc_id", "pre", F.col("value").alias("says")), ["doc_id", "pre"], "left")
    rows = running(edges.unionByName(texts, allowMissingColumns=True), {"breaks": "flow"}).where("text is not null")
    own = ["doc_id", "flow", *(["says"] if values is not None else [])]
    if values is not None:
        # a change of the value inside a flow
        near = W.partitionBy("doc_id", "flow").orderBy("_at")
        rows = rows.withColumn("turn", F.sum(F.when(F.lag("says").over(near).eqNullSafe(F.col("says")), 0).otherwise(1)).over(near))
        own.append("turn")
    found = rows.groupBy(*own).agg(F.min("pre").alias("first_pre"), F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "").alias("source"))
    found = found.where(F.col("source").rlike(r"\S"))
    unit = F.row_number().over(W.partitionBy("doc_id").orderBy("first_pre")).cast("long")
    return found.select("doc_id", unit.alias("unit"), "first_pre", "parts", "source", *([F.col("says").alias("value")] if values is not None else []))
