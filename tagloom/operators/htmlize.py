"""XML documents with markup to bodies of HTML5, over node rows.

What the conversion decides of an element or attribute is an expression or a
join: names from :mod:`blocks`, attributes by their namespace, and whatever
HTML has no place for goes: elements of the tag set other than its span with
all that is below them, and instructions. Other attributes become elements in
front of the content, as inserts of :mod:`edits`. That numbers the new trees,
and :mod:`subtrees` writes them, so no task holds a document's tree.

Rules are not carried over here; a document whose root is an element of the
tag set has no body, and no row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shred import OF, STEP
from ..sources.stored import store
from ..sources.tree import ITS, XML
from . import blocks, edits, subtrees

#: Class, flow and identifiers of elements that stand for attributes.
ATT_CLASS, ID_PREFIX = "_ITS_ATT", "ITS_"
WITHIN = "no"


def _is_span() -> F.Column:
    return (F.col("ns_uri") == ITS) & (F.col("local_name") == "span")


def attribute_forms(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, parent, qname, value, form, name, text) of all attributes: ``form`` is keep (as ``name`` and ``text``), drop or element."""
    # the owner is the step before
    on_span = F.col("labels").rlike(f"{STEP}span{OF}{re.escape(ITS)}{STEP}[^{STEP}]*$")
    rows = nodes.where("kind = 'ATT'").select("doc_id", "pre", "parent", "qname", "local_name", "ns_uri", "value", on_span.alias("on_span"))
    ns, local, value = F.coalesce("ns_uri", F.lit("")), F.col("local_name"), F.col("value")
    own = (ns == ITS) | (F.col("on_span") & (ns == ""))
    kept = F.when(ns == XML, F.when(local.isin("id", "lang"), local)).when(own & (local != "version"), F.when(local.isin("translate", "dir"), local).otherwise(C.camel_to_dash(local)))
    form = F.when(kept.isNotNull(), "keep").when(((ns == XML) & (local == "space")) | own, "drop").otherwise("element")
    text = F.when(own & (local == "dir"), F.when(value == "lro", "ltr").when(value == "rlo", "rtl").otherwise(value)).otherwise(value)
    override = own & (local == "dir") & value.isin("lro", "rlo")
    return rows.select("doc_id", "pre", "parent", "qname", "value", form.alias("form"), kept.alias("name"), text.alias("text"), override.alias("override"))


def bodies(nodes: DataFrame) -> DataFrame:
    """Node rows of the HTML bodies, rooted in the documents' nodes; ``old_pre`` is the number in ``nodes``."""
    nodes = nodes.where(~_is_standoff())
    atts = store(attribute_forms(nodes))
    names = blocks.block_names(nodes, atts.where("override").select("doc_id", F.col("parent").alias("pre")), nodes.where("kind = 'ELT'").where(_is_span()))
    none = F.lit(None)
    # identifiers count upwards from the leaves, by name in an element; in the element the last name comes first
    asked = atts.where("form = 'element'").join(nodes.where("kind = 'ELT'").select("doc_id", F.col("pre").alias("parent"), "post"), ["doc_id", "parent"])
    asked = asked.select("doc_id", "parent", "qname", "value", "post", F.col("qname").alias("by_name"), F.col("pre").alias("by_pre"), F.lit(1).cast("long").alias("one"))
    asked = edits.ranked(asked, ["post", "by_name", "by_pre"], {"one": "n"})
    form = F.create_map(F.lit("title"), F.col("qname"), F.lit("class"), F.lit(ATT_CLASS), F.lit("its-within-text"), F.lit(WITHIN), F.lit("id"), F.concat(F.lit(ID_PREFIX), F.col("n").cast("string")))
    made = asked.select("doc_id", F.lit("insert").alias("op"), none.cast("long").alias("pre"), F.lit("first").alias("place"), F.col("parent").alias("target"), (-F.col("n")).alias("seq"), F.lit("span").alias("qname"), F.col("value").alias("text"), form.alias("attrs"))
    # rows without what goes: the numbers left are as good as dense ones for the edits
    rest = nodes.where("kind not in ('ATT', 'PI')").drop("attrs", "decls", "labels", "path")
    rows = edits.edited(rest.withColumn("attrs", none.cast("map<string,string>")), made)
    # attributes that stay come from the old element in their order, of equal names the last value, then its name as title
    held = atts.where("form = 'keep'").groupBy("doc_id", F.col("parent").alias("old_pre"), "name").agg(F.min("pre").alias("at"), F.max_by("text", "pre").alias("text"))
    held = held.groupBy("doc_id", "old_pre").agg(F.array_sort(F.collect_list(F.struct("at", "name", "text"))).alias("held"))
    # texts stay where they are: only elements are joined
    texts = rows.where("kind not in ('ATT', 'ELT')")
    rows = rows.where("kind = 'ELT'").join(names.select("doc_id", F.col("pre").alias("old_pre"), F.col("name").alias("becomes")), ["doc_id", "old_pre"], "left").join(held, ["doc_id", "old_pre"], "left")
    pair = lambda n, v: F.struct(n.alias("name"), v.alias("text"))
    stays = F.coalesce(F.transform("held", lambda h: F.struct(h["name"].alias("name"), h["text"].alias("text"))), F.array().cast("array<struct<name:string,text:string>>"))
    new = F.transform(F.array(F.lit("title"), F.lit("class"), F.lit("its-within-text"), F.lit("id")), lambda n: pair(n, F.element_at("attrs", n)))
    own = F.when(F.col("becomes").isNotNull(), F.concat(stays, F.array(pair(F.lit("title"), F.col("qname"))))).otherwise(new)
    rows = rows.withColumn("own", own).withColumns({"qname": F.coalesce("becomes", "qname"), "local_name": F.coalesce("becomes", "local_name")}).drop("becomes", "held")
    rows = rows.unionByName(texts.withColumn("own", F.lit(None).cast(rows.schema["own"].dataType)))
    return rows.withColumn("ns_uri", F.lit("")).drop("decls", "prefix", "attrs")


def html_markup(rows: DataFrame) -> DataFrame:
    """(doc_id, markup) of :func:`bodies`; a document whose root is left out has no row."""
    value, pre, zero = F.coalesce("value", F.lit("")), F.col("pre"), F.lit(0)
    quoted = lambda c: F.replace(C.xml_escape(c), F.lit('"'), F.lit("&quot;"))
    at = lambda place, turn, order, text: F.struct(place.cast("long").alias("place"), F.lit(turn).alias("turn"), order.cast("long").alias("order"), text.alias("text"))
    start = F.concat(F.lit("<"), "qname", F.array_join(F.transform("own", lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), quoted(a["text"]), F.lit('"'))), ""), F.lit(">"))
    element = F.array(at(pre, 0, zero, start), at(pre + F.col("size") - 1, 3, -F.col("level"), F.concat(F.lit("</"), "qname", F.lit(">"))))
    leaf = F.when(F.col("kind") == "TXT", F.array(at(pre, 0, zero, C.xml_escape(value)))).when(F.col("kind") == "COM", F.array(at(pre, 0, zero, F.concat(F.lit("<!--"), value, F.lit("-->")))))
    # what stands beside the root is no part of a body
    inside = rows.where("kind <> 'DOC'").where((F.col("level") > 1) | (F.col("kind") == "ELT"))
    return subtrees.joined(inside.select("doc_id", F.explode(F.when(F.col("kind") == "ELT", element).otherwise(leaf)).alias("e")))


def _is_standoff() -> F.Column:
    """Whether a node is in an element that is left out: its labels name one."""
    return F.col("labels").rlike(f"{STEP}(?!@|span{OF})[^{STEP}{OF}]*{OF}{re.escape(ITS)}({STEP}|$)")
