"""Keyed tables viewed as trees: one document per customer, orders below it, line items below those.

Numbers come from windows over the key path, never from a walk. Line items are
counted within their order, orders are numbered by those counts, and a line
item's number follows from its order's; so only the narrow rows of customers
and orders are sorted by customer, and line items move once, by their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shred import OF, STEP, UNNAMED
from .stored import once


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (depth 1) and orders (depth 2): number, subtree and text offsets, ``copies`` rows of one customer and order key, of which this is the ``copy``-th."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    none, long = F.lit(None).cast("string"), lambda n: F.lit(n).cast("long")
    held = read("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("l_returnflag"), F.lit(0))).alias("chars"))
    tops = read("customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("depth"), long(-1).alias("k_order"), none.alias("a_status"), none.alias("a_priority"), long(1).alias("rows"), long(0).alias("chars"))
    orders = read("orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mids = orders.select(F.col("o_custkey").alias("doc_id"), F.lit(2).alias("depth"), F.col("o_orderkey").alias("k_order"), F.col("o_orderstatus").alias("a_status"), F.col("o_orderpriority").alias("a_priority"), (F.coalesce("n", F.lit(0)) + 1).alias("rows"), F.coalesce("chars", F.lit(0)).alias("chars"))
    doc, own = W.partitionBy("doc_id"), W.partitionBy("doc_id", "k_order")
    along, places = doc.orderBy("k_order"), doc.orderBy("k_order").rowsBetween(W.unboundedPreceding, 0)
    depth = F.col("depth")
    count = lambda n: F.sum(F.when(depth == n, 1).otherwise(0)).over(places)
    t = tops.unionByName(mids).withColumns({"_rows": F.sum("rows").over(along), "_chars": F.sum("chars").over(along), "_tops": count(1), "_orders": count(2)})
    t = t.withColumns({"copies": F.count("*").over(own), "copy": F.row_number().over(own.orderBy("depth")), "_own": F.sum("rows").over(own), "_text": F.sum("chars").over(own), "_all": F.sum("rows").over(doc), "_full": F.sum("chars").over(doc)})
    before, start, top = F.col("_rows") - F.col("_own"), F.col("_chars") - F.col("_text"), depth == 1
    return t.select(
        "doc_id", "depth", "k_order", "a_status", "a_priority", "copies", F.col("copy").cast("long").alias("copy"), (before + F.col("copy")).alias("number"), F.when(top, F.col("_all")).otherwise(F.col("_own")).alias("width"),
        F.when(top, F.col("_tops")).otherwise(F.col("_orders")).alias("nth"), start.alias("t_from"), (start + F.when(top, F.col("_full")).otherwise(F.col("_text"))).alias("t_to"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items: number, order's number, place and text offset. ``(l_orderkey, l_linenumber)`` repeats, so more columns order them."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey is not null")
    chars = F.coalesce(F.length("l_returnflag"), F.lit(0))
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = lines.select("l_orderkey", F.col("l_returnflag").alias("a_flag"), chars.alias("chars"), F.row_number().over(order).alias("line"), (F.sum(chars).over(order.rowsBetween(W.unboundedPreceding, 0)) - chars).alias("before"))
    orders = heads(spark, sf_dir).where("depth = 2").select("doc_id", "k_order", (F.col("number") - F.col("copy")).alias("base"), "copies", "copy", "t_from")
    t = lines.join(orders, F.col("l_orderkey") == F.col("k_order"))
    copies, copy = F.col("copies"), F.col("copy")
    start = F.col("t_from") + copies * F.col("before") + (copy - 1) * F.col("chars")
    return t.select(
        "doc_id", "k_order", (copies * (F.col("line") - 1) + copy).alias("nth"), F.col("line").cast("long").alias("line"), (F.col("base") + copies * F.col("line") + copy).alias("number"), (F.col("base") + 1).alias("above"), "a_flag", start.alias("t_from"), (start + F.col("chars")).alias("t_to"),
    )


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders, numbered and written once for all queries of the application."""
    return once(spark, f"customers and orders {sf_dir}", lambda: _heads(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, numbered and written once for all queries of the application."""
    return once(spark, f"line items {sf_dir}", lambda: _lines(spark, sf_dir))


def customer_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pre, post, size, level, parent, local_name, k_order, k_line, a_*): customer, order and lineitem elements.

    Attributes are columns ``a_status``, ``a_priority`` and ``a_flag``.
    """
    none = F.lit(None).cast("string")
    one = F.lit(1).cast("long")
    tops = heads(spark, sf_dir).select("doc_id", F.col("depth").alias("level"), F.when(F.col("depth") == 1, "customer").otherwise("order").alias("local_name"), "k_order", F.lit(0).cast("long").alias("k_line"), "a_status", "a_priority", none.alias("a_flag"), F.col("number").alias("pre"), F.col("width").alias("size"), F.when(F.col("depth") == 2, one).alias("parent"))
    leaves = lines(spark, sf_dir).select("doc_id", F.lit(3).alias("level"), F.lit("lineitem").alias("local_name"), "k_order", F.col("line").alias("k_line"), none.alias("a_status"), none.alias("a_priority"), "a_flag", F.col("number").alias("pre"), one.alias("size"), F.col("above").alias("parent"))
    # post order: all that starts before the end of the subtree, less the ancestors
    return tops.unionByName(leaves).withColumn("post", F.col("pre") + F.col("size") - F.col("level"))


#: Numbers that one element of a keyed tree takes: its own, its attributes' and its text's.
STRIDE = 8


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer trees as node rows, the shape that XPath plans and rules work on.

    An element with number ``pre`` in :func:`customer_trees` has ``STRIDE * pre``
    here; attributes and the text of a line item (its flag) take the numbers
    behind it, and number 0 is the document. Orders have ``status``,
    ``priority`` and, as identifier, their key; line items have ``flag`` and
    refer to their order by ``order``.

    Only elements are stored. Every sort of node is a part of this view with its
    kind, name and labels as literals, so a condition on those leaves out the
    parts, and the columns, that it does not need.
    """
    top, order, item = heads(spark, sf_dir).where("depth = 1"), heads(spark, sf_dir).where("depth = 2"), lines(spark, sf_dir)
    none, empty, key = F.lit(None).cast("string"), F.create_map().cast("map<string,string>"), F.col("k_order").cast("string")
    # no higher-order function: with one, these columns are not compiled
    pair = lambda a, x, b, y: F.when(x.isNotNull() & y.isNotNull(), F.create_map(F.lit(a), x, F.lit(b), y)).when(x.isNotNull(), F.create_map(F.lit(a), x)).when(y.isNotNull(), F.create_map(F.lit(b), y)).otherwise(empty)

    def part(rows: DataFrame, kind: str, name: str, path: str, pre: Column, size: Column, level: int, parent: Column, value: Column = none, xml_id: Column = none, nth: Column = F.lit(1), attrs: Column = F.lit(None)) -> DataFrame:
        names = [*path.split(), *([] if kind in ("ELT", "DOC") else [f"@{name}" if kind == "ATT" else UNNAMED[kind]])]
        labels = "".join(STEP + n + ("" if n.startswith("#") else OF) for n in names)
        offset = lambda c: F.lit(None).cast("long") if kind == "ATT" else F.col(c).cast("long")
        return rows.select(
            "doc_id", pre.cast("long").alias("pre"), size.cast("long").alias("size"), F.lit(level).alias("level"), parent.cast("long").alias("parent"), pre.cast("long").alias("sib_ord"), F.lit(kind).alias("kind"), F.lit(name).alias("qname"), F.lit(name).alias("local_name"), F.lit("").alias("ns_uri"),
            value.alias("value"), xml_id.alias("xml_id"), nth.cast("int").alias("nth"), F.lit(labels).alias("labels"), attrs.cast("map<string,string>").alias("attrs"), offset("t_from").alias("t_from"), offset("t_to").alias("t_to"),
        )

    at, below, one = F.col("number") * STRIDE, F.col("above") * STRIDE, F.lit(1)
    width = F.col("width") * STRIDE
    status, priority, flag = F.col("a_status"), F.col("a_priority"), F.col("a_flag")
    upper, inner = "customer order", "customer order lineitem"
    return reduce(
        DataFrame.unionByName,
        [
            part(top, "DOC", "", "", F.lit(0), width + STRIDE, 0, F.lit(None)),
            part(top, "ELT", "customer", "customer", at, width, 1, F.lit(0), nth=F.col("nth"), attrs=empty),
            part(order, "ELT", "order", upper, at, width, 2, F.lit(STRIDE), xml_id=key, nth=F.col("nth"), attrs=pair("status", status, "priority", priority)),
            part(order.where(status.isNotNull()), "ATT", "status", upper, at + 1, one, 3, at, value=status),
            part(order.where(priority.isNotNull()), "ATT", "priority", upper, at + 2, one, 3, at, value=priority),
            part(item, "ELT", "lineitem", inner, at, F.lit(STRIDE), 3, below, nth=F.col("nth"), attrs=pair("flag", flag, "order", key)),
            part(item.where(flag.isNotNull()), "ATT", "flag", inner, at + 3, one, 4, at, value=flag),
            part(item, "ATT", "order", inner, at + 4, one, 4, at, value=key),
            part(item.where(flag.isNotNull()), "TXT", "", inner, at + 5, one, 4, at, value=flag),
        ],
    )
