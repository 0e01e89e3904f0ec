"""Trees edited as tables: deletes, moves and inserts are rows, and all numbers follow from counts.

Node rows never change in place. Every node begins somewhere, and elements end
somewhere: these events are put into their new order, and counting the nodes
that begin up to an event gives new numbers, sizes and text offsets. Where an
event goes is a key made from old numbers alone: its own place, or the gap that
its subtree is moved to and its place in the subtree. The order comes from
Spark's range partitioning and a sort within the ranges, counts from sums in
the ranges and over them, so no document and no gap is one task. Documents
whose numbers, and whose edits, are within one range (``RANGE``) need no joins:
their nodes move once and :mod:`small_edits` applies the same keys there.

``edits`` has the columns ``doc_id``, ``op`` (delete, move or insert), ``pre``
(the node that goes or moves), ``place`` (first or last in, before or after)
and ``target``, ``seq`` (their order at one place) and, for inserts, ``qname``,
``text`` and ``attrs``: a new element without a namespace, its attributes by
name and its text, if it is not null.

Defined results. All edits refer to the tree as it was. Of several edits of one
node that with the largest ``seq`` counts (deletes before moves at a tie). The
innermost edit decides: what moves out of a deleted subtree stays, what is
deleted in a moved one goes. Inserts into a deleted subtree go with it, those
into a moved one move. A move whose new place is in a moved or deleted subtree
(its own included), an edit of a node that is not there or is the document, and
a place beside an attribute or the document, are left out; :func:`rejected`
names them. Without edits, numbers become dense and nothing else changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.stored import store
from . import small_edits
from .ancestry import labelled
from .staircase import RANGE, innermost

_KEY = ("gap", "turn", "deep", "closing", "seq", "edit")
#: Columns that are numbered anew or left out.
_GONE = {"pre", "size", "level", "parent", "post", "t_from", "t_to", "labels", "nth", "path", "sib_ord", "block"}
_NEW = "doc_id long, op string, pre long, place string, target long, seq long, qname string, text string, attrs map<string,string>"


def ranked(events: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``events`` without ``keys`` and with running sums (column to name) over each document in the order of the keys, which no two rows share."""
    rows = events.repartitionByRange("doc_id", *keys).sortWithinPartitions("doc_id", *keys).drop(*keys)
    rows = store(rows.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    totals = rows.groupBy("doc_id", "_part").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums)])
    earlier = W.partitionBy("doc_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("doc_id", "_part", *[F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))])
    own = W.partitionBy("doc_id", "_part").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = rows.select("*", *[F.sum(c).over(own).alias(f"_s{k}") for k, c in enumerate(sums)]).join(before, ["doc_id", "_part"])
    return inner.withColumns({name: F.col(f"_s{k}") + F.col(f"_b{k}") for k, name in enumerate(sums.values())}).drop("_row", "_part", *[f"_{x}{k}" for x in "sb" for k in range(len(sums))])


def _key(*values: Column | int) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for v, n in zip(values, _KEY, strict=True)])


def no_edits(spark) -> DataFrame:
    return spark.createDataFrame([], _NEW)


def _placed(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the gap, the new parent and its level (null where there is no such place), the node's own level and size, and their number."""
    edits = store(edits.select(*[c.split()[0] for c in _NEW.split(", ")]).withColumn("edit", F.monotonically_increasing_id()))
    rows = nodes.select("doc_id", "pre", "size", "level", "parent", "kind")
    goals = rows.select("doc_id", F.col("pre").alias("target"), F.col("size").alias("t_size"), F.col("level").alias("t_level"), F.col("parent").alias("t_parent"), F.col("kind").alias("t_kind"))
    atts = rows.where("kind = 'ATT'").groupBy("doc_id", F.col("parent").alias("target")).agg((F.max("pre") + 1).alias("t_inner"))
    own = rows.select("doc_id", "pre", F.col("size").alias("own_size"), F.col("level").alias("own_level"), F.col("kind").alias("own_kind"))
    found = edits.join(goals, ["doc_id", "target"], "left").join(atts, ["doc_id", "target"], "left").join(own, ["doc_id", "pre"], "left")
    beside, inside = F.col("place").isin("before", "after") & ~F.col("t_kind").isin("ATT", "DOC"), F.col("place").isin("first", "last") & F.col("t_kind").isin("ELT", "DOC")
    end, at = F.col("target") + F.col("t_size"), F.col("place")
    gap = F.when(at == "before", F.col("target")).when(at.isin("after", "last"), end).otherwise(F.coalesce("t_inner", F.col("target") + 1))
    return found.withColumns({
        "gap": F.when(beside | inside, gap), "host": F.when(beside, F.col("t_parent")).when(inside, F.col("target")), "host_level": F.when(beside, F.col("t_level") - 1).when(inside, F.col("t_level")),
        "seq": F.coalesce("seq", F.lit(0).cast("long")),
    }).drop("t_size", "t_level", "t_parent", "t_kind", "t_inner")


def _judged(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Placed edits with ``reason``, null where they take effect."""
    placed = store(_placed(nodes, edits))
    first = W.partitionBy("doc_id", "pre").orderBy(F.desc("seq"), (F.col("op") == "delete").desc(), F.col("edit"))
    late = F.when((F.col("op") != "insert") & F.col("own_size").isNotNull() & (F.row_number().over(first) > 1), F.lit("another edit of the node counts"))
    roots = placed.where("op <> 'insert' and own_size is not null")
    reason = (
        F.when(~F.coalesce(F.col("op").isin("delete", "move", "insert"), F.lit(False)), F.lit("no such operation"))
        .when((F.col("op") != "insert") & F.col("own_size").isNull(), F.lit("no such node"))
        .when((F.col("op") != "insert") & (F.col("own_kind") == "DOC"), F.lit("the document stays"))
        .when((F.col("op") == "move") & (F.col("own_kind") == "ATT"), F.lit("attributes do not move"))
        .when((F.col("op") != "delete") & F.col("gap").isNull(), F.lit("no such place"))
        .when((F.col("op") == "insert") & F.col("qname").isNull(), F.lit("no name"))
    )
    rows = roots.withColumn("_late", late).unionByName(placed.where("op is null or op = 'insert' or own_size is null").withColumn("_late", F.lit(None).cast("string"))).withColumn("reason", F.coalesce(reason, F.col("_late"))).drop("_late")
    rows = store(rows)
    if rows.where("reason is null and op = 'move'").isEmpty():
        return rows
    taken = rows.where("reason is null and op <> 'insert'").select("doc_id", F.col("pre").alias("_lo"), (F.col("pre") + F.col("own_size")).alias("_hi"), F.lit("edit").alias("key"), F.col("edit").alias("value"))
    asked = rows.where("reason is null and op = 'move'").select("doc_id", F.col("host").alias("_at"), "edit")
    lost = innermost(taken, asked).select("doc_id", "edit", F.lit("the new place is moved or deleted").alias("why"))
    return rows.join(lost, ["doc_id", "edit"], "left").withColumn("reason", F.coalesce("reason", F.col("why"))).drop("why")


def rejected(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, op, pre, place, target, seq, reason) of edits that have no effect."""
    return _judged(nodes, edits).where("reason is not null").select("doc_id", "op", "pre", "place", "target", "seq", "reason")


def edited(nodes: DataFrame, edits: DataFrame, labels: bool = False) -> DataFrame:
    """Node rows of the edited trees, numbered anew; ``old_pre`` is the number that a node had, null for new ones.

    Labels, places among siblings and paths are left out; ``labels`` puts the first two in
    (as :func:`~tagloom.operators.ancestry.labelled` does).
    """
    ship(nodes.sparkSession)
    edits = store(edits.select(*[c.split()[0] for c in _NEW.split(", ")]).where("doc_id is not null").withColumn("edit", F.monotonically_increasing_id()))
    far = nodes.where(f"pre >= {RANGE} or pre < 0").select("doc_id")
    large = store(far.unionByName(edits.groupBy("doc_id").count().where(f"count > {RANGE}").select("doc_id")).distinct())
    found = _swept(nodes, edits, large, labels)
    if large.isEmpty():
        return found
    rest = _joined(store(nodes.join(large, "doc_id", "left_semi")), edits.join(large, "doc_id", "left_semi"))
    return found.unionByName(labelled(rest) if labels else rest)


def _swept(nodes: DataFrame, edits: DataFrame, large: DataFrame, labels: bool) -> DataFrame:
    """:func:`edited` for all documents but ``large`` ones: nodes and edits move once, to their document, and a batch of whole documents is edited together."""
    rows = nodes.where(f"doc_id is not null and pre >= 0 and pre < {RANGE}")
    keep = [c for c in rows.columns if c not in (_GONE - {"pre", "size", "level", "parent"})]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    # maps go as JSON: Spark measures a batch with every row, and walks over all null maps for that
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    rows = rows.select(*[text(F.col(c)).alias(c) if kinds[c].startswith("map") else c for c in keep])
    asked = edits.select("doc_id", text(F.struct(*small_edits.EDIT.names)).alias("_e"))
    skip = large.select("doc_id", F.lit(None).cast("string").alias("_e"), F.lit(True).alias("_skip"))
    stream = rows.unionByName(asked.unionByName(skip, allowMissingColumns=True), allowMissingColumns=True)
    stream = stream.repartition("doc_id").sortWithinPartitions("doc_id", "pre")
    out = {c: kinds[c] for c in keep} | {"doc_id": "bigint", "pre": "bigint", "size": "bigint", "level": "int", "parent": "bigint", "t_from": "bigint", "t_to": "bigint", "old_pre": "bigint"}
    out |= {"labels": "string", "nth": "int"} if labels else {}
    found = stream.mapInArrow(small_edits.sweeper(out, labels), ", ".join(f"`{c}` {t}" for c, t in out.items()))
    return found.withColumn("post", F.col("pre") + F.col("size") - 1 - F.col("level")).withColumn("sib_ord", F.col("pre"))


def _joined(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """:func:`edited` without labels, for documents of any size."""
    valid = store(_judged(nodes, edits).where("reason is null"))
    roots = valid.where("op <> 'insert'")
    # nothing moves or goes: no node needs the sweep
    points = nodes.limit(0) if roots.isEmpty() else nodes
    spans = roots.select("doc_id", F.col("pre").alias("_lo"), (F.col("pre") + F.col("own_size")).alias("_hi"), F.lit("edit").alias("key"), F.col("edit").alias("value"))
    inside = innermost(spans, points.select("doc_id", "pre", F.col("pre").alias("_at"))).select("doc_id", "pre", F.col("value").alias("root"))
    told = roots.select("doc_id", F.col("edit").alias("root"), F.col("op").alias("r_op"), F.col("gap").alias("r_gap"), F.col("host").alias("r_host"), F.col("host_level").alias("r_level"), F.col("own_level").alias("r_own"), F.col("pre").alias("r_pre"), F.col("seq").alias("r_seq"))
    inside = store(inside.join(told, ["doc_id", "root"]))

    moved, none = F.col("root").isNotNull(), _key(0, 0, 0, 0, 0, 0)
    goal = _key(F.col("r_gap"), 0, -F.col("r_level"), 0, F.col("r_seq"), F.col("root"))
    shift = F.when(moved, F.col("r_level") + 1 - F.col("r_own")).otherwise(F.lit(0))
    old = nodes.select("doc_id", "pre", "size", "level", "parent", "kind", F.when(F.col("kind") == "TXT", F.length("value")).otherwise(F.lit(0)).alias("chars"))
    old = old.join(inside, ["doc_id", "pre"], "left").where("r_op is null or r_op = 'move'")
    parent = F.when(moved & (F.col("pre") == F.col("r_pre")), F.col("r_host")).otherwise(F.col("parent"))
    begin, end = _key(F.col("pre"), 1, 0, 0, 0, 0), _key(F.col("pre") + F.col("size"), 0, -F.col("level"), 1, 0, 0)

    def event(place: Column, part: Column, starts: bool, ref: Column, leaf: Column, level: Column, parent: Column, chars: Column) -> Column:
        """One event; ``place`` holds the outer and the inner key."""
        return F.struct(
            place["outer"].alias("outer"), place["inner"].alias("inner"), part.cast("int").alias("part"), F.lit(1 if starts else 0).cast("long").alias("begins"), ref.cast("long").alias("ref"), leaf.cast("int").alias("leaf"),
            level.cast("int").alias("level"), parent.cast("long").alias("up"), (chars if starts else F.lit(0)).cast("long").alias("chars"),
        )

    def at(key: Column) -> Column:
        return F.struct(F.when(moved, goal).otherwise(key).alias("outer"), F.when(moved, key).otherwise(none).alias("inner"))

    zero, length = F.lit(0), F.col("chars")
    level = F.col("level") + shift
    both = F.when(F.col("kind").isin("ELT", "DOC"), F.array(event(at(begin), zero, True, F.col("pre"), zero, level, parent, length), event(at(end), zero, False, F.col("pre"), zero, level, parent, zero)))
    old_events = old.select("doc_id", F.explode(both.otherwise(F.array(event(at(begin), zero, True, F.col("pre"), F.lit(-1), level, parent, length)))).alias("e")).select("doc_id", "e.*")

    # new elements: their start, attributes, text and end are parts of one place
    new = valid.where("op = 'insert'").join(inside.withColumnRenamed("pre", "host"), ["doc_id", "host"], "left").where("r_op is null or r_op = 'move'")
    new = new.withColumn("names", F.array_sort(F.map_keys(F.coalesce("attrs", F.expr("cast(map() as map<string,string>)")))))
    spot, ref = at(_key(F.col("gap"), 0, -F.col("host_level"), 0, F.col("seq"), F.col("edit"))), -1 - F.col("edit")
    level, count = F.col("host_level") + 1 + shift, F.size("names")
    inner = F.transform(F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")), lambda i: event(spot, i, True, ref, i, level + 1, ref, zero))
    text = F.when(F.col("text").isNotNull(), F.array(event(spot, count + 1, True, ref, count + 1, level + 1, ref, F.length("text"))))
    pieces = F.concat(F.array(event(spot, zero, True, ref, zero, level, F.col("host"), zero)), inner, F.coalesce(text, F.filter(inner, lambda e: F.lit(False))), F.array(event(spot, count + 2, False, ref, zero, level, F.col("host"), zero)))
    new_events = new.select("doc_id", F.explode(pieces).alias("e")).select("doc_id", "e.*")

    order = store(ranked(old_events.unionByName(new_events), ["outer", "inner", "part"], {"begins": "n", "chars": "c"}))
    starts, ends = order.where("begins = 1"), order.where("begins = 0").select("doc_id", "ref", F.lit(0).alias("leaf"), F.col("n").alias("n_end"), F.col("c").alias("c_end"))
    numbered = starts.join(ends, ["doc_id", "ref", "leaf"], "left")
    numbers = store(numbered.select("doc_id", "ref", "leaf", "level", "up", (F.col("n") - 1).alias("pre"), (F.coalesce("n_end", "n") - F.col("n") + 1).alias("size"), (F.col("c") - F.col("chars")).alias("t_from"), F.coalesce("c_end", "c").alias("t_to")))
    above = numbers.where("leaf <= 0").select("doc_id", F.col("ref").alias("up"), F.col("pre").alias("parent"))
    numbers = numbers.join(above, ["doc_id", "up"], "left").drop("up")

    payload = nodes.select("doc_id", F.col("pre").alias("ref"), *[c for c in nodes.columns if c != "doc_id" and c not in _GONE])
    kept = numbers.where("leaf <= 0").join(payload, ["doc_id", "ref"]).withColumn("old_pre", F.col("ref")).drop("leaf", "ref")
    made = numbers.where("ref < 0").join(new.select("doc_id", ref.alias("ref"), "qname", "text", "attrs", "names"), ["doc_id", "ref"])
    is_att, is_elt = (F.col("leaf") > 0) & (F.col("leaf") <= F.size("names")), F.col("leaf") == 0
    name = F.when(is_elt, F.col("qname")).when(is_att, F.get("names", F.col("leaf") - 1)).otherwise(F.lit(""))
    value = F.when(is_att, F.element_at("attrs", name)).when(~is_elt, F.col("text"))
    own = {"kind": F.when(is_elt, "ELT").when(is_att, "ATT").otherwise("TXT"), "qname": name, "local_name": name, "ns_uri": F.lit(""), "prefix": F.lit(""), "value": value, "attrs": F.when(is_elt, F.coalesce("attrs", F.expr("cast(map() as map<string,string>)"))), "old_pre": F.lit(None).cast("long")}
    made = made.select("doc_id", "level", "pre", "size", "t_from", "t_to", "parent", *[e.alias(c) for c, e in own.items() if c in kept.columns])
    out = kept.unionByName(made, allowMissingColumns=True)
    # an attribute that is deleted leaves its element's own map, too
    bare = roots.where("op = 'delete' and own_kind = 'ATT'").join(nodes.where("kind = 'ATT'").select("doc_id", "pre", "parent", "local_name", "ns_uri"), ["doc_id", "pre"])
    bare = bare.groupBy("doc_id", F.col("parent").alias("old_pre")).agg(F.collect_set(F.when(F.coalesce("ns_uri", F.lit("")) == "", F.col("local_name")).otherwise(F.concat(F.lit("{"), "ns_uri", F.lit("}"), "local_name"))).alias("_bare"))
    if "attrs" in out.columns:
        out = out.join(bare, ["doc_id", "old_pre"], "left").withColumn("attrs", F.when(F.col("_bare").isNull(), F.col("attrs")).otherwise(F.map_filter("attrs", lambda k, _: ~F.array_contains("_bare", k)))).drop("_bare")
    return out.withColumn("post", F.col("pre") + F.col("size") - 1 - F.col("level")).withColumn("sib_ord", F.col("pre"))


def elements_for_attributes(nodes: DataFrame, found: DataFrame, qname: str | None = None) -> DataFrame:
    """Edits that turn attributes (``found``: doc_id, pre) into the first elements of their owners, in their order, named as they were or ``qname``; the value is the text."""
    told = ["doc_id", "pre", "parent", "kind", "qname", "value"]
    if set(told) <= set(found.columns):  # what an expression found has all that is needed
        own = found.select(*told).where("kind = 'ATT'").dropDuplicates(["doc_id", "pre"])
    else:
        own = nodes.where("kind = 'ATT'").join(found.select("doc_id", "pre").distinct(), ["doc_id", "pre"])
    none = F.lit(None)
    drop = own.select("doc_id", F.lit("delete").alias("op"), "pre", none.cast("string").alias("place"), none.cast("long").alias("target"), F.lit(0).cast("long").alias("seq"), none.cast("string").alias("qname"), none.cast("string").alias("text"), none.cast("map<string,string>").alias("attrs"))
    title = F.create_map(F.lit("title"), F.col("qname")) if qname else none.cast("map<string,string>")
    make = own.select("doc_id", F.lit("insert").alias("op"), none.cast("long").alias("pre"), F.lit("first").alias("place"), F.col("parent").alias("target"), F.col("pre").alias("seq"), (F.lit(qname) if qname else F.col("qname")).alias("qname"), F.col("value").alias("text"), title.alias("attrs"))
    return drop.unionByName(make)


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Edits of several kinds as one table."""
    return reduce(DataFrame.unionByName, parts)
