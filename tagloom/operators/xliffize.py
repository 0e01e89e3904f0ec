"""XML documents to XLIFF 1.2 by named groups and units, over node rows.

A node's label path says which step of it is the outermost group and which the
outermost unit in that, and the node's own path up to that step is the unit's
key. So nothing is joined: after one shuffle by document its rows are sorted,
inline children, units and groups are numbered, and units put together. (The
result has a document in one row, too.) What rules say of elements comes as a
table, joined to units and their children only.

Defined results. A unit without text is left out, and a group without units
too; a document without units has an empty body, one whose root is an element
of the tag set other than its span has no row. Local markup counts before
rules, for terms and notes as a whole. Standoff markup inside a unit is left
out, and :func:`documents` writes no header for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shred import OF, STEP
from ..sources.tree import ITS, ITSX, XLIFF, XML
from .convert import NOTE, TERM
from .subtrees import escaped

_EVENT = "array<struct<place:bigint,turn:int,order:bigint,text:string>>"
_PAIRS = "array<struct<name:string,value:string>>"
_ROW = ["doc_id", "pre", "size", "level", "parent", "sib_ord", "kind", "qname", "prefix", "local_name", "ns_uri", "value", "attrs", "decls"]


def _name(step: Column) -> Column:
    return F.substring_index(step, OF, 1)


def _space(step: Column) -> Column:
    return F.substring_index(step, OF, -1)


def _is_standoff(step: Column) -> Column:
    return (_space(step) == ITS) & (_name(step) != "span")


def placed(nodes: DataFrame, tu: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Root elements and all nodes in units: node columns with ``unit`` and ``box`` (paths of unit and group), ``depth`` below the unit and ``aside``, true in standoff markup."""
    steps, at = F.col("_steps"), lambda s, names: _name(s).isin(*names) & (_space(s) != ITS)
    first = F.array_position(F.transform(steps, lambda s: at(s, group)), True).cast("int") - 1 if group else F.lit(1)
    rows = nodes.select(*_ROW, "path", F.split("labels", STEP).alias("_steps"))
    rows = rows.where(~F.coalesce(_is_standoff(F.get("_steps", F.lit(1))), F.lit(False))).withColumn("_g", first)
    inner = F.array_position(F.transform(F.slice(steps, F.greatest(F.col("_g"), F.lit(0)) + 1, F.size(steps)), lambda s: at(s, tu)), True).cast("int")
    rows = rows.withColumn("_u", F.when((F.col("_g") > 0) & (inner > 0), F.col("_g") + inner - 1))
    cut = lambda level: F.expr(f"substring_index(path, '/', {level} + 1)")
    aside = F.coalesce(_is_standoff(F.get(steps, F.col("_u") + 1)), F.lit(False))
    rows = rows.withColumns({"unit": F.when(F.col("_u").isNotNull(), cut("_u")), "box": F.when(F.col("_u").isNotNull(), cut("_g")), "depth": F.col("level") - F.col("_u"), "aside": aside})
    return rows.where(F.col("unit").isNotNull() | ((F.col("level") == 1) & (F.col("kind") == "ELT"))).drop("_steps", "_g", "_u", "path")


def _att(name: str | Column, value: Column) -> Column:
    """One attribute's markup, empty for a null value."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.concat(F.lit(" "), name, F.lit('="'), escaped(value, True), F.lit('"')), F.lit(""))


def _tag(name: str, atts: Column, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}"), atts, F.when(content == "", F.lit("/>")).otherwise(F.concat(F.lit(">"), content, F.lit(f"</{name}>"))))


def dressed(rows: DataFrame) -> DataFrame:
    """``rows`` with what an element's metadata (local attributes, and ``said`` by rules) becomes: ``on_unit``, ``on_source``, ``mark`` around its text and ``note`` as a unit, ``inline`` as a child (null where it needs no mark)."""
    key = lambda e: e["key"]
    own, bare = f"{{{ITS}}}", (F.col("ns_uri") == ITS) & (F.col("local_name") == "span")
    entries = F.map_entries("attrs")
    local = F.filter(entries, lambda e: key(e).startswith(own) | (bare & ~key(e).startswith("{")))
    local = F.transform(local, lambda e: F.struct(F.regexp_replace(key(e), r"^\{[^}]*\}", "").alias("name"), e["value"].alias("value")))
    other = F.filter(entries, lambda e: ~key(e).isin(f"{{{XML}}}id", f"{own}withinText"))
    rows = rows.withColumns({"_local": F.coalesce(local, F.array().cast(_PAIRS)), "_asks": F.size(F.coalesce(other, F.array().cast("array<struct<key:string,value:string>>"))) > 0})
    names = F.array_distinct(F.transform("_local", lambda e: e["name"]))
    # of an attribute with and without a prefix on one span the last counts, at the place of the first
    rows = rows.withColumn("_local", F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter("_local", lambda e: e["name"] == n), -1)["value"].alias("value"))))

    def get(name: str) -> Column:
        group = next((g for g in (TERM, NOTE) if name in g), (name,))
        here = F.exists("_local", lambda e: e["name"].isin(*group))
        mine = F.get(F.filter("_local", lambda e: e["name"] == name), F.lit(0))["value"]
        return F.when(here, mine).otherwise(F.col("said")[name])

    wanted = (*TERM, *NOTE, "translate")
    rows = rows.withColumns({f"_{n}": get(n) for n in wanted})
    used = [*wanted, "version", "withinText"]
    rest = F.array_join(F.transform(F.filter("_local", lambda e: ~e["name"].isin(*used)), lambda e: _att(F.concat(F.lit("its:"), e["name"]), e["value"])), "")
    kind = F.when(F.coalesce(F.col("_term"), F.lit("yes")) == "yes", "term").otherwise("x-its-term-no")
    terms = F.concat(*[_att(f"itsxlf:{n}", F.col(f"_{n}")) for n in TERM[1:]])
    any_term = F.coalesce(*[F.col(f"_{n}") for n in TERM]).isNotNull()
    translate, note = F.col("_translate"), F.col("_locNote")
    mtype = F.when(any_term, kind).when(translate.isNotNull(), F.when(translate == "yes", "x-its-translate-yes").otherwise("protected")).otherwise("x-its")
    inline = F.concat(_att("mtype", mtype), terms, _att("comment", note), F.when(note.isNotNull(), _att("itsxlf:locNoteType", F.coalesce("_locNoteType", F.lit("description")))).otherwise(""), rest)
    told = F.coalesce(F.exists(F.map_keys("said"), lambda n: n != "idValue"), F.lit(False))
    xml_id = F.col("attrs")[f"{{{XML}}}id"]
    return rows.withColumns({
        "on_unit": F.concat(_att("translate", translate), _att("resname", F.coalesce(xml_id, F.col("said")["idValue"]))),
        "on_source": rest,
        "mark": F.when(F.col("_term").isNotNull(), F.concat(_att("mtype", kind), terms)),
        "note": F.when(note.isNotNull(), _tag("note", F.when(F.col("_locNoteType") == "alert", ' priority="1"').otherwise(' priority="2"'), escaped(note))).otherwise(""),
        "inline": F.when(told | F.col("_asks"), inline),
    }).drop("_local", "_asks", *[f"_{n}" for n in wanted])


def _events(rows: DataFrame) -> DataFrame:
    """``rows`` with ``events``: what each node adds to the content of its unit; markup below the unit is text of a placeholder."""
    pre, zero, depth, kind = F.col("pre"), F.lit(0), F.col("depth"), F.col("kind")
    at = lambda place, turn, order, text: F.struct(place.cast("long").alias("place"), F.lit(turn).alias("turn"), order.cast("long").alias("order"), text.alias("text"))
    text = lambda *parts: escaped(F.concat(*parts))
    # declarations of the tag set that nothing in the placeholder uses are left out
    decls = F.array_sort(F.map_entries(F.coalesce("decls", F.expr("cast(map() as map<string,string>)"))))
    decls = F.filter(decls, lambda d: (d["value"] != ITS) | F.array_contains("used", d["key"]))
    spaces = F.array_join(F.transform(decls, lambda d: _att(F.concat(F.lit("xmlns"), F.when(d["key"] == "", "").otherwise(F.concat(F.lit(":"), d["key"]))), d["value"])), "")
    full = F.col("full")
    close, last = F.when(full, ">").otherwise("/>"), pre + F.col("size") - 1
    end = F.concat(F.lit("</"), "qname", F.lit(">"))
    # a direct child, in a mark if it has metadata
    mark, unmark = F.coalesce(F.concat(F.lit("<mrk"), "inline", F.lit(">")), F.lit("")), F.when(F.col("inline").isNotNull(), "</mrk>").otherwise("")
    bare = F.when(F.col("inline").isNull(), _att("xml:id", F.col("own_id"))).otherwise("")
    opened = F.concat(mark, F.lit('<ph id="'), F.col("inner").cast("string"), F.lit('">'), text(F.lit("<"), "qname", spaces, bare, close))
    closed = F.concat(F.lit("</ph>"), unmark)
    child = F.when(full, F.array(at(pre, 0, zero, opened), at(last, 3, -F.col("level"), F.concat(text(end), closed)))).otherwise(F.array(at(pre, 0, zero, F.concat(opened, closed))))
    deeper = F.array(at(pre, 0, zero, text(F.lit("<"), "qname", spaces)), at(pre, 2, zero, text(close)))
    deeper = F.when(full, F.concat(deeper, F.array(at(last, 3, -F.col("level"), text(end))))).otherwise(deeper)
    value = F.coalesce("value", F.lit(""))
    pi = F.concat(F.lit("<?"), "qname", F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""), F.lit("?>"))
    events = (
        F.when(F.col("aside") | (depth < 1), F.lit(None))
        .when(kind == "TXT", F.array(at(pre, 0, zero, F.when(depth == 1, escaped(value)).otherwise(text(escaped(value))))))
        .when((kind == "ELT") & (depth == 1), child)
        .when((kind == "ELT"), deeper)
        .when((kind == "ATT") & (depth > 2), F.array(at(F.col("parent"), 1, F.col("sib_ord"), text(_att(F.col("qname"), value)))))
        .when((kind == "COM") & (depth > 1), F.array(at(pre, 0, zero, text(F.lit("<!--"), value, F.lit("-->")))))
        .when((kind == "PI") & (depth > 1), F.array(at(pre, 0, zero, text(pi))))
    )
    return rows.withColumn("events", F.coalesce(events, F.array()).cast(_EVENT))


def units(nodes: DataFrame, tu: Sequence[str], group: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, group, head, body): translation units in document order, numbered from 1 with their groups.

    ``head`` and ``body`` are the unit's markup before and after its number. A
    document has a row with a null ``unit`` besides. ``values`` (doc_id, pre,
    name, value) is what rules say of elements, one value a name.
    """
    rows = placed(nodes, tu, group)
    # comments and instructions beside the text, and attributes of units and their children, are read off the elements or not shown
    rows = rows.where((F.col("kind").isin("ELT", "TXT") | (F.col("depth") > F.when(F.col("kind") == "ATT", 2).otherwise(1))))
    asks = F.coalesce((F.col("kind") == "ELT") & (F.col("depth") < 2), F.lit(False))
    heads, rest = rows.where(asks), rows.where(~asks)
    if values is None:
        heads = heads.withColumn("said", F.lit(None).cast("map<string,string>"))
    else:
        said = values.where("value is not null").groupBy("doc_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("said"))
        heads = heads.join(said, ["doc_id", "pre"], "left")
    full = F.col("size") > 1 + F.coalesce(F.size(F.map_keys("attrs")), F.lit(0))
    dress = [c for c in ("on_unit", "on_source", "mark", "note", "inline", "own_id")]
    heads = dressed(heads).withColumn("own_id", F.col("attrs")[f"{{{XML}}}id"])
    rest = rest.withColumns({c: F.lit(None).cast("string") for c in dress})
    goes = [*[c for c in _ROW if c not in ("attrs", "local_name", "ns_uri")], "unit", "depth", "aside", *dress, full.alias("full"), F.when(F.col("depth") == 0, F.col("box")).alias("box")]
    rows = heads.select(goes).unionByName(rest.select(goes)).repartition("doc_id")
    own = W.partitionBy("doc_id", "unit")
    child = (F.col("kind") == "ELT") & (F.col("depth") == 1) & ~F.col("aside")
    rows = rows.withColumn("inner", F.sum(child.cast("int")).over(own.orderBy("pre")))
    shown = ~F.col("aside") & (((F.col("kind") == "ELT") & (F.col("depth") > 0)) | ((F.col("kind") == "ATT") & (F.col("depth") > 2)))
    rows = rows.withColumn("used", F.collect_set(F.when(shown, F.coalesce("prefix", F.lit("")))).over(W.partitionBy("doc_id", "unit", "inner")))
    rows = _events(rows)
    top = F.when((F.col("depth") == 0) & (F.col("kind") == "ELT"), F.struct("on_unit", "on_source", "mark", "note"))
    content = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("events"))), lambda e: e["text"]), "")
    found = rows.groupBy("doc_id", "unit").agg(
        F.min("pre").alias("first"), F.max("box").alias("box"), F.max(top).alias("top"), content.alias("content"),
        F.max((F.col("kind") == "TXT") & F.coalesce(F.col("value").rlike(r"(?U)\S"), F.lit(False))).alias("said"), F.max((F.col("level") == 1) & (F.col("kind") == "ELT")).alias("root"),
    )
    is_unit = F.col("unit").isNotNull() & F.col("said")
    found = found.where(is_unit | F.col("root")).withColumn("box", F.when(is_unit, F.col("box")))
    mark = F.when(F.col("top.mark").isNotNull(), _tag("mrk", F.col("top.mark"), F.col("content"))).otherwise(F.col("content"))
    source, target = _tag("source", F.col("top.on_source"), F.col("_in")), _tag("target", F.concat(F.lit(' state="new"'), F.col("top.on_source")), F.col("_in"))
    body = F.concat(F.lit('"'), F.col("top.on_unit"), F.lit(">"), source, target, F.col("top.note"), F.lit("</trans-unit>"))
    order = W.partitionBy("doc_id").orderBy("first")
    turn = is_unit & ~F.lag("box").over(order).eqNullSafe(F.col("box"))
    found = found.withColumn("_in", mark).withColumns({"_turn": turn, "_n": F.sum(is_unit.cast("int")).over(order)})
    return found.select(
        "doc_id", F.when(is_unit, F.col("_n")).alias("unit"), F.when(is_unit, F.sum(F.col("_turn").cast("int")).over(order)).alias("group"), F.coalesce("_turn", F.lit(False)).alias("opens"),
        F.when(is_unit, F.lit('<trans-unit id="')).alias("head"), F.when(is_unit, body).alias("body"),
    )


def documents(nodes: DataFrame, tu: Sequence[str], group: Sequence[str] = (), values: DataFrame | None = None, original: str = "STRING", source_language: str = "en") -> DataFrame:
    """(doc_id, n_units, n_groups, xliff): every document as XLIFF 1.2."""
    rows = units(nodes, tu, group, values)
    number = lambda c: c.cast("string")
    box = F.when(F.col("opens"), F.concat(F.when(F.col("group") > 1, "</group>").otherwise(""), F.lit('<group id="'), number(F.col("group")), F.lit('">'))).otherwise("")
    piece = F.when(F.col("unit").isNotNull(), F.struct(F.col("unit"), F.concat(box, "head", number(F.col("unit")), "body").alias("text")))
    found = rows.groupBy("doc_id").agg(F.count("unit").alias("n_units"), F.coalesce(F.max("group"), F.lit(0)).cast("long").alias("n_groups"), F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("_all"))
    inner = F.when(F.col("n_units") == 0, "<body/>").otherwise(F.concat(F.lit("<body>"), "_all", F.lit("</group></body>")))
    file = F.concat(F.lit('<file datatype="plaintext"'), _att("original", F.lit(original)), _att("source-language", F.lit(source_language)), F.lit(">"), inner, F.lit("</file>"))
    top = F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<xliff xmlns="{XLIFF}" xmlns:its="{ITS}" xmlns:itsxlf="{ITSX}" its:version="2.0">')
    return found.select("doc_id", "n_units", "n_groups", F.concat(top, file, F.lit("</xliff>")).alias("xliff"))
