"""XPath compiled to structural joins over node rows.

A context relation carries (doc_id, ctx, node columns); a step is an equi-join
on ``doc_id`` and ``parent = pre`` (child, attribute, parent, siblings), a sweep
over subtrees in document order (descendant, ancestor, see :mod:`staircase`), or
a join by range of numbers (following, preceding). The next sibling and the one
before come from ``lead`` and ``lag``. Positions are windows over the context
node of their step. Predicates become boolean columns: a path inside a
predicate runs with each candidate as its own context, and its hits are joined
back. What is not lowered raises :class:`NotLowered`; the tree evaluator then
takes over.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.xpath_syntax import fuse, parse
from ..sources.tree import XML
from .staircase import RANGE, innermost, interval_join, subtree

NODE = ["pre", "size", "parent", "sib_ord", "kind", "qname", "local_name", "ns_uri", "value", "xml_id"]
#: Numbers that are swept together: intervals meet by (document, range), so a large document is no single key.
BUCKET = RANGE
#: Characters of a document whose texts are put together in one row.
PIECE = 1024
_SELF = [("self", ("kind", "node"), [])]
_REVERSE = {"ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}


class NotLowered(ValueError):
    """An expression that has no plan here."""


@dataclass
class _Bound:
    nodes: DataFrame
    prefixes: Mapping[str, str]
    params: Mapping[str, str]
    #: The contexts are all documents.
    whole: bool = False
    #: Whether string values of elements are planned too; ``full`` has the text offsets for them.
    texts: bool = False
    full: DataFrame | None = None
    #: Paths of predicates that are being planned, and whether the candidates of the outermost predicate stand once each.
    depth: int = 0
    alone: bool = False


def roots(nodes: DataFrame) -> DataFrame:
    """The root element of every document as its context."""
    return nodes.where("kind = 'ELT' and level = 1").select("doc_id", F.col("pre").alias("ctx"), *NODE)


def select(
    nodes: DataFrame, expr: str, prefixes: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, context: DataFrame | None = None, positions: bool = True, texts: bool = False
) -> DataFrame:
    """(doc_id, ctx, position, hits, node columns) of a node-set expression, from each context node.

    ``context`` has the columns of :func:`roots`; the default is the root
    element, and the document (number 0) for absolute paths. Without
    ``positions`` those two columns are left out, and their sort with them.
    With ``texts``, predicates on the string values of elements are planned
    as well (``nodes`` then needs ``t_from`` and ``t_to``).
    """
    bound = _Bound(nodes.select("doc_id", *NODE), prefixes or {}, params or {}, texts=texts, full=nodes)
    tree = fuse(parse(expr))
    if context is None and all(t[0] == "path" and t[1] == "/" for t in (tree[1] if tree[0] == "union" else [tree])):
        context = nodes.where("kind = 'DOC'").select("doc_id", F.lit(0).cast("long").alias("ctx"), *NODE)
        bound.whole = True
    found = _node_set(tree, roots(nodes) if context is None else context, bound)
    if not positions:
        return found.select("doc_id", "ctx", *NODE)
    own = W.partitionBy("doc_id", "ctx")
    return found.withColumn("position", F.row_number().over(own.orderBy("pre"))).withColumn("hits", F.count("*").over(own)).select("doc_id", "ctx", "position", "hits", *NODE)


def _node_set(tree, ctx: DataFrame, b: _Bound) -> DataFrame:
    if tree[0] == "union":
        parts = [_node_set(t, ctx, b) for t in tree[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(["doc_id", "ctx", "pre"])
    if tree[0] == "call" and tree[1] == "id" and len(tree[2]) == 1 and tree[2][0][0] in ("str", "var"):
        arg = tree[2][0]
        text = arg[1] if arg[0] == "str" else b.params.get(arg[1], "")
        words = text.split()
        hit = b.nodes.where((F.col("kind") == "ELT") & F.col("xml_id").isin(words)) if words else b.nodes.where(F.lit(False))
        return ctx.select("doc_id", "ctx").distinct().join(hit, "doc_id").select("doc_id", "ctx", *NODE)
    if tree[0] == "call" and tree[1] == "id" and len(tree[2]) == 1 and tree[2][0][0] == "path":
        if not _is_leaf(tree[2][0]):
            raise NotLowered("identifiers from the string value of an element")
        words = _node_set(tree[2][0], ctx, b).select("doc_id", "ctx", F.explode(F.split(F.trim("value"), r"\s+")).alias("xml_id")).where("xml_id <> ''")
        hit = b.nodes.where("kind = 'ELT' and xml_id is not null")
        return words.join(hit, ["doc_id", "xml_id"]).select("doc_id", "ctx", *NODE).dropDuplicates(["doc_id", "ctx", "pre"])
    if tree[0] != "path" or tree[1] not in (None, "/"):
        raise NotLowered(f"no plan for {tree[0]}")
    steps = list(tree[2])
    now, top = ctx, False
    if tree[1] == "/":
        now = ctx if b.whole else ctx.select("doc_id", "ctx").distinct().join(b.nodes.where("kind = 'DOC'"), "doc_id").select("doc_id", "ctx", *NODE)
        top = True
    for axis, test, preds in steps:
        now = _step(now, axis, test, preds, b, top)
        top = False
    return now.select("doc_id", "ctx", *NODE)


def _is_leaf(path) -> bool:
    """Whether a path ends at attributes or texts, whose value is a column."""
    return bool(path[2]) and (path[2][-1][0] == "attribute" or path[2][-1][1] == ("kind", "text"))


def _step(ctx: DataFrame, axis: str, test, preds, b: _Bound, top: bool) -> DataFrame:
    n = b.nodes
    old = ctx.select("doc_id", "ctx", *[F.col(c).alias(f"o_{c}") for c in ("pre", "size", "parent", "sib_ord", "kind")])
    no_att = F.col("kind") != "ATT"
    repeats = True
    if axis in ("child", "attribute"):
        out = old.join(n.withColumnRenamed("parent", "o_pre"), ["doc_id", "o_pre"]).withColumn("parent", F.col("o_pre"))
        out = out.where(no_att if axis == "child" else ~no_att)
        repeats = False
    elif axis == "self":
        out = ctx.withColumn("o_pre", F.col("pre"))
        repeats = False
    elif axis == "parent":
        out = old.join(n.withColumnRenamed("pre", "o_parent"), ["doc_id", "o_parent"]).withColumn("pre", F.col("o_parent"))
    elif axis in ("descendant", "descendant-or-self"):
        low = F.col("pre") >= F.col("o_pre") if axis.endswith("self") else F.col("pre") > F.col("o_pre")
        if top and b.whole:  # all nodes of all documents
            out = n.where(no_att if axis == "descendant-or-self" else no_att & (F.col("kind") != "DOC")).withColumn("ctx", F.lit(0).cast("long")).withColumn("o_pre", F.col("ctx"))
            repeats = False
        elif top:  # all nodes of the document: no interval is needed
            out = old.select("doc_id", "ctx", "o_pre").join(n, "doc_id").where(low & no_att)
            repeats = False
        else:
            found = interval_join(subtree(old.select("doc_id", "ctx", "o_pre", "o_size"), "o_pre", "o_size"), n.where(no_att & _test(test, axis, b)).withColumn("_at", F.col("pre")))
            out = found.select("doc_id", "ctx", "o_pre", *NODE)
            if axis.endswith("self"):
                out = out.unionByName(ctx.select("doc_id", "ctx", F.col("pre").alias("o_pre"), *NODE))
    elif axis in ("ancestor", "ancestor-or-self"):
        tops = subtree(n.where("kind in ('ELT', 'DOC') and size > 1").where(_test(test, axis, b)))
        out = interval_join(tops, old.select("doc_id", "ctx", "o_pre", F.col("o_pre").alias("_at"))).select("doc_id", "ctx", "o_pre", *NODE)
        if axis.endswith("self"):
            out = out.unionByName(ctx.select("doc_id", "ctx", F.col("pre").alias("o_pre"), *NODE))
    elif axis in ("following-sibling", "preceding-sibling") and preds and preds[0] == ("num", 1.0):
        out, preds = _beside(old, n, axis, test, b), preds[1:]
    elif axis in ("following-sibling", "preceding-sibling"):
        side = F.col("sib_ord") > F.col("o_sib_ord") if axis[0] == "f" else F.col("sib_ord") < F.col("o_sib_ord")
        out = old.where("o_kind <> 'ATT'").join(n.withColumnRenamed("parent", "o_parent"), ["doc_id", "o_parent"]).withColumn("parent", F.col("o_parent")).where(side & no_att)
    elif axis in ("following", "preceding"):
        side = F.col("pre") >= F.col("o_pre") + F.col("o_size") if axis[0] == "f" else F.col("pre") + F.col("size") <= F.col("o_pre")
        # a context goes to the ranges that hold its answer, from its own on
        last = n.where("kind = 'DOC'").select("doc_id", F.floor((F.col("pre") + F.col("size")) / RANGE).alias("_last"))
        own = F.floor((F.col("o_pre") + F.col("o_size")) / RANGE) if axis[0] == "f" else F.floor(F.col("o_pre") / RANGE)
        to = F.sequence(own, F.greatest(own, F.col("_last"))) if axis[0] == "f" else F.sequence(F.lit(0).cast("long"), own)
        spread = old.join(last, "doc_id").withColumn("_range", F.explode(to)).drop("_last")
        out = spread.join(n.where(no_att).withColumn("_range", F.floor(F.col("pre") / RANGE)), ["doc_id", "_range"]).where(side)
    else:
        raise NotLowered(f"no plan for axis {axis}")
    out = out.where(_test(test, axis, b)).select("doc_id", "ctx", "o_pre", *NODE)
    for p in preds:
        b.alone = b.whole and not b.depth and not repeats
        out = _filter(out, p, axis, b)
    out = out.select("doc_id", "ctx", *NODE)
    return out.dropDuplicates(["doc_id", "ctx", "pre"]) if repeats or axis == "self" else out


def _beside(old: DataFrame, n: DataFrame, axis: str, test, b: _Bound) -> DataFrame:
    """The nearest sibling that passes the test: the last (or next) one seen in the order of the siblings, without pairs."""
    own = W.partitionBy("doc_id", "parent").orderBy("sib_ord")
    near = F.when((F.col("kind") != "ATT") & _test(test, axis, b), F.struct(*NODE))
    frame = own.rowsBetween(1, W.unboundedFollowing) if axis[0] == "f" else own.rowsBetween(W.unboundedPreceding, -1)
    pick = (F.first if axis[0] == "f" else F.last)(near, ignorenulls=True).over(frame)
    siblings = n.where("kind <> 'ATT'").withColumn("_near", pick).where("_near is not null").select("doc_id", F.col("pre").alias("o_pre"), "_near.*")
    return old.where("o_kind <> 'ATT'").select("doc_id", "ctx", "o_pre").join(siblings, ["doc_id", "o_pre"])


def _test(test, axis: str, b: _Bound) -> Column:
    if test[0] == "pi":
        return (F.col("kind") == "PI") & (F.col("qname") == test[1])
    if test[0] == "kind":
        return F.lit(True) if test[1] == "node" else F.col("kind") == {"text": "TXT", "comment": "COM", "processing-instruction": "PI"}[test[1]]
    prefix, local = test[1], test[2]
    out = F.col("kind") == ("ATT" if axis == "attribute" else "ELT")
    if prefix or local != "*":
        if prefix and prefix != "xml" and prefix not in b.prefixes:
            raise NotLowered(f"unbound prefix {prefix}")
        uri = XML if prefix == "xml" else b.prefixes[prefix] if prefix else ""
        out = out & (F.col("ns_uri") == uri)
    return out if local == "*" else out & (F.col("local_name") == local)


def _filter(rows: DataFrame, pred, axis: str, b: _Bound) -> DataFrame:
    if pred[0] == "num" or _positional(pred):
        own = W.partitionBy("doc_id", "ctx", "o_pre")
        order = F.col("pre").desc() if axis in _REVERSE else F.col("pre")
        rows = rows.withColumn("_pos", F.row_number().over(own.orderBy(order)).cast("double")).withColumn("_last", F.count("*").over(own).cast("double"))
        test = F.col("_pos") == pred[1] if pred[0] == "num" else None
        if test is None:
            rows, test = _value(rows, pred, b)
            test = F.col("_pos") == test if pred[0] != "op" or pred[1] in ("+", "-", "*", "div", "mod") else test
        return rows.where(test).select("doc_id", "ctx", "o_pre", *NODE)
    rows, test = _boolean(rows, pred, b)
    return rows.where(test).select("doc_id", "ctx", "o_pre", *NODE)


def _positional(tree) -> bool:
    if tree[0] == "call":
        return tree[1] in ("position", "last") or any(_positional(a) for a in tree[2])
    return tree[0] == "op" and any(_positional(t) for t in tree[2:])


_count = iter(range(1 << 60))


def _hits(rows: DataFrame, path, b: _Bound) -> DataFrame:
    """What a relative path reaches from each candidate; ``ctx`` is the candidate."""
    if path[0] == "path" and path[1] is not None:
        raise NotLowered("absolute path in a predicate")
    if path[0] == "path" and path[2] and all(axis in ("child", "attribute") and not preds for axis, _, preds in path[2]):
        return _upwards(path[2], b)
    if path[0] == "path" and path[2] == _SELF:
        # no first() over the columns, so conditions on the kind pass through
        own = rows.select("doc_id", F.col("pre").alias("ctx"), "pre", "size", "kind", "value")
        return own if b.alone else own.distinct()
    start = rows.select("doc_id", F.col("pre").alias("ctx"), *NODE)
    if not b.alone:
        start = start.dropDuplicates(["doc_id", "ctx"])
    alone, b.depth = b.alone, b.depth + 1
    found = _node_set(path, start, b)
    b.alone, b.depth = alone, b.depth - 1
    return found


def _upwards(steps, b: _Bound) -> DataFrame:
    """(doc_id, ctx, pre, size, kind, value) of child and attribute steps, from their last nodes up: the candidates need not be known."""
    own = lambda axis, test: b.nodes.where(_test(test, axis, b) & ((F.col("kind") == "ATT") if axis == "attribute" else (F.col("kind") != "ATT")))
    last = ["pre", "size", "kind", "value"]
    out = own(*steps[-1][:2]).select("doc_id", F.col("parent").alias("ctx"), *last)
    for axis, test, _ in reversed(steps[:-1]):
        above = own(axis, test).select("doc_id", F.col("pre").alias("ctx"), F.col("parent").alias("_up"))
        out = out.join(above, ["doc_id", "ctx"]).select("doc_id", F.col("_up").alias("ctx"), *last)
    return out


def _flag(rows: DataFrame, hits: DataFrame) -> tuple[DataFrame, Column]:
    name = f"_f{next(_count)}"
    have = hits.select("doc_id", F.col("ctx").alias("pre"), F.lit(True).alias(name)).dropDuplicates(["doc_id", "pre"])
    return rows.join(have, ["doc_id", "pre"], "left"), F.coalesce(F.col(name), F.lit(False))


def _boolean(rows: DataFrame, tree, b: _Bound) -> tuple[DataFrame, Column]:
    if tree[0] in ("path", "union"):
        return _flag(rows, _hits(rows, tree, b))
    if tree[0] == "call" and tree[1] in ("true", "false"):
        return rows, F.lit(tree[1] == "true")
    if tree[0] == "call" and tree[1] == "not":
        rows, test = _boolean(rows, tree[2][0], b)
        return rows, ~test
    if tree[0] == "op" and tree[1] in ("and", "or"):
        rows, left = _boolean(rows, tree[2], b)
        rows, right = _boolean(rows, tree[3], b)
        return rows, (left & right) if tree[1] == "and" else (left | right)
    if tree[0] == "op" and tree[1] in ("=", "!=", "<", "<=", ">", ">="):
        left, right = tree[2], tree[3]
        flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        symbol = tree[1]
        if right[0] == "path":
            left, right, symbol = right, left, flip.get(symbol, symbol)
        if left[0] == "path":
            if right[0] == "path" and b.texts and symbol in ("=", "!="):
                return _flag(rows, _equal_paths(rows, left, right, symbol, b))
            if right[0] not in ("str", "num", "var"):
                raise NotLowered("comparison of two paths")
            if b.texts and not _is_leaf(left):
                value = b.params.get(right[1], "") if right[0] == "var" else right[1]
                return _flag(rows, _texts_like(_hits(rows, left, b), symbol, value, b))
            hits = _hits(rows, left, b)
            if left[2] and left[2][-1][0] != "attribute" and left[2][-1][1] != ("kind", "text"):
                raise NotLowered("string value of an element in a predicate")
            value = b.params.get(right[1], "") if right[0] == "var" else right[1]
            text = F.coalesce("value", F.lit(""))
            own = text if isinstance(value, str) and symbol in ("=", "!=") else text.try_cast("double")
            return _flag(rows, hits.where(_symbol(symbol, own, F.lit(value if symbol in ("=", "!=") else float(value)))))
        rows, x = _value(rows, left, b)
        rows, y = _value(rows, right, b)
        return rows, _symbol(symbol, x, y)
    if tree[0] == "call" and tree[1] in ("contains", "starts-with"):
        a, c = tree[2]
        if a[0] == "path" and c[0] in ("str", "var") and b.texts and not _is_leaf(a):
            part = b.params.get(c[1], "") if c[0] == "var" else c[1]
            # the first node of the path counts, and none is an empty text
            long_enough = F.col("t_to") - F.col("t_from") >= len(part)
            texts = _texts(_first_hits(rows, a, b), b, long_enough)
            found = texts.where(F.col("text").contains(part) if tree[1] == "contains" else F.col("text").startswith(part))
            return (rows, F.lit(True)) if not part else _flag(rows, found)
        if a[0] == "path" and c[0] == "str":
            hits = _hits(rows, a, b)
            if a[2][-1][0] != "attribute":
                raise NotLowered("string value of an element in a predicate")
            hits = hits.where(F.col("value").contains(c[1]) if tree[1] == "contains" else F.col("value").startswith(c[1]))
            return _flag(rows, hits)
    raise NotLowered(f"no plan for {tree[0]} in a predicate")


def _symbol(symbol: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[symbol]


def _value(rows: DataFrame, tree, b: _Bound) -> tuple[DataFrame, Column]:
    if tree[0] in ("num", "str"):
        return rows, F.lit(tree[1])
    if tree[0] == "var":
        return rows, F.lit(b.params.get(tree[1], ""))
    if tree[0] == "call":
        if tree[1] == "position":
            return rows, F.col("_pos")
        if tree[1] == "last":
            return rows, F.col("_last")
        if tree[1] in ("name", "local-name", "namespace-uri") and not tree[2]:
            return rows, F.col({"name": "qname", "local-name": "local_name", "namespace-uri": "ns_uri"}[tree[1]])
    if b.texts and tree[0] == "call" and tree[1] in ("string", "concat", "string-length", "normalize-space"):
        return _text_call(rows, tree, b)
    if b.texts and tree[0] == "path":
        return _joined_text(rows, tree, b)
    if tree[0] == "op" and tree[1] in ("+", "-", "*", "div", "mod"):
        rows, x = _value(rows, tree[2], b)
        rows, y = _value(rows, tree[3], b)
        return rows, {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: x % y}[tree[1]]()
    if tree[0] == "op":
        return _boolean(rows, tree, b)
    raise NotLowered(f"no plan for the value of {tree[0]}")


def _first_hits(rows: DataFrame, path, b: _Bound) -> DataFrame:
    """Of what a path reaches from each row, the first node in document order."""
    hits = _hits(rows, path, b)
    if path[0] == "path" and path[2] == _SELF:
        return hits
    return hits.groupBy("doc_id", "ctx").agg(F.min_by(F.struct("pre", "size", "kind", "value"), "pre").alias("x")).select("doc_id", "ctx", "x.*")


def _texts(hits: DataFrame, b: _Bound, could: Column | None = None) -> DataFrame:
    """(doc_id, ctx, pre, text): string values of nodes; ``could`` is a condition on text offsets that spares the others their texts."""
    leaf = F.col("kind").isin("ATT", "TXT", "COM", "PI")
    own = hits.select("doc_id", "ctx", "pre", "size", "kind", "value")
    leaves = own.where(leaf).select("doc_id", "ctx", "pre", F.coalesce("value", F.lit("")).alias("text"))
    offsets = b.full.where("kind in ('ELT', 'DOC')").select("doc_id", "pre", "t_from", "t_to")
    inner = own.where(~leaf).select("doc_id", "ctx", "pre").join(offsets if could is None else offsets.where(could), ["doc_id", "pre"])
    return leaves.unionByName(_cut(b.full, inner).select("doc_id", "ctx", "pre", "text"))


def _cut(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """``of`` (doc_id, pre, t_from, t_to and more) with ``text``: cut from the document's texts, which are put together in pieces of ``PIECE`` characters."""
    at = lambda c: F.floor(c / PIECE)
    texts = nodes.where("kind = 'TXT'").select("doc_id", at(F.col("t_from")).alias("_piece"), F.col("t_from").alias("_start"), F.struct(F.col("pre").alias("p"), F.col("value").alias("t")).alias("x"))
    pieces = texts.groupBy("doc_id", "_piece").agg(F.min("_start").alias("_start"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("_text"))
    first, last = at(F.col("t_from")), at(F.greatest(F.col("t_from"), F.col("t_to") - 1))
    lo = F.greatest(F.col("t_from") - F.col("_start"), F.lit(0))
    part = F.coalesce(F.substring("_text", (lo + 1).cast("int"), (F.col("t_to") - F.col("_start") - lo).cast("int")), F.lit(""))
    keys = [c for c in of.columns if c != "doc_id"]
    short = of.where(F.coalesce(first == last, F.lit(True))).withColumn("_piece", first).join(pieces, ["doc_id", "_piece"], "left").select("doc_id", *keys, part.alias("text"))
    # longer texts lie in several pieces
    long = of.where(first < last).withColumn("_piece", F.explode(F.sequence(first, last))).join(pieces, ["doc_id", "_piece"]).select("doc_id", *keys, F.struct(F.col("_piece").alias("p"), part.alias("t")).alias("x"))
    long = long.groupBy("doc_id", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("text"))
    return short.unionByName(long)


def _texts_like(hits: DataFrame, symbol: str, value, b: _Bound) -> DataFrame:
    """Contexts with a node whose string value compares to a literal; for equality only nodes of its length get their texts."""
    if symbol in ("=", "!=") and isinstance(value, str):
        could = F.col("t_to") - F.col("t_from") == len(value) if symbol == "=" else None
        return _texts(hits, b, could).where(_symbol(symbol, F.col("text"), F.lit(value)))
    number = F.trim("text").try_cast("double")
    return _texts(hits, b).where(_symbol(symbol, number, F.lit(float(value))))


def _equal_paths(rows: DataFrame, left, right, symbol: str, b: _Bound) -> DataFrame:
    """Contexts from which two paths reach equal (or different) string values."""
    x, y = (_texts(_hits(rows, p, b), b).select("doc_id", "ctx", "text") for p in (left, right))
    if symbol == "=":
        # one node's own text is one row already
        return (x if left[2] == _SELF else x.distinct()).join(y if right[2] == _SELF else y.distinct(), ["doc_id", "ctx", "text"])
    both = lambda t, n: t.groupBy("doc_id", "ctx").agg(F.min("text").alias(f"{n}_min"), F.max("text").alias(f"{n}_max"))
    return both(x, "x").join(both(y, "y"), ["doc_id", "ctx"]).where("not (x_min = x_max and y_min = y_max and x_min = y_min)")


def _joined_text(rows: DataFrame, path, b: _Bound) -> tuple[DataFrame, Column]:
    """The string value of the first node that a path reaches from each row, empty where there is none."""
    name = f"_t{next(_count)}"
    texts = _texts(_first_hits(rows, path, b), b).select("doc_id", F.col("ctx").alias("pre"), F.col("text").alias(name))
    return rows.join(texts, ["doc_id", "pre"], "left"), F.coalesce(F.col(name), F.lit(""))


def _text_length(rows: DataFrame, path, b: _Bound) -> tuple[DataFrame, Column]:
    """The length of that string value: the difference of the node's text offsets."""
    name = f"_n{next(_count)}"
    hits = _first_hits(rows, path, b).select("doc_id", "ctx", "pre", "kind", "value")
    inner = F.col("kind").isin("ELT", "DOC")
    offsets = b.full.where("kind in ('ELT', 'DOC')").select("doc_id", "pre", (F.col("t_to") - F.col("t_from")).alias(name))
    lengths = hits.where(inner).select("doc_id", "ctx", "pre").join(offsets, ["doc_id", "pre"]).select("doc_id", F.col("ctx").alias("pre"), name)
    lengths = lengths.unionByName(hits.where(~inner).select("doc_id", F.col("ctx").alias("pre"), F.length("value").cast("long").alias(name)))
    return rows.join(lengths, ["doc_id", "pre"], "left"), F.coalesce(F.col(name), F.lit(0)).cast("double")


def _text_call(rows: DataFrame, tree, b: _Bound) -> tuple[DataFrame, Column]:
    args = tree[2] or [("path", None, _SELF)]
    if tree[1] == "string-length" and args[0][0] == "path":
        return _text_length(rows, args[0], b)
    values = []
    for arg in args:
        rows, value = _value(rows, arg, b)
        if arg[0] == "num":
            raise NotLowered("the text of a number")
        values.append(value)
    if tree[1] == "string-length":
        return rows, F.length(values[0]).cast("double")
    if tree[1] == "normalize-space":
        return rows, F.trim(F.regexp_replace(values[0], "[ \\t\\r\\n]+", " "))
    return rows, values[0] if tree[1] == "string" else F.concat(*values)


def string_values(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, pre, text): descendant text of the element rows ``of(doc_id, pre, size)``, in document order; from text offsets where ``nodes`` has them."""
    if {"t_from", "t_to"} <= set(nodes.columns):
        offsets = nodes.where("kind in ('ELT', 'DOC')").select("doc_id", "pre", "t_from", "t_to")
        return _cut(nodes, of.select("doc_id", "pre").join(offsets, ["doc_id", "pre"], "left")).select("doc_id", "pre", "text")
    texts = nodes.where("kind = 'TXT'").select("doc_id", F.col("pre").alias("_at"), F.col("pre").alias("t_pre"), F.col("value").alias("t"))
    joined = interval_join(subtree(of.select("doc_id", "pre", "size")).drop("size"), texts)
    got = joined.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_pre", "t"))), lambda x: x["t"]), "").alias("text"))
    return of.select("doc_id", "pre").join(got, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("text", F.lit("")).alias("text"))


def declarations(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri) of the namespace declarations that node rows carry."""
    return nodes.where("decls is not null").select("doc_id", "pre", F.explode("decls").alias("prefix", "uri"))


def in_scope(nodes: DataFrame, scope: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(doc_id, pre, prefix, uri): namespaces in scope of each element, or of ``points`` (doc_id, pre), from declarations (doc_id, pre, prefix, uri, and size if it is at hand)."""
    sized = scope if "size" in scope.columns else scope.join(nodes.select("doc_id", "pre", "size"), ["doc_id", "pre"])
    marks = sized.select("doc_id", "pre", "size", F.col("prefix").alias("key"), F.col("uri").alias("value"))
    own = (nodes.where("kind = 'ELT'") if points is None else points).select("doc_id", "pre", F.col("pre").alias("_at"))
    found = innermost(subtree(marks, inside=False).drop("pre", "size"), own)
    return found.where("value <> ''").select("doc_id", "pre", F.col("key").alias("prefix"), F.col("value").alias("uri"))
