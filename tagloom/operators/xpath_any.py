"""One entry for XPath over node rows: a plan where there is one, on nodes alone or on string values too, else the tree evaluator, document by document."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.xpath_syntax import XPathError
from ..functions.xpath_tree import Context, evaluate, to_string
from ..sources.tree import ATT, Node
from .xpath_plan import NODE, NotLowered, roots, select

_ROWS = ["doc_id", "level", *NODE]


def rebuilt(rows: dict[str, list]) -> tuple[Node, dict[int, Node]]:
    """The tree of one document's node rows, and its nodes by number."""
    order = sorted(range(len(rows["pre"])), key=lambda i: rows["pre"][i])
    nodes: dict[int, Node] = {}
    top = None
    for i in order:
        kind = rows["kind"][i]
        node = Node(kind, rows["qname"][i] or "", rows["ns_uri"][i] or "", rows["value"][i])
        node.pre = rows["pre"][i]
        nodes[node.pre] = node
        above = nodes.get(rows["parent"][i]) if rows["parent"][i] is not None else None
        if above is None:
            top = top or node
            continue
        node.parent = above
        (above.attrs if kind == ATT else above.children).append(node)
    return top, nodes


def _each(expr: str, params: Mapping[str, str], prefixes: Mapping[str, str]):
    """(document's contexts, its node rows) to hits or one value for each context."""

    def run(ctx: pa.Table, nodes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(ctx) and len(nodes):
            rows = nodes.to_pydict()
            doc, by_pre = rebuilt(rows)
            ids = {}
            for pre, own in zip(rows["pre"], rows["xml_id"], strict=True):
                if own is not None:
                    ids.setdefault(own, by_pre[pre])
            known = Context(doc, dict(params), dict(prefixes))
            known._ids = ids  # the rows' xml_id need not be an attribute
            for key in sorted(set(ctx.column("ctx").to_pylist())):
                try:
                    got = evaluate(expr, by_pre[key], 1, 1, known)
                except XPathError as e:
                    out.append((rows["doc_id"][0], key, None, None, None, None, str(e)))
                    continue
                if isinstance(got, list):
                    out.extend((rows["doc_id"][0], key, i, len(got), n.pre, None, None) for i, n in enumerate(got, 1))
                else:
                    out.append((rows["doc_id"][0], key, None, None, None, to_string(got), None))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(("doc_id", "ctx", "position", "hits", "pre", "text", "error"), kinds, strict=True))})

    return run


_FOUND = "doc_id long, ctx long, position int, hits long, pre long, text string, error string"


def by_tree(nodes: DataFrame, expr: str, prefixes: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, context: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx, position, hits, pre, text, error): the tree evaluator's answer, a node or a value, from each context node.

    One document's rows are one group, so a document has to fit a task.
    """
    ctx = (roots(nodes) if context is None else context).select(F.col("doc_id").cast("long").alias("doc_id"), "ctx")
    rows = nodes.select(F.col("doc_id").cast("long").alias("doc_id"), *_ROWS[1:])
    return ctx.groupBy("doc_id").cogroup(rows.groupBy("doc_id")).applyInArrow(_each(expr, params or {}, prefixes or {}), _FOUND)


def evaluate_nodes(nodes: DataFrame, expr: str, prefixes: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, context: DataFrame | None = None) -> DataFrame:
    """As :func:`xpath_plan.select`, for every expression that gives nodes; contexts where it gives none, or fails, have no rows."""
    try:
        return select(nodes, expr, prefixes, params, context)
    except NotLowered:
        if "t_from" in nodes.columns:
            try:
                return select(nodes, expr, prefixes, params, context, texts=True)
            except NotLowered:
                pass
        found = by_tree(nodes, expr, prefixes, params, context).where("pre is not null").select("doc_id", "ctx", "position", "hits", "pre")
        return found.join(nodes.select("doc_id", *NODE), ["doc_id", "pre"]).select("doc_id", "ctx", "position", "hits", *NODE)


def evaluate_values(nodes: DataFrame, expr: str, prefixes: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, context: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx, text): the string value of any expression from each context node; the first node's where it gives nodes."""
    found = by_tree(nodes, f"string({expr})", prefixes, params, context)
    return found.where("error is null").select("doc_id", "ctx", "text")


def errors(nodes: DataFrame, expr: str, prefixes: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, context: DataFrame | None = None) -> DataFrame:
    """(doc_id, ctx, error) of contexts from which the expression fails."""
    return by_tree(nodes, expr, prefixes, params, context).where("error is not null").select("doc_id", "ctx", "error")
