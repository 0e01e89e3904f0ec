"""Many selectors in one scan: a summary of the label paths answers them.

A document set has few different label paths (the names from the root to a
node) however many nodes. A selector of child, descendant and attribute steps
is a regular expression over them; it is evaluated once for each path, and one
equi-join on the path gives every node the rules that may select it. What a
selector asks of the last node itself, its attributes and its place among
siblings of its name, is data too and is tested on the node's own row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.xpath_syntax import XPathError, fuse, parse
from ..sources.shred import OF, STEP, UNNAMED, attribute_key
from ..sources.stored import store
from ..sources.tree import COM, PI, TXT, XML
from .xpath_plan import NODE, NotLowered

#: Matched label paths that are sent to all tasks; more of them meet the nodes by a shuffle.
PATHS = 1000
_ELEMENT = f"{STEP}[^@#{STEP}][^{STEP}]*"
_ATTRIBUTE = f"{STEP}@[^{STEP}]*"
_KINDS = {"text": UNNAMED[TXT], "comment": UNNAMED[COM], "processing-instruction": UNNAMED[PI]}
#: What is asked of a node: ``=`` or ``!=`` a value, ``has`` or ``not`` an attribute, ``nth`` of its name; a value may be a parameter's.
TESTS = "array<struct<op:string,name:string,value:string,param:string>>"
_ARROW_TESTS = pa.list_(pa.struct([(n, pa.string()) for n in ("op", "name", "value", "param")]))


@dataclass(frozen=True)
class Pattern:
    """One alternative of a selector: an expression over label paths, the last name (None for any) and tests of the node."""

    regex: str
    last: str | None
    tests: tuple[tuple[str, str | None, str | None, str | None], ...]

    def rows(self) -> list[dict]:
        return [dict(zip(("op", "name", "value", "param"), t, strict=True)) for t in self.tests]


def _uri(prefix: str, prefixes: Mapping[str, str]) -> str:
    if not prefix:
        return ""
    if prefix == "xml":
        return XML
    if prefix not in prefixes:
        raise XPathError(f"unbound prefix {prefix}")
    return prefixes[prefix]


def _label(axis: str, test, prefixes: Mapping[str, str]) -> tuple[str, str | None]:
    """Expression and name of one step."""
    if test[0] == "name" and test[2] == "*":
        if test[1]:
            raise NotLowered("any name of one namespace")
        return (_ATTRIBUTE if axis == "attribute" else _ELEMENT), None
    if test[0] == "name":
        name = f"{'@' if axis == 'attribute' else ''}{test[2]}{OF}{_uri(test[1], prefixes)}"
    elif test[0] == "kind" and test[1] in _KINDS and axis != "attribute":
        name = _KINDS[test[1]]
    else:
        raise NotLowered(f"no label for {test}")
    return STEP + re.escape(name), name


def _tests(pred, prefixes: Mapping[str, str], nth: bool) -> list[list[tuple]]:
    """A predicate as alternatives of tests that all have to hold."""
    if pred[0] == "num":
        if not nth or pred[1] != int(pred[1]):
            raise NotLowered("a position that the row does not hold")
        return [[("nth", None, str(int(pred[1])), None)]]
    if pred[0] == "op" and pred[1] in ("and", "or"):
        left, right = (_tests(p, prefixes, False) for p in pred[2:])
        return left + right if pred[1] == "or" else [x + y for x in left for y in right]
    if pred[0] == "call" and pred[1] == "not" and pred[2][0][0] == "path":
        return [[("not", _own(pred[2][0], prefixes), None, None)]]
    if pred[0] == "path":
        return [[("has", _own(pred, prefixes), None, None)]]
    if pred[0] == "op" and pred[1] in ("=", "!="):
        left, right = (pred[2], pred[3]) if pred[2][0] == "path" else (pred[3], pred[2])
        if left[0] == "path" and right[0] in ("str", "var"):
            return [[(pred[1], _own(left, prefixes), right[1] if right[0] == "str" else None, right[1] if right[0] == "var" else None)]]
    raise NotLowered(f"no test for {pred[0]} on the node's own row")


def _own(path, prefixes: Mapping[str, str]) -> str:
    if path[1] is not None or len(path[2]) != 1 or path[2][0][0] != "attribute" or path[2][0][1][0] != "name" or path[2][0][1][2] == "*" or path[2][0][2]:
        raise NotLowered("more than an attribute of the node")
    _, prefix, local = path[2][0][1]
    return attribute_key(local, _uri(prefix, prefixes))


def patterns(selector: str, prefixes: Mapping[str, str]) -> list[Pattern]:
    """A selector's alternatives; raises :class:`NotLowered` for what needs more than label paths and the node's own row."""
    tree = fuse(parse(selector))
    out = []
    for part in tree[1] if tree[0] == "union" else [tree]:
        if part[0] != "path" or part[1] not in (None, "/") or not part[2]:
            raise NotLowered("no path of steps")
        regex, last, alternatives = "" if part[1] == "/" else _ELEMENT, None, [[]]
        for k, (axis, test, preds) in enumerate(part[2]):
            final = k == len(part[2]) - 1
            if axis == "descendant-or-self" and test == ("kind", "node") and not preds and not final:
                regex += f"(?:{_ELEMENT})*"
                continue
            if axis not in ("child", "descendant", "attribute"):
                raise NotLowered(f"no label path for axis {axis}")
            step, last = _label(axis, test, prefixes)
            regex += (f"(?:{_ELEMENT})*" if axis == "descendant" else "") + step
            if preds and (not final or axis == "attribute" or test[0] != "name"):
                raise NotLowered("a predicate on another node than the last element")
            for i, p in enumerate(preds):
                # a position counts siblings of one name, before any other test
                found = _tests(p, prefixes, i == 0 and axis == "child" and test[2] != "*")
                alternatives = [a + b for a in alternatives for b in found]
        out += [Pattern(f"^(?:{regex})$", last, tuple(a)) for a in alternatives]
    return out


def holds(tests: str, params: str | None = None) -> str:
    """SQL of whether a row's ``attrs`` and ``nth`` pass ``tests``; an unknown parameter is empty."""
    value = f"coalesce(t.value, {params}[t.param], '')" if params else "coalesce(t.value, '')"
    return (
        f"forall({tests}, t -> coalesce(case t.op when '=' then attrs[t.name] = {value} when '!=' then attrs[t.name] <> {value} "
        f"when 'has' then attrs[t.name] is not null when 'not' then attrs[t.name] is null when 'nth' then nth = cast(t.value as int) end, false))"
    )


def summary(nodes: DataFrame) -> DataFrame:
    """(labels, n): the different label paths and how many nodes have each."""
    return nodes.groupBy("labels").agg(F.count("*").alias("n"))


_ALTERNATIVES = pa.list_(pa.struct([("rule_seq", pa.int64()), ("tests", _ARROW_TESTS)]))


def _matcher(known: list[tuple[int, Pattern]]):
    def run(batches):
        tried = [(i, re.compile(p.regex), p.rows()) for i, p in known]
        for batch in batches:
            found = [(path, hits) for path in batch.column(0).to_pylist() if (hits := [{"rule_seq": i, "tests": tests} for i, r, tests in tried if r.match(path)])]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], _ALTERNATIVES)], ["labels", "alternatives"])

    return run


def match_by_path(nodes: DataFrame, selectors: Mapping[int, list[Pattern]], extra: list[str] | None = None) -> DataFrame:
    """(doc_id, rule_seq, match_pos, match_size, node columns) of all selectors, by rule number, over node rows with ``labels``, ``attrs`` and ``nth``.

    ``nodes`` should be stored: its labels are read for the summary, its rows once for all selectors.
    """
    known = [(i, p) for i, ps in selectors.items() for p in ps]
    # stored first: while their number is unknown, all nodes would be shuffled by label, of which there are few
    paths = store(summary(nodes).select("labels").mapInArrow(_matcher(known), f"labels string, alternatives array<struct<rule_seq:bigint,tests:{TESTS}>>"))
    few = [r.labels for r in paths.select("labels").limit(PATHS + 1).collect()]
    rows = nodes.select("doc_id", *NODE, "labels", "attrs", "nth", *(extra or []))
    if len(few) <= PATHS:
        rows, paths = rows.where(F.col("labels").isin(few)) if few else rows.limit(0), F.broadcast(paths)
    rows = rows.join(paths, "labels")
    own = F.expr(f"array_distinct(transform(filter(alternatives, a -> {holds('a.tests')}), a -> a.rule_seq))")
    hits = rows.select("doc_id", *NODE, *(extra or []), F.explode(own).alias("rule_seq"))
    return numbered(hits)


def numbered(hits: DataFrame) -> DataFrame:
    """``hits`` with each one's place in document order among those of its document and rule, and their number."""
    own = W.partitionBy("doc_id", "rule_seq")
    return hits.withColumn("match_pos", F.row_number().over(own.orderBy("pre")).cast("long")).withColumn("match_size", F.count("*").over(own))
