"""Rules over node rows: selectors of label paths share one scan, others and pointers are one plan each over all documents.

The counterpart of :mod:`match` for rules that are the same for all documents:
what depends on a rule only is a literal, what depends on nodes is a join.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.xpath_syntax import XPathError
from ..sources.tree import parse_xml
from .path_summary import match_by_path, patterns
from .rules import Rule, xml_containers
from .xpath_any import evaluate_nodes
from .xpath_plan import NODE, NotLowered

MATCH = ["doc_id", "rule_seq", "rule_type", "match_pos", "match_size", *NODE]


def rules_of(text: str, files: Mapping[str, str] | None = None, uri: str = "") -> list[Rule]:
    """Rules of an XML rules text in application order, included files first."""
    return [r for box in xml_containers(parse_xml(text), uri, files) for r in box.rules]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def match_nodes(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_seq, rule_type, match_pos, match_size, node columns) of all rules; nodes that are no element or attribute keep their position and are left out."""
    parts, by_path = [], {}
    for i, r in enumerate(rules):
        if r.selector is not None and {"labels", "attrs", "nth"} <= set(nodes.columns):
            try:
                by_path[i] = patterns(r.selector, r.prefixes)
            except (NotLowered, XPathError):
                pass
        if r.selector is not None and (i not in by_path or any(t[3] for p in by_path[i] for t in p.tests)):
            by_path.pop(i, None)
            hits = evaluate_nodes(nodes, r.selector, r.prefixes, r.params)
            parts.append(hits.select("doc_id", F.lit(i).cast("long").alias("rule_seq"), F.lit(r.kind).alias("rule_type"), F.col("position").cast("long").alias("match_pos"), F.col("hits").alias("match_size"), *NODE))
    if by_path:
        kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), (F.col("rule_seq") + 1).cast("int"))
        parts.append(match_by_path(nodes, by_path).select("doc_id", "rule_seq", kinds.alias("rule_type"), "match_pos", "match_size", *NODE))
    if not parts:
        raise ValueError("no rule has a selector")
    return _union(parts).where("kind in ('ELT', 'ATT')")


def pointer_hits(nodes: DataFrame, matches: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_seq, pre, pointer, first_hit, hits, value): what each match's pointers reach; ``hits`` may be 0."""
    parts = []
    for i, r in enumerate(rules):
        own = matches.where(F.col("rule_seq") == i)
        context = own.select("doc_id", F.col("pre").alias("ctx"), *NODE)
        for name, expr in r.pointers.items():
            found = evaluate_nodes(nodes, expr, r.prefixes, r.params, context).where("position = 1")
            found = found.select("doc_id", F.col("ctx").alias("own"), F.col("pre").alias("first_hit"), "hits", F.col("value").alias("value"))
            joined = own.select("doc_id", "rule_seq", "pre").join(found.withColumnRenamed("own", "pre"), ["doc_id", "pre"], "left")
            parts.append(joined.select("doc_id", "rule_seq", "pre", F.lit(name).alias("pointer"), "first_hit", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "value"))
    if not parts:
        raise ValueError("no rule has a pointer")
    return _union(parts)


def pointer_warnings(hits: DataFrame) -> DataFrame:
    """(doc_id, rule_seq, pre, pointer, message) of pointers that reach no node or several."""
    return hits.where("hits <> 1").select("doc_id", "rule_seq", "pre", "pointer", F.concat(F.lit("pointer has "), F.col("hits"), F.lit(" hits")).alias("message"))


def _literal(rules: list[Rule], name: str) -> Column:
    out = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        value = r.values.get(name, r.child_values.get(name))
        if value is not None:
            out = F.when(F.col("rule_seq") == i, F.lit(value)).otherwise(out)
    return out


def last_wins(matches: DataFrame, rules: list[Rule], name: str) -> DataFrame:
    """(doc_id, pre, value) of one data category value: of the rules that set it, the last one that matches a node."""
    set_by = matches.withColumn("value", _literal(rules, name)).where("value is not null")
    return set_by.groupBy("doc_id", "pre").agg(F.max_by("value", "rule_seq").alias("value"))


def over_local(merged: DataFrame, local: DataFrame) -> DataFrame:
    """(doc_id, pre, value): local markup (doc_id, pre, value) laid over merged rule values; every node of ``local`` is in the result."""
    return local.withColumnRenamed("value", "_own").join(merged, ["doc_id", "pre"], "left").select("doc_id", "pre", F.coalesce("_own", "value").alias("value"))


def minted_ids(matches: DataFrame, prefix: str = "ITS_") -> DataFrame:
    """(doc_id, pre, new_id): identifiers for all matched nodes, by name and then document order."""
    own = W.partitionBy("doc_id").orderBy("local_name", "pre")
    return matches.select("doc_id", "pre", "local_name").distinct().select("doc_id", "pre", F.concat(F.lit(prefix), F.row_number().over(own)).alias("new_id"))


def id_selector(ids: DataFrame) -> DataFrame:
    """(doc_id, selector): one selector for all identifiers (doc_id, n, new_id) of a document, in the order of ``n``."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "new_id"))), lambda x: F.concat(F.lit("id('"), x["new_id"], F.lit("')")))
    return ids.groupBy("doc_id").agg(F.array_join(parts, "|").alias("selector"))


def sibling_paths(nodes: DataFrame, of: DataFrame, above: str) -> DataFrame:
    """(doc_id, pre, path) of element rows that are children of the element at path ``above``: a number where siblings share the name."""
    own = W.partitionBy("doc_id", "parent", "qname")
    t = nodes.where("kind = 'ELT'").join(of.select("doc_id", "parent").distinct(), ["doc_id", "parent"], "left_semi")
    t = t.withColumn("p", F.row_number().over(own.orderBy("sib_ord"))).withColumn("n", F.count("*").over(own))
    step = F.concat(F.lit(f"{above}/"), "qname", F.when(F.col("n") > 1, F.concat(F.lit("["), F.col("p"), F.lit("]"))).otherwise(F.lit("")))
    return of.select("doc_id", "pre").join(t.select("doc_id", "pre", step.alias("path")), ["doc_id", "pre"])
