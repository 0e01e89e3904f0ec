"""Rules as data: the rules that documents carry themselves, in tables, matched by joins.

Containers, rules and parameters are rows of the node table like any other;
selectors are compiled once for each different text and its prefixes, and meet
the label paths of their documents by document and last name. Parameters stay
columns, so documents that differ in their values only share a selector.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.xpath_syntax import XPathError

from ..sources.shred import OF, STEP
from ..sources.stored import store
from ..sources.tree import ITS
from .path_summary import _ARROW_TESTS, TESTS, holds, numbered, patterns
from .xpath_plan import NODE, NotLowered, in_scope, string_values

_POINTER = "((k like '%Pointer' and k <> 'Pointer') or (kind = 'idValue' and k = 'idValue'))"


def containers(nodes: DataFrame) -> DataFrame:
    """(doc_id, box, box_pre, box_size, params): rule containers in document order, with the parameters that stand first in each."""
    boxes = nodes.where((F.col("kind") == "ELT") & (F.col("ns_uri") == ITS) & (F.col("local_name") == "rules")).select("doc_id", F.col("pre").alias("box_pre"), F.col("size").alias("box_size"))
    inner = nodes.where("kind = 'ELT'").withColumnRenamed("parent", "box_pre").join(boxes.select("doc_id", "box_pre"), ["doc_id", "box_pre"], "left_semi")
    is_param = (F.col("ns_uri") == ITS) & (F.col("local_name") == "param")
    first_other = F.min(F.when(~is_param, F.col("sib_ord"))).over(W.partitionBy("doc_id", "box_pre"))
    params = inner.withColumn("_other", first_other).where(is_param & (F.col("_other").isNull() | (F.col("sib_ord") < F.col("_other"))))
    texts = string_values(nodes, params.select("doc_id", "pre", "size"))
    # a repeated name has the last value
    own = params.join(texts, ["doc_id", "pre"]).groupBy("doc_id", "box_pre", F.coalesce(F.col("attrs")["name"], F.lit("")).alias("name")).agg(F.max_by("text", "sib_ord").alias("value"))
    own = own.groupBy("doc_id", "box_pre").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("params"))
    numbered_boxes = boxes.withColumn("box", F.row_number().over(W.partitionBy("doc_id").orderBy("box_pre")))
    return numbered_boxes.join(own, ["doc_id", "box_pre"], "left").withColumn("params", F.coalesce("params", F.expr("cast(map() as map<string,string>)")))


def rule_table(nodes: DataFrame) -> DataFrame:
    """(doc_id, rule_seq, rule_type, selector, pointers, values, params, prefixes): every document's own rules in order.

    ``prefixes`` is the JSON text of the namespaces in scope, prefixes
    ascending; rules without a selector have a null one. Label paths tell what
    is inside containers, so all but the declarations comes from those rows.
    """
    decls = nodes.where("decls is not null").select("doc_id", "pre", "size", F.explode("decls").alias("prefix", "uri"))
    nodes = store(nodes.where(F.col("labels").contains(f"{STEP}rules{OF}{ITS}")).select("doc_id", "pre", "size", "parent", "sib_ord", "kind", "local_name", "ns_uri", "value", "attrs"))
    boxes = containers(nodes)
    rules = nodes.where((F.col("kind") == "ELT") & (F.col("ns_uri") == ITS) & F.col("local_name").endswith("Rule")).select("doc_id", "pre", "size", F.col("parent").alias("box_pre"), F.expr("substring(local_name, 1, length(local_name) - 4)").alias("rule_type"), "attrs")
    rules = rules.join(boxes.select("doc_id", "box_pre", "params"), ["doc_id", "box_pre"])
    marks = rules.select("doc_id", "pre")
    scope = in_scope(nodes, decls, marks).groupBy("doc_id", "pre").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "uri"))))).alias("prefixes"))
    inner = nodes.where("kind = 'ELT'").select("doc_id", F.col("pre").alias("c_pre"), "size", F.col("parent").alias("pre"), "local_name").join(marks, ["doc_id", "pre"], "left_semi")
    texts = string_values(nodes, inner.select("doc_id", F.col("c_pre").alias("pre"), "size")).withColumnRenamed("pre", "c_pre")
    inner = inner.join(texts, ["doc_id", "c_pre"]).groupBy("doc_id", "pre", "local_name").agg(F.max_by("text", "c_pre").alias("text"))
    inner = inner.groupBy("doc_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("local_name", "text"))).alias("inner"))
    out = rules.join(scope, ["doc_id", "pre"], "left").join(inner, ["doc_id", "pre"], "left").withColumnRenamed("rule_type", "kind")
    out = out.withColumn("pointers", F.expr(f"map_filter(attrs, (k, v) -> {_POINTER})")).withColumn("own", F.expr(f"map_filter(attrs, (k, v) -> k <> 'selector' and not {_POINTER})"))
    none = F.expr("cast(map() as map<string,string>)")
    values = F.map_concat(F.map_filter(F.coalesce("inner", none), lambda k, v: ~F.map_contains_key(F.col("own"), k)), "own")
    seq = (F.row_number().over(W.partitionBy("doc_id").orderBy("pre")) - 1).cast("long")
    return store(out.select("doc_id", seq.alias("rule_seq"), F.col("kind").alias("rule_type"), F.col("attrs")["selector"].alias("selector"), "pointers", values.alias("values"), "params", F.coalesce("prefixes", F.lit("{}")).alias("prefixes")))


_COMPILED = "selector string, prefixes string, regex string, last string, tests " + TESTS + ", error string"


def _compile(batches):
    for batch in batches:
        out = []
        for selector, prefixes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                out += [(selector, prefixes, p.regex, p.last, p.rows(), None) for p in patterns(selector, json.loads(prefixes))]
            except (NotLowered, XPathError) as e:
                out.append((selector, prefixes, None, None, None, f"{'no plan' if isinstance(e, NotLowered) else 'bad selector'}: {e}"))
        kinds = [pa.string()] * 4 + [_ARROW_TESTS, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["selector", "prefixes", "regex", "last", "tests", "error"])


def compiled(rules: DataFrame) -> DataFrame:
    """Each different (selector, prefixes) of ``rules`` with its alternatives, or why there is none."""
    return rules.where("selector is not null").select("selector", "prefixes").distinct().mapInArrow(_compile, _COMPILED)


def match_tables(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_seq, rule_type, match_pos, match_size, node columns): what each document's own rules select.

    Rules whose selector has no plan over label paths are left out; :func:`unplanned` names them.
    """
    known = rules.join(compiled(rules).where("error is null"), ["selector", "prefixes"]).select("doc_id", "rule_seq", "rule_type", "params", "regex", F.coalesce("last", F.lit("*")).alias("tail"), "tests")
    tail = F.element_at(F.split("labels", "\x1f"), -1)
    star = F.when(tail.startswith("#"), tail).otherwise(F.lit("*"))
    paths = nodes.where("labels <> ''").select("doc_id", "labels").distinct()
    paths = paths.select("doc_id", "labels", F.explode(F.array_distinct(F.array(tail, star))).alias("tail"))
    hit = known.join(paths, ["doc_id", "tail"]).where("labels rlike regex").select("doc_id", "labels", "rule_seq", "rule_type", "params", "tests")
    found = nodes.select("doc_id", *NODE, "labels", "attrs", "nth").join(hit, ["doc_id", "labels"]).where(F.expr(holds("tests", "params")))
    # alternatives of one selector may find the same node
    found = found.select("doc_id", "rule_seq", "rule_type", *NODE).dropDuplicates(["doc_id", "rule_seq", "pre"])
    return numbered(found).where("kind in ('ELT', 'ATT')")


def unplanned(rules: DataFrame) -> DataFrame:
    """(doc_id, rule_seq, message) of rules that :func:`match_tables` leaves out."""
    bad = rules.join(compiled(rules).where("error is not null"), ["selector", "prefixes"]).select("doc_id", "rule_seq", F.col("error").alias("message"))
    return bad.unionByName(rules.where("selector is null").select("doc_id", "rule_seq", F.lit("no selector").alias("message")))


def last_wins(matches: DataFrame, rules: DataFrame, name: str) -> DataFrame:
    """(doc_id, pre, value) of one data category value: of the rules that set it, the last that matches the node."""
    sets = rules.select("doc_id", "rule_seq", F.col("values")[name].alias("value")).where("value is not null")
    return matches.select("doc_id", "rule_seq", "pre").join(sets, ["doc_id", "rule_seq"]).groupBy("doc_id", "pre").agg(F.max_by("value", "rule_seq").alias("value"))



def all_values(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, pre, name, value) of all data category values: for each name the last rule that matches the node and sets it."""
    sets = rules.select("doc_id", "rule_seq", F.explode("values").alias("name", "value"))
    return matches.select("doc_id", "rule_seq", "pre").join(sets, ["doc_id", "rule_seq"]).groupBy("doc_id", "pre", "name").agg(F.max_by("value", "rule_seq").alias("value"))
