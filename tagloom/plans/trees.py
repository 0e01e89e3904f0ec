"""Queries over keyed trees: axes, predicates, matches, merged metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rule_plan
from ..operators.xpath_plan import NODE, select, string_values
from ..sources.relational import STRIDE, customer_nodes, customer_trees

#: The same tree in SQL.
TREE = """WITH lines AS (SELECT o_custkey AS doc_id, l_orderkey AS k_order, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k_line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rows_ AS (SELECT c_custkey AS doc_id, 1 AS level, 'customer' AS local_name, -1 AS k_order, 0 AS k_line, NULL AS a_status, NULL AS a_priority, NULL AS a_flag FROM customer
  UNION ALL SELECT o_custkey, 2, 'order', o_orderkey, 0, o_orderstatus, o_orderpriority, NULL FROM orders
  UNION ALL SELECT doc_id, 3, 'lineitem', k_order, k_line, NULL, NULL, l_returnflag FROM lines),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k_order, k_line) AS pre,
  CASE level WHEN 1 THEN count(*) OVER (PARTITION BY doc_id) WHEN 2 THEN count(*) OVER (PARTITION BY doc_id, k_order) ELSE 1 END AS size FROM rows_),
tree AS MATERIALIZED (SELECT *, CASE level WHEN 2 THEN 1 WHEN 3 THEN min(pre) OVER (PARTITION BY doc_id, k_order) END AS parent, pre + size - level AS post FROM numbered)
"""

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        O[f.__name__] = TREE + sql
        return f

    return keep


@query("SELECT doc_id, pre, post, size, CAST(level AS BIGINT) AS level, parent, local_name FROM tree")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_trees(spark, sf_dir).select("doc_id", "pre", "post", "size", F.col("level").cast("long").alias("level"), "parent", "local_name")


@query("SELECT CAST(level AS BIGINT) AS level, local_name, count(*) AS n, CAST(max(size) AS BIGINT) AS largest FROM tree GROUP BY level, local_name")
def tree_levels(spark, sf_dir):
    return customer_trees(spark, sf_dir).groupBy(F.col("level").cast("long").alias("level"), "local_name").agg(F.count("*").alias("n"), F.max("size").alias("largest"))


def node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed trees' node rows: a view of elements numbered and written once for all expressions and queries of the application."""
    return customer_nodes(spark, sf_dir)


def at(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """All elements, or those of a name, as contexts."""
    own = nodes.where("kind = 'ELT'") if name is None else nodes.where((F.col("kind") == "ELT") & (F.col("local_name") == name))
    return own.select("doc_id", F.col("pre").alias("ctx"), *NODE)


def context(found: DataFrame) -> DataFrame:
    """What an expression found, as contexts of the next."""
    return found.select("doc_id", F.col("pre").alias("ctx"), *NODE)


def plain(found: DataFrame) -> DataFrame:
    """Node numbers as those of the keyed tree."""
    return found.withColumns({c: F.floor(F.col(c) / STRIDE) for c in ("ctx", "pre", "parent", "first_hit") if c in found.columns})


def hits(spark, sf_dir, expr: str) -> DataFrame:
    return plain(select(node_table(spark, sf_dir), expr, positions=False)).select("doc_id", "pre")


@query("SELECT a.doc_id, a.pre AS ctx, n.pre FROM tree a JOIN tree n ON n.doc_id = a.doc_id AND n.parent = a.pre WHERE a.local_name = 'order'")
def axis_child(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return plain(select(nodes, "*", context=at(nodes, "order"), positions=False)).select("doc_id", "ctx", "pre")


@query("SELECT a.doc_id, a.k_order, n.pre FROM tree a JOIN tree n ON n.doc_id = a.doc_id AND n.pre > a.pre AND n.pre < a.pre + a.size WHERE a.local_name = 'order' AND a.a_status = 'F'")
def axis_descendant(spark, sf_dir):
    """Below an order, by the interval of its subtree."""
    nodes = node_table(spark, sf_dir)
    orders = context(select(nodes, "//order[@status='F']", positions=False))
    found = plain(select(nodes, "descendant::*", context=orders, positions=False))
    return found.join(plain(orders).select("doc_id", "ctx", F.col("xml_id").cast("long").alias("k_order")), ["doc_id", "ctx"]).select("doc_id", "k_order", "pre")


@query("SELECT n.doc_id, n.pre AS ctx, p.pre FROM tree n JOIN tree p ON p.doc_id = n.doc_id AND p.pre = n.parent WHERE n.local_name = 'lineitem' AND n.a_flag = 'R'")
def axis_parent(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return plain(select(nodes, "..", context=context(select(nodes, "//lineitem[@flag='R']", positions=False)), positions=False)).select("doc_id", "ctx", "pre")


@query("SELECT doc_id, pre, a_status AS value FROM tree WHERE a_status IS NOT NULL")
def axis_attribute(spark, sf_dir):
    found = plain(select(node_table(spark, sf_dir), "//order/@status", positions=False))
    return found.select("doc_id", F.col("parent").alias("pre"), "value")


@query("SELECT doc_id, pre, lead(pre) OVER (PARTITION BY doc_id, parent ORDER BY pre) AS next_pre, lag(pre) OVER (PARTITION BY doc_id, parent ORDER BY pre) AS prev_pre FROM tree WHERE level = 3")
def axis_sibling(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    items = at(nodes, "lineitem")
    beside = lambda axis, name: plain(select(nodes, f"{axis}::*[1]", context=items, positions=False)).select("doc_id", "ctx", F.col("pre").alias(name))
    out = plain(items).select("doc_id", "ctx").join(beside("following-sibling", "next_pre"), ["doc_id", "ctx"], "left").join(beside("preceding-sibling", "prev_pre"), ["doc_id", "ctx"], "left")
    return out.select("doc_id", F.col("ctx").alias("pre"), "next_pre", "prev_pre")


@query("SELECT n.doc_id, n.pre, CAST(count(*) AS BIGINT) AS ancestors FROM tree n JOIN tree a ON a.doc_id = n.doc_id AND a.pre < n.pre AND n.pre < a.pre + a.size GROUP BY n.doc_id, n.pre")
def axis_ancestor(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    found = plain(select(nodes, "ancestor::*", context=at(nodes), positions=False))
    return found.groupBy("doc_id", F.col("ctx").alias("pre")).agg(F.count("*").alias("ancestors"))


@query("SELECT doc_id, pre FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre) AS p FROM tree WHERE level = 3) WHERE p = 2")
def pred_position(spark, sf_dir):
    return hits(spark, sf_dir, "order/lineitem[2]")


@query("SELECT doc_id, pre FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre DESC) AS p FROM tree WHERE level = 3) WHERE p = 1")
def pred_last(spark, sf_dir):
    return hits(spark, sf_dir, "order/lineitem[last()]")


@query("SELECT doc_id, pre FROM tree WHERE local_name = 'order' AND a_priority = '1-URGENT'")
def pred_attr_eq(spark, sf_dir):
    return hits(spark, sf_dir, "//order[@priority='1-URGENT']")


@query("SELECT a.doc_id, a.pre FROM tree a WHERE a.local_name = 'order' AND EXISTS (SELECT 1 FROM tree n WHERE n.doc_id = a.doc_id AND n.parent = a.pre AND n.a_flag = 'R')")
def pred_attr_exists(spark, sf_dir):
    return hits(spark, sf_dir, "//order[lineitem/@flag='R']")


@query("SELECT a.doc_id, a.pre FROM tree a WHERE a.local_name = 'order' AND NOT EXISTS (SELECT 1 FROM tree n WHERE n.doc_id = a.doc_id AND n.parent = a.pre)")
def pred_not_child(spark, sf_dir):
    return hits(spark, sf_dir, "//order[not(lineitem)]")


@query("SELECT doc_id, pre FROM tree WHERE local_name = 'order' AND a_status = 'F' UNION SELECT doc_id, pre FROM tree WHERE local_name = 'order' AND a_priority = '5-LOW'")
def union_distinct(spark, sf_dir):
    return hits(spark, sf_dir, "//order[@status='F'] | //order[@priority='5-LOW']")


@query("SELECT n.doc_id, n.pre, n.k_order, a.pre AS target FROM tree n JOIN tree a ON a.doc_id = n.doc_id AND a.k_order = n.k_order AND a.local_name = 'order' WHERE n.local_name = 'lineitem'")
def id_references(spark, sf_dir):
    """id() of every line item's reference to its order, looked up among all identifiers of its tree."""
    nodes = node_table(spark, sf_dir)
    found = plain(select(nodes, "id(@order)", context=at(nodes, "lineitem"), positions=False))
    return found.select("doc_id", F.col("ctx").alias("pre"), F.col("xml_id").cast("long").alias("k_order"), F.col("pre").alias("target"))


_RULES = [(0, "order", "a_status", "F", "no"), (1, "order", "a_priority", "1-URGENT", "yes"), (2, "lineitem", "a_flag", "R", "no"), (3, "order", "a_status", "O", "yes"), (4, "lineitem", "a_flag", "A", "yes")]
_RULE_SQL = ", ".join(f"({i}, '{n}', '{c}', '{v}', '{t}')" for i, n, c, v, t in _RULES)
_MATCH_SQL = f""", rule(rule_seq, name, att, val, translate) AS (VALUES {_RULE_SQL}),
hit AS (SELECT r.rule_seq, r.translate, t.* FROM rule r JOIN tree t ON t.local_name = r.name AND CASE r.att WHEN 'a_status' THEN t.a_status WHEN 'a_priority' THEN t.a_priority ELSE t.a_flag END = r.val)
"""
_COLUMNS = {"a_status": "status", "a_priority": "priority", "a_flag": "flag"}
#: The same rules as a rules text; its elements are read like any document's.
RULES = rule_plan.rules_of(
    "<its:rules xmlns:its='http://www.w3.org/2005/11/its' version='2.0'>"
    + "".join(f"<its:translateRule selector=\"//{n}[@{_COLUMNS[c]}='{v}']\" translate='{t}'/>" for _, n, c, v, t in _RULES)
    + "</its:rules>"
)
POINTERS = rule_plan.rules_of(
    "<its:rules xmlns:its='http://www.w3.org/2005/11/its' version='2.0'><its:locNoteRule selector='//order' locNotePointer=\"lineitem[@flag='N']\"/></its:rules>"
)


def matches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Node rows, and the matches of all rules."""
    nodes = node_table(spark, sf_dir)
    return nodes, rule_plan.match_nodes(nodes, RULES)


def _pointers(spark, sf_dir) -> DataFrame:
    nodes = node_table(spark, sf_dir)
    return plain(rule_plan.pointer_hits(nodes, rule_plan.match_nodes(nodes, POINTERS), POINTERS))


@query(_MATCH_SQL + "SELECT CAST(rule_seq AS BIGINT) AS rule_seq, count(*) AS n, count(DISTINCT doc_id) AS docs FROM hit GROUP BY rule_seq")
def rule_match_count(spark, sf_dir):
    return matches(spark, sf_dir)[1].groupBy("rule_seq").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(_MATCH_SQL + "SELECT doc_id, pre, CAST(rule_seq AS BIGINT) AS rule_seq, row_number() OVER (PARTITION BY doc_id, rule_seq ORDER BY pre) AS match_pos, count(*) OVER (PARTITION BY doc_id, rule_seq) AS match_size FROM hit")
def rule_match_position(spark, sf_dir):
    return plain(matches(spark, sf_dir)[1]).select("doc_id", "pre", "rule_seq", "match_pos", "match_size")


@query("SELECT a.doc_id, a.pre, min(n.pre) AS first_hit, count(n.pre) AS hits FROM tree a LEFT JOIN tree n ON n.doc_id = a.doc_id AND n.parent = a.pre AND n.a_flag = 'N' WHERE a.local_name = 'order' GROUP BY a.doc_id, a.pre")
def pointer_first_hit(spark, sf_dir):
    """First node that a pointer reaches from every match, and how many."""
    return _pointers(spark, sf_dir).select("doc_id", "pre", "first_hit", "hits")


@query("SELECT a.doc_id, a.pre, 'pointer has ' || count(n.pre) || ' hits' AS message FROM tree a LEFT JOIN tree n ON n.doc_id = a.doc_id AND n.parent = a.pre AND n.a_flag = 'N' WHERE a.local_name = 'order' GROUP BY a.doc_id, a.pre HAVING count(n.pre) <> 1")
def pointer_multi_warning(spark, sf_dir):
    return rule_plan.pointer_warnings(_pointers(spark, sf_dir)).select("doc_id", "pre", "message")


@query(_MATCH_SQL + "SELECT doc_id, pre, arg_max(translate, rule_seq) AS translate FROM hit GROUP BY doc_id, pre")
def rules_last_wins(spark, sf_dir):
    return plain(rule_plan.last_wins(matches(spark, sf_dir)[1], RULES, "translate")).select("doc_id", "pre", F.col("value").alias("translate"))


@query(_MATCH_SQL + "SELECT t.doc_id, t.pre, coalesce(CASE WHEN t.a_priority = '3-MEDIUM' THEN 'local' END, r.translate) AS translate FROM tree t LEFT JOIN (SELECT doc_id, pre, arg_max(translate, rule_seq) AS translate FROM hit GROUP BY doc_id, pre) r USING (doc_id, pre) WHERE t.level = 2")
def local_overrides_global(spark, sf_dir):
    nodes, found = matches(spark, sf_dir)
    own = select(nodes, "self::*[@priority='3-MEDIUM']", context=at(nodes, "order")).select("doc_id", F.col("ctx").alias("pre"), F.lit("local").alias("value"))
    local = at(nodes, "order").select("doc_id", F.col("ctx").alias("pre")).join(own, ["doc_id", "pre"], "left")
    merged = rule_plan.last_wins(found, RULES, "translate")
    return plain(rule_plan.over_local(merged, local)).select("doc_id", "pre", F.col("value").alias("translate"))


@query(_MATCH_SQL + "SELECT doc_id, string_agg('id(''ITS_' || n || ''')', '|' ORDER BY n) AS selector FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS n FROM hit WHERE rule_seq = 2) GROUP BY doc_id")
def false_inheritance_selectors(spark, sf_dir):
    """One selector for all synthesized elements of a document, numbered by the position of the match that they stand for."""
    found = rule_plan.match_nodes(node_table(spark, sf_dir), RULES[2:3])
    return rule_plan.id_selector(found.select("doc_id", F.col("match_pos").alias("n"), F.concat(F.lit("ITS_"), "match_pos").alias("new_id")))


@query(_MATCH_SQL + "SELECT doc_id, pre, 'ITS_' || row_number() OVER (PARTITION BY doc_id ORDER BY local_name, pre) AS new_id FROM (SELECT DISTINCT doc_id, pre, local_name FROM hit)")
def future_ids(spark, sf_dir):
    return plain(rule_plan.minted_ids(matches(spark, sf_dir)[1]))


@query("SELECT doc_id, pre, '/customer/order' || CASE WHEN n > 1 THEN '[' || p || ']' ELSE '' END AS path FROM (SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM tree WHERE level = 2)")
def node_paths(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return plain(rule_plan.sibling_paths(nodes, select(nodes, "order"), "/customer"))


@query("SELECT p.doc_id, p.pre, string_agg(n.a_flag, '' ORDER BY n.pre) AS text FROM tree p JOIN tree n ON n.doc_id = p.doc_id AND n.parent = p.pre WHERE p.level = 2 AND n.a_flag IS NOT NULL GROUP BY p.doc_id, p.pre")
def string_value(spark, sf_dir):
    """Text below each order, its line items' flags being their text."""
    nodes = node_table(spark, sf_dir)
    return plain(string_values(nodes, select(nodes, "//order")).where("text <> ''"))
