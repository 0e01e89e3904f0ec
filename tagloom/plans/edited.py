"""Queries over trees that change: unique paths, edits by tables, names of blocks, documents as HTML bodies and as XLIFF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import ancestry, blocks, edits, htmlize, rule_tables, xliffize
from ..operators.xpath_plan import select
from ..shipping import ship
from ..sources.relational import STRIDE
from ..sources.shred import shred
from ..sources.stored import once
from ..sources.tree import ITS, ITSX, XLIFF
from .markup import read
from .trees import TREE, node_table, plain

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        Q[f.__name__] = f
        O[f.__name__] = sql
        return f

    return keep


_NTH = TREE + ", t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre) AS p, count(*) OVER (PARTITION BY doc_id, parent) AS n FROM tree), "


@query(_NTH + f"""o AS (SELECT doc_id, pre, '/customer/order' || CASE WHEN n > 1 THEN '[' || p || ']' ELSE '' END AS path, a_status, a_priority FROM t WHERE level = 2),
l AS (SELECT t.doc_id, t.pre, o.path || '/lineitem' || CASE WHEN n > 1 THEN '[' || p || ']' ELSE '' END AS path, a_flag, k_order FROM t JOIN o ON o.doc_id = t.doc_id AND o.pre = t.parent WHERE level = 3)
SELECT doc_id, CAST(0 AS BIGINT) AS pre, 'DOC' AS kind, '/' AS path FROM t WHERE level = 1 UNION ALL SELECT doc_id, {STRIDE} * pre, 'ELT', '/customer' FROM t WHERE level = 1
UNION ALL SELECT doc_id, {STRIDE} * pre, 'ELT', path FROM o UNION ALL SELECT doc_id, {STRIDE} * pre + 1, 'ATT', path || '/@status' FROM o WHERE a_status IS NOT NULL UNION ALL SELECT doc_id, {STRIDE} * pre + 2, 'ATT', path || '/@priority' FROM o WHERE a_priority IS NOT NULL
UNION ALL SELECT doc_id, {STRIDE} * pre, 'ELT', path FROM l UNION ALL SELECT doc_id, {STRIDE} * pre + 3, 'ATT', path || '/@flag' FROM l WHERE a_flag IS NOT NULL UNION ALL SELECT doc_id, {STRIDE} * pre + 4, 'ATT', path || '/@order' FROM l
UNION ALL SELECT doc_id, {STRIDE} * pre + 5, 'TXT', path || '/text()' FROM l WHERE a_flag IS NOT NULL""")
def unique_paths(spark, sf_dir):
    """A path for every node of the keyed trees that selects it alone."""
    return ancestry.unique_paths(node_table(spark, sf_dir)).select("doc_id", "pre", "kind", "path")


def edited_customers(spark, sf_dir) -> DataFrame:
    """Returned line items move to the end of their customer, orders in process go, and urgent orders' status becomes an element before their line items."""

    def make() -> DataFrame:
        nodes = node_table(spark, sf_dir)
        none = F.lit(None)
        tail = [none.cast("string").alias("qname"), none.cast("string").alias("text"), none.cast("map<string,string>").alias("attrs")]
        found = lambda x: select(nodes, x, positions=False)
        move = found("//lineitem[@flag='R']").select("doc_id", F.lit("move").alias("op"), "pre", F.lit("last").alias("place"), F.lit(STRIDE).cast("long").alias("target"), F.col("pre").alias("seq"), *tail)
        drop = found("//order[@status='P']").select("doc_id", F.lit("delete").alias("op"), "pre", none.cast("string").alias("place"), none.cast("long").alias("target"), F.lit(0).cast("long").alias("seq"), *tail)
        return edits.edited(nodes, edits.all_of([move, drop, edits.elements_for_attributes(nodes, found("//order[@priority='1-URGENT']/@status"))]), labels=True)

    return once(spark, f"edited customers {sf_dir}", make)


#: Rows of the edited trees with a key for their order: order's place (line items that moved come last), line item's place, place in the element.
_EDITED = TREE + """, li AS (SELECT n.*, o.pre AS o_pre, o.a_status AS o_status FROM tree n JOIN tree o ON o.doc_id = n.doc_id AND o.pre = n.parent AND n.level = 3),
kept AS (SELECT doc_id, CASE WHEN a_flag = 'R' THEN 1000000000 ELSE o_pre END AS k1, pre AS k2, CASE WHEN a_flag = 'R' THEN 2 ELSE 3 END AS level, * EXCLUDE (doc_id, level) FROM li WHERE a_flag = 'R' OR o_status <> 'P'),
od AS (SELECT *, coalesce(a_priority = '1-URGENT', false) AS urgent FROM tree WHERE level = 2 AND a_status <> 'P'),
r AS (SELECT doc_id, 0 AS k1, 0 AS k2, 0 AS k3, 'DOC' AS kind, 0 AS level, '' AS name, NULL AS value FROM tree WHERE level = 1
  UNION ALL SELECT doc_id, 0, 0, 1, 'ELT', 1, 'customer', NULL FROM tree WHERE level = 1
  UNION ALL SELECT doc_id, pre, 0, 0, 'ELT', 2, 'order', NULL FROM od UNION ALL SELECT doc_id, pre, 0, 1, 'ATT', 3, 'status', a_status FROM od WHERE NOT urgent UNION ALL SELECT doc_id, pre, 0, 2, 'ATT', 3, 'priority', a_priority FROM od
  UNION ALL SELECT doc_id, pre, 0, 3, 'ELT', 3, 'status', NULL FROM od WHERE urgent UNION ALL SELECT doc_id, pre, 0, 4, 'TXT', 4, '', a_status FROM od WHERE urgent
  UNION ALL SELECT doc_id, k1, k2, 0, 'ELT', level, 'lineitem', NULL FROM kept UNION ALL SELECT doc_id, k1, k2, 1, 'ATT', level + 1, 'flag', a_flag FROM kept UNION ALL SELECT doc_id, k1, k2, 2, 'ATT', level + 1, 'order', CAST(k_order AS VARCHAR) FROM kept UNION ALL SELECT doc_id, k1, k2, 3, 'TXT', level + 1, '', a_flag FROM kept),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k1, k2, k3) - 1 AS pre FROM r)
"""


@query(_EDITED + """SELECT doc_id, pre, kind, CAST(level AS BIGINT) AS level, name, value, CASE WHEN kind IN ('ATT', 'TXT') THEN 1 WHEN level < 2 THEN count(*) OVER (PARTITION BY doc_id) - level
  WHEN name = 'order' THEN count(*) OVER (PARTITION BY doc_id, k1) WHEN name = 'status' THEN 2 ELSE count(*) OVER (PARTITION BY doc_id, k1, k2) END AS size,
  CASE kind WHEN 'DOC' THEN NULL ELSE coalesce(max(CASE WHEN kind = 'ELT' THEN pre END) OVER (PARTITION BY doc_id, k1, k2 ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS near FROM e""".replace(
    # the parent: the element before it in its own group, for the first of a group the order or the customer
    "coalesce(max(CASE WHEN kind = 'ELT' THEN pre END) OVER (PARTITION BY doc_id, k1, k2 ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS near",
    "CASE WHEN level = 1 THEN 0 WHEN level = 2 AND kind = 'ELT' THEN 1 WHEN name = 'status' OR name = 'priority' OR (name = 'lineitem' AND level = 3) THEN first_value(pre) OVER (PARTITION BY doc_id, k1 ORDER BY pre) ELSE max(CASE WHEN kind = 'ELT' THEN pre END) OVER (PARTITION BY doc_id, k1, k2 ORDER BY pre) END END AS parent",
))
def edited_trees(spark, sf_dir):
    """Intervals, levels and parents after edits of all three kinds."""
    return edited_customers(spark, sf_dir).select("doc_id", "pre", "kind", F.col("level").cast("long").alias("level"), F.col("qname").alias("name"), "value", "size", "parent")


@query(_EDITED + "SELECT doc_id, pre, value FROM e WHERE kind = 'TXT' AND level = 4 AND (SELECT count(*) FROM e x WHERE x.doc_id = e.doc_id AND x.pre = e.pre - 1 AND x.name = 'status') = 1")
def edited_status(spark, sf_dir):
    """``//order/status/text()`` of the edited trees: labels come with the new numbers, and expressions run on the new rows."""
    return select(edited_customers(spark, sf_dir), "//order/status/text()", positions=False).select("doc_id", "pre", "value")


@query(TREE + """, o AS (SELECT p.doc_id, p.pre, coalesce(p.a_priority = '1-URGENT', false) AS bdo, coalesce(bool_or(n.a_flag = 'R'), false) AS held FROM tree p LEFT JOIN tree n ON n.doc_id = p.doc_id AND n.parent = p.pre WHERE p.level = 2 GROUP BY p.doc_id, p.pre, p.a_priority)
SELECT doc_id, pre, CASE WHEN bdo THEN 'bdo' WHEN held THEN 'div' ELSE 'span' END AS name FROM o UNION ALL SELECT c.doc_id, c.pre, CASE WHEN coalesce(bool_or(held AND NOT bdo), false) THEN 'div' ELSE 'span' END FROM tree c LEFT JOIN o ON o.doc_id = c.doc_id WHERE c.level = 1 GROUP BY c.doc_id, c.pre
UNION ALL SELECT n.doc_id, n.pre, CASE WHEN n.a_flag = 'R' AND NOT o.bdo THEN 'div' ELSE 'span' END FROM tree n JOIN o ON o.doc_id = n.doc_id AND o.pre = n.parent WHERE n.level = 3""")
def block_names(spark, sf_dir):
    """Divisions from the leaves up: returned line items are blocks, urgent orders override the direction."""
    nodes = node_table(spark, sf_dir)
    own = nodes.withColumn("block", F.coalesce((F.col("local_name") == "lineitem") & (F.col("attrs")["flag"] == "R"), F.lit(False)))
    return plain(blocks.block_names(own, select(nodes, "//order[@priority='1-URGENT']", positions=False))).select("doc_id", "pre", "name")


def _marked_up(spark, sf_dir) -> DataFrame:
    """Documents as XML with local markup; a line is a paragraph, a span of the tag set or an overridden paragraph in turn."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")

    def line(x, i):
        t, n = C.xml_escape(x), i.cast("string")
        one = F.concat(F.lit("<para n='"), n, F.lit("'>"), t, F.lit("</para>"))
        two = F.concat(F.lit("<its:span its:locNoteType='alert' term='yes'>"), t, F.lit("</its:span>"))
        three = F.concat(F.lit("<para its:dir='rlo' its:translate='no'>\n<q xml:space='preserve' xml:id='q"), n, F.lit("'>"), t, F.lit("</q>\n</para>"))
        return F.when(i % 3 == 0, one).when(i % 3 == 1, two).otherwise(three)

    top = F.concat(F.lit("<doc xmlns:its='http://www.w3.org/2005/11/its' its:version='2.0' xml:lang='"), C.xml_escape(F.coalesce("lang", F.lit(""))), F.lit("' source='"), C.xml_escape(F.coalesce("source", F.lit(""))), F.lit("'><!--c--><?go on?><its:locQualityIssues xml:id='s'><its:locQualityIssue/></its:locQualityIssues>\n"))
    xml = F.concat(top, F.array_join(F.transform(F.split(clean, "\n"), line), "\n"), F.lit("\n</doc>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("xml").alias("doc_type"), xml.alias("content"))


_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH d AS (SELECT doc_id, {_ESC.format("coalesce(lang, '')")} AS lang, {_ESC.format("coalesce(source, '')")} AS source, string_split({_ESC.format("regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')")}, chr(10)) AS ls FROM documents)
SELECT doc_id, '<div lang="' || lang || '" title="doc"><span title="source" class="_ITS_ATT" its-within-text="no" id="ITS_' || ((len(ls) - 1) // 3 + 2) || '">' || source || '</span><!--c-->' || chr(10) || array_to_string(list_transform(range(1, len(ls) + 1), lambda k: CASE (k - 1) % 3
  WHEN 0 THEN '<div title="para"><span title="n" class="_ITS_ATT" its-within-text="no" id="ITS_' || ((k - 1) // 3 + 1) || '">' || (k - 1) || '</span>' || ls[k] || '</div>'
  WHEN 1 THEN '<span its-loc-note-type="alert" its-term="yes" title="its:span">' || ls[k] || '</span>'
  ELSE '<bdo dir="rtl" translate="no" title="para">' || chr(10) || '<span id="q' || (k - 1) || '" title="q">' || ls[k] || '</span>' || chr(10) || '</bdo>' END), chr(10)) || chr(10) || '</div>' AS markup FROM d""")
def html_bodies(spark, sf_dir):
    """Every document's HTML body, by joins over node rows."""
    ship(spark)
    nodes = once(spark, f"marked up {sf_dir}", lambda: shred(_marked_up(spark, sf_dir)))
    return htmlize.html_markup(htmlize.bodies(nodes))


#: Lines of a section.
SECTION = 8


def _sectioned(spark, sf_dir) -> DataFrame:
    """Documents as XML with rules of their own: a section for every eight lines, paragraphs plain, with a note and inline elements, and terms in turn."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x08\\x0B-\\x1F]", "")
    note = F.replace(C.xml_escape(F.coalesce("source", F.lit(""))), F.lit("'"), F.lit("&apos;"))

    def line(x, i):
        t, n = C.xml_escape(x), i.cast("string")
        one = F.concat(F.lit("<para n='"), n, F.lit("'>"), t, F.lit("</para>"))
        two = F.concat(F.lit("<para its:locNoteType='alert' its:locNote='"), note, F.lit("' xml:id='p"), n, F.lit("'>"), t, F.lit("<b k='1'>x</b><u/></para>"))
        three = F.concat(F.lit("<para its:term='yes' its:allowedCharacters='a'><q>"), t, F.lit("</q>;</para>"))
        return F.concat(F.when((i > 0) & (i % SECTION == 0), "</sec><sec>").otherwise(""), F.when(i % 3 == 0, one).when(i % 3 == 1, two).otherwise(three))

    top = f"<doc xmlns:its='{ITS}'><its:rules version='2.0'><its:translateRule selector='//para' translate='yes'/><its:translateRule selector=\"//para[@n='3']\" translate='no'/></its:rules><sec>"
    xml = F.concat(F.lit(top), F.array_join(F.transform(F.split(clean, "\n"), line), "\n"), F.lit("</sec></doc>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("xml").alias("doc_type"), xml.alias("content"))


_INK = "[^\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


@query(f"""WITH d AS (SELECT doc_id, {_ESC.format("coalesce(source, '')")} AS note, string_split({_ESC.format("regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')")}, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, note, k - 1 AS i, ls[k] AS t FROM d, unnest(range(1, len(ls) + 1)) AS x(k)),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, dense_rank() OVER (PARTITION BY doc_id ORDER BY i // {SECTION}) AS g, row_number() OVER (PARTITION BY doc_id, i // {SECTION} ORDER BY i) = 1 AS opens,
  CASE i % 3 WHEN 0 THEN t WHEN 1 THEN t || '<mrk mtype="x-its"><ph id="1">&lt;b&gt;x&lt;/b&gt;</ph></mrk><ph id="2">&lt;u/&gt;</ph>' ELSE '<mrk mtype="term"><ph id="1">' || CASE WHEN t = '' THEN '&lt;q/&gt;' ELSE '&lt;q&gt;' || {_ESC.format("t")} || '&lt;/q&gt;' END || '</ph>;</mrk>' END AS c,
  CASE i % 3 WHEN 2 THEN ' its:allowedCharacters="a"' ELSE '' END AS a FROM p WHERE i % 3 <> 0 OR regexp_matches(t, '{_INK}')),
m AS (SELECT doc_id, count(*) AS n_units, max(g) AS n_groups, string_agg(CASE WHEN opens THEN CASE WHEN g > 1 THEN '</group>' ELSE '' END || '<group id="' || g || '">' ELSE '' END || '<trans-unit id="' || n || '" translate="' || CASE WHEN i = 3 THEN 'no' ELSE 'yes' END || '"' || CASE i % 3 WHEN 1 THEN ' resname="p' || i || '"' ELSE '' END
  || '><source' || a || '>' || c || '</source><target state="new"' || a || '>' || c || '</target>' || CASE WHEN i % 3 <> 1 THEN '' WHEN note = '' THEN '<note priority="1"/>' ELSE '<note priority="1">' || note || '</note>' END || '</trans-unit>', '' ORDER BY i) AS b FROM u GROUP BY doc_id)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_groups, 0) AS n_groups, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<xliff xmlns="{XLIFF}" xmlns:its="{ITS}" xmlns:itsxlf="{ITSX}" its:version="2.0"><file datatype="plaintext" original="STRING" source-language="en">'
  || coalesce('<body>' || b || '</group></body>', '<body/>') || '</file></xliff>' AS xliff FROM d LEFT JOIN m USING (doc_id)""")
def xliff_documents(spark, sf_dir):
    """Every document as XLIFF by sections and paragraphs, metadata from its own rules and markup, by joins over node rows."""
    ship(spark)
    nodes = once(spark, f"sectioned {sf_dir}", lambda: shred(_sectioned(spark, sf_dir)))
    rules = rule_tables.rule_table(nodes)
    said = rule_tables.all_values(rule_tables.match_tables(nodes, rules), rules)
    return xliffize.documents(nodes, ["para"], ["sec"], said)
