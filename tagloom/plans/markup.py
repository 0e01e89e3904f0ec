"""Queries over pages, documents and conversations: tokens, pointers, segments, labels, conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..shipping import ship

Q: dict = {}
O: dict[str, str] = {}
_TOKEN_SQL = C.TOKEN.replace("'", "''")
TOK = f"""WITH list AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN_SQL}') AS ts FROM pages),
tok AS (SELECT page_id, p AS pos, ts[p] AS t FROM list, unnest(range(1, len(ts) + 1)) AS u(p)),
kinds AS (SELECT *, CASE WHEN starts_with(t, '<!--') THEN 'COM' WHEN starts_with(t, '</') THEN 'END' WHEN starts_with(t, '<!') THEN 'DECL' WHEN regexp_matches(t, '^<[a-zA-Z]') THEN 'START' ELSE 'TXT' END AS kind,
  lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM tok),
navs AS (SELECT *, sum(CASE WHEN tag = 'nav' AND kind = 'START' THEN 1 WHEN tag = 'nav' AND kind = 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM kinds)
"""


def query(sql: str | None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def page_tokens(spark, sf_dir) -> DataFrame:
    """(page_id, pos from 1, t, kind, tag)."""
    t = read(spark, sf_dir, "pages").select("page_id", F.posexplode(C.tokens(F.col("html"))).alias("p", "t"))
    return t.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "t", C.token_kind(F.col("t")).alias("kind"), C.tag_name(F.col("t")).alias("tag"))


@query(TOK + "SELECT page_id, pos, kind, tag, CAST(length(t) AS BIGINT) AS n_chars FROM kinds")
def tokenize_pages(spark, sf_dir):
    return page_tokens(spark, sf_dir).select("page_id", "pos", "kind", "tag", F.length("t").cast("long").alias("n_chars"))


@query(TOK + "SELECT kind, tag, count(*) AS n FROM kinds GROUP BY kind, tag")
def token_kind_counts(spark, sf_dir):
    return page_tokens(spark, sf_dir).groupBy("kind", "tag").agg(F.count("*").alias("n"))


_NAV = TOK + """SELECT page_id, regexp_extract(t, 'href="([^"]*)"', 1) AS href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS match_pos, count(*) OVER (PARTITION BY page_id) AS match_size
FROM navs WHERE tag = 'a' AND kind = 'START' AND depth > 0"""


@query(_NAV)
def nav_link_pointers(spark, sf_dir):
    """Selector "links inside nav", pointer ``@href``, with position and size: one window over the page's tokens."""
    step = F.when((F.col("tag") == "nav") & (F.col("kind") == "START"), 1).when((F.col("tag") == "nav") & (F.col("kind") == "END"), -1).otherwise(0)
    page = W.partitionBy("page_id")
    links = page_tokens(spark, sf_dir).withColumn("depth", F.sum(step).over(page.orderBy("pos"))).where("tag = 'a' and kind = 'START' and depth > 0")
    return links.select("page_id", F.regexp_extract("t", 'href="([^"]*)"', 1).alias("href"), F.row_number().over(page.orderBy("pos")).cast("long").alias("match_pos"), F.count("*").over(page).alias("match_size"))


def page_nodes(spark, sf_dir, doc_type: str = "html") -> DataFrame:
    from ..sources.shred import shred

    ship(spark)
    return shred(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(doc_type).alias("doc_type"), F.col("html").alias("content")))


@query(_NAV)
def xpath_nav_links(spark, sf_dir):
    """The same rule by the shredder and the compiled XPath."""
    from ..operators.xpath_plan import select
    from ..sources.tree import XHTML

    hits = select(page_nodes(spark, sf_dir), "//h:nav//h:a/@href", {"h": XHTML})
    return hits.select(F.col("doc_id").alias("page_id"), F.col("value").alias("href"), F.col("position").cast("long").alias("match_pos"), F.col("hits").alias("match_size"))


@query(TOK + "SELECT page_id, coalesce(max(nxt), '') AS title FROM (SELECT page_id, tag, kind, lead(t) OVER (PARTITION BY page_id ORDER BY pos) AS nxt, lead(kind) OVER (PARTITION BY page_id ORDER BY pos) AS nk FROM kinds) WHERE tag = 'title' AND kind = 'START' AND nk = 'TXT' GROUP BY page_id")
def title_text(spark, sf_dir):
    page = W.partitionBy("page_id").orderBy("pos")
    t = page_tokens(spark, sf_dir).withColumns({"nxt": F.lead("t").over(page), "nk": F.lead("kind").over(page)})
    return t.where("tag = 'title' and kind = 'START' and nk = 'TXT'").groupBy("page_id").agg(F.max("nxt").alias("title"))


@query(TOK + """SELECT page_id, regexp_extract(t, 'charset="([^"]*)"', 1) AS charset FROM kinds WHERE tag = 'meta' AND kind = 'START' AND contains(t, 'charset=')""")
def meta_charset(spark, sf_dir):
    t = page_tokens(spark, sf_dir).where("tag = 'meta' and kind = 'START'").where(F.col("t").contains("charset="))
    return t.select("page_id", F.regexp_extract("t", 'charset="([^"]*)"', 1).alias("charset"))


@query(TOK + """SELECT page_id, pos, tag, (pk = 'TXT' AND nk = 'TXT' AND regexp_matches(pt, '[\\r\\n]\\s*$') AND regexp_matches(nt, '^\\s*[\\r\\n]')) AS block
FROM (SELECT *, coalesce(lag(kind) OVER w, '') AS pk, coalesce(lag(t) OVER w, '') AS pt, coalesce(lead(kind) OVER w, '') AS nk, coalesce(lead(t) OVER w, '') AS nt FROM kinds WINDOW w AS (PARTITION BY page_id ORDER BY pos)) WHERE kind = 'START'""")
def block_inline_flag(spark, sf_dir):
    """Block where line ends separate the tag from the text on both sides."""
    page = W.partitionBy("page_id").orderBy("pos")
    near = {"pk": F.lag("kind").over(page), "pt": F.lag("t").over(page), "nk": F.lead("kind").over(page), "nt": F.lead("t").over(page)}
    t = page_tokens(spark, sf_dir).withColumns({k: F.coalesce(v, F.lit("")) for k, v in near.items()}).where("kind = 'START'")
    block = (F.col("pk") == "TXT") & (F.col("nk") == "TXT") & F.col("pt").rlike(r"[\r\n]\s*$") & F.col("nt").rlike(r"^\s*[\r\n]")
    return t.select("page_id", "pos", "tag", block.alias("block"))


_GROUPS = TOK + """, g AS (SELECT *, sum(CASE WHEN tag = 'article' AND kind = 'START' THEN 1 WHEN tag = 'article' AND kind = 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS inside,
  sum(CASE WHEN tag = 'article' AND kind = 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS group_id,
  sum(CASE WHEN tag IN ('p', 'h1') AND kind = 'START' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS unit FROM kinds)
SELECT page_id, CAST(group_id AS BIGINT) AS group_id, row_number() OVER (PARTITION BY page_id ORDER BY unit) AS tu_id, s AS source FROM (
  SELECT page_id, group_id, unit, string_agg(t, '' ORDER BY pos) AS s FROM g WHERE inside > 0 AND kind = 'TXT' AND unit > 0 GROUP BY page_id, group_id, unit) WHERE regexp_matches(s, '\\S')"""


@query(_GROUPS)
def custom_groups(spark, sf_dir):
    """Groups ``article``, units ``p`` and ``h1``: text islands between unit starts, numbered over the page."""
    page = W.partitionBy("page_id").orderBy("pos")
    is_start, is_end = F.col("kind") == "START", F.col("kind") == "END"
    article = F.col("tag") == "article"
    t = page_tokens(spark, sf_dir).withColumns({
        "inside": F.sum(F.when(article & is_start, 1).when(article & is_end, -1).otherwise(0)).over(page),
        "group_id": F.sum(F.when(article & is_start, 1).otherwise(0)).over(page),
        "unit": F.sum(F.when(F.col("tag").isin("p", "h1") & is_start, 1).otherwise(0)).over(page),
    })
    units = t.where("inside > 0 and kind = 'TXT' and unit > 0").groupBy("page_id", "group_id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("source"))
    units = units.where(F.col("source").rlike(r"\S"))
    return units.select("page_id", F.col("group_id").cast("long").alias("group_id"), F.row_number().over(W.partitionBy("page_id").orderBy("unit")).cast("long").alias("tu_id"), "source")


@query(TOK + """, f AS (SELECT *, CASE WHEN kind = 'TXT' AND regexp_matches(t, '\\S') THEN 1 ELSE 0 END AS texty, CASE WHEN kind IN ('START', 'END') AND tag NOT IN ('a', 'b', 'i', 'em', 'strong', 'span') THEN 1 ELSE 0 END AS brk FROM kinds),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM f)
SELECT page_id, CAST(island AS BIGINT) AS island, count(*) AS parts, string_agg(t, '' ORDER BY pos) AS source FROM isl WHERE texty = 1 GROUP BY page_id, island""")
def segment_islands(spark, sf_dir):
    """Units of flowing text: a break flag on structural tags, summed up, names the island."""
    page = W.partitionBy("page_id").orderBy("pos")
    brk = F.when(F.col("kind").isin("START", "END") & ~F.col("tag").isin("a", "b", "i", "em", "strong", "span"), 1).otherwise(0)
    t = page_tokens(spark, sf_dir).withColumn("island", F.sum(brk).over(page)).where((F.col("kind") == "TXT") & F.col("t").rlike(r"\S"))
    return t.groupBy("page_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("source"))


@query("SELECT doc_id, CAST(p AS BIGINT) AS tu_id, string_split(text, chr(10))[p] AS source FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(p) WHERE regexp_matches(string_split(text, chr(10))[p], '\\S')")
def segment_paragraphs(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "source"))
    return d.where(F.col("source").rlike(r"\S")).select("doc_id", (F.col("p") + 1).cast("long").alias("tu_id"), "source")


_PAIRS = "WITH c AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) "


@query(_PAIRS + "SELECT conv_id, turn, text AS source, nt AS target FROM c WHERE role = 'user' AND nr = 'assistant'")
def source_target_pairs(spark, sf_dir):
    """A user's turn as source, the answer as target."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumns({"nr": F.lead("role").over(own), "nt": F.lead("text").over(own)})
    return c.where("role = 'user' and nr = 'assistant'").select("conv_id", "turn", F.col("text").alias("source"), F.col("nt").alias("target"))


@query(_PAIRS + "SELECT conv_id, turn, CASE WHEN coalesce(nt, '') = '' THEN 'ITS_EMPTY_TARGET' WHEN nt = text THEN 'ITS_DUP_TARGET' ELSE '' END AS label FROM c WHERE role = 'user'")
def target_labels(spark, sf_dir):
    """Empty and duplicate targets."""
    own = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("nt", F.lead("text").over(own)).where("role = 'user'")
    label = F.when(F.coalesce("nt", F.lit("")) == "", "ITS_EMPTY_TARGET").when(F.col("nt") == F.col("text"), "ITS_DUP_TARGET").otherwise("")
    return c.select("conv_id", "turn", label.alias("label"))


@query("SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_target(spark, sf_dir):
    """Equal subtrees by fingerprint."""
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


#: Attribute names of the public vocabulary.
NAMES = "allowedCharacters annotatorsRef dir domainMapping lang localeFilterList localeFilterType locNote locNoteRef locNoteType locQualityIssueType locQualityRatingScore mtConfidence person provenanceRecordsRef space storageEncoding storageSize taClassRef taConfidence taIdent taSource term termConfidence termInfoRef tool translate withinText".split()


@query("SELECT r_regionkey, n AS name, 'its-' || lower(regexp_replace(n, '([A-Z])', '-\\1', 'g')) AS dashed FROM region, unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS t(n)")
def camel_to_dash(spark, sf_dir):
    r = read(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("name"))
    return r.select(F.col("r_regionkey"), "name", C.camel_to_dash(F.col("name")).alias("dashed"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents")
def escape_markup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.xml_escape(F.col("text")).alias("escaped"))


@query("SELECT doc_id, CASE WHEN NOT contains(source, '''') THEN '''' || source || '''' ELSE '\"' || source || '\"' END AS xpath FROM documents")
def literal_to_xpath(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.literal_xpath(F.lit("LIT"), F.col("source")).alias("xpath"))


@query(TOK + ", e AS (SELECT page_id, tag, count(*) AS n FROM kinds WHERE kind = 'START' AND tag IN ('nav', 'a', 'article', 'h1', 'footer') GROUP BY page_id, tag) SELECT page_id, tag, n FROM e")
def shredded_elements(spark, sf_dir):
    """Elements of the shredded trees, for tags that the pages close properly."""
    n = page_nodes(spark, sf_dir).where("kind = 'ELT'").where(F.col("local_name").isin("nav", "a", "article", "h1", "footer"))
    return n.groupBy(F.col("doc_id").alias("page_id"), F.col("local_name").alias("tag")).agg(F.count("*").alias("n"))


def _as_xml(spark, sf_dir) -> DataFrame:
    """Documents as XML with rules of their own: a paragraph per line, quality labels as metadata."""
    rules = "<head><its:rules version='2.0' xmlns:its='http://www.w3.org/2005/11/its'><its:translateRule selector='//para[1]' translate='no'/><its:domainRule selector='//body' domainPointer='@topic'/></its:rules></head>"
    control = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    paras = F.array_join(F.transform(F.split(control, "\n"), lambda x: F.concat(F.lit("<para>"), C.xml_escape(x), F.lit("</para>"))), "\n")
    xml = F.concat(F.lit("<xml>"), F.lit(rules), F.lit("\n<body topic='"), F.col("source"), F.lit("'>\n"), paras, F.lit("\n</body>\n</xml>"))
    return read(spark, sf_dir, "documents").select("doc_id", F.lit("xml").alias("doc_type"), xml.alias("content"))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS rule_seq, 'translate' AS rule_type, CAST(1 AS BIGINT) AS match_size, '' AS pointer FROM documents UNION ALL SELECT doc_id, 1, 'domain', 1, source FROM documents")
def match_documents(spark, sf_dir):
    """Inline rules of every document, by the per-document evaluator."""
    from ..operators.batch import match_documents as run

    ship(spark)
    m = run(_as_xml(spark, sf_dir))
    return m.select("doc_id", F.col("rule_seq").cast("long").alias("rule_seq"), "rule_type", F.col("match_size").cast("long").alias("match_size"), F.coalesce(F.get("ptr", F.lit(0))["value"], F.lit("")).alias("pointer"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10)), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS units FROM documents")
def xml_to_xliff(spark, sf_dir):
    """Units of every converted document."""
    from ..operators.batch import convert_documents

    ship(spark)
    out = convert_documents(_as_xml(spark, sf_dir), "xml2xliff")
    return out.select("doc_id", F.regexp_count("output", F.lit("<trans-unit")).cast("long").alias("units"))


_PARAS = """WITH d AS (SELECT doc_id, source, list_transform(string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), chr(10)),
  lambda x: replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS ls FROM documents),
u AS (SELECT doc_id, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'i': i, 't': ls[i]}), lambda x: regexp_matches(x.t, '\\S')) AS us FROM d)
"""
_TOP = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Document</title><script type="application/its+xml"><its:rules xmlns:h="http://www.w3.org/1999/xhtml" xmlns:its="http://www.w3.org/2005/11/its" version="2.0">
<its:localeFilterRule selector="//@*" localeFilterList="*" localeFilterType="include"/>
<its:dirRule selector="//@*" dir="ltr"/>
<its:translateRule selector="//@*" translate="no"/>
"""
_HTML_RULES = """<its:withinTextRule selector="//h:span" withinText="no"/>
<its:translateRule selector="id('ITS_3')" translate="no"/>
<its:translateRule selector="id('ITS_1')" translate="no"/>
<its:domainRule selector="id('ITS_2')" domainPointer="id('ITS_3')"/>
</its:rules></script></head><body><div title="xml"><span title="head"></span>
<div title="body" id="ITS_2"><span title="topic" class="_ITS_ATT" its-within-text="no" id="ITS_3">"""
_XLIFF_TOP = """<?xml version="1.0" encoding="utf-8"?>
<xliff xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:its="http://www.w3.org/2005/11/its" xmlns:itsxlf="http://www.w3.org/ns/its-xliff/" its:version="2.0"><file datatype="plaintext" original="STRING" source-language="en"><body>"""


def _quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("'", "''") + "'"


@query(_PARAS + f"""SELECT doc_id, {_quoted(_XLIFF_TOP)} || array_to_string(list_transform(us, lambda x: '<trans-unit' || CASE x.i WHEN 1 THEN ' translate="no"' ELSE '' END
  || '><source>' || x.t || '</source><target state="new">' || x.t || '</target></trans-unit>'), '') || '</body></file></xliff>' AS output FROM u WHERE len(us) > 0""")
def xliff_texts(spark, sf_dir):
    """The whole XLIFF text of every document that has a unit."""
    from ..operators.batch import convert_documents

    ship(spark)
    return convert_documents(_as_xml(spark, sf_dir), "xml2xliff").where(F.col("output").contains("<trans-unit")).select("doc_id", "output")


@query(_PARAS + f"""SELECT doc_id, {_quoted(_TOP + _HTML_RULES)} || source || '</span>' || chr(10)
  || array_to_string(list_transform(range(1, len(ls) + 1), lambda i: '<div title="para"' || CASE i WHEN 1 THEN ' id="ITS_1"' ELSE '' END || '>' || ls[i] || '</div>'), chr(10))
  || chr(10) || '</div>' || chr(10) || '</div></body></html>' AS output, CAST(NULL AS VARCHAR) AS error FROM d""")
def xml_to_html(spark, sf_dir):
    from ..operators.batch import convert_documents

    ship(spark)
    return convert_documents(_as_xml(spark, sf_dir), "xml2html").select("doc_id", "output", "error")


_LABELLED = """<its:dirRule selector="%ids" dir="ltr"/>
<its:localeFilterRule selector="%ids" localeFilterList="*" localeFilterType="include"/>
<its:translateRule selector="%ids" translate="no"/>
<its:targetPointerRule selector="//*[@title='source']" targetPointer="../*[@title='target']"/>
</its:rules></script><style>body {visibility:hidden} p {visibility: visible}</style></head><body><div title="xliff"><div title="file"><div title="body">"""


@query(_PARAS + f"""SELECT doc_id, replace({_quoted(_TOP + _LABELLED)}, '%ids', array_to_string(list_transform(range(1, len(us) + 1), lambda k: 'id(''ITS_' || k || ''')'), '|'))
  || array_to_string(list_transform(range(1, len(us) + 1), lambda k: '<div' || CASE us[k].i WHEN 1 THEN ' translate="no"' ELSE '' END || ' title="trans-unit"><p class="ITS_LABEL ITS_DUP_TARGET" id="ITS_' || k
  || '">Target is duplicate of source with the same ITS metadata inside</p><p title="source">' || us[k].t || '</p><p title="target">' || us[k].t || '</p></div>'), '')
  || '</div></div></div></body></html>' AS output FROM u WHERE len(us) > 0""")
def labelled_pairs(spark, sf_dir):
    """The whole HTML text, labels included, of every document that has a unit: to XLIFF and on to HTML."""
    return xliff_to_html(spark, sf_dir).where(F.col("output").contains('title="trans-unit"')).select("doc_id", "output")


@query(None)
def xliff_to_html(spark, sf_dir):
    """Documents to XLIFF and on to HTML with labels."""
    from ..operators.batch import convert_documents

    ship(spark)
    x = convert_documents(_as_xml(spark, sf_dir), "xml2xliff").select("doc_id", F.lit("xml").alias("doc_type"), F.col("output").alias("content"))
    return convert_documents(x, "xliff2html", deal=False, labels=True).select("doc_id", "output", "error")


@query(None)
def reduce_html(spark, sf_dir):
    from ..operators.batch import convert_documents

    ship(spark)
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("html").alias("doc_type"), F.col("html").alias("content"))
    return convert_documents(pages, "reduceHtml").select("doc_id", "output", "error")


@query(_PARAS + """SELECT doc_id, '/xml/body' AS path, 'domain' AS name, source AS value FROM d
  UNION ALL SELECT doc_id, '/xml/body/para' || CASE WHEN len(ls) > 1 THEN '[1]' ELSE '' END, 'translate', 'no' FROM d""")
def effective_metadata(spark, sf_dir):
    from ..operators.batch import effective_documents

    ship(spark)
    return effective_documents(_as_xml(spark, sf_dir))
