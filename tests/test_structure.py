"""HTML trees by scope, interval sweeps, path summaries, rule tables, string values, units, subtree hashes, markup and includes, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.xpath_tree import Context, evaluate
from tagloom.operators import flow, includes, path_summary, rule_plan, rule_tables, staircase, subtrees
from tagloom.operators.xpath_plan import NODE, NotLowered, declarations, in_scope, select
from tagloom.sources.shred import errors_of, nodes_of, shred, shred_all
from tagloom.sources.stored import forget, once, store
from tagloom.sources.tree import COM, DOC, ELT, PI, TXT, escape, parse, parse_html, parse_xml, to_html

ITS = 'xmlns:its="http://www.w3.org/2005/11/its"'


def rows_of(spark, texts, kind="xml"):
    return store(shred(spark.createDataFrame([(i, kind, t) for i, t in texts.items()], "doc_id long, doc_type string, content string")))


@pytest.mark.parametrize(
    ("html", "body"),
    [
        ("<p><b>one<br><p>two</p><p>three", "<p><b>one<br></b></p><p><b>two</b></p><p><b>three</b></p>"),
        ("<a>x<a>y</a>", "<a>x</a><a>y</a>"),
        ("<b><i>x</b>y</i>", "<b><i>x</i></b><i>y</i>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<table>x<tr><td>c<td>d</table>z", "x<table><tbody><tr><td>c</td><td>d</td></tr></tbody></table>z"),
        ("<table><b>q<tr><td>r</table>s", "<b>q</b><table><tbody><tr><td>r</td></tr></tbody></table><b>s</b>"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<div><a>x<div>y</a>z</div>", "<div><a>x</a><div><a>y</a>z</div></div>"),
        ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
        ("<p><button><p>x</button>y", "<p><button><p>x</p></button>y</p>"),
        ("<em><em><em><em>x<p>y", "<em><em><em><em>x<p>y</p></em></em></em></em>"),
        ("x</p>y</b>", "x<p></p>y"),
    ],
)
def test_html_trees(html, body):
    out = to_html(parse_html(html)).split("\n", 1)[1]
    assert out == f"<html><body>{body}</body></html>"
    assert to_html(parse_html(out)).split("\n", 1)[1] == out or "<p></p>" in out


def test_html_never_fails():
    rnd = random.Random(4)
    tags = "p b i a li ul table tr td div nobr h1 button em span br script title body option".split()
    for _ in range(400):
        text = "".join(rnd.choice([f"<{rnd.choice(tags)}>", f"</{rnd.choice(tags)}>", "t", " "]) for _ in range(rnd.randrange(30)))
        doc = parse_html(text)
        assert sorted({n.pre for n in doc.walk()}) == [n.pre for n in doc.walk()]
        assert all(c.parent is n for n in doc.walk() for c in n.children)


def grown(rnd, depth=0):
    if depth > 5 or rnd.random() < 0.3:
        return rnd.choice(["x", "yy", "", "<e/>", "<!--c-->"])
    name, inner = rnd.choice("abc"), "".join(grown(rnd, depth + 1) for _ in range(rnd.randrange(5)))
    att = rnd.choice(["", f' k="{rnd.randrange(3)}"', ' k="1" m="x"', ' xmlns:n="u" n:k="2"', ' xmlns="v"'])
    return f"<{name}{att}>{inner}</{name}>"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    out = {i: f"<a>{''.join(grown(rnd) for _ in range(6))}</a>" for i in range(30)}
    out[30] = "<a>" + "<b><c>x</c><c k='1'>yy</c></b>" * 3000 + "</a>"
    return out


@pytest.fixture(scope="module")
def nodes(spark, texts):
    return rows_of(spark, texts)


@pytest.fixture(scope="module")
def trees(texts):
    return {i: parse_xml(t) for i, t in texts.items()}


def found_by_evaluator(trees, expr, prefixes=None):
    out = []
    for i, doc in trees.items():
        got = evaluate(expr, doc.children[0], 1, 1, Context(doc, {"v": "1"}, prefixes or {}))
        out += [(i, k, n.pre) for k, n in enumerate(got, 1)]
    return sorted(out)


EXPRESSIONS = ["//c[.='x']", "//b[contains(., 'xyy')]", "//b[starts-with(., 'x')]/c", "//c[string-length(.) > 1]", "//*[c='yy']", "//c[. = ../c/@k]", "//b[c = c/@k]", "//c[concat(@k, name())='1c']", "//b[string(c)='x']", "//c[normalize-space(.)='yy']", "//b[c != 'x']", "//c[. = following-sibling::c]", "//c[.=$v]", "//b[contains(.,'')]"]


@pytest.mark.parametrize("expr", EXPRESSIONS)
def test_string_values_have_plans(nodes, trees, expr):
    got = select(nodes, expr, params={"v": "1"}, texts=True).collect()
    assert sorted((r.doc_id, r.position, r.pre) for r in got) == found_by_evaluator(trees, expr)


@pytest.mark.parametrize("expr", ["//c/ancestor::b", "//b/descendant-or-self::*", "//c/ancestor-or-self::*", "//c/following-sibling::*[1]", "//c/preceding-sibling::c[1]", "//c/preceding-sibling::node()[1]", "//b/following-sibling::b[1][@k]", "//b//c[2]"])
def test_axes_over_ranges(nodes, trees, expr):
    small = {i: t for i, t in trees.items() if i < 30}
    got = select(nodes.where("doc_id < 30"), expr).collect()
    assert sorted((r.doc_id, r.position, r.pre) for r in got) == found_by_evaluator(small, expr)


@pytest.mark.parametrize("axis", ["following", "preceding"])
def test_following_and_preceding(nodes, trees, axis):
    few = nodes.where("local_name = 'c' and (doc_id < 30 or pre % 5000 < 4)").select("doc_id", F.col("pre").alias("ctx"), *NODE)
    got = select(nodes, f"{axis}::c[@k]", context=few, positions=False)
    assert "position" not in got.columns
    want = []
    for r in few.collect():
        doc = trees[r.doc_id]
        ends = r.pre + r["size"]
        for n in doc.walk():
            if n.kind == ELT and n.name == "c" and n.ns == "" and n.att("k") is not None:
                own = sum(1 + len(x.attrs) for x in n.walk())
                if (n.pre >= ends) if axis == "following" else (n.pre + own <= r.pre):
                    want.append((r.doc_id, r.ctx, n.pre))
    assert sorted((r.doc_id, r.ctx, r.pre) for r in got.collect()) == sorted(want)
    reached = {(d, p) for d, _, p in want}
    pruned = staircase.beyond(nodes, few, axis).where("local_name = 'c' and attrs['k'] is not null and ns_uri = ''")
    assert sorted((r.doc_id, r.pre) for r in pruned.collect()) == sorted(reached)


def test_sweeps_against_all_pairs(spark):
    rnd = random.Random(2)
    spans = [(d, lo, lo + rnd.choice([0, 1, 3, 5000, 20000]), f"{d}-{k}") for d in range(4) for k in range(60) for lo in [rnd.randrange(20000)]]
    points = [(d, rnd.randrange(21000), k) for d in range(5) for k in range(400)]
    left = spark.createDataFrame(spans, "doc_id long, _lo long, _hi long, name string").repartition(3)
    right = spark.createDataFrame(points, "doc_id long, _at long, k int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = sorted(tuple(r) for r in staircase.interval_join(left, right).select("doc_id", "name", "k").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((d, n, k) for d, lo, hi, n in spans for e, at, k in points if d == e and lo <= at < hi)
    assert staircase.interval_join(left.limit(0), right).count() == 0


def test_namespaces_in_scope(nodes, trees):
    got = sorted((r.doc_id, r.pre, r.prefix, r.uri) for r in in_scope(nodes, declarations(nodes)).collect())
    assert got == sorted((i, n.pre, p, u) for i, doc in trees.items() for n in doc.walk() if n.kind == ELT for p, u in n.scope().items())


def test_running_sums_over_ranges(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("_at"), F.lit(1).alias("v"))
    assert staircase.running(df, {"v": "s"}).where((F.col("s") != F.floor(F.col("_at") / 2) + 1)).count() == 0


SELECTORS = ["//c", "//b/c", "b", "/a/b", "//*", "//@k", "//c[@k='1']", "//c[@k!='1']", "//b[not(@k)]", "//b[@k and @m]", "//b[@k='1' or @m='x']", "//c[2]", "//b[1][@k]", "//n:k | //v:b", "//b[@n:k='2']", "//v:*", "b//c/@k", "//c[@k=$v]"]


def test_path_summary_against_the_evaluator(nodes, trees):
    prefixes = {"n": "u", "v": "v"}
    known = {}
    for i, s in enumerate(SELECTORS):
        try:
            known[i] = path_summary.patterns(s, prefixes)
        except NotLowered:
            assert s == "//v:*"
    got = {}
    for r in path_summary.match_by_path(nodes, {i: p for i, p in known.items() if "$" not in SELECTORS[i]}).collect():
        got.setdefault(r.rule_seq, []).append((r.doc_id, r.match_pos, r.pre))
    for i in known:
        if "$" not in SELECTORS[i]:
            assert sorted(got.get(i, [])) == found_by_evaluator(trees, SELECTORS[i], prefixes), SELECTORS[i]
    assert path_summary.summary(nodes.where("doc_id = 30")).count() < 10


@pytest.mark.parametrize("bad", ["..", "//b[c]", "id('x')", "//b[c/@k='1']/c", "//b[position()=2]", "//b/parent::a", "//c[@k][1]", "//b[@k='1']/c"])
def test_what_needs_more_than_paths_is_not_lowered(bad):
    with pytest.raises(NotLowered):
        path_summary.patterns(bad, {})


def test_rules_share_one_scan(nodes):
    rules = rule_plan.rules_of(f"<its:rules version='2.0' {ITS}>" + "".join(f"<its:translateRule selector='{s}' translate='no'/>" for s in ("//c", "//b", "//c[@k=1]", "//c[@k]")) + "</its:rules>")
    plan = rule_plan.match_nodes(nodes, rules[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # the label paths, and the rows once for both rules


def test_rule_tables(spark):
    head = lambda k, more="": f'<its:rules version="2.0" {ITS} xmlns:h="urn:h"><its:param name="k">old</its:param><its:param name="k">{k}</its:param>{more}'
    texts = {
        1: f'<r>{head(1)}<its:translateRule selector="//p[@n=$k]" translate="no"/><its:locNoteRule selector="//h:q" locNotePointer="@x" locNoteType="alert"><its:locNote>note</its:locNote></its:locNoteRule></its:rules><p n="1"/><p n="2"/><h:q xmlns:h="urn:h"/></r>',
        2: f'<r>{head(2)}<its:translateRule selector="//p[@n=$k]" translate="no"/></its:rules><p n="1"/><p n="2"/>{head(9, "<x/><its:param name='late'>l</its:param>")}<its:translateRule selector="//p[@n=$late]|//p" translate="yes"/><its:termRule selector="//p[q]" term="yes"/><its:termRule term="no"/></its:rules></r>',
        3: "<r/>",
    }
    nodes = rows_of(spark, texts)
    rules = store(rule_tables.rule_table(nodes))
    got = {(r.doc_id, r.rule_seq): r for r in rules.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert got[1, 0].params == {"k": "1"} and got[2, 1].params == {"k": "9"} and got[1, 1].pointers == {"locNotePointer": "@x"}
    assert got[1, 1]["values"] == {"locNote": "note", "locNoteType": "alert"} and '"h":"urn:h"' in got[1, 1].prefixes
    found = rule_tables.match_tables(nodes, rules)
    pre = {(r.doc_id, r.pre): (r.local_name, r.attrs.get("n")) for r in nodes.where("kind = 'ELT'").collect()}
    assert sorted((r.doc_id, r.rule_seq, *pre[r.doc_id, r.pre], r.match_pos, r.match_size) for r in found.collect()) == [(1, 0, "p", "1", 1, 1), (1, 1, "q", None, 1, 1), (2, 0, "p", "2", 1, 1), (2, 1, "p", "1", 1, 2), (2, 1, "p", "2", 2, 2)]
    assert {(r.doc_id, r.rule_seq) for r in rule_tables.unplanned(rules).collect()} == {(2, 2), (2, 3)}
    assert sorted((r.doc_id, r.value) for r in rule_tables.last_wins(found, rules, "translate").collect()) == [(1, "no"), (2, "yes"), (2, "yes")]
    assert rule_tables.rule_table(nodes.where("doc_id = 3")).count() == 0


def plain_markup(n):
    inner = "".join(plain_markup(c) for c in n.children)
    if n.kind == DOC:
        return inner
    if n.kind == ELT:
        quoted = lambda v: escape(v, quote=False).replace('"', "&quot;").replace("\n", "&#10;")
        return f"<{n.name}" + "".join(f' xmlns{":" + p if p else ""}="{u}"' for p, u in sorted(n.decls.items())) + "".join(f' {a.name}="{quoted(a.value)}"' for a in n.attrs) + f">{inner}</{n.name}>"
    return {TXT: escape(n.value or "", quote=False), COM: f"<!--{n.value}-->", PI: f"<?{n.name} {n.value}?>"}[n.kind]


def test_markup_from_rows(spark, nodes, trees):
    assert {r.doc_id: r.markup for r in subtrees.serialized(nodes).collect()} == {i: plain_markup(t) for i, t in trees.items()}
    html = {1: "<p title='a\"<b'>x &amp; y<br><b>z</p><!--k--><p>w", 2: "", 3: "<ul><li>1<li>2</ul>"}
    got = {r.doc_id: r.markup for r in subtrees.serialized(rows_of(spark, html, "html")).collect()}
    assert got == {i: plain_markup(parse(t, "html")) for i, t in html.items()}


def test_equal_subtrees(nodes, trees):
    def shape(n):
        return (n.kind, n.local, n.ns, n.value, tuple(sorted((a.local, a.ns, a.value) for a in n.attrs)), tuple(shape(c) for c in n.children))

    groups: dict = {}
    for i, doc in trees.items():
        for n in doc.walk():
            if n.kind == ELT:
                groups.setdefault(shape(n), []).append((i, n.pre))
    want = sorted((n[1], len(x), *min(x)) for n, x in groups.items() if len(x) > 1)
    got = sorted((r.local_name, r.copies, r.first_doc, r.first_pre) for r in subtrees.equal_subtrees(nodes).collect())
    assert got == want and len(want) > 20


def test_subtrees_in_one_range_are_summed_without_joins(spark, nodes):
    kept = nodes.where("pre < 4096").join(nodes.where("pre >= 4096").select("doc_id").distinct(), "doc_id", "left_anti")
    found = subtrees.fingerprints(store(kept))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Window" not in plan
    want = subtrees._summed(kept.where("kind not in ('ATT', 'DOC')").select("doc_id", "pre", "size", "kind", "local_name", "ns_uri", "value", "attrs"))
    assert found.count() == want.count() > 100 and found.exceptAll(want.select(*found.columns)).count() == 0


def test_units_and_inheritance(spark):
    nodes = rows_of(spark, {1: "<a>one<b>two<i/></b>three<p>four<b>five</b></p> <p> </p>six</a>", 2: "<a/>"})
    named = lambda name: nodes.where((F.col("kind") == "ELT") & (F.col("local_name") == name)).select("doc_id", "pre")
    within = named("b").union(named("i"))
    assert [(r.doc_id, r.unit, r.parts, r.source) for r in flow.units(nodes, within).orderBy("unit").collect()] == [(1, 1, 3, "onetwothree"), (1, 2, 2, "fourfive"), (1, 3, 1, "six")]
    says = named("a").withColumn("value", F.lit("yes")).union(named("p").withColumn("value", F.lit("no"))).union(named("b").withColumn("value", F.lit("b"))).withColumn("name", F.lit("x"))
    own = flow.inherited(nodes, says)
    assert [(r.source, r.value) for r in flow.units(nodes, within, own).orderBy("unit").collect()] == [("one", "yes"), ("two", "b"), ("three", "yes"), ("four", "no"), ("five", "b"), ("six", "yes")]


def test_includes(spark):
    files = spark.createDataFrame([("http://h/d/a.xml",), ("http://h/d/b.xml",), ("http://h/c.xml",), ("http://h/d/e/f.xml",)], "uri string")
    links = spark.createDataFrame(
        [("http://h/d/a.xml", 1, "b.xml"), ("http://h/d/a.xml", 2, "../c.xml"), ("http://h/d/b.xml", 1, "./e/../e/f.xml"), ("http://h/d/e/f.xml", 1, "/d/a.xml"), ("http://h/c.xml", 1, "d/b.xml"), ("http://h/c.xml", 2, "http://x/none.xml")],
        "uri string, ord int, href string",
    )
    ways = store(includes.walk(files, links, files.where("uri like '%a.xml'")))
    order = [r.uri.rpartition("/")[2] for r in includes.application_order(ways).orderBy("seq").collect()]
    assert order == ["f.xml", "b.xml", "f.xml", "b.xml", "c.xml", "a.xml"]
    params = spark.createDataFrame([("http://h/d/a.xml", "t", "A"), ("http://h/d/b.xml", "t", "B"), ("http://h/c.xml", "s", "C")], "uri string, name string, value string")
    got = {(tuple(r.places), r.name): r.value for r in includes.parameters(ways, params).collect()}
    assert got[(1,), "t"] == "A" and got[(2, 1, 1), "s"] == "C" and ((1, 1), "s") not in got
    assert [r.target for r in includes.unresolved(files, links).collect()] == ["http://x/none.xml"]
    with pytest.raises(ValueError):
        includes.walk(files, links, files, most=1)


def test_tables_are_written_once(spark):
    made = []
    make = lambda: made.append(1) or spark.range(5)
    assert once(spark, "t", make).count() == once(spark, "t", make).count() == 5 and len(made) == 1
    forget(spark, "t")
    assert once(spark, "t", make).count() == 5 and len(made) == 2


def test_one_parse_gives_nodes_and_errors(spark):
    docs = spark.createDataFrame([(1, "xml", "<a>x</a>"), (2, "xml", "<a>"), (3, "xml", None), (4, "html", "<p")], "doc_id long, doc_type string, content string")
    rows = store(shred_all(docs))
    assert [r.doc_id for r in errors_of(rows).collect()] == [2] and errors_of(rows).first().message
    assert sorted({r.doc_id for r in nodes_of(rows).collect()}) == [1, 4]
    plan = shred_all(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
