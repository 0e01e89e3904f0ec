"""XPath and rules over node rows: one entry for all expressions, diagnostics for what is left out."""

import pytest

from tagloom.functions.columns import literal_xpath as literal_column
from tagloom.functions.xpath_syntax import XPathError, parse
from tagloom.functions.xpath_tree import Context, evaluate
from tagloom.operators import rule_plan
from tagloom.operators.batch import convert_documents, diagnostics, effective_documents, match_documents
from tagloom.operators.xpath_any import errors, evaluate_nodes, evaluate_values
from tagloom.operators.xpath_plan import BUCKET, NotLowered, select, string_values
from tagloom.sources.shred import shred
from tagloom.sources.tree import parse_xml
from pyspark.sql import functions as F

ITS = 'xmlns:its="http://www.w3.org/2005/11/its"'
TEXTS = {
    1: '<r><p xml:id="a" ref="b c">one<b>two</b></p><p xml:id="b">three</p><q xml:id="c" ref="a"/></r>',
    2: '<r><p>x<b n="2">y</b><b n="3">z</b></p><!--k--><q><p xml:id="a">w</p></q></r>',
}


@pytest.fixture(scope="module")
def nodes(spark):
    return shred(spark.createDataFrame([(i, "xml", t) for i, t in TEXTS.items()], "doc_id long, doc_type string, content string")).cache()


def plain(expr):
    out = []
    for i, t in TEXTS.items():
        doc = parse_xml(t)
        got = evaluate(expr, doc.children[0], 1, 1, Context(doc, {"v": "a"}, {}))
        out += [(i, k, n.pre) for k, n in enumerate(got, 1)]
    return out


@pytest.mark.parametrize("expr", ["//p", "/r/p[1]", "//b/..", "id(//@ref)", "id($v)", "//p[b]/@ref | //q", "p/b[last()]", "//p[starts-with(@ref, 'b')]", "//*[b/@n='3']", "/", "/.."])
def test_plans_find_what_the_evaluator_finds(nodes, expr):
    select(nodes, expr, params={"v": "a"})
    got = evaluate_nodes(nodes, expr, params={"v": "a"}).collect()
    assert sorted((r.doc_id, r.position, r.pre) for r in got) == plain(expr)


@pytest.mark.parametrize("expr", ["//p[string(b)='two']", "//p[.='three']", "//*[concat(@n, 'x')='2x']", "//p[count(b) > 1]", "id(//q[1]/@ref)[1]", "//b[@n = ../b/@n]"])
def test_the_evaluator_takes_over_where_there_is_no_plan(nodes, expr):
    with pytest.raises(NotLowered):
        select(nodes, expr)
    got = evaluate_nodes(nodes, expr).collect()
    assert sorted((r.doc_id, r.position, r.pre) for r in got) == plain(expr)
    assert all(r.kind in ("ELT", "ATT") and r.local_name for r in got)


def test_values_and_failures(nodes):
    context = nodes.where("local_name = 'p'").select("doc_id", F.col("pre").alias("ctx"), *[c for c in nodes.columns if c != "doc_id"])
    texts = {(r.doc_id, r.text) for r in evaluate_values(nodes, "concat(name(), ':', b)", context=context).collect()}
    assert texts == {(1, "p:two"), (1, "p:"), (2, "p:y"), (2, "p:")}
    assert evaluate_values(nodes, "count(//p)").where("text = '2'").count() == 2
    assert {r.error for r in errors(nodes, "//p/x:y").collect()} == {"unbound prefix x"}


def test_intervals_over_several_buckets(spark):
    text = "<r><a>" + "<b>t</b>" * BUCKET + "</a><a><b>u</b></a></r>"
    rows = shred(spark.createDataFrame([(1, "xml", text)], "doc_id long, doc_type string, content string")).cache()
    tops = select(rows, "//a")
    context = tops.select("doc_id", F.col("pre").alias("ctx"), *[c for c in tops.columns if c not in ("doc_id", "ctx", "position", "hits")])
    found = select(rows, "descendant::b", context=context).groupBy("ctx").count().collect()
    assert sorted(r["count"] for r in found) == [1, BUCKET]
    assert sorted(len(r.text) for r in string_values(rows, tops).collect()) == [1, BUCKET]
    deep = select(rows, "//b").select("doc_id", F.col("pre").alias("ctx"), *[c for c in tops.columns if c not in ("doc_id", "ctx", "position", "hits")])
    assert select(rows, "ancestor::a", context=deep).count() == BUCKET + 1


def test_rules_over_rows(nodes):
    rules = rule_plan.rules_of(
        f'<its:rules version="2.0" {ITS}><its:translateRule selector="//p" translate="no"/><its:translateRule selector="//p[@ref]" translate="yes"/>'
        '<its:locNoteRule selector="//p|//comment()" locNotePointer="b" locNoteType="alert"/></its:rules>'
    )
    found = rule_plan.match_nodes(nodes, rules)
    assert {(r.doc_id, r.rule_seq): r.match_size for r in found.collect()} == {(1, 0): 2, (2, 0): 2, (1, 1): 1, (1, 2): 2, (2, 2): 3}
    assert sorted(r.value for r in rule_plan.last_wins(found, rules, "translate").collect()) == ["no", "no", "no", "yes"]
    hits = rule_plan.pointer_hits(nodes, found, rules)
    assert sorted((r.doc_id, r.hits) for r in hits.collect()) == [(1, 0), (1, 1), (2, 0), (2, 2)]
    assert {r.message for r in rule_plan.pointer_warnings(hits).collect()} == {"pointer has 0 hits", "pointer has 2 hits"}


@pytest.mark.parametrize("bad", ["contains('a')", "substring('x')", "position(1)", "concat('a')", "translate('a','b')", "(" * 300 + "1" + ")" * 300, "a[" * 200 + "1" + "]" * 200, "1" + "+1" * 5000, "id()"])
def test_expressions_are_checked_when_they_are_read(bad):
    with pytest.raises(XPathError):
        parse(bad)


def test_signs_in_a_row():
    assert evaluate("-" * 5001 + "2", parse_xml("<a/>"), 1, 1, Context(parse_xml("<a/>"))) == -2.0


def test_no_document_or_rule_fails_a_job_and_each_is_told(spark):
    texts = [
        f'<r><its:rules version="2.0" {ITS}><its:termRule selector="//p[contains(.)]" term="yes"/><its:locNoteRule selector="//p" locNotePointer="b"/><its:termRule term="no"/><its:termRule selector="//comment()" term="no"/></its:rules><p/><!--c--></r>',
        "<r><p></r>",
        "<r>" + "<p>" * 3000 + "</p>" * 3000 + "</r>",
        f'<r><its:rules version="2.0" {ITS} xmlns:xlink="http://www.w3.org/1999/xlink" xlink:href="gone.xml"><its:termRule selector="$x" term="yes"/></its:rules></r>',
        "",
        None,
    ]
    docs = spark.createDataFrame([(i, "xml", t, "a clash") for i, t in enumerate(texts)], "doc_id long, doc_type string, content string, code string")
    codes = {(r.doc_id, r.level, r.code) for r in diagnostics(docs).collect()}
    assert {(0, "warning", "bad_selector"), (0, "warning", "pointer_hits"), (0, "warning", "no_selector"), (0, "warning", "skipped_match"), (1, "error", "parse_error"), (3, "warning", "include_missing"), (4, "error", "parse_error"), (5, "error", "parse_error")} <= codes
    assert not {i for i, level, _ in codes if level == "error"} & {0, 3}
    assert {r.doc_id for r in match_documents(docs).collect()} == {0}
    assert effective_documents(docs).count() >= 0
    for task in ("xml2html", "xml2xliff", "reduceHtml"):
        out = {r.doc_id: r for r in convert_documents(docs, task).collect()}
        assert len(out) == len(texts) and (task == "reduceHtml" or out[1].error)
    assert diagnostics(docs.limit(0)).count() == 0


def test_literals_with_both_quotes(spark):
    rows = [("a'b\"c'",), ("it's",), ('"',), ("",)]
    for r in spark.createDataFrame(rows, "t string").select("t", literal_column(F.lit("STR"), F.col("t")).alias("x")).collect():
        assert evaluate(r.x, parse_xml("<a/>"), 1, 1, Context(parse_xml("<a/>"))) == r.t


def test_equal_names_of_two_folders(spark, tmp_path):
    from tagloom.cli import options, run

    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.xml").write_text("<r/>")
    assert run(spark, options(["--xml2html", "-i", str(tmp_path / "*"), "-o", str(tmp_path / "out")])) == 0
    assert sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x-1.html", "x.html"]


def test_long_string_values_are_put_together_from_pieces(spark):
    text = "<r><p>" + "".join(f"<b>{i}é</b>" for i in range(1500)) + "</p><p/>" + "x" * 3000 + "</r>"
    rows = shred(spark.createDataFrame([(1, "xml", text)], "doc_id long, doc_type string, content string")).cache()
    assert sorted(r.text for r in string_values(rows, select(rows, "//p | /r")).collect()) == sorted(["", (t := "".join(f"{i}é" for i in range(1500))), t + "x" * 3000])
    assert select(rows, "//b[string-length(.) > 4 and starts-with(., '14')]", texts=True).count() == 100
    assert select(rows, "//*[string-length(b) = 2]", texts=True).count() == 1
