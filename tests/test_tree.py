import pytest

from tagloom.sources.shred import node_rows
from tagloom.sources.tree import ELT, ParseError, parse_html, parse_xml, pretty_xml, to_html, to_xml

ZOO = '<z xmlns="d" xmlns:q="u:q"><one a="1">t<in/>u</one><!--note--><?do it?><q:two q:b="2" c="3"/><![CDATA[<raw>]]></z>'


def test_round_trip():
    doc = parse_xml(ZOO)
    again = parse_xml(to_xml(doc))
    assert to_xml(again) == to_xml(doc)
    assert "&lt;raw&gt;" in to_xml(doc)


def test_namespaces_and_kinds():
    root = parse_xml(ZOO).children[0]
    assert [c.kind for c in root.children] == ["ELT", "COM", "PI", "ELT", "TXT"]
    two = root.elements("two", "u:q")[0]
    assert two.att("b", "u:q") == "2" and two.att("c") == "3" and two.att("b") is None
    assert root.scope() == {"": "d", "q": "u:q"}


def test_malformed_xml_is_an_error():
    for bad in ("<a>", "<a b=1/>", "<p:a/>", ""):
        with pytest.raises(ParseError):
            parse_xml(bad)


def test_html_is_tolerant():
    out = to_html(parse_html("<title>T</title><p>a<p>b<ul><li>1<li>2</ul><script>x = '</p>'</script>"))
    assert "<p>a</p><p>b</p>" in out and "<li>1</li><li>2</li>" in out and "x = '</p>'" in out
    assert parse_html("").children[0].name == "html"


def test_intervals_nest():
    rows = {r[0]: r for r in node_rows(parse_xml(ZOO))}
    for pre, post, size, level, parent, *_ in rows.values():
        if parent is not None:
            up = rows[parent]
            assert up[0] < pre < up[0] + up[2] and post < up[1] and level == up[3] + 1
    assert sorted(r[1] for r in rows.values()) == sorted(rows)


def test_block_needs_line_ends_on_both_sides():
    root = parse_xml("<a>x\n <b/>\n y<c/>z</a>").children[0]
    b, c = [n for n in root.children if n.kind == ELT]
    assert b.block() and not c.block() and root.block()


def test_paths_of_rows_are_those_of_nodes():
    from tagloom.operators.paths import path

    doc = parse_xml(ZOO)
    want = {n.pre: path(n) for e in doc.walk() for n in (e, *e.attrs)}
    assert {r[0]: r[-1] for r in node_rows(doc)} == want


def test_wide_documents_take_linear_time():
    assert len(node_rows(parse_xml("<a>" + "<b/>" * 50_000 + "</a>"))) == 50_002


def test_moving_nodes():
    doc = parse_xml("<r><a/>t<b x='1'/></r>")
    r = doc.children[0]
    a, b = r.elements()
    assert to_xml(doc) == '<r><a/>t<b x="1"/></r>'
    for where, want in (("before", "ba"), ("after", "ab"), ("first_child", "a"), ("last_child", "a")):
        b.paste(a, where)
        assert "".join(n.name for n in r.elements()) == want and (b.parent is a) == (where.endswith("child"))
    for bad in ((a, b, "after"), (a, a, "last_child"), (a, r, "beside")):
        with pytest.raises(ValueError):
            bad[0].paste(bad[1], bad[2])
    b.rename("c").drop_attribute("x")
    assert to_xml(doc) == "<r><a><c/></a>t</r>"
    assert b.remove().parent is None and to_xml(doc) == "<r><a/>t</r>"


def test_setting_and_stripping_namespaces():
    doc = parse_xml('<p:a xmlns:p="u" xmlns="d" p:k="1"><p:b/><c/><e xmlns="f"/></p:a>')
    a = doc.children[0].strip_namespace()
    assert a.ns == "" and a.att("k") == "1" and not a.decls
    assert to_xml(doc) == '<a k="1"><p:b xmlns:p="u"/><c xmlns="d"/><e xmlns="f"/></a>'
    assert [n.ns for n in parse_xml(to_xml(doc)).children[0].elements()] == ["u", "d", "f"]
    inner = parse_xml('<r xmlns="d"><x/></r>')
    inner.children[0].children[0].strip_namespace()
    assert parse_xml(to_xml(inner)).children[0].children[0].ns == ""
    assert to_xml(a.elements()[1].set_namespace("w", "q")) == '<q:c xmlns="d" xmlns:q="w"/>'
    with pytest.raises(ValueError):
        a.set_namespace("")


def test_pretty_markup_keeps_text():
    doc = parse_xml('<r k="v"><a><b/><!--c--></a><d>t<e><f/></e></d></r>')
    assert pretty_xml(doc) == '<?xml version="1.0" encoding="utf-8"?>\n<r k="v">\n  <a>\n    <b/>\n    <!--c-->\n  </a>\n  <d>t<e><f/></e></d>\n</r>\n'


def test_references_without_a_semicolon_stay_text_where_asked():
    from tagloom.sources.html_tree import terminated
    from tagloom.sources.tree import parse

    html = "<p title='&amp'>a &amp; b&amp</p><script>x &amp y && z</script><!--&amp--><p>&copyx; &copy;&quot &#65; & c"
    texts = lambda kind: [n.value for n in parse(html, kind).walk() if n.kind == "TXT"]
    assert texts("html") == ["a & b&", "x &amp y && z", "©x; ©\" A & c"]
    assert texts("html-terminated") == ["a & b&amp", "x &amp y && z", "&copyx; ©&quot A & c"]
    assert terminated("<p title='&amp'>&amp;</p><!--&amp-->") == "<p title='&amp'>&amp;</p><!--&amp-->"
