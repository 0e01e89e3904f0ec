from tagloom.operators.match import literal_xpath, match_all, merged
from tagloom.operators.rules import Diagnostics, containers
from tagloom.sources.tree import parse_html, parse_xml

NS = 'xmlns:its="http://www.w3.org/2005/11/its" xmlns:xlink="http://www.w3.org/1999/xlink"'
INNER = f'<its:rules version="2.0" {NS} xml:id="r2"><its:param name="foo">inner</its:param><its:param name="baz">q</its:param><its:termRule selector="//k" term="yes"/></its:rules>'
MIDDLE = f'<its:rules version="2.0" {NS} xml:id="r1" xlink:href="sub/inner.xml"><its:locNoteRule selector="//n" locNote="m"/></its:rules>'
FILES = {"middle.xml": MIDDLE, "sub/inner.xml": INNER, "loop.xml": f'<its:rules {NS} xlink:href="loop.xml"/>'}
DOC = f"""<doc {NS}><its:rules version="2.0" xlink:href="middle.xml"><its:param name="foo">outer</its:param><its:param name="t">x1</its:param>
<its:idValueRule selector="id($t)" idValue="'fixed'"/><other/></its:rules>
<p xml:id="x1" note="hey">one<q/></p><p xml:id="x2">two<!--c--></p><p>three</p></doc>"""


def test_included_containers_apply_first_and_parameters_pass_down():
    notes = Diagnostics()
    boxes = containers(parse_xml(DOC), "xml", "main.xml", FILES, notes=notes)
    assert [b.uri for b in boxes] == ["sub/inner.xml", "middle.xml", "main.xml"]
    assert boxes[0].params == {"foo": "inner", "t": "x1", "baz": "q"}
    assert boxes[2].params == {"foo": "outer", "t": "x1"}
    assert [r.kind for b in boxes for r in b.rules] == ["term", "locNote", "idValue"]


def test_missing_and_cyclic_includes_are_reported():
    for href, code in (("gone.xml", "include_missing"), ("loop.xml", "include_cycle")):
        notes = Diagnostics()
        containers(parse_xml(f'<d {NS}><its:rules xlink:href="{href}"/></d>'), "xml", "main.xml", FILES, notes=notes)
        assert code in [c for _, c, _ in notes.rows]


def test_sibling_containers_do_not_leak():
    boxes = containers(parse_xml(f'<d {NS}><its:rules><its:param name="a">1</its:param></its:rules><its:rules><its:param name="b">2</its:param></its:rules></d>'), "xml")
    assert [b.params for b in boxes] == [{"a": "1"}, {"b": "2"}]


def test_html_containers_take_scripts_and_links_in_order():
    html = f'<head><link rel="its-rules" href="middle.xml"><script type="application/its+xml">{INNER}</script><script type="application/its+xml"><its:other {NS}/></script></head><p>x'
    boxes = containers(parse_html(html), "html", "page.html", FILES)
    assert [b.element.att("id", "http://www.w3.org/XML/1998/namespace") for b in boxes] == ["r2", "r1", "r2"]


def matches_of(rules, body="<p n='1'>a</p><p>b</p><p>c</p><!--k-->"):
    notes = Diagnostics()
    doc = parse_xml(f"<d {NS}><its:rules>{rules}</its:rules>{body}</d>")
    return match_all(containers(doc, "xml", notes=notes), doc, False, notes), notes


def test_positions_pointers_and_warnings():
    found, notes = matches_of('<its:aRule selector="//p" xPointer="@n" yPointer="concat(position(),\'/\',last())"/>')
    assert [m.pointers["yPointer"] for m in found] == ["1/3", "2/3", "3/3"]
    assert "xPointer" in found[0].pointers and "xPointer" not in found[1].pointers
    assert [c for _, c, _ in notes.rows] == ["pointer_hits", "pointer_hits"]


def test_skipped_kinds_keep_their_position():
    found, notes = matches_of('<its:aRule selector="//comment()|//p" pPointer="position()"/>', "<p/><!--k--><p/>")
    assert [m.pointers["pPointer"] for m in found] == [1.0, 3.0]
    assert [c for _, c, _ in notes.rows] == ["skipped_match"]


def test_last_rule_wins():
    found, _ = matches_of('<its:translateRule selector="//p" translate="yes"/><its:translateRule selector="//p[1]" translate="no"/><its:locNoteRule selector="//p"><its:locNote>n</its:locNote></its:locNoteRule>')
    values = list(merged(found).values())
    assert values[0] == {"translate": "no", "locNote": "n"} and values[1] == {"translate": "yes", "locNote": "n"}


def test_rule_without_selector_matches_nothing():
    found, notes = matches_of('<its:aRule translate="no"/>')
    assert not found and notes.rows[0][1] == "no_selector"


def test_separate_rules_replace_own_ones():
    doc = parse_xml(DOC)
    boxes = containers(doc, "xml", "main.xml", FILES, parse_xml(INNER))
    assert len(boxes) == 1


def test_literals_as_xpath():
    assert literal_xpath("a") == "'a'" and literal_xpath("a'b") == '"a\'b"' and literal_xpath(2.0) == "2" and literal_xpath(True) == "true()"
    assert literal_xpath("'\"") == "concat('', \"'\", '\"')"
