import re

import pytest

from tagloom.operators.batch import convert_documents, effective_documents, match_documents
from tagloom.operators.convert import ConversionError, camel_to_dash, reduce_html, xliff_to_html, xml_to_html, xml_to_xliff
from tagloom.sources.tree import parse_xml

ITS = 'xmlns:its="http://www.w3.org/2005/11/its"'
XLF = 'xmlns="urn:oasis:names:tc:xliff:document:1.2" xmlns:itsxlf="http://www.w3.org/ns/its-xliff/"'


def body(html):
    return re.search("<body>(.*)</body>", html, re.S)[1]


def rules(html):
    return re.findall(r"<its:(\w+)Rule ([^>]*?)/?>", html)


def flat(xml):
    return re.sub(r"\s+", " ", xml)


def test_camel_to_dash():
    assert camel_to_dash("locNoteType") == "its-loc-note-type"


def test_divisions_spans_and_attributes():
    html, _ = xml_to_html(f'<r {ITS}>\n <a its:translate="no" xml:id="k" xml:space="preserve"/>\n <b>in <i>side</i> line</b>\n <c its:locNoteType="alert" its:version="2.0"/>\n</r>')
    out = body(html)
    assert '<div translate="no" id="k" title="a"></div>' in out
    assert '<div title="b">in <span title="i">side</span> line</div>' in out
    assert '<div its-loc-note-type="alert" title="c"></div>' in out


def test_direction_overrides_and_saved_attributes():
    html, _ = xml_to_html(f'<r {ITS}>\n <a its:dir="rlo"><b/></a>\n <c kind="z">t</c>\n</r>')
    assert '<bdo dir="rtl" title="a"><span title="b"></span></bdo>' in body(html)
    assert re.search(r'<span title="kind" class="_ITS_ATT" its-within-text="no" id="ITS_1">z</span>', body(html))
    assert ("translate", 'selector="id(\'ITS_1\')" translate="no"') in rules(html)


def test_rules_are_rewritten_for_each_match():
    html, notes = xml_to_html(f'<r {ITS}><h><its:rules><its:domainRule selector="//p" domainPointer="@t"/><its:preserveSpaceRule selector="//p" space="preserve"/></its:rules></h>\n<p t="x">1</p>\n<p t="y">2</p>\n</r>')
    own = [a for k, a in rules(html) if k == "domain"]
    assert own == ["selector=\"id('ITS_1')\" domainPointer=\"id('ITS_2')\"", "selector=\"id('ITS_3')\" domainPointer=\"id('ITS_4')\""]
    assert "preserveSpace" not in html
    assert [k for k, _ in rules(html)][:4] == ["localeFilter", "dir", "translate", "withinText"]
    assert any(m.startswith("matched ") for _, _, m in notes.rows)


def test_instructions_namespaces_comments_and_literals():
    html, _ = xml_to_html(f"<r {ITS} xmlns:f='u'><its:rules><its:aRule selector='//p' xPointer='processing-instruction()' yPointer='namespace::f' zPointer='comment()' wPointer='/' vPointer=\"'lit'\"/></its:rules>\n<p>t<?go now?><!--c--></p>\n</r>")
    assert '<span title="go" class="_ITS_PI" its-within-text="no"' in html and '<span title="xmlns:f" class="_ITS_NS" its-within-text="no"' in html
    own = dict(rules(html))["a"]
    assert 'zPointer="/html/body' not in own and re.search(r'zPointer="/\*.*comment\(\)"', own) and 'wPointer="/"' in own and "vPointer=\"'lit'\"" in own


def test_standoff_goes_to_the_head():
    html, _ = xml_to_html(f'<r {ITS}><its:provenanceRecords xml:id="p1"><its:provenanceRecord tool="x"/></its:provenanceRecords></r>')
    assert '<script type="application/its+xml" id="p1"><its:provenanceRecords' in html and "provenance" not in body(html)


def test_guards():
    for convert in (xml_to_html, xliff_to_html, xml_to_xliff):
        with pytest.raises(ConversionError):
            convert(f"<its:rules {ITS}/>")
    with pytest.raises(ConversionError):
        xml_to_xliff(f"<its:locQualityIssues {ITS}/>")
    assert "trans-unit" in xml_to_xliff(f"<its:span {ITS}>t</its:span>")[0]


def test_xliff_notes_terms_and_global_rules():
    html, notes = xliff_to_html(f'<xliff {XLF}><trans-unit resname="n1"><source>s<mrk mtype="term" itsxlf:termInfo="what">w</mrk></source><note priority="2">N</note><note annotates="other">x</note></trans-unit><source itsxlf:domains="dd"/></xliff>', labels=False)
    assert 'its-loc-note="N" its-loc-note-type="description"' in html and 'its-term="yes"' in html
    assert re.search(r'its-term-info-ref="#(ITS_\d+)"', html)[1] in re.findall(r'<div title="termInfo" id="(ITS_\d+)">what', html)
    assert ("idValue" in dict(rules(html))) and "idValue=\"'n1'\"" in html and "domainPointer" in html
    assert "note_target" in [c for _, c, _ in notes.rows]
    assert "body {visibility:hidden}" in html


def test_labels():
    unit = lambda s, t: f"<trans-unit><source{s}>x</source><target{t}>x</target></trans-unit>"
    html, _ = xliff_to_html(f"<xliff {XLF}>{unit('', '')}{unit(' translate=\"no\"', '')}<trans-unit><source>x</source><target/></trans-unit></xliff>")
    assert html.count("ITS_DUP_TARGET") == 1 and html.count("ITS_EMPTY_TARGET") == 1


def test_segmentation_by_markup():
    out, _ = xml_to_xliff(f'<r {ITS}>one <i its:withinText="yes">two<b>out</b></i> three<n its:withinText="nested">deep</n><z>four</z>five</r>')
    assert re.findall("<source>(.*?)</source>", flat(out)) == ['one <mrk mtype="x-its">two</mrk> three ', "out", "deep", "four", "five"]
    parse_xml(out)


def test_segmentation_metadata():
    out, _ = xml_to_xliff(f'<r {ITS}><a its:translate="no" its:locNote="n" its:locNoteType="alert" xml:id="u" its:storageSize="3">t</a><b its:term="yes" its:termConfidence="1">w</b></r>')
    assert '<trans-unit translate="no" resname="u"><source its:storageSize="3">t</source><target state="new" its:storageSize="3">t</target><note priority="1">n</note>' in out
    assert '<source><mrk mtype="term" itsxlf:termConfidence="1">w</mrk></source>' in out


def test_segmentation_by_names():
    out, _ = xml_to_xliff("<r><sec><para>a<x>b<y/></x></para><para> </para></sec><sec/><sec><para>c<sec><para>d</para></sec></para></sec></r>", group=["sec"], tu=["para"])
    assert re.findall(r'<group id="(\d)">', out) == ["1", "2"] and re.findall(r'<trans-unit id="(\d)">', out) == ["1", "2"]
    assert '<source>a<ph id="1">&lt;x&gt;b&lt;y/&gt;&lt;/x&gt;</ph></source>' in out
    one, _ = xml_to_xliff("<r><para>a</para></r>", group=[], tu=["para"])
    assert one.count("<group") == 1
    with pytest.raises(ConversionError):
        xml_to_xliff("<r/>", group=["sec"])


def test_reduce_puts_all_rules_into_the_head():
    files = {"m.xml": f'<its:rules {ITS} version="2.0" xml:id="m"><its:param name="a">1</its:param><its:termRule selector="//p" term="yes"/></its:rules>'}
    html, notes = reduce_html(f'<head><link rel="its-rules" href="m.xml"><script type="application/its+xml"><its:rules {ITS} version="2.0"/></script></head><p>x</p>', "", files)
    assert "its-rules" not in html and html.count("<its:rules") == 2 and '<its:param name="a">1</its:param>' in html
    assert html.index('id="m"') < html.rindex("<its:rules")


def test_batches_isolate_bad_documents(spark):
    rows = [(1, "xml", f'<r {ITS}><its:rules><its:translateRule selector="//p" translate="no"/></its:rules>\n<p its:translate="yes">t</p>\n</r>'), (2, "xml", "<r>"), (3, "xml", None)]
    df = spark.createDataFrame(rows, "doc_id long, doc_type string, content string")
    out = {r.doc_id: r for r in convert_documents(df, "xml2html", title="T").collect()}
    assert out[1].error is None and "<title>T</title>" in out[1].output and out[2].output is None and out[2].error and out[3].error
    found = match_documents(df).collect()
    assert [(r.doc_id, r.rule_type, r.match_pos, r.path) for r in found] == [(1, "translate", 1, "/r/p")]
    assert ("translate", "yes") in {(r.name, r.value) for r in effective_documents(df).collect()}
    files = spark.createDataFrame([("u", "x")], "uri string, content string")
    assert convert_documents(df, "reduceHtml", files).count() == 3


def test_conversions_hold_a_bounded_amount_of_text(spark):
    import pyarrow as pa

    from tagloom.operators import batch

    texts = ["x" * (batch.SLICE_BYTES // 4)] * 10 + [None, "y" * (2 * batch.SLICE_BYTES), ""]
    rows = pa.RecordBatch.from_arrays([pa.array(range(13)), pa.array(["xml"] * 13), pa.array([""] * 13), pa.array(texts)], ["doc_id", "doc_type", "uri", "content"])
    parts = list(batch._slices(rows))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(13))
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column(3).to_pylist()) <= batch.SLICE_BYTES for p in parts)


def test_documents_are_dealt_anew_before_they_are_parsed(spark):
    from tagloom.operators.batch import convert_documents
    from tagloom.sources.shred import shred

    docs = spark.createDataFrame([(1, "xml", "<r/>")], "doc_id long, doc_type string, content string")
    for df in (shred(docs), convert_documents(docs, "xml2html")):
        assert "RebalancePartitions" in df._jdf.queryExecution().optimizedPlan().toString()
