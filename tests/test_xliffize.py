"""XLIFF over node rows against the conversion of one document."""

import random
import re

from test_edits import rows_of

from tagloom.operators import rule_tables, xliffize
from tagloom.operators.convert import ConversionError, xml_to_xliff

ITS = "xmlns:its='http://www.w3.org/2005/11/its'"
MARKS = [
    "", "", " its:translate='no'", " its:term='yes' its:termInfoRef='#a&amp;b'", " its:term='no'", " its:locNote='n &lt; \"1\"' its:locNoteType='alert'", " its:locNote='d'", " xml:id='i'", " k='1'",
    " its:withinText='yes'", " its:withinText='yes' xml:id='j'", " its:termConfidence='0.5'", " its:allowedCharacters='[a-z]' its:version='2.0'", f" {ITS}", " xmlns:n='u' n:k='2'", " xmlns:its='v' its:k='3'",
]


def grown(rnd, names, depth=0):
    gap = lambda: rnd.choice(["", "x &amp; y", " ", "\n", "z&#13;", "<!--n-->", "<?p i?>", "&lt;é"])
    inner = gap() + "".join(grown(rnd, names, depth + 1) + gap() for _ in range(rnd.randrange(4))) if depth < 5 else gap()
    name = rnd.choice(names)
    bare = rnd.choice(["", " translate='yes'", " locNote='s' its:locNote='t'"]) if name == "its:span" else ""
    mark = rnd.choice(MARKS)
    return f"<{name}{'' if ('xmlns:its=' in mark and 'v' in mark) and name.startswith('its:') else mark if not (bare and 'locNote=' in mark) else ''}{bare}>{inner}</{name}>"


def body_of(text):
    return re.sub("<header>.*</header>", "", text, flags=re.S)


def check(spark, texts, tu, group=(), values=None):
    want = {}
    for i, t in texts.items():
        try:
            want[i] = body_of(xml_to_xliff(t, group=list(group) or None, tu=list(tu))[0])
        except ConversionError:
            continue
    nodes = rows_of(spark, texts)
    got = {r.doc_id: r for r in xliffize.documents(nodes, tu, group, values(nodes) if values else None).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i].xliff == want[i], texts[i]
        assert (got[i].n_units, got[i].n_groups) == (want[i].count("<trans-unit"), want[i].count("<group"))
    return want


def test_units_and_groups_are_those_of_the_conversion(spark):
    rnd = random.Random(5)
    names = ["sec", "para", "b", "its:span", "q", "sec", "para", "its:standoff"]
    texts = {i: f"<doc {ITS}>{grown(rnd, names)}{grown(rnd, names)}{grown(rnd, names)}</doc>" for i in range(120)}
    texts |= {200: f"<its:rules {ITS} version='2.0'/>", 201: "<para/>", 202: "<para> </para>", 203: "<para>x</para>", 204: "<sec><para>&#160;</para></sec>", 205: f"<its:span {ITS}><para>y</para></its:span>", 206: "<doc><sec/></doc>"}
    want = check(spark, texts, ["para"], ["sec"])
    assert 200 not in want and sum("<mrk" in x for x in want.values()) > 20
    check(spark, texts, ["para", "sec"])
    check(spark, texts, ["b", "q"], ["para", "doc"])


def test_rules_become_metadata_of_units_and_marks(spark):
    rules = "<its:rules version='2.0' {}><its:translateRule selector='//para' translate='yes'/><its:translateRule selector=\"//para[@n='1']\" translate='no'/><its:locNoteRule selector='//b' locNoteType='alert'><its:locNote>{}</its:locNote></its:locNoteRule><its:termRule selector='//q' term='yes'/><its:termRule selector=\"//para[@n='2']\" term='no'/></its:rules>"
    bodies = ["<para n='1'>a<b>c</b></para><para n='2'>d <q its:term='no'>e</q><q k='1'>f<b>g</b></q></para>", "<para its:translate='no'>h<b its:locNote='own'>i</b><u>j</u></para>", "<para n='1'> </para>"]
    texts = {i: f"<doc {ITS}>{rules.format(ITS, f'note {i}') if i < 5 else ''}<sec>{bodies[i % 3]}</sec><sec>{bodies[(i + 1) % 3]}</sec></doc>" for i in range(8)}

    def values(nodes):
        table = rule_tables.rule_table(nodes)
        return rule_tables.all_values(rule_tables.match_tables(nodes, table), table)

    want = check(spark, texts, ["para"], ["sec"], values)
    assert 'translate="no"' in want[0] and 'comment="note 0"' in want[0]


def test_empty_table_has_no_documents(spark):
    assert xliffize.documents(rows_of(spark, {0: "<a/>"}).where("false"), ["a"]).count() == 0
