"""Unique paths, label paths, edits and block decisions over node rows, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.xpath_tree import Context, evaluate
from tagloom.operators import ancestry, blocks, edits, staircase
from tagloom.operators.xpath_any import evaluate_nodes
from tagloom.operators.xpath_plan import select
from tagloom.sources.shred import shred
from tagloom.sources.stored import store
from tagloom.sources.tree import ATT, DOC, ELT, TXT, Node, parse_xml


def rows_of(spark, texts, kind="xml"):
    return store(shred(spark.createDataFrame([(i, kind, t) for i, t in texts.items()], "doc_id long, doc_type string, content string")))


def grown(rnd, depth=0):
    if depth > 6 or rnd.random() < 0.25:
        return rnd.choice(["x", "yy", "", "<e/>", "<!--c-->", "<?go on?>", "<e k='1' m='2'>z</e>"])
    name, inner = rnd.choice("abc"), "".join(grown(rnd, depth + 1) for _ in range(rnd.randrange(5)))
    att = rnd.choice(["", f' k="{rnd.randrange(3)}"', ' k="1" m="x"', ' xmlns:n="u" n:k="2"', ' xmlns="v"'])
    return f"<{name}{att}>{inner}</{name}>"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(12)
    out = {i: f"<a>{''.join(grown(rnd) for _ in range(6))}</a>" for i in range(25)}
    out[25] = "<a>" + "<b><c>x</c><c k='1'>yy</c></b>" * 2500 + "</a>"
    out[26] = "<a>" * 70 + "deep" + "</a>" * 70
    out[27] = "<a/>"
    return out


@pytest.fixture(scope="module")
def nodes(spark, texts):
    return rows_of(spark, texts)


def test_unique_paths_are_those_of_the_shredder(nodes):
    found = ancestry.unique_paths(nodes)
    assert found.count() == nodes.count()
    wrong = found.join(nodes.select("doc_id", "pre", F.col("path").alias("want")), ["doc_id", "pre"]).where("not path <=> want")
    assert wrong.count() == 0


def test_unique_paths_select_their_node(nodes, texts):
    found = {(r.doc_id, r.pre): r.path for r in ancestry.unique_paths(nodes).where("doc_id < 12").collect()}
    for i in range(12):
        tree = parse_xml(texts[i])
        for n in tree.walk():
            path = found[i, n.pre]
            if n.kind != ATT or not n.ns:  # a prefix needs its binding
                hits = evaluate(path, tree, 1, 1, Context(tree, {}, {}))
                assert [h.pre for h in hits] == [n.pre], path


def test_unique_paths_of_ranges_in_many_batches(spark):
    # children of all sorts on both sides of ends of ranges, in a namespace too, beside documents of one range
    inner = "".join(f"<b k='{i}'><?go {i}?>x<!--c--><n:b xmlns:n='u' n:k='2' m='1'><c/>y<d/>z</n:b></b>" + "<!--e-->" * (i == 900) for i in range(1200))
    texts = {0: f"<!--top--><a xmlns='v'>{inner}</a><?end on?>", 1: "<a><b/>x<b/></a>", 2: f"<a><w>{inner}</w><b/><w><c/></w></a>"}
    rows = rows_of(spark, texts)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found, again = store(ancestry.unique_paths(rows)), store(ancestry.labelled(rows.drop("labels", "nth")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found.count() == again.count() == rows.count() > 5 * staircase.RANGE
    assert rows.join(found.withColumnRenamed("path", "found"), ["doc_id", "pre"]).where("path <=> found").count() == rows.count()
    both = rows.join(again.select("doc_id", "pre", F.col("labels").alias("l"), F.col("nth").alias("n")), ["doc_id", "pre"])
    assert both.where("labels <=> l and nth <=> n").count() == rows.count()


def test_a_node_without_its_parent_begins_its_way(nodes):
    found = {r.pre: r.path for r in ancestry.unique_paths(nodes.where("doc_id = 1 and pre > 1")).collect()}
    assert len(found) == nodes.where("doc_id = 1 and pre > 1").count() and all(p.count("/") >= 1 for p in found.values())


def test_paths_without_rows(nodes):
    assert ancestry.unique_paths(nodes.where("false")).count() == 0


def test_labels_again(nodes):
    again = ancestry.labelled(nodes.drop("labels", "nth")).select("doc_id", "pre", F.col("labels").alias("l"), F.col("nth").alias("n"))
    assert again.count() == nodes.count()
    assert nodes.join(again, ["doc_id", "pre"]).where("not (labels <=> l and nth <=> n)").count() == 0


EDIT = "doc_id long, op string, pre long, place string, target long, seq long, qname string, text string, attrs map<string,string>"


def plain_edits(doc, own):
    """The edited tree and the edits that have no effect, one edit at a time on a tree in memory."""
    by = {n.pre: n for n in doc.walk()}
    rejected, cands = [], {}
    for e in own:
        t = by.get(e["target"]) if e["target"] is not None else None
        if e["op"] != "insert":
            n = by.get(e["pre"])
            if n is None or n.kind == DOC or (e["op"] == "move" and n.kind == ATT):
                rejected.append(e)
                continue
        if e["op"] != "delete":
            ok = t is not None and (t.kind in (ELT, DOC) if e["place"] in ("first", "last") else t.kind not in (ATT, DOC))
            if not ok or (e["op"] == "insert" and e["qname"] is None):
                rejected.append(e)
                continue
            e = {**e, "host": t if e["place"] in ("first", "last") else t.parent}
            e["at"] = 0 if e["place"] == "first" else len(t.children) if e["place"] == "last" else next(i for i, c in enumerate(t.parent.children) if c is t) + (e["place"] == "after")
        cands[e["op"] == "insert", e["pre"] if e["op"] != "insert" else e["seq"]] = max(cands.get((e["op"] == "insert", e["pre"] if e["op"] != "insert" else e["seq"]), e), e, key=lambda x: x["seq"])
    roots = {pre: e for (ins, pre), e in cands.items() if not ins}
    rejected += [e for e in own if e["op"] != "insert" and e["pre"] in roots and roots[e["pre"]]["seq"] != e["seq"] and e not in rejected]

    def above(n):
        while n is not None:
            yield n
            n = n.parent

    bad = [p for p, e in roots.items() if e["op"] == "move" and any(a.pre in roots for a in above(e["host"]))]
    rejected += [roots.pop(p) for p in bad]
    at = {}
    for e in [*roots.values(), *(e for (ins, _), e in cands.items() if ins)]:
        if e["op"] != "delete":
            at.setdefault((e["host"].pre, e["at"]), []).append(e)

    def emit(n):
        new = Node(n.kind, n.name, n.ns, n.value)
        new.decls = dict(n.decls)
        new.attrs = [emit(a) for a in n.attrs if a.pre not in roots]
        for k in range(len(n.children) + 1):
            for e in sorted(at.get((n.pre, k), []), key=lambda x: x["seq"]):
                if e["op"] == "move":
                    new.children.append(emit(by[e["pre"]]))
                else:
                    fresh = Node(ELT, e["qname"], "", None)
                    for name in sorted(e["attrs"] or {}):
                        fresh.set(name, e["attrs"][name])
                    if e["text"] is not None:
                        fresh.children.append(Node(TXT, "#text", "", e["text"]))
                    new.children.append(fresh)
            if k < len(n.children) and n.children[k].pre not in roots:
                new.children.append(emit(n.children[k]))
        return new

    return emit(doc), rejected


def flat(top):
    """(pre, size, level, parent, kind, name, value, t_from, t_to) of a tree, numbered from 0."""
    out, chars = [], 0

    def go(n, level, parent):
        nonlocal chars
        row = [len(out), 1, level, parent, n.kind, n.name if n.kind in (ELT, ATT) else None, n.value if n.kind not in (ELT, DOC) else None, chars, None]
        out.append(row)
        if n.kind == TXT:
            chars += len(n.value)
        for c in [*n.attrs, *n.children]:
            go(c, level + 1, row[0])
        row[1], row[8] = len(out) - row[0], chars
        if n.kind == ATT:
            row[7] = row[8] = None

    go(top, 0, None)
    return [tuple(r) for r in out]


def made_edits(rnd, doc, i):
    every = list(doc.walk())
    out = []
    for k in range(rnd.randrange(1, 9)):
        op = rnd.choice(["delete", "move", "move", "insert", "insert"])
        pre = rnd.choice(every).pre if op != "insert" else None
        place = rnd.choice(["first", "last", "before", "after"]) if op != "delete" else None
        target = rnd.choice(every).pre if op != "delete" else None
        text = rnd.choice([None, "t", "text", ""]) if op == "insert" else None
        attrs = rnd.choice([None, {"k": "v"}, {"z": "1", "b": "2"}]) if op == "insert" else None
        out.append({"doc_id": i, "op": op, "pre": pre, "place": place, "target": target, "seq": k, "qname": "new" if op == "insert" else None, "text": text, "attrs": attrs})
    out.append({"doc_id": i, "op": "delete", "pre": 10**6, "place": None, "target": None, "seq": 99, "qname": None, "text": None, "attrs": None})
    return out


def test_edits_against_a_tree_in_memory(spark, nodes, texts):
    rnd = random.Random(5)
    small = [i for i in texts if i not in (25, 26)]
    trees = {i: parse_xml(texts[i]) for i in small}
    own = {i: made_edits(rnd, trees[i], i) for i in small}
    table = spark.createDataFrame([tuple(e.values()) for es in own.values() for e in es], EDIT)
    mine = nodes.where(F.col("doc_id").isin(small))
    out, lost = {}, {}
    for r in edits.edited(mine, table).collect():
        shown = r.qname if r.kind in (ELT, ATT) else None
        ends = (None, None) if r.kind == ATT else (r.t_from, r.t_to)
        out.setdefault(r.doc_id, []).append((r.pre, r.size, r.level, r.parent, r.kind, shown, r.value if r.kind not in (ELT, DOC) else None, *ends))
    for r in edits.rejected(mine, table).collect():
        lost.setdefault(r.doc_id, set()).add(r.seq)
    for i in small:
        want, rejected = plain_edits(trees[i], own[i])
        assert lost.get(i, set()) == {e["seq"] for e in rejected}, own[i]
        assert sorted(out[i]) == flat(want), own[i]


def test_no_edits_change_nothing(spark, nodes):
    out = edits.edited(nodes, edits.no_edits(spark)).select("doc_id", "pre", *[F.col(c).alias(f"n_{c}") for c in ("size", "level", "parent", "post", "kind")], "old_pre")
    both = nodes.join(out, ["doc_id", "pre"])
    assert both.count() == nodes.count()
    assert both.where("size <> n_size or level <> n_level or not parent <=> n_parent or kind <> n_kind or old_pre <> pre").count() == 0
    assert both.where("post <> n_post").count() == 0


def test_many_moves_to_one_gap(spark, nodes):
    """A third of a document's nodes goes to one place."""
    doc = nodes.where("doc_id = 25")
    moved = doc.where("local_name = 'c' and map_contains_key(attrs, 'k')").selectExpr("doc_id", "'move' as op", "pre", "'first' as place", "1L as target", "-pre as seq", "cast(null as string) as qname", "cast(null as string) as text", "cast(null as map<string,string>) as attrs")
    out = store(edits.edited(doc, moved))
    assert out.count() == doc.count()
    tops = out.where("level = 2 and kind = 'ELT'").orderBy("pre").select("local_name", "old_pre").collect()
    assert [t.local_name for t in tops] == ["c"] * 2500 + ["b"] * 2500
    assert [t.old_pre for t in tops[:2500]] == sorted((t.old_pre for t in tops[:2500]), reverse=True)


def test_edited_rows_answer_expressions(spark, nodes):
    found = select(nodes, "//e/@m")
    out = ancestry.labelled(edits.edited(nodes, edits.elements_for_attributes(nodes, found)))
    assert select(out, "//e/@m").count() == 0
    made = select(out, "//e/m[1]")
    assert made.count() == found.count() > 0
    assert out.where("kind = 'ELT' and local_name = 'e' and ns_uri = '' and map_contains_key(attrs, 'm')").count() == 0
    assert evaluate_nodes(out, "//e/m[.='2']").count() == found.count()


def test_documents_in_one_range_are_edited_without_joins(spark, nodes, texts):
    rnd = random.Random(8)
    small = [i for i in texts if i not in (25, 26)]
    mine = nodes.where(F.col("doc_id").isin(small))
    own = [tuple(e.values()) for i in small for e in made_edits(rnd, parse_xml(texts[i]), i)]
    # more edits than a range has numbers: that document goes by joins
    many = [(27, "insert", None, "first", 1, k, "new", "t", None) for k in range(staircase.RANGE + 1)]
    found = edits.edited(mine, spark.createDataFrame(own, EDIT), labels=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    want = store(ancestry.labelled(edits._joined(mine, spark.createDataFrame(own, EDIT))))
    told = ["doc_id", "pre", "size", "level", "parent", "post", "kind", "qname", "value", "t_from", "t_to", "old_pre", "labels", "nth"]
    rows = lambda df: sorted(df.select(*told, F.to_json("attrs").alias("a")).collect(), key=lambda r: (r.doc_id, r.pre))
    assert [x for x in zip(rows(found), rows(want), strict=True) if x[0] != x[1]] == []
    again = edits.edited(mine, spark.createDataFrame([e for e in own if e[0] != 27] + many, EDIT)).where("doc_id = 27")
    assert again.count() == 2 * len(many) + mine.where("doc_id = 27").count()


def plain_names(doc, bdo, inline):
    out = {}

    def go(n, in_bdo):
        own = n.pre in bdo
        holds = False
        for c in n.children:
            if c.kind == ELT:
                holds |= go(c, own) == "div"
        name = "bdo" if own else "div" if holds else "span" if n.pre in inline or in_bdo or not n.block() else "div"
        out[n.pre] = name
        return name

    go(next(c for c in doc.children if c.kind == ELT), False)
    return out


def test_block_names(spark):
    rnd = random.Random(3)

    def tree(depth=0):
        gap = lambda: rnd.choice(["", "x", "\n", "x\n ", "\n\n"])
        inner = gap() + "".join(tree(depth + 1) + gap() for _ in range(rnd.randrange(4))) if depth < 6 else ""
        return f"<{rnd.choice('ab')}{rnd.choice(['', ' o="1"', ' i="1"', '', ''])}>{inner}</{{}}>".replace("{}", "_")

    import re

    def closed(text):
        out, stack = [], []
        for t in re.findall(r"<[^>]*>|[^<]+", text):
            if t.startswith("</"):
                t = f"</{stack.pop()}>"
            elif t.startswith("<"):
                stack.append(t[1])
            out.append(t)
        return "".join(out)

    texts = {i: closed(tree()) for i in range(60)}
    nodes = rows_of(spark, texts)
    marked = lambda a: nodes.where(F.map_contains_key("attrs", F.lit(a)))
    got = {(r.doc_id, r.pre): r.name for r in blocks.block_names(nodes, marked("o"), marked("i")).collect()}
    want = {}
    for i, t in texts.items():
        doc = parse_xml(t)
        sets = [{n.pre for n in doc.walk() if n.kind == ELT and n.att(a) is not None} for a in "oi"]
        want |= {(i, pre): name for pre, name in plain_names(doc, *sets).items()}
    assert got == want
    assert len(set(want.values())) == 3


def test_bodies_are_those_of_the_conversion(spark):
    import re

    from tagloom.operators import htmlize
    from tagloom.operators.convert import ConversionError, XmlToHtml

    rnd = random.Random(21)
    its = "xmlns:its='http://www.w3.org/2005/11/its'"
    marks = ["", " its:translate='no'", " its:dir='rlo'", " its:dir='ltr' its:term='yes'", " xml:id='i' xml:lang='en' xml:space='preserve'", " k='1 &lt; \"2\"' b='x'", " its:version='2.0' its:locNoteRef='&amp;'"]

    def tree(depth=0):
        gap = lambda: rnd.choice(["", "x &amp; y", "\n", "x\n ", "\n\n", "<!--n-->", "<?p i?>"])
        inner = gap() + "".join(tree(depth + 1) + gap() for _ in range(rnd.randrange(4))) if depth < 5 else ""
        name = rnd.choice(["a", "b", "its:span", "a", "b", "its:standoff"])
        return f"<{name}{rnd.choice(marks)}{rnd.choice(['', chr(32) + 'note=' + chr(34) + 'n' + chr(34)])}>{inner}</{name}>"

    texts = {i: f"<?x y?><!--top--><a {its}>{tree()}\n{tree()}\n</a>" for i in range(60)}
    texts[60], texts[61] = f"<its:standoff {its}>x</its:standoff>", f"<a {its}/>"
    want = {}
    for i, t in texts.items():
        try:
            want[i] = re.search(r"<body>(.*)</body>", XmlToHtml("t").convert(t), re.S)[1]
        except ConversionError:
            continue
    got = {r.doc_id: r.markup for r in htmlize.html_markup(htmlize.bodies(rows_of(spark, texts))).collect()}
    assert got.keys() == want.keys() == texts.keys() - {60}
    for i in want:
        assert got[i] == want[i]
