"""Conversions of one document: XML and XLIFF to HTML, XML to XLIFF, HTML with all rules inside.

Matches are evaluated on the unchanged document; the converted tree is derived
from it, together with a map from old nodes to new ones, and rules are written
anew against the result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from ..sources.tree import ATT, COM, DOC, ELT, ITS, ITSX, NS, PI, TXT, XHTML, XLIFF, XML, Node, element, parse_html, parse_xml, to_html, to_xml
from .match import Match, literal_xpath, match_all, merged
from .paths import path, shown
from .rules import Container, Diagnostics, containers, html_containers

#: Names and texts that readers of the output look for.
ATT_CLASS, PI_CLASS, NS_CLASS = "_ITS_ATT", "_ITS_PI", "_ITS_NS"
ID_PREFIX = "ITS_"
EMPTY_LABEL = ("ITS_LABEL ITS_EMPTY_TARGET", "Target is empty")
SAME_LABEL = ("ITS_LABEL ITS_DUP_TARGET", "Target is duplicate of source with the same ITS metadata inside")
VISIBLE = "body {visibility:hidden} p {visibility: visible}"
TERM = ("term", "termInfo", "termInfoRef", "termConfidence")
NOTE = ("locNote", "locNoteType")
INLINE = frozenset("g x bx ex bpt ept sub it ph mrk".split())


class ConversionError(ValueError):
    """A document that this conversion does not take."""


def camel_to_dash(name: str) -> str:
    """``locNoteType`` to ``its-loc-note-type``."""
    return "its-" + re.sub("([A-Z])", r"-\1", name).lower()


def _root(doc: Node) -> Node:
    return next(c for c in doc.children if c.kind == ELT)


class _ToHtml:
    """What both HTML conversions share: synthesized elements, identifiers, rewritten rules."""

    def __init__(self, title: str):
        self.title = title
        self.notes = Diagnostics()
        self.new: dict[int, Node] = {}
        self.standoff: list[Node] = []
        self.made: list[tuple[Node, str]] = []
        self.extra: list[tuple[str, Node, dict[str, Node | str]]] = []
        self.ids = 0

    def log(self, message: str) -> None:
        self.notes.add("debug", "convert", message)

    def prepare(self, text: str, uri: str, files: Mapping[str, str]) -> None:
        self.doc = parse_xml(text)
        self.root = _root(self.doc)
        if self.root.ns == ITS and self.root.local == "rules":
            raise ConversionError("the document holds rules only")
        boxes = containers(self.doc, "xml", uri, files, notes=self.notes)
        self.matches = match_all(boxes, self.doc, False, self.notes, frozenset(["preserveSpace"]))
        for m in self.matches:
            self.log("matched " + self._told(m))

    @staticmethod
    def _told(m: Match) -> str:
        pointers = "".join(f"; {n}={shown(v) if isinstance(v, Node) else v}" for n, v in sorted(m.pointers.items()))
        return f"<{m.rule.element.name}> on {shown(m.node)}{pointers}"

    def synthesize(self, old: Node, host: Node, value: str, title: str, kind: str, first: bool) -> Node:
        span = element("span", XHTML, {"title": title, "class": kind, "its-within-text": "no"}, value)
        host.add(span, 0 if first else None)
        self.new[id(old)] = span
        self.made.append((span, kind))
        return span

    def realize(self, top: Node) -> None:
        """Elements for matched nodes that HTML has no place for; equal namespace declarations become one."""
        named: dict[tuple[str, str], Node] = {}
        wanted = {id(t): t for m in self.matches for t in (m.node, *m.pointers.values()) if isinstance(t, Node) and t.kind in (ATT, PI, NS) and id(t) not in self.new}
        for t in sorted(wanted.values(), key=lambda n: (n.name, n.pre)):
            if t.kind == ATT:
                if id(t.parent) in self.new:
                    self.synthesize(t, self.new[id(t.parent)], t.value, t.name, ATT_CLASS, True)
            elif t.kind == PI:
                host = self.new.get(id(t.parent)) or top
                self.synthesize(t, host, t.value, t.name, PI_CLASS, False)
            elif (t.name, t.value) in named:
                self.new[id(t)] = named[t.name, t.value]
            else:
                title = f"xmlns:{t.name}" if t.name else "xmlns"
                named[t.name, t.value] = self.synthesize(t, top, t.value, title, NS_CLASS, True)

    def identify(self, el: Node) -> str:
        own = el.att("id")
        if own is None:
            self.ids += 1
            own = f"{ID_PREFIX}{self.ids}"
            el.set("id", own)
            self.log(f"<{el.name}> is now known as {own}")
        return own

    def expression(self, target: Node | str | float | bool) -> str:
        """An XPath of a match's part in the new document."""
        if not isinstance(target, Node):
            return literal_xpath(target)
        if target.kind == DOC:
            return "/"
        new = self.new.get(id(target))
        if new is None:
            return path(target)
        return f"id('{self.identify(new)}')" if new.kind == ELT else path(new)

    def skeleton(self, top: Node) -> Node:
        doc = Node(DOC, "#document")
        html = doc.add(element("html", XHTML))
        head = html.add(element("head", XHTML))
        head.add(element("meta", XHTML, {"charset": "utf-8"}))
        head.add(element("title", XHTML, text=self.title))
        for s in self.standoff:
            script = element("script", XHTML, {"type": "application/its+xml"})
            if s.att("id", XML):
                script.set("id", s.att("id", XML))
            own = s.copy()
            own.decls = self.outer_scope(s) | own.decls
            script.add(own)
            head.add(script)
        html.add(element("body", XHTML)).add(top)
        return doc

    @staticmethod
    def outer_scope(el: Node) -> dict[str, str]:
        used = {n.prefix for e in el.walk() if e.kind == ELT for n in (e, *e.attrs)} - {"xml"}
        return {p: u for p, u in el.scope().items() if p in used}

    def add_rules(self, doc: Node, middle: list[Node]) -> None:
        """The script of all rules: corrections first, then one rule for each match."""
        rules = Node(ELT, "its:rules", ITS)
        rules.decls = {"its": ITS, "h": XHTML}
        rules.set("version", "2.0")
        own = [self._rewritten(m) for m in self.matches]
        for kind, node, pointers in self.extra:
            atts = {"selector": self.expression(node)} | {n: self.expression(t) for n, t in pointers.items()}
            own.append(element(f"its:{kind}Rule", ITS, atts))
        made = sorted(self.made, key=lambda x: x[1] != ATT_CLASS)
        synthesized = []
        if made:
            where = "|".join(f"id('{self.identify(e)}')" for e, _ in made)
            others = "|".join(f"id('{self.identify(e)}')" for e, k in made if k != ATT_CLASS)
            if others:
                synthesized += [element("its:dirRule", ITS, {"selector": others, "dir": "ltr"}), element("its:localeFilterRule", ITS, {"selector": others, "localeFilterList": "*", "localeFilterType": "include"})]
            synthesized.append(element("its:translateRule", ITS, {"selector": where, "translate": "no"}))
        first = [
            element("its:localeFilterRule", ITS, {"selector": "//@*", "localeFilterList": "*", "localeFilterType": "include"}),
            element("its:dirRule", ITS, {"selector": "//@*", "dir": "ltr"}),
            element("its:translateRule", ITS, {"selector": "//@*", "translate": "no"}),
        ]
        for r in self.ordered(first, middle, synthesized, own):
            rules.append_text("\n")
            rules.add(r)
        rules.append_text("\n")
        head = _root(doc).elements("head")[0]
        script = element("script", XHTML, {"type": "application/its+xml"})
        script.add(rules)
        head.add(script)

    @staticmethod
    def ordered(first, middle, synthesized, own):
        return [*first, *middle, *synthesized, *own]

    def _rewritten(self, m: Match) -> Node:
        out = m.rule.element.copy()
        out.set("selector", self.expression(m.node))
        for name in m.rule.pointers:
            if name in m.pointers:
                out.set(name, self.expression(m.pointers[name]))
            else:
                out.attrs = [a for a in out.attrs if a.name != name]
        self.log(f"<{out.name}> written for what {self._told(m)} found")
        return out

    def copy_rest(self, old: Node, host: Node) -> Node | None:
        """Text and comments as they are; instructions are no HTML."""
        if old.kind in (TXT, COM):
            new = Node(old.kind, old.name, "", old.value)
            self.new[id(old)] = host.add(new)
            return new
        return None


class XmlToHtml(_ToHtml):
    """XML with markup to HTML5 with the same metadata."""

    def convert(self, text: str, uri: str = "", files: Mapping[str, str] | None = None) -> str:
        self.prepare(text, uri, files or {})
        top = self._element(self.root, False)
        if top is None:
            raise ConversionError("the document holds standoff markup only")
        self.realize(top)
        doc = self.skeleton(top)
        self.add_rules(doc, [element("its:withinTextRule", ITS, {"selector": "//h:span", "withinText": "no"})])
        return to_html(doc)

    def _element(self, old: Node, in_bdo: bool, at: int | None = None) -> Node | None:
        is_span = old.ns == ITS and old.local == "span"
        if old.ns == ITS and not is_span:
            if old.local != "rules":
                self.standoff.append(old)
            return None
        new = Node(ELT, "", XHTML)
        self.new[id(old)] = new
        name, saved = self._attributes(old, new, is_span)
        new.set("title", old.name)
        holds_div = False
        for i, c in enumerate(old.children):
            if c.kind == ELT:
                child = self._element(c, name == "bdo", i)
                if child is not None:
                    new.add(child)
                    holds_div |= child.name == "div"
            else:
                self.copy_rest(c, new)
        if not name:
            if holds_div:
                if is_span:
                    self.notes.warn("span_to_div", f"{shown(old)} holds a division and becomes one")
                name = "div"
            else:
                name = "span" if is_span or in_bdo or not old.block(at) else "div"
        new.name = name
        for a in sorted(saved, key=lambda a: (a.name, a.pre)):
            self.synthesize(a, new, a.value, a.name, ATT_CLASS, True)
        return new

    def _attributes(self, old: Node, new: Node, is_span: bool) -> tuple[str, list[Node]]:
        """The name that an override of direction asks for, and attributes without an HTML form."""
        name, saved = "", []
        for a in old.attrs:
            if a.ns == XML:
                if a.local in ("id", "lang"):
                    new.set(a.local, a.value)
                elif a.local != "space":
                    saved.append(a)
            elif a.ns == ITS or (is_span and not a.ns):
                if a.local == "translate":
                    new.set("translate", a.value)
                elif a.local == "dir":
                    override = {"lro": "ltr", "rlo": "rtl"}.get(a.value)
                    name = "bdo" if override else name
                    new.set("dir", override or a.value)
                elif a.local != "version":
                    new.set(camel_to_dash(a.local), a.value)
            else:
                saved.append(a)
        return name, saved


class XliffToHtml(_ToHtml):
    """XLIFF 1.2 to HTML5, with labels on units whose target is empty or repeats the source."""

    def __init__(self, title: str, labels: bool = False):
        super().__init__(title)
        self.labels = labels
        self.infos: list[tuple[str, Node]] = []

    def convert(self, text: str, uri: str = "", files: Mapping[str, str] | None = None) -> str:
        self.prepare(text, uri, files or {})
        top = self._element(self.root)
        if top is None:
            raise ConversionError("the document holds standoff markup only")
        for info, host in self.infos:
            div = element("div", XHTML, {"title": "termInfo"}, info)
            top.add(div)
            host.set("its-term-info-ref", f"#{self.identify(div)}")
        self.realize(top)
        if self.labels:
            self._label(top)
        doc = self.skeleton(top)
        rule = element("its:targetPointerRule", ITS, {"selector": "//*[@title='source']", "targetPointer": "../*[@title='target']"})
        self.add_rules(doc, [rule])
        _root(doc).elements("head")[0].add(element("style", XHTML, text=VISIBLE))
        return to_html(doc)

    @staticmethod
    def ordered(first, middle, synthesized, own):
        return [*first, *synthesized, *middle, *own]

    def _element(self, old: Node) -> Node | None:
        if old.ns == ITS:
            if old.local not in ("rules", "span"):
                self.standoff.append(old)
            return None
        new = Node(ELT, "p" if old.local in ("source", "target") else "span" if old.local in INLINE else "div", XHTML)
        self.new[id(old)] = new
        saved = self._attributes(old, new)
        new.set("title", old.name)
        if old.local == "sub" and old.ns == XLIFF:
            new.set("its-within-text", "nested")
        for c in old.children:
            if c.kind == ELT:
                child = self._element(c)
                if child is not None:
                    new.add(child)
            else:
                self.copy_rest(c, new)
        for a in saved:
            if a.local == "resname":
                self.extra.append(("idValue", old, {"idValue": a.value}))
                continue
            self.synthesize(a, new, a.value, a.name, ATT_CLASS, True)
            self.extra.append((a.local.removesuffix("s"), old, {f"{a.local.removesuffix('s')}Pointer": a}))
        self._notes(old)
        return new

    def _notes(self, old: Node) -> None:
        for note in old.elements("note"):
            whom = note.att("annotates") or "general"
            if whom not in ("general", "source", "target"):
                self.notes.warn("note_target", f"{shown(note)} annotates {whom}")
                continue
            host = old if whom == "general" else next(iter(old.elements(whom)), None)
            if host is None:
                self.notes.warn("note_target", f"{shown(note)} annotates a missing {whom}")
                continue
            priority = note.att("priority") or "1"
            new = self.new[id(host)]
            new.set("its-loc-note", note.text())
            new.set("its-loc-note-type", "description" if priority.isdecimal() and int(priority) > 1 else "alert")

    def _attributes(self, old: Node, new: Node) -> list[Node]:
        saved = []
        mtype = {"protected": ("translate", "no"), "x-its-translate-yes": ("translate", "yes"), "term": ("its-term", "yes"), "x-its-term-no": ("its-term", "no")}
        for a in old.attrs:
            if a.ns == XML and a.local in ("id", "lang"):
                new.set(a.local, a.value)
            elif a.ns == ITS:
                if a.local != "version":
                    new.set(camel_to_dash(a.local), a.value)
            elif a.ns == ITSX:
                if a.local in ("domains", "externalResourceRef"):
                    saved.append(a)
                elif a.local == "termInfo":
                    self.infos.append((a.value, new))
                else:
                    new.set(camel_to_dash(a.local), a.value)
            elif not a.ns and a.local == "translate":
                new.set("translate", a.value)
            elif not a.ns and a.local == "mtype":
                if a.value in mtype:
                    new.set(*mtype[a.value])
            elif not a.ns and a.local == "comment":
                new.set("its-loc-note", a.value)
            elif not a.ns and a.local == "resname":
                saved.append(a)
        return saved

    def _label(self, top: Node) -> None:
        meta: dict[int, dict[str, str]] = {}
        for old, its in merged(self.matches).items():
            if old in self.new:
                meta[id(self.new[old])] = its
        units = [n for n in top.walk() if n.kind == ELT and n.att("title") is not None and n.att("title").rpartition(":")[2] == "trans-unit"]
        for unit in units:
            pick = lambda name: next((c for c in unit.elements() if (c.att("title") or "").rpartition(":")[2] == name), None)  # noqa: B023, E731
            source, target = pick("source"), pick("target")
            if target is None:
                continue
            if target.text() == "":
                self._new_label(unit, *EMPTY_LABEL)
            if source is not None and self._alike(source, target, meta, True):
                self._new_label(unit, *SAME_LABEL)

    def _new_label(self, unit: Node, kind: str, text: str) -> None:
        label = unit.add(element("p", XHTML, {"class": kind}, text), 0)
        self.made.append((label, "label"))

    def _alike(self, a: Node, b: Node, meta: dict[int, dict[str, str]], top: bool = False) -> bool:
        """Same names, texts, attributes and metadata all the way down; identifiers and the outer title aside."""
        skip = {"id"} | ({"title"} if top else set())
        atts = lambda n: {x.name: x.value for x in n.attrs if x.name not in skip}
        kids = lambda n: [c for c in n.children if c.kind == ELT]
        if a.name != b.name or a.text() != b.text() or atts(a) != atts(b) or meta.get(id(a), {}) != meta.get(id(b), {}) or len(kids(a)) != len(kids(b)):
            return False
        return all(self._alike(x, y, meta) for x, y in zip(kids(a), kids(b), strict=True))


class XmlToXliff:
    """XML to XLIFF 1.2 translation units, by the markup's own rules or by named groups and units."""

    def __init__(self, source_language: str = "en"):
        self.notes = Diagnostics()
        self.source_language = source_language

    def convert(self, text: str, uri: str = "", files: Mapping[str, str] | None = None, group: list[str] | None = None, tu: list[str] | None = None) -> str:
        doc = parse_xml(text)
        root = _root(doc)
        if root.ns == ITS and root.local != "span":
            raise ConversionError("the document holds rules or standoff markup only")
        if group is not None and not tu:
            raise ConversionError("groups need the names of units")
        boxes = containers(doc, "xml", uri, files or {}, notes=self.notes)
        self.its = merged(match_all(boxes, doc, False, self.notes))
        self.standoff: list[Node] = []
        self.units: list[Node] = []
        self.pending: list[tuple[Node, Node]] = []
        if tu:
            body = self._custom(root, group or [], tu)
        else:
            self._segment(root)
            for unit, source in self.pending:
                self._finish(unit, source)
            body = self.units
        return self._skeleton(body, uri)

    def _skeleton(self, body: list[Node], uri: str) -> str:
        top = element("xliff", XLIFF)
        top.decls = {"": XLIFF, "its": ITS, "itsxlf": ITSX}
        top.set("its:version", "2.0", ITS)
        file = top.add(element("file", XLIFF, {"datatype": "plaintext", "original": uri or "STRING", "source-language": self.source_language}))
        if self.standoff:
            head = file.add(element("header", XLIFF))
            for s in self.standoff:
                own = s.copy()
                own.decls = {p: u for p, u in (_ToHtml.outer_scope(s) | own.decls).items() if p != "its"}
                head.add(own)
        inner = file.add(element("body", XLIFF))
        for n in body:
            inner.add(n)
        return '<?xml version="1.0" encoding="utf-8"?>\n' + to_xml(top)

    # the markup's own segmentation
    def _within(self, el: Node) -> str:
        return el.att("withinText") or "no" if el.ns == ITS and el.local == "span" else el.att("withinText", ITS) or ("yes" if el.ns == ITS and el.local == "span" else "no")

    def _segment(self, el: Node) -> None:
        """Units of an element that breaks the flow, then those of what it holds, in document order of their starts."""
        if el.ns == ITS and el.local != "span":
            if el.local != "rules":
                self.standoff.append(el)
            return
        place: Node | None = None
        later: list[Node] = []
        for c in el.children:
            if c.kind == TXT:
                if place is None and c.value.strip():
                    place = self._open(el)
                if place is not None:
                    place.append_text(c.value)
            elif c.kind == ELT and c.ns == ITS and c.local != "span":
                if c.local != "rules":
                    self.standoff.append(c)
            elif c.kind == ELT and self._within(c) == "yes":
                if place is None and c.text().strip():
                    place = self._open(el)
                if place is not None:
                    mark = place.add(element("mrk", XLIFF))
                    self._flow_inline(c, mark, later)
                    self._dress(c, mark, None, inline=True)
            elif c.kind == ELT and self._within(c) == "nested":
                if place is not None:
                    place.append_text(" ")
                later.append(c)
            elif c.kind == ELT:
                self._drain(later)
                place = None
                self._segment(c)
        self._drain(later)

    def _flow_inline(self, el: Node, mark: Node, later: list[Node]) -> None:
        for c in el.children:
            if c.kind == TXT:
                mark.append_text(c.value)
            elif c.kind == ELT:
                if c.ns == ITS and c.local != "span":
                    if c.local != "rules":
                        self.standoff.append(c)
                elif self._within(c) == "yes":
                    inner = mark.add(element("mrk", XLIFF))
                    self._flow_inline(c, inner, later)
                    self._dress(c, inner, None, inline=True)
                else:
                    if self._within(c) == "nested":
                        mark.append_text(" ")
                    later.append(c)

    def _drain(self, later: list[Node]) -> None:
        while later:
            self._segment(later.pop(0))

    def _open(self, el: Node) -> Node:
        """A new unit for direct text of ``el``; returns where its text goes."""
        unit = element("trans-unit", XLIFF)
        source = unit.add(element("source", XLIFF))
        self.units.append(unit)
        place = self._dress(el, source, unit, inline=False)
        self.pending.append((unit, source))
        return place

    def _finish(self, unit: Node, source: Node) -> None:
        target = source.copy()
        target.name = "target"
        target.attrs.insert(0, _attribute("state", "new"))
        target.attrs[0].parent = target
        unit.add(target, unit.children.index(source) + 1)

    # metadata
    def _dress(self, el: Node, new: Node, unit: Node | None, inline: bool) -> Node:
        """Put an element's metadata on its unit and source, or on its inline mark; returns where text goes."""
        its = self.its.get(id(el), {})
        bare = el.ns == ITS and el.local == "span"
        local = {a.local: a.value for a in el.attrs if a.ns == ITS or (bare and not a.ns)}
        for group in (TERM, NOTE):
            if any(n in local for n in group):
                its = {n: v for n, v in its.items() if n not in group}
        get = lambda name: local.get(name, its.get(name))
        place = new
        term = get("term")
        if term is not None or (inline and any(get(n) is not None for n in TERM)):
            mark = new if inline else new.add(element("mrk", XLIFF))
            place = mark
            mark.set("mtype", "term" if term == "yes" or term is None else "x-its-term-no")
            for n in TERM[1:]:
                value = get(n)
                if value is not None:
                    mark.set(f"itsxlf:{n}", value, ITSX)
        translate = get("translate")
        if translate is not None:
            if not inline:
                unit.set("translate", translate)
            elif new.att("mtype") is None:
                new.set("mtype", "x-its-translate-yes" if translate == "yes" else "protected")
        note = get("locNote")
        if note is not None:
            kind = get("locNoteType")
            if inline:
                new.set("comment", note)
                new.set("itsxlf:locNoteType", kind or "description", ITSX)
            else:
                unit.add(element("note", XLIFF, {"priority": "1" if kind == "alert" else "2"}, note))
        name = el.att("id", XML) or its.get("idValue")
        if name is not None and not inline:
            unit.set("resname", name)
        used = {*TERM, *NOTE, "translate", "version", "withinText"}
        for n, v in local.items():
            if n not in used:
                new.set(f"its:{n}", v, ITS)
        if inline and new.att("mtype") is None:
            new.attrs.insert(0, _attribute("mtype", "x-its"))
        return place

    # groups and units by name
    def _custom(self, root: Node, group: list[str], tu: list[str]) -> list[Node]:
        out: list[Node] = []
        count = 0

        def standoff(el: Node) -> None:
            for n in el.walk():
                if n.kind == ELT and n.ns == ITS and n.local not in ("rules", "span") and not (n.parent and n.parent.ns == ITS and n.parent.local != "span"):
                    self.standoff.append(n)

        def outermost(el: Node, names: list[str]) -> list[Node]:
            if el.local in names and el.ns != ITS:
                return [el]
            return [x for c in el.elements() for x in outermost(c, names)]

        standoff(root)
        for g in outermost(root, group) if group else [root]:
            units = []
            for u in outermost(g, tu):
                if u.text().strip():
                    count += 1
                    units.append(self._unit(u, count))
            if units:
                box = element("group", XLIFF, {"id": str(len(out) + 1)})
                for u in units:
                    box.add(u)
                out.append(box)
        return out

    def _unit(self, el: Node, number: int) -> Node:
        unit = element("trans-unit", XLIFF, {"id": str(number)})
        source = unit.add(element("source", XLIFF))
        place = self._dress(el, source, unit, inline=False)
        inner = 0
        for c in el.children:
            if c.kind == TXT:
                place.append_text(c.value)
            elif c.kind == ELT and not (c.ns == ITS and c.local != "span"):
                inner += 1
                keys = set(self.its.get(id(c), {})) - {"idValue"}
                if keys or any(a for a in c.attrs if not (a.ns == XML and a.local == "id") and not (a.ns == ITS and a.local == "withinText")):
                    mark = place.add(element("mrk", XLIFF))
                    self._dress(c, mark, None, inline=True)
                    mark.add(element("ph", XLIFF, {"id": str(inner)}, to_xml(_plain(c, True))))
                else:
                    place.add(element("ph", XLIFF, {"id": str(inner)}, to_xml(_plain(c, False))))
        self._finish(unit, source)
        return unit


def _attribute(name: str, value: str) -> Node:
    return Node(ATT, name, "", value)


def _plain(el: Node, moved: bool) -> Node:
    """A copy to be shown as text; attributes that moved to a mark are gone, and with them unused declarations."""
    out = el.copy()
    out.attrs = [] if moved else [a for a in out.attrs if not (a.ns == ITS and a.local == "withinText")]
    used = {x.prefix for n in out.walk() if n.kind == ELT for x in (n, *n.attrs)}
    for n in out.walk():
        n.decls = {p: u for p, u in n.decls.items() if p in used or u != ITS}
    return out


def xml_to_html(text: str, title: str = "Document", uri: str = "", files: Mapping[str, str] | None = None) -> tuple[str, Diagnostics]:
    c = XmlToHtml(title)
    return c.convert(text, uri, files), c.notes


def xliff_to_html(text: str, title: str = "Document", labels: bool = True, uri: str = "", files: Mapping[str, str] | None = None) -> tuple[str, Diagnostics]:
    c = XliffToHtml(title, labels)
    return c.convert(text, uri, files), c.notes


def xml_to_xliff(text: str, uri: str = "", files: Mapping[str, str] | None = None, group: list[str] | None = None, tu: list[str] | None = None) -> tuple[str, Diagnostics]:
    c = XmlToXliff()
    out = c.convert(text, uri, files, group, tu)
    return out, c.notes


def reduce_html(text: str, uri: str = "", files: Mapping[str, str] | None = None) -> tuple[str, Diagnostics]:
    """HTML whose rules all stand in head scripts, in application order, with their parameters resolved."""
    notes = Diagnostics()
    doc = parse_html(text)
    boxes = html_containers(doc, uri, files or {}, notes)
    own = {id(b.script) for b in boxes if b.script is not None}
    for el in list(doc.walk()):
        link = el.kind == ELT and el.local == "link" and el.att("rel") == "its-rules"
        if link:
            notes.add("debug", "reduce", f"link {el.att('href')} left out")
        if link or id(el) in own:
            el.parent.children = [c for c in el.parent.children if c is not el]
    head = _root(doc).elements("head")
    head = head[0] if head else _root(doc).add(element("head", XHTML), 0)
    for b in boxes:
        head.add(_script(b))
        notes.add("debug", "reduce", f"rules {b.element.att('id', XML) or 'without an id'} now stand in the head")
    return to_html(doc), notes


def _script(box: Container) -> Node:
    rules = box.element.copy()
    rules.decls = box.element.scope() | rules.decls
    rules.children = [c for c in rules.children if not (c.kind == ELT and c.ns == ITS and c.local == "param")]
    for i, (name, value) in enumerate(sorted(box.params.items())):
        rules.add(element("its:param", ITS, {"name": name}, value), i)
    script = element("script", XHTML, {"type": "application/its+xml"})
    if box.element.att("id", XML):
        script.set("id", box.element.att("id", XML))
    script.add(rules)
    return script
