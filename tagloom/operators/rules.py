"""Rule containers of a document: where they are, in which order they apply, what parameters they see."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from dataclasses import dataclass, field

from ..sources.tree import ELT, ITS, XHTML, XLINK, Node, ParseError, parse_xml


@dataclass
class Diagnostics:
    """Messages of one document, in order."""

    rows: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, level: str, code: str, message: str) -> None:
        self.rows.append((level, code, message))

    def warn(self, code: str, message: str) -> None:
        self.add("warning", code, message)


@dataclass
class Rule:
    """One rule: selector, pointers and literal values, with what its container binds."""

    kind: str
    element: Node
    container: Container
    selector: str | None
    pointers: dict[str, str]
    values: dict[str, str]
    child_values: dict[str, str]
    prefixes: dict[str, str]

    @property
    def params(self) -> dict[str, str]:
        return self.container.params


@dataclass
class Container:
    """One ``its:rules`` element."""

    element: Node
    uri: str
    params: dict[str, str]
    script: Node | None = None
    rules: list[Rule] = field(default_factory=list)

    @property
    def version(self) -> str | None:
        return self.element.att("version")

    @property
    def query_language(self) -> str:
        return self.element.att("queryLanguage") or "xpath"


def is_pointer(kind: str, name: str) -> bool:
    return (name.endswith("Pointer") and name != "Pointer") or (kind == "idValue" and name == "idValue")


def read_rule(el: Node, container: Container, notes: Diagnostics) -> Rule:
    """A rule from its element, whose local name must end in ``Rule``."""
    if not el.local.endswith("Rule"):
        raise ValueError(f"{el.name} is no rule")
    kind = el.local.removesuffix("Rule")
    atts = {a.name: a.value for a in el.attrs}
    selector = atts.get("selector")
    if selector is None:
        notes.warn("no_selector", f"{el.name} has no selector")
    pointers = {n: atts[n] for n in sorted(atts) if is_pointer(kind, n)}
    values = {n: atts[n] for n in sorted(atts) if n not in pointers and n != "selector" and "xmlns" not in n}
    inner = {c.local: c.text() for c in el.elements()}
    return Rule(kind, el, container, selector, pointers, values, inner, el.scope())


def _container(el: Node, uri: str, inherited: Mapping[str, str], notes: Diagnostics, script: Node | None = None) -> Container:
    params = dict(inherited)
    for c in el.elements():
        if not (c.ns == ITS and c.local == "param"):
            break
        params[c.att("name") or ""] = c.text()
    out = Container(el, uri, params, script)
    # other elements in a container are none of its business
    out.rules = [read_rule(c, out, notes) for c in el.elements(ns=ITS) if c.local.endswith("Rule")]
    return out


def _included(href: str, base: str, files: Mapping[str, str], params: Mapping[str, str], seen: tuple[str, ...], notes: Diagnostics) -> list[Container]:
    uri = posixpath.normpath(posixpath.join(posixpath.dirname(base), href))
    if uri in seen:
        notes.warn("include_cycle", f"{uri} includes itself")
        return []
    if uri not in files:
        notes.warn("include_missing", f"cannot read {uri}")
        return []
    try:
        doc = parse_xml(files[uri])
    except ParseError as e:
        notes.warn("include_malformed", f"{uri}: {e}")
        return []
    return xml_containers(doc, uri, files, params, (*seen, uri), notes)


def xml_containers(doc: Node, uri: str = "", files: Mapping[str, str] | None = None, params: Mapping[str, str] | None = None, seen: tuple[str, ...] = (), notes: Diagnostics | None = None) -> list[Container]:
    """Containers of an XML document, included ones first; parameters pass down, never sideways."""
    notes = notes if notes is not None else Diagnostics()
    out: list[Container] = []
    for el in doc.walk():
        if el.kind == ELT and el.ns == ITS and el.local == "rules":
            own = _container(el, uri, params or {}, notes)
            href = el.att("href", XLINK)
            if href:
                out.extend(_included(href, uri, files or {}, own.params, seen or (uri,), notes))
            out.append(own)
    return out


def html_containers(doc: Node, uri: str = "", files: Mapping[str, str] | None = None, notes: Diagnostics | None = None) -> list[Container]:
    """Containers of an HTML document: rule scripts and rule links in document order."""
    notes = notes if notes is not None else Diagnostics()
    out: list[Container] = []
    for el in doc.walk():
        if el.kind != ELT or el.ns != XHTML:
            continue
        if el.local == "script" and el.att("type") == "application/its+xml":
            try:
                root = next(c for c in parse_xml(el.text().strip()).children if c.kind == ELT)
            except ParseError as e:
                notes.warn("script_malformed", str(e))
                continue
            if root.ns == ITS and root.local == "rules":
                out.append(_container(root, uri, {}, notes, el))
        elif el.local == "link" and el.att("rel") == "its-rules" and el.parent is not None and el.parent.local == "head":
            out.extend(_included(el.att("href") or "", uri, files or {}, {}, (uri,), notes))
    return out


def containers(doc: Node, kind: str, uri: str = "", files: Mapping[str, str] | None = None, rules_doc: Node | None = None, notes: Diagnostics | None = None) -> list[Container]:
    """Containers in application order; a separate rules document replaces the document's own rules."""
    if rules_doc is not None:
        return xml_containers(rules_doc, uri, files, notes=notes)
    return html_containers(doc, uri, files, notes) if kind == "html" else xml_containers(doc, uri, files, notes=notes)
