"""A small in-memory document tree: what one task holds of one document.

XML goes through expat, with prefixes kept; HTML through :mod:`html_tree`.
Everything that spans documents is a DataFrame operation elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from xml.parsers import expat

#: Namespaces of the public standards.
ITS = "http://www.w3.org/2005/11/its"
ITSX = "http://www.w3.org/ns/its-xliff/"
XHTML = "http://www.w3.org/1999/xhtml"
XLIFF = "urn:oasis:names:tc:xliff:document:1.2"
XLINK = "http://www.w3.org/1999/xlink"
XML = "http://www.w3.org/XML/1998/namespace"

DOC, ELT, ATT, TXT, COM, PI, NS = "DOC", "ELT", "ATT", "TXT", "COM", "PI", "NS"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class ParseError(ValueError):
    """A document that is not well formed."""


class Node:
    """One node; attributes and namespace declarations hang off their element and are no children."""

    __slots__ = ("kind", "name", "ns", "value", "parent", "children", "attrs", "decls", "pre")

    def __init__(self, kind: str, name: str = "", ns: str = "", value: str | None = None):
        self.kind, self.name, self.ns, self.value = kind, name, ns, value
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.attrs: list[Node] = []
        self.decls: dict[str, str] = {}
        self.pre = -1

    @property
    def prefix(self) -> str:
        return self.name.partition(":")[0] if ":" in self.name else ""

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    # reading
    def att(self, local: str, ns: str = "") -> str | None:
        return next((a.value for a in self.attrs if a.local == local and a.ns == ns), None)

    def walk(self) -> Iterator[Node]:
        """Itself and its descendants in document order, without attributes."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self, local: str | None = None, ns: str | None = None) -> list[Node]:
        return [c for c in self.children if c.kind == ELT and (local is None or c.local == local) and (ns is None or c.ns == ns)]

    def text(self) -> str:
        """String value."""
        if self.kind in (ELT, DOC):
            return "".join(n.value or "" for n in self.walk() if n.kind == TXT)
        return self.value or ""

    def root(self) -> Node:
        top = self
        while top.parent is not None:
            top = top.parent
        return top

    def scope(self) -> dict[str, str]:
        """In-scope namespaces without the implicit ``xml`` one."""
        chain, at = [], self
        while at is not None:
            chain.append(at.decls)
            at = at.parent
        out: dict[str, str] = {}
        for d in reversed(chain):
            out |= d
        return {p: u for p, u in out.items() if u}

    def block(self, at: int | None = None) -> bool:
        """Block where line ends part it from text on both sides; the root always is. ``at``: its place among its siblings, if known."""
        if self.parent is None or self.parent.kind == DOC:
            return True
        if at is None:
            at = next(i for i, c in enumerate(self.parent.children) if c is self)
        before = self.parent.children[at - 1] if at else None
        after = self.parent.children[at + 1] if at + 1 < len(self.parent.children) else None
        if before is None or after is None or before.kind != TXT or after.kind != TXT:
            return False
        tail = before.value.rstrip(" \t\f\v\r\n")
        head = after.value.lstrip(" \t\f\v\r\n")
        return any(c in "\r\n" for c in before.value[len(tail):]) and any(c in "\r\n" for c in after.value[: len(after.value) - len(head)])

    # building
    def set(self, name: str, value: str, ns: str = "") -> Node:
        local = name.rpartition(":")[2]
        for a in self.attrs:
            if a.local == local and a.ns == ns:
                a.value = value
                return a
        new = Node(ATT, name, ns, value)
        new.parent = self
        self.attrs.append(new)
        return new

    def add(self, child: Node, at: int | None = None) -> Node:
        child.parent = self
        self.children.insert(len(self.children) if at is None else at, child)
        return child

    def append_text(self, text: str) -> None:
        if text:
            if self.children and self.children[-1].kind == TXT:
                self.children[-1].value += text
            else:
                self.add(Node(TXT, "#text", "", text))

    def copy(self, deep: bool = True) -> Node:
        new = Node(self.kind, self.name, self.ns, self.value)
        new.decls = dict(self.decls)
        for a in self.attrs:
            new.set(a.name, a.value, a.ns)
        if deep:
            for c in self.children:
                new.add(c.copy())
        return new

    def rename(self, name: str) -> Node:
        self.name = name
        return self

    def drop_attribute(self, local: str, ns: str = "") -> None:
        self.attrs = [a for a in self.attrs if a.local != local or a.ns != ns]

    def remove(self) -> Node:
        """Take it out of its parent; it stays whole by itself."""
        if self.parent is not None:
            own = "attrs" if self.kind == ATT else "children"
            setattr(self.parent, own, [c for c in getattr(self.parent, own) if c is not self])
            self.parent = None
        return self

    def paste(self, other: Node, where: str = "last_child") -> Node:
        """Move it to a place at ``other``: last_child, first_child, before or after."""
        inside = where in ("last_child", "first_child")
        if not inside and where not in ("before", "after"):
            raise ValueError(f"no place {where}")
        above = other if inside else other.parent
        if above is None:
            raise ValueError("a node without a parent has no place beside it")
        at: Node | None = above
        while at is not None:
            if at is self:
                raise ValueError("a node has no place at itself or below itself")
            at = at.parent
        self.remove()
        if inside:
            return above.add(self, 0 if where == "first_child" else None)
        return above.add(self, next(i for i, c in enumerate(above.children) if c is other) + (where == "after"))

    def set_namespace(self, uri: str, prefix: str = "") -> Node:
        """Declare ``uri`` here for ``prefix`` (none: as the default) and put the element into it."""
        if not uri:
            raise ValueError("a namespace needs a URI")
        self.decls[prefix] = self.ns = uri
        self.name = f"{prefix}:{self.local}" if prefix else self.local
        return self

    def strip_namespace(self) -> Node:
        """Put the element and its attributes into no namespace; children that use its declarations get them."""
        for child in self.elements():
            nodes = [n for n in child.walk() if n.kind == ELT]
            used = {n.prefix for n in nodes} | {a.prefix for n in nodes for a in n.attrs if a.prefix}
            child.decls = {p: u for p, u in self.decls.items() if p in used} | child.decls
        above = self.parent.scope() if self.parent is not None else {}
        self.name, self.ns = self.local, ""
        # no namespace has to be said where an outer default holds
        self.decls = {"": ""} if above.get("") else {}
        attrs, self.attrs = self.attrs, []
        for a in attrs:
            self.set(a.local, a.value)
        return self

    def number(self) -> Node:
        """Give document-order numbers: an element, its attributes, then its children."""
        count = 0
        for node in self.walk():
            node.pre = count
            count += 1
            for a in node.attrs:
                a.pre = count
                count += 1
        return self


def element(name: str, ns: str = "", atts: dict[str, str] | None = None, text: str = "") -> Node:
    out = Node(ELT, name, ns)
    for k, v in (atts or {}).items():
        out.set(k, v)
    out.append_text(text)
    return out


def parse_xml(text: str) -> Node:
    """The document node; CDATA is text. Raises ParseError."""
    doc = Node(DOC, "#document")
    at = [doc]
    parser = expat.ParserCreate()
    parser.ordered_attributes = True
    parser.buffer_text = True

    def resolve(name: str, scope: dict[str, str], default: str) -> str:
        prefix, colon, _ = name.partition(":")
        if not colon:
            return default
        if prefix == "xml":
            return XML
        if prefix not in scope:
            raise ParseError(f"unbound prefix {prefix}")
        return scope[prefix]

    def start(name, flat):
        el = Node(ELT, name)
        at[-1].add(el)
        pairs = list(zip(flat[::2], flat[1::2], strict=True))
        for k, v in pairs:
            if k == "xmlns" or k.startswith("xmlns:"):
                el.decls[k[6:]] = v
        scope = el.scope()
        el.ns = resolve(name, scope, scope.get("", ""))
        for k, v in pairs:
            if not (k == "xmlns" or k.startswith("xmlns:")):
                el.set(k, v, resolve(k, scope, ""))
        at.append(el)

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda name: at.pop()
    parser.CharacterDataHandler = lambda s: at[-1].append_text(s) if len(at) > 1 else None
    parser.CommentHandler = lambda s: at[-1].add(Node(COM, "#comment", "", s))
    parser.ProcessingInstructionHandler = lambda t, s: at[-1].add(Node(PI, t, "", s))
    try:
        parser.Parse(text.lstrip("﻿"), True)
    except expat.ExpatError as e:
        raise ParseError(str(e)) from None
    return doc.number()


def parse_html(text: str) -> Node:
    """The document node; never fails."""
    from .html_tree import parse_html as build

    return build(text)


def parse(text: str, kind: str) -> Node:
    if kind == "xml":
        return parse_xml(text)
    if kind == "html":
        return parse_html(text)
    if kind == "html-terminated":
        from .html_tree import terminated

        return parse_html(terminated(text))
    raise ParseError(f"type must be xml or html, not {kind}")


def _xml_att(value: str) -> str:
    return escape(value, quote=False).replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;").replace("\r", "&#13;")


def to_xml(node: Node) -> str:
    """Markup of a subtree."""
    if node.kind == DOC:
        return "".join(to_xml(c) for c in node.children)
    if node.kind == TXT:
        return escape(node.value, quote=False).replace("\r", "&#13;")
    if node.kind == COM:
        return f"<!--{node.value}-->"
    if node.kind == PI:
        return f"<?{node.name} {node.value}?>" if node.value else f"<?{node.name}?>"
    if node.kind == ATT:
        return f'{node.name}="{_xml_att(node.value)}"'
    decls = "".join(f' xmlns{":" + p if p else ""}="{_xml_att(u)}"' for p, u in sorted(node.decls.items()))
    atts = "".join(f" {to_xml(a)}" for a in node.attrs)
    inner = "".join(to_xml(c) for c in node.children)
    return f"<{node.name}{decls}{atts}>{inner}</{node.name}>" if node.children else f"<{node.name}{decls}{atts}/>"


def pretty_xml(node: Node, depth: int = 0) -> str:
    """Markup with a line for each child of elements that hold no text; text and what stands beside it stay as they are."""
    if node.kind == DOC:
        return '<?xml version="1.0" encoding="utf-8"?>\n' + "".join(pretty_xml(c) + "\n" for c in node.children)
    if node.kind != ELT or not node.children or any(c.kind == TXT for c in node.children):
        return to_xml(node)
    bare = node.copy(deep=False)
    inner = "".join(f"\n{'  ' * (depth + 1)}{pretty_xml(c, depth + 1)}" for c in node.children)
    return f"{to_xml(bare)[:-2]}>{inner}\n{'  ' * depth}</{node.name}>"


def to_html(node: Node, raw: bool = False) -> str:
    """HTML5 markup of a subtree, with a doctype for a document."""
    if node.kind == DOC:
        return "<!DOCTYPE html>\n" + "".join(to_html(c) for c in node.children)
    if node.kind == TXT:
        return node.value if raw else escape(node.value, quote=False)
    if node.kind == COM:
        return f"<!--{node.value}-->"
    if node.kind != ELT:
        return ""
    atts = "".join(f' {a.name}="{escape(a.value, quote=False).replace(chr(34), "&quot;")}"' for a in node.attrs)
    if node.name in VOID:
        return f"<{node.name}{atts}>"
    own = node.name in ("script", "style")
    # markup inside a script is data of its own kind
    inner = "".join(to_xml(c) if own and c.kind == ELT else to_html(c, own) for c in node.children)
    return f"<{node.name}{atts}>{inner}</{node.name}>"
