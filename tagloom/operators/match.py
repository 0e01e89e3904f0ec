"""Matches: the nodes that a rule's selector finds, with what its pointers reach from each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from ..functions.xpath_tree import Context, evaluate
from ..functions.xpath_syntax import XPathError
from ..sources.tree import ATT, ELT, Node
from .paths import shown
from .rules import Container, Diagnostics, Rule


@dataclass
class Match:
    """A selected node with its position in the selector's list, and pointer targets (nodes or literals)."""

    rule: Rule
    rule_seq: int
    node: Node
    position: int
    size: int
    pointers: dict[str, Node | str | float | bool]


def match_rule(rule: Rule, rule_seq: int, doc: Node, is_html: bool, notes: Diagnostics) -> list[Match]:
    """Matches of one rule, in document order; nodes that are no element or attribute are skipped but keep their position."""
    if rule.selector is None:
        return []
    ctx = Context(doc, rule.params, rule.prefixes, is_html)
    root = next((c for c in doc.children if c.kind == ELT), doc)
    try:
        found = evaluate(rule.selector, root, 1, 1, ctx)
    except XPathError as e:
        notes.warn("bad_selector", f"selector {rule.selector}: {e}")
        return []
    if not isinstance(found, list):
        notes.warn("bad_selector", f"{rule.selector} selects no nodes")
        return []
    out = []
    for position, node in enumerate(found, 1):
        if node.kind not in (ELT, ATT):
            notes.warn("skipped_match", f"{rule.kind}Rule cannot apply to {shown(node)}")
            continue
        pointers: dict = {}
        for name, expr in rule.pointers.items():
            try:
                got = evaluate(expr, node, position, len(found), ctx)
            except XPathError as e:
                notes.warn("bad_pointer", f"pointer {name} ({expr}): {e}")
                continue
            if isinstance(got, list):
                if len(got) != 1:
                    notes.warn("pointer_hits", f"{name} of {rule.kind}Rule has {len(got)} hits from {shown(node)}")
                if got:
                    pointers[name] = got[0]
            else:
                pointers[name] = got
        out.append(Match(rule, rule_seq, node, position, len(found), pointers))
    for w in ctx.warnings:
        notes.warn("unknown_variable", w)
    return out


def match_all(boxes: list[Container], doc: Node, is_html: bool, notes: Diagnostics, skip: frozenset[str] = frozenset()) -> list[Match]:
    """Matches of all rules, in application order."""
    rules = [r for box in boxes for r in box.rules]
    return [m for i, r in enumerate(rules) if r.kind not in skip for m in match_rule(r, i, doc, is_html, notes)]


def literal_xpath(value: str | float | bool) -> str:
    """A value as an XPath expression."""
    from ..functions.xpath_tree import number_text

    if isinstance(value, bool):
        return "true()" if value else "false()"
    if isinstance(value, float):
        return number_text(value)
    if "'" not in value:
        return f"'{value}'"
    if '"' not in value:
        return f'"{value}"'
    parts = ", \"'\", ".join(f"'{p}'" for p in value.split("'"))
    return f"concat({parts})"


def text_of(value: Node | str | float | bool) -> str:
    from ..functions.xpath_tree import to_string

    return value.text() if isinstance(value, Node) else to_string(value)


def merged(matches: list[Match]) -> dict[int, dict[str, str]]:
    """Metadata of each selected node, by its number: the last rule wins for each name."""
    out: dict[int, dict[str, str]] = {}
    for m in matches:
        own = out.setdefault(id(m.node), {})
        own |= m.rule.values
        own |= m.rule.child_values
        own |= {n.removesuffix("Pointer"): text_of(v) for n, v in m.pointers.items()}
    return out


def with_local(node: Node, its: Mapping[str, str], its_uri: str) -> dict[str, str]:
    """Rule values of a node with its own attributes laid over them."""
    return dict(its) | {a.local: a.value for a in node.attrs if a.ns == its_uri}
