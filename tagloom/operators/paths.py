"""The unique XPath of a node."""

from __future__ import annotations

from collections import Counter

from ..sources.tree import ATT, COM, DOC, ELT, NS, PI, TXT, Node


def _sort_of(node: Node) -> str:
    """What a step calls the node; siblings of one sort are told apart by number."""
    if node.kind == ELT:
        return "*" if node.ns else node.name
    return {TXT: "text()", COM: "comment()"}.get(node.kind) or f"processing-instruction('{node.name}')"


def child_steps(children: list[Node]) -> list[str]:
    """The last step of each child's path, in one pass over the children."""
    names, total = [_sort_of(c) for c in children], Counter()
    for c, name in zip(children, names, strict=True):
        total[name] += 1
        if c.kind == ELT and name != "*":
            total["*"] += 1
    seen: Counter = Counter()
    out = []
    for c, name in zip(children, names, strict=True):
        if c.kind == ELT and name != "*":
            seen["*"] += 1
        seen[name] += 1
        out.append(name if total[name] == 1 else f"{name}[{seen[name]}]")
    return out


def _step(node: Node) -> str:
    if node.kind == ATT:
        return f"@{node.name}"
    if node.kind == NS:
        return f"namespace::{node.name}"
    if node.parent is None:
        return _sort_of(node)
    at = next(i for i, c in enumerate(node.parent.children) if c is node)
    return child_steps(node.parent.children)[at]


def path(node: Node) -> str:
    """A path that selects this node alone; names in a namespace show as ``*``."""
    if node.kind == DOC:
        return "/"
    steps = []
    while node is not None and node.kind != DOC:
        steps.append(_step(node))
        node = node.parent
    return "/" + "/".join(reversed(steps))


def shown(node: Node) -> str:
    """How a node appears in messages."""
    if node.kind == ELT:
        own = node.att("id") or node.att("id", "http://www.w3.org/XML/1998/namespace")
        return f'<{node.name} id="{own}">' if own else f"<{node.name}>"
    if node.kind == ATT:
        return f"@{node.name}[{node.value}]"
    if node.kind == NS:
        return f"[namespace: xmlns:{node.name}]"
    if node.kind == DOC:
        return "[document]"
    text = (node.value or "").strip()
    text = text if len(text) <= 10 else text[:10] + "..."
    return {TXT: f"[text: {text}]", COM: f"<!--{text}-->", PI: f"<?{node.name} {text}?>"}[node.kind]
