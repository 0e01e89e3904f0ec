"""Edits of documents within one range of numbers: a batch of whole documents at a time, by the keys of :mod:`edits`.

Rows come sorted by document, edits (``_e``) before nodes. A document is at most
one range of nodes and as many edits, so what a task holds is bounded; those
that are larger have a row with ``_skip`` and are left to the joins.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.shred import OF, STEP, UNNAMED

_OPS = ("delete", "move", "insert")
_MAP = pa.map_(pa.string(), pa.string())
#: An edit, which comes as JSON.
EDIT = pa.struct([("op", pa.string()), ("pre", pa.int64()), ("place", pa.string()), ("target", pa.int64()), ("seq", pa.int64()), ("qname", pa.string()), ("text", pa.string()), ("attrs", _MAP), ("edit", pa.int64())])


def _maps(texts: pa.Array) -> pa.Array:
    """Maps from their JSON, each different one read once."""
    codes = texts.dictionary_encode()
    return pa.array([list(json.loads(t).items()) for t in codes.dictionary.to_pylist()], _MAP).take(codes.indices)


def _told(texts: pa.Array) -> pa.Array:
    own = [json.loads(t) for t in texts.to_pylist()]
    return pa.array([e | {"attrs": None if e["attrs"] is None else list(e["attrs"].items())} for e in own], EDIT)


def _ints(column, null: int = -1) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def _is(column, *values: str) -> np.ndarray:
    return pc.is_in(column, pa.array(values, column.type)).to_numpy(zero_copy_only=False).astype(bool)


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of ``asked`` in sorted ``keys``, -1 where they are not."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _pick(values: np.ndarray, at: np.ndarray, missing: int = -1) -> np.ndarray:
    """``values`` at places, ``missing`` where a place is -1."""
    return np.where(at >= 0, values[np.maximum(at, 0)], missing) if len(values) else np.full(len(at), missing)


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One number that sorts as the columns do, from the first to the last."""
    out = np.zeros(len(columns[0]), np.int64)
    bits = 0
    for c in columns:
        c = c - (c.min() if len(c) else 0)
        width = int(c.max()).bit_length() if len(c) else 0
        bits += width
        out = out << width | c
    if bits > 62:
        raise OverflowError("keys of a batch need more than 62 bits")
    return out


class _Edits:
    """The edits of a batch that take effect, with their gaps and hosts."""

    def __init__(self, group: np.ndarray, e: dict, nodes: _Nodes):
        op, place = e["op"], e["place"]
        delete, move, insert = (_is(op, o) for o in _OPS)
        known = op.is_valid().to_numpy(zero_copy_only=False)
        at = lambda name: np.where(e[name].is_valid().to_numpy(zero_copy_only=False), _find(nodes.key, nodes.keys(group, _ints(e[name]))), -1)
        own, goal = at("pre"), at("target")
        target, ends = _ints(e["target"]), _pick(nodes.pre + nodes.size, goal)
        beside = (goal >= 0) & _is(place, "before", "after") & ~_pick(nodes.att | nodes.doc, goal, 0).astype(bool)
        inside = (goal >= 0) & _is(place, "first", "last") & _pick(nodes.elt | nodes.doc, goal, 0).astype(bool)
        gap = np.where(_is(place, "before"), target, np.where(_is(place, "after", "last"), ends, np.maximum(_pick(nodes.inner, goal), target + 1)))
        placed = beside | inside
        host = np.where(inside, target, np.where(beside, _pick(nodes.parent, goal), -1))
        level = np.where(inside, _pick(nodes.level, goal), _pick(nodes.level, goal) - 1)
        seq = _ints(e["seq"], 0)
        edit = _ints(e["edit"])
        bad = ~(delete | move | insert) | (~insert & (own < 0)) | (~insert & _pick(nodes.doc, own, 0).astype(bool)) | (move & _pick(nodes.att, own, 0).astype(bool)) | (~delete & ~placed)
        bad |= insert & ~e["qname"].is_valid().to_numpy(zero_copy_only=False)
        # of the edits of one node the first in this order counts, whether or not it has an effect
        roots = np.flatnonzero(known & ~insert & (own >= 0))
        order = roots[np.lexsort((edit[roots], ~delete[roots], -seq[roots], own[roots]))]
        bad[order[1:][own[order[1:]] == own[order[:-1]]]] = True
        # a move to a place in what moves or goes
        taken = ~bad & ~insert
        asked = np.flatnonzero(~bad & move)
        lo = np.sort(nodes.key[own[taken]])
        hi = np.sort(nodes.keys(group[taken], nodes.pre[own[taken]] + nodes.size[own[taken]]))
        where = nodes.keys(group[asked], host[asked])
        bad[asked[np.searchsorted(lo, where, side="right") > np.searchsorted(hi, where, side="right")]] = True
        ok = np.flatnonzero(~bad)
        self.rows = ok
        self.group, self.own, self.gap, self.host, self.level = group[ok], own[ok], gap[ok], host[ok], level[ok]
        self.delete, self.move, self.insert = delete[ok], move[ok], insert[ok]
        self.turn = np.empty(len(ok), np.int64)
        self.turn[np.lexsort((edit[ok], seq[ok]))] = np.arange(1, len(ok) + 1)


class _Nodes:
    """The nodes of a batch, sorted by document and number."""

    def __init__(self, group: np.ndarray, rows: pa.RecordBatch, width: int):
        self.group, self.width = group, width
        self.pre, self.size, self.level, self.parent = (_ints(rows.column(c)) for c in ("pre", "size", "level", "parent"))
        kind = rows.column("kind")
        self.elt, self.doc, self.att, self.txt = (_is(kind, k) for k in ("ELT", "DOC", "ATT", "TXT"))
        self.chars = np.where(self.txt, _ints(pc.utf8_length(rows.column("value")), 0), 0)
        self.key = self.keys(group, self.pre)
        self.up = np.where(self.parent >= 0, _find(self.key, self.keys(group, self.parent)), -1)
        #: Past the last attribute of an element.
        self.inner = np.full(len(self.pre), -1)
        mine = self.att & (self.up >= 0)
        np.maximum.at(self.inner, self.up[mine], self.pre[mine] + 1)

    def keys(self, group: np.ndarray, number: np.ndarray) -> np.ndarray:
        return group * self.width + number


def _edited(rows: pa.RecordBatch, marks: pa.RecordBatch, kinds: dict[str, str], labels: bool) -> pa.RecordBatch:
    """The rows of whole documents with ``marks`` (doc_id, _e) applied."""
    doc = _ints(rows.column("doc_id"))
    group = np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]])).astype(np.int64)
    firsts = doc[np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))]
    of = _find(firsts, _ints(marks.column("doc_id")))
    marks, of = marks.filter(pa.array(of >= 0)), of[of >= 0]
    told = _told(marks.column("_e"))
    e = dict(zip([f.name for f in told.type], told.flatten(), strict=True))
    ends = _ints(rows.column("pre")) + _ints(rows.column("size"))
    nodes = _Nodes(group, rows, int(max(ends.max(), _ints(rows.column("parent")).max(), 0)) + 2)
    for c in ("pre", "target"):  # what is outside the documents' numbers is nowhere
        v = _ints(e[c])
        e[c] = pa.array(v, mask=(v < 0) | (v >= nodes.width))
    ed = _Edits(of, e, nodes)

    # the innermost edit around each node
    root = np.full(len(rows), -1)
    for i in (r := np.flatnonzero(~ed.insert))[np.argsort(ed.own[r], kind="stable")]:
        at = ed.own[i]
        root[at : np.searchsorted(nodes.key, nodes.key[at] + nodes.size[at])] = i
    gone = _pick(ed.delete, root, 0).astype(bool)
    kept = np.flatnonzero(~gone)
    new = np.flatnonzero(ed.insert)
    hosted = _pick(root, np.where(ed.host[new] >= 0, _find(nodes.key, nodes.keys(ed.group[new], ed.host[new])), -1))
    stays = ~_pick(ed.delete, hosted, 0).astype(bool)
    new, hosted = new[stays], hosted[stays]

    r = root[kept]
    moved = r >= 0
    top = moved & (_pick(ed.own, r) == kept)
    up = np.where(top, _pick(ed.host, r), nodes.parent[kept])
    shift = lambda r: np.where(r >= 0, _pick(ed.level, r) + 1 - nodes.level[np.maximum(_pick(ed.own, r), 0)], 0)
    level = nodes.level[kept] + shift(r)
    # new elements, their attributes and texts
    lists = [sorted(k for k, _ in m) if m else [] for m in e["attrs"].take(pa.array(ed.rows[new])).to_pylist()]
    texts = e["text"].take(pa.array(ed.rows[new]))
    has_text = texts.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.array([len(x) for x in lists], np.int64)
    many = 1 + count + has_text
    who = np.repeat(np.arange(len(new)), many)
    leaf = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    is_text = (leaf > 0) & (leaf > count[who])

    # all begins, then the ends of elements: keys as in ``edits``, inner ones for what is in a moved subtree
    k, m = len(kept), len(who)
    opens = np.flatnonzero(nodes.elt[kept] | nodes.doc[kept])
    at, low = nodes.pre[kept], np.zeros(k, np.int64)
    begin = [at * 2 + 1, low, low]
    end = [(at + nodes.size[kept])[opens] * 2, (-2 * nodes.level[kept] + 1)[opens], low[opens]]
    goal = lambda i: [ed.gap[i] * 2, -2 * ed.level[i], ed.turn[i]]
    spot = goal(new)

    def outer(r: np.ndarray, key: list) -> list:
        """Outer and inner keys: the place that the subtree around is moved to, then the own one."""
        inside, to = r >= 0, goal(np.maximum(r, 0)) if len(ed.rows) else key
        return [*(np.where(inside, t, c) for t, c in zip(to, key, strict=True)), *(np.where(inside, c, 0) for c in key)]

    news = outer(hosted, spot)
    columns = [outer(r, begin), [c[who] for c in news], outer(r[opens], end), news]
    parts = [low, leaf, low[opens], many + 1]
    groups = [group[kept], ed.group[new][who], group[kept][opens], ed.group[new]]
    a, b, c, d, f, g = (np.concatenate([own[i] for own in columns]) for i in range(6))
    by = np.concatenate(groups)
    order = np.lexsort((_packed(g, np.concatenate(parts)), _packed(d, f), _packed(b, c), _packed(by, a)))
    begins = np.zeros(len(order), np.int64)
    begins[: k + m] = 1
    chars = np.zeros(len(order), np.int64)
    chars[:k] = nodes.chars[kept]
    chars[k : k + m] = np.where(is_text, _ints(pc.utf8_length(texts), 0)[who], 0)
    n, t = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    n[order], t[order] = np.cumsum(begins[order]), np.cumsum(chars[order])
    # counts go on over the batch: take off what stands before the document
    before = np.concatenate([[0], np.cumsum(np.bincount(by[: k + m], minlength=len(firsts)))])[by]
    text_before = np.concatenate([[0], np.cumsum(np.bincount(by, chars, minlength=len(firsts)).astype(np.int64))])[by]
    n, t = n - before, t - text_before
    last = np.arange(k + m)
    last[opens] = np.arange(k + m, k + m + len(opens))
    last[k + np.flatnonzero(leaf == 0)] = np.arange(k + m + len(opens), len(order))
    pre, size = n[: k + m] - 1, n[last] - n[: k + m] + 1
    t_from, t_to = t[: k + m] - chars[: k + m], t[last]

    # parents, by places among the rows that begin
    of_node = np.full(len(rows), -1)
    of_node[kept] = np.arange(k)
    old_up = np.where(up >= 0, _pick(of_node, _find(nodes.key, nodes.keys(group[kept], up))), -1)
    new_up = _pick(of_node, np.where(ed.host[new] >= 0, _find(nodes.key, nodes.keys(ed.group[new], ed.host[new])), -1))
    heads = k + np.cumsum(many) - many
    above = np.concatenate([old_up, np.where(leaf == 0, new_up[who], heads[who])]).astype(np.int64)
    level = np.concatenate([level, (ed.level[new] + 1 + shift(hosted))[who] + (leaf > 0)])

    taken = pa.array(kept)
    own_names = [x for names_ in lists for x in (None, *names_, "")]
    first = np.cumsum(count + 2) - (count + 2)
    name_at = first[who] + np.where(is_text, count[who] + 1, leaf)
    tag = e["qname"].take(pa.array(ed.rows[new]))
    name = pc.coalesce(pa.array(own_names, pa.string()).take(pa.array(name_at)), tag.take(pa.array(who)))
    values = [x for m_, names_ in zip(e["attrs"].take(pa.array(ed.rows[new])).to_pylist(), lists, strict=True) for own in [dict(m_ or ())] for x in (None, *(own[y] for y in names_), None)]
    value = pc.if_else(pa.array(is_text), texts.take(pa.array(who)), pa.array(values, pa.string()).take(pa.array(name_at)))
    sort = pa.array(np.array(["ELT", "ATT", "TXT"], object)[np.where(leaf == 0, 0, np.where(is_text, 2, 1))], pa.string())
    blank = pa.array([""] * m, pa.string())
    made = {"kind": sort, "qname": name, "local_name": name, "ns_uri": blank, "prefix": blank, "value": value}
    numbers = {"pre": pre, "size": size, "t_from": t_from, "t_to": t_to}
    out = {c: pa.array(v) for c, v in numbers.items()}
    out["doc_id"] = pa.array(firsts[by[: k + m]])
    out["level"] = pa.array(level.astype(np.int32))
    out["parent"] = pa.array(_pick(pre, above), mask=above < 0)
    out["old_pre"] = pa.array(np.concatenate([nodes.pre[kept], np.zeros(m, np.int64)]), mask=np.arange(k + m) >= k)
    for c, kind in kinds.items():
        if c in out or c in ("labels", "nth"):
            continue
        old = rows.column(c).take(taken)
        old = _maps(old) if kind.startswith("map") else old
        if c == "attrs":
            entries = e["attrs"].take(pa.array(ed.rows[new])).to_pylist()
            fresh = pa.array([(entries[i] or []) if x == 0 else None for i, x in zip(who.tolist(), leaf.tolist(), strict=True)], old.type)
            old = _bare(old, kept, nodes, rows, ed)
        else:
            fresh = made[c].cast(old.type) if c in made else pa.nulls(m, old.type)
        out[c] = pa.concat_arrays([old, fresh])
    if labels:
        out["labels"], out["nth"] = _labelled(out, above, level)
    return pa.RecordBatch.from_arrays([out[c] for c in kinds], list(kinds))


def _bare(attrs: pa.Array, kept: np.ndarray, nodes: _Nodes, rows: pa.RecordBatch, ed: _Edits) -> pa.Array:
    """Elements' own maps without the attributes that are deleted."""
    lost: dict[int, set] = {}
    cut = ed.own[ed.delete]
    cut = cut[nodes.att[cut] & (nodes.up[cut] >= 0)]
    local, space = rows.column("local_name").take(pa.array(cut)).to_pylist(), rows.column("ns_uri").take(pa.array(cut)).to_pylist()
    for up, name, ns in zip(nodes.up[cut].tolist(), local, space, strict=True):
        lost.setdefault(up, set()).add(f"{{{ns}}}{name}" if ns else name)
    at = _find(kept, np.array(sorted(lost), np.int64))
    at = at[at >= 0]
    if not len(at):
        return attrs
    maps = [None if own is None else [p for p in own if p[0] not in lost[i]] for own, i in zip(attrs.take(pa.array(at)).to_pylist(), kept[at].tolist(), strict=True)]
    place = np.arange(len(attrs))
    place[at] = len(attrs) + np.arange(len(at))
    return pa.concat_arrays([attrs, pa.array(maps, attrs.type)]).take(pa.array(place))


def _labelled(out: dict, above: np.ndarray, level: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``labels`` and ``nth`` as the shredder writes them."""
    kind, pre = out["kind"], out["pre"].to_numpy()
    of = lambda *k: _is(kind, *k)
    own = pc.binary_join_element_wise(pc.if_else(pa.array(of("ATT")), "@", ""), out["local_name"].fill_null(""), OF, out["ns_uri"].fill_null(""), "")
    for k, name in UNNAMED.items():
        own = pc.if_else(pa.array(of(k)), name, own)
    step = pc.if_else(pa.array(of("DOC")), "", pc.binary_join_element_wise("", own, STEP))
    codes = own.dictionary_encode().indices.to_numpy()
    doc = out["doc_id"].to_numpy()
    order = np.lexsort((pre, codes, above, doc))
    turn = np.ones(len(order), bool)
    turn[1:] = (doc[order][1:] != doc[order][:-1]) | (above[order][1:] != above[order][:-1]) | (codes[order][1:] != codes[order][:-1])
    start = np.flatnonzero(turn)
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) + 1
    nth[of("ATT", "DOC")] = 1
    # from the tops down, a level at a time
    done, place = [], np.full(len(order), -1)
    at, left = np.flatnonzero(above < 0), np.flatnonzero(above >= 0)
    ways = step.take(pa.array(at))
    found = [ways]
    while True:
        done.append(at)
        place[at] = np.arange(len(at))
        below = place[above[left]] >= 0
        inner, left = left[below], left[~below]
        if not len(inner):
            break
        ways = pc.binary_join_element_wise(ways.take(pa.array(place[above[inner]])), step.take(pa.array(inner)), "")
        found.append(ways)
        place[at] = -1
        at = inner
    back = np.empty(len(order), np.int64)
    back[np.concatenate(done)] = np.arange(len(order))
    return pa.concat_arrays(found).take(pa.array(back)), pa.array(nth.astype(np.int32))


def sweeper(kinds: dict[str, str], labels: bool):
    """Rows in order of documents to rows of the edited ones; the last document of a batch waits for the next."""

    def whole(batch: pa.RecordBatch):
        skip = batch.column("_skip").fill_null(False)
        doc = batch.column("doc_id")
        if pc.any(skip).as_py():
            batch = batch.filter(pc.invert(pc.is_in(doc, doc.filter(skip))))
        is_node = batch.column("_e").is_null()
        rows = batch.filter(is_node)
        if len(rows):
            yield _edited(rows, batch.filter(pc.invert(is_node)).select(["doc_id", "_e"]), kinds, labels)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            doc = _ints(batch.column("doc_id"))
            if held and _ints(held[-1].column("doc_id"))[-1] != doc[0]:
                yield from whole(pa.concat_batches(held))
                held = []
            turns = np.flatnonzero(doc[1:] != doc[:-1]) + 1
            if len(turns):
                yield from whole(pa.concat_batches([*held, batch.slice(0, turns[-1])]))
                held = [batch.slice(turns[-1])]
            else:
                held.append(batch)
        if held:
            yield from whole(pa.concat_batches(held))

    return run
