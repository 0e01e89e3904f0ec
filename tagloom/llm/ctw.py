"""LM scoring by context-tree weighting over bytes, and a smoothed word unigram model as the base.

A text is its words, A-Z lower-cased, joined by one space and closed by an end
symbol (0xFF, which UTF-8 never holds); what precedes its first byte counts as
end symbols. Each byte is eight binary decisions. For each of the 255 decision
nodes there is a context tree over the ``depth`` bytes before, the nearest
first. A node of depth d weighs its Krichevsky-Trofimov estimate against the
product of its children, half and half, so all depths are mixed:
P_w = (P_e + prod P_w(child)) / 2, and P_w = P_e at full depth. The trained
trees are fixed; the probability of a bit is the mixture of the estimates on
its path with the posterior weights, 1/2 from the first node that training has
not seen. ``score`` sums log10 over all bits of the text and its end.

How it is spread: a byte's probability depends on its gram (the byte and its
context) only. Map tasks count distinct grams and words (one 64-bit key each)
of their texts; counts meet by the hash of the three nearest context bytes, so
every subtree below depth 3 is whole in one row and no row sees more than the
distinct grams of its contexts. What lies above (at most 65,536 contexts) is
summed, weighted in the driver and broadcast. That gives a table of every
gram's log probability and every word's count, as large as the corpus makes
it. Its ``HOT`` most frequent keys are broadcast; the occurrences of all
others meet the table by the hash of the key. Counts decide what is hot, so
no key that meets the table is frequent. Sums are whole numbers in units of
2**-36, the same in any order.

Defined results: null texts are empty, and an empty text is one end token;
without training rows every bit has probability 1/2 and every token count is 0;
rows equal in identifier and text train as often as they stand and get equal
results; rows that share an identifier only are scored apart; a null identifier
belongs to the fold of the empty text; a very long text is read whole, by one
task; ties in frequency are hot together or not at all; an empty table gives no
rows. Extra columns are ignored. The input is read twice and must hold the
same rows each time, or the job fails. Words are told apart by 63-bit hashes: two
different ones among n share a count with probability n squared / 2**64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .folds import remainder
from .rows import keyed, plain_id
from .scratch import Scratch, shuffle_partitions
from .windows import from_small, from_steps, small, steps_of, task_of

#: Context bytes; a gram of one byte more fills seven of the eight bytes of a key.
DEPTH = 6
#: Keys of the broadcast table, at most.
HOT = 1 << 21
#: Distinct keys that a map task holds, and grams in one row of the stored tables, about.
HOLD, PIECE = 2 << 20, 1 << 18
#: Text bytes looked at together.
CHUNK = 1 << 20
#: Frequencies up to this are told apart when the hot keys are chosen.
MOST = 1 << 16
UNIT = 1 << 36
#: Units of the summed logarithms of the upper trees, and of what their rounding leaves.
COARSE, FINE = 1 << 14, 1 << 30
END = 0xFF
_WORD = np.uint64(1 << 63)
_END_KEY = np.uint64((1 << 64) - 1)
_LN10 = math.log(10)
_SMALL = np.array([math.lgamma(n / 2) if n else 0.0 for n in range(64)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function at multiples of 1/2 above 0."""
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 16, _SMALL[np.minimum(2 * x, 63).astype(np.int64)], series)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _folded() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


_LOW = _folded()


def keys_of(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram keys and word keys of consecutive texts, each with row pointers; the last key of a row is its end.

    A gram's key has the nearest context byte first and the byte itself last.
    """
    words = tk.Words(data, offs, tk.lower_space_table())
    rows = len(offs) - 1
    row = words.row_of()
    keep = words.codes > 0
    inner = np.flatnonzero(row[1:] == row[:-1])
    keep[words.end[inner]] = True
    at = np.flatnonzero(keep)
    own = _LOW[data[at]]
    own[words.codes[at] == 0] = 0x20
    size = np.diff(np.searchsorted(at, offs))
    stream = np.full(len(at) + (rows + 1) * depth, END, np.uint8)
    place = np.arange(len(at)) + (np.repeat(np.arange(rows), size) + 1) * depth
    stream[place] = own
    ends = np.cumsum(size) + np.arange(1, rows + 1) * depth
    keys = stream[depth:].astype(np.uint64)
    n = len(keys)
    for back in range(1, depth + 1):
        keys |= stream[depth - back : depth - back + n].astype(np.uint64) << np.uint64(8 * (depth + 1 - back))
    real = np.zeros(len(stream), bool)
    real[place] = True
    real[ends] = True
    grams = keys[real[depth:]]
    gram_ptr = np.concatenate([[0], np.cumsum(size + 1)])
    tokens = np.full(words.n + rows, _END_KEY, np.uint64)
    tokens[np.arange(words.n) + row] = words.hashes() | _WORD
    return grams, gram_ptr, tokens, words.ptr + np.arange(rows + 1)


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of the columns of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[lead], np.add.reduceat(count[order], lead, axis=0, dtype=count.dtype) if len(key) else count


def _group_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """What brings keys together for training: a word itself, a gram's nearest context bytes."""
    return np.where(keys >= _WORD, keys, keys >> np.uint64(8 * (depth + 1 - min(3, depth))))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers, their first bytes together, then their second and so on, compressed: sorted keys and small counts shrink to little."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def from_planes(raw: bytes, kind=np.int64) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    flat = np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(kind).ravel()


def _row(bucket: int, key: np.ndarray, count: np.ndarray) -> tuple:
    return int(bucket), planes(key), planes(count[:, 0].astype(np.int64)), planes(count[:, 1].astype(np.int64))


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_PACK = "bucket int, keys binary, train binary, total binary"
_PACKED = ["bucket", "keys", "train", "total"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _counter(depth: int, buckets: int):
    """(train, text) to distinct keys with their counts in training and in all rows, packed by bucket."""

    def flush(keys, counts):
        key, count = _summed(keys, counts)
        bucket = (tk.mix(_group_of(key, depth)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        key, count, bucket = key[order], count[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        return _batch([_row(b, key[cut[b] : cut[b + 1]], count[cut[b] : cut[b + 1]]) for b in np.unique(bucket)], *_PACKED)

    def run(batches):
        keys: list = []
        counts: list = []
        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(1)), limit=CHUNK):
                grams, gram_ptr, words, word_ptr = keys_of(data, offs, depth)
                for key, ptr in ((grams, gram_ptr), (words, word_ptr)):
                    of = np.repeat(train[lo:hi], np.diff(ptr))
                    for part, is_train in ((key[of], 1), (key[~of], 0)):
                        one, n = np.unique(part, return_counts=True)
                        keys.append(one)
                        counts.append(np.stack([n * is_train, n], 1).astype(np.uint32))
                if sum(map(len, keys)) > HOLD:
                    key, count = _summed(keys, counts)
                    keys, counts = [key], [count]
                    if len(key) > HOLD // 2:
                        yield flush(keys, counts)
                        keys, counts = [], []
        if keys:
            yield flush(keys, counts)

    return run


def _meet(depth: int):
    """All counts of a partition, summed; rows of about ``PIECE`` keys that end where the contexts change."""

    def run(batches):
        keys: list = [np.zeros(0, np.uint64)]
        counts: list = [np.zeros((0, 2), np.int64)]
        held = 0
        for batch in batches:
            for _, key, train, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(from_planes(key, np.uint64))
                counts.append(np.stack([from_planes(train), from_planes(total)], 1))
                held += len(keys[-1])
                if held > 2 * len(keys[0]) + HOLD:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
        key, count = _summed(keys, counts)
        group = _group_of(key, depth)
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        lo = 0
        while lo < len(key):
            hi = int(edge[min(np.searchsorted(edge, lo + PIECE), len(edge) - 1)])
            yield _batch([_row(0, key[lo:hi], count[lo:hi])], *_PACKED)
            lo = hi

    return run


class _Level:
    """Decision nodes of one depth: for each of the eight bits, runs of elements (context, byte) in order."""

    def __init__(self, element: np.ndarray, count: np.ndarray, below: _Level | None = None, up: np.ndarray | None = None):
        self.element, self.count = element, count
        byte, context = element & np.uint64(255), element >> np.uint64(8)
        self.node, self.lead, self.weight, self.one, self.log = [], [], [], [], []
        for b in range(8):
            name = (context << np.uint64(8)) | np.uint64(1 << b) | (byte >> np.uint64(8 - b))
            new = np.concatenate([[True], name[1:] != name[:-1]])
            node, lead = np.cumsum(new) - 1, np.flatnonzero(new)
            both = np.bincount(node, weights=count)
            n1 = np.bincount(node, weights=count * ((byte >> np.uint64(7 - b)) & np.uint64(1)))
            own = kt_log(both - n1, n1)
            log, weight = own, np.ones(len(own))
            if below is not None:
                rest = np.bincount(node[up[below.lead[b]]], weights=below.log[b], minlength=len(own))
                log, weight = _mixed(own, rest)
            self.node.append(node)
            self.lead.append(lead)
            self.weight.append(weight)
            self.one.append((n1 + 0.5) / (both + 1.0))
            self.log.append(log)

    def parent(self) -> tuple[_Level, np.ndarray]:
        element, up = np.unique(((self.element >> np.uint64(16)) << np.uint64(8)) | (self.element & np.uint64(255)), return_inverse=True)
        return _Level(element, np.bincount(up, weights=self.count, minlength=len(element)), self, up), up


def _mixed(own: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the half-and-half mixture, and the posterior weight of its first part."""
    both = np.logaddexp(own, rest)
    return both - math.log(2), np.exp(own - both)


def subtrees(keys: np.ndarray, train: np.ndarray, depth: int) -> tuple[np.ndarray, _Level]:
    """Whole subtrees below depth 3: each gram's bit probabilities there (grams x 8), and that level."""
    level, path = _Level(keys, train.astype(np.float64)), np.arange(len(keys))
    bit = np.stack([((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(bool) for b in range(8)], 1)

    def of(one):
        return np.stack([np.where(bit[:, b], one[b][level.node[b][path]], 1 - one[b][level.node[b][path]]) for b in range(8)], 1)

    p = of(level.one)
    for _ in range(depth - min(3, depth)):
        level, up = level.parent()
        path = up[path]
        w = np.stack([level.weight[b][level.node[b][path]] for b in range(8)], 1)
        p = w * of(level.one) + (1 - w) * p
    return p, level


def _grams(batch):
    for key, train, total in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("keys", "train", "total")), strict=True):
        yield from_planes(key, np.uint64), from_planes(train), from_planes(total)


_SUMS = ["kind", "name", "a", "b", "log", "rest"]


def _upward(depth: int):
    """What the upper trees need of each piece: node counts and summed logarithms (0); words (1); frequencies (2)."""

    def run(batches):
        for batch in batches:
            for key, train, total in _grams(batch):
                out = []
                n, many = np.unique(np.minimum(total, MOST), return_counts=True)
                out.append((np.full(len(n), 2), n, many, many * 0, many * 0, many * 0))
                words = key >= _WORD
                if words.any():
                    out.append(tuple(np.array([x]) for x in (1, 0, train[words].sum(), (train[words] > 0).sum(), 0, 0)))
                if not words.all():
                    _, level = subtrees(key[~words], train[~words], depth)
                    byte = level.element & np.uint64(255)
                    for b in range(8):
                        lead, node = level.lead[b], level.node[b]
                        name = ((level.element[lead] >> np.uint64(16)) << np.uint64(8)) | np.uint64(1 << b) | (byte[lead] >> np.uint64(8 - b))
                        both = np.bincount(node, weights=level.count)
                        n1 = np.bincount(node, weights=level.count * ((byte >> np.uint64(7 - b)) & np.uint64(1)))
                        one, up = np.unique(name, return_inverse=True)
                        log = np.bincount(up, weights=level.log[b]) * COARSE
                        sums = [np.rint(x).astype(np.int64) for x in (np.bincount(up, weights=both - n1), np.bincount(up, weights=n1), log, (log - np.rint(log)) * FINE)]
                        out.append((np.zeros(len(one), np.int64), one.astype(np.int64), *sums))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], _SUMS)

    return run


class UpperTrees:
    """Depths 2 to 0, folded into two numbers a node and bit: P(bit) = a[bit] + b * P(bit below)."""

    def __init__(self, name: np.ndarray, n0: np.ndarray, n1: np.ndarray, rest: np.ndarray, levels: int):
        order = np.argsort(name)
        self.name = name[order]
        layers = [(self.name, n0[order].astype(np.float64), n1[order].astype(np.float64), rest[order])]
        ups, made = [], []
        for k in range(levels):
            own_name, z, o, below = layers[-1]
            log, w = _mixed(kt_log(z, o), below)
            made.append((w, (o + 0.5) / (z + o + 1.0)))
            if k + 1 < levels:
                name_up, up = np.unique(((own_name >> np.uint64(16)) << np.uint64(8)) | (own_name & np.uint64(255)), return_inverse=True)
                ups.append(up)
                layers.append((name_up, *(np.bincount(up, weights=x, minlength=len(name_up)) for x in (z, o, log))))
        path = np.arange(len(self.name))
        self.a = np.zeros((2, len(self.name)))
        self.b = np.ones(len(self.name))
        for k, (w, one) in enumerate(made):
            w, one = w[path], one[path]
            self.a = np.stack([w * (1 - one), w * one]) + (1 - w) * self.a
            self.b = (1 - w) * self.b
            if k < len(ups):
                path = ups[k][path]

    def finish(self, keys: np.ndarray, p: np.ndarray, depth: int) -> np.ndarray:
        """log10 of each gram's probability, from its bit probabilities at the deepest upper node's children."""
        byte = keys & np.uint64(255)
        context = keys >> np.uint64(8 * (depth + 2 - min(3, depth)))
        out = np.zeros(len(keys))
        for b in range(8):
            at = np.searchsorted(self.name, (context << np.uint64(8)) | np.uint64(1 << b) | (byte >> np.uint64(8 - b)))
            bit = ((byte >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64)
            out += np.log(self.a[bit, at] + self.b[at] * p[:, b])
        return out / _LN10


_ANSWER = "bucket int, keys binary, value binary, total binary"
_ANSWERS = ["bucket", "keys", "value", "total"], _PACKED[1]


def _answerer(upper, depth: int, buckets: int):
    """Every key's value in units: a gram's log10 probability, log10 of a word's training count plus one."""

    def run(batches):
        for batch in batches:
            for key, train, total in _grams(batch):
                words = key >= _WORD
                value = np.log10(train + 1.0)
                if not words.all():
                    value[~words] = upper.value.finish(key[~words], subtrees(key[~words], train[~words], depth)[0], depth)
                units = np.rint(value * UNIT).astype(np.int64)
                bucket = (tk.mix(key) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                yield _batch([_row(b, key[o], np.stack([units[o], total[o]], 1)) for b in np.unique(bucket) for o in [order[cut[b] : cut[b + 1]]]], *_ANSWERS)

    return run


def _hottest(least: int):
    def run(batches):
        for batch in batches:
            for key, value, total in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = from_planes(total) >= least
                yield pa.RecordBatch.from_arrays([pa.array(from_planes(key)[at]), pa.array(from_planes(value)[at])], ["key", "value"])

    return run


class Lookup:
    """Values by 64-bit key, addressed by the key's leading hash bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.begin = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=1 << self.bits), out=self.begin[1:])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (tk.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and which keys are known."""
        value, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        slot = self._slot(keys)
        at, end = self.begin[slot], self.begin[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            value[left[hit]] = self.values[at[hit]]
            known[left[hit]] = True
            at = at + 1
            more = ~hit & (at < end)
            left, at, end = left[more], at[more], end[more]
        return value, known


def _by_row(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]


#: Parts of the table (kind 0), occurrences by document of a task (1), documents of a task with their sums (2), sums by document (3).
_FOUND = "bucket int, kind int, task long, keys binary, value binary, rows binary, many binary, ids binary, hs binary, sums binary"
_FOUND_NAMES = [x.split(" ")[0] for x in _FOUND.split(", ")]
_FOUND_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
_SUM_NAMES = ["size", "n_tokens", "known", "base", "score"]
_PART = "_id long, _h long, docs long, " + ", ".join(f"{x} long" for x in _SUM_NAMES)


def _scorer(hot, depth: int, buckets: int):
    """(_id, _h, text) to sums over the broadcast keys (kind 2) and the occurrences of all others by bucket (kind 1)."""
    def run(batches):
        look = Lookup(*hot.value)
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2)), limit=CHUNK):
                grams, gram_ptr, words, word_ptr = keys_of(data, offs, depth)
                value, there = look(grams)
                base, there_too = look(words)
                own_ids, own_hs = ids[lo:hi], hs[lo:hi]
                sums = np.stack([np.diff(gram_ptr), np.diff(word_ptr), _by_row(base > 0, word_ptr), _by_row(base, word_ptr), _by_row(value, gram_ptr)], 1).astype(np.int64)
                task = task_of(own_ids, own_hs)
                rows = [(task % buckets, 2, task, None, None, None, None, own_ids.tobytes(), own_hs.tobytes(), sums.tobytes())]
                key = np.concatenate([grams[~there], words[~there_too]])
                if len(key):
                    of = np.concatenate([np.repeat(np.arange(hi - lo), np.diff(gram_ptr))[~there], np.repeat(np.arange(hi - lo), np.diff(word_ptr))[~there_too]])
                    bucket = (tk.mix(key) % np.uint64(buckets)).astype(np.int32)
                    order = np.lexsort((of, bucket))
                    key, of, bucket = key[order], of[order], bucket[order]
                    cut = np.searchsorted(bucket, np.arange(buckets + 1))
                    for b in np.unique(bucket):
                        x, y = cut[b], cut[b + 1]
                        docs, many = np.unique(of[x:y], return_counts=True)
                        rows.append((int(b), 1, task, planes(key[x:y]), None, steps_of(docs), small(many), None, None, None))
                yield _batch(rows, _FOUND_NAMES, _FOUND_KINDS)

    return run


def _joiner(batches):
    """Rows of one partition, its part of the table first; occurrences become sums by document, the documents pass."""
    keys: list = [np.zeros(0, np.uint64)]
    values: list = [np.zeros(0, np.int64)]
    look = None
    for batch in batches:
        out = []
        for row in batch.select(_FOUND_NAMES).to_pylist():
            if row["kind"] == 0:
                keys.append(from_planes(row["keys"], np.uint64))
                values.append(from_planes(row["value"]))
            elif row["kind"] == 2:
                out.append(tuple(row.values()))
            else:
                look = look or Lookup(np.concatenate(keys), np.concatenate(values))
                key = from_planes(row["keys"], np.uint64)
                value, there = look(key)
                if not there.all():
                    raise ValueError("a key is missing from the table; the input changed between two reads")
                ptr, words = np.concatenate([[0], np.cumsum(from_small(row["many"]))]), key >= _WORD
                sums = np.stack([_by_row(words & (value > 0), ptr), _by_row(np.where(words, value, 0), ptr), _by_row(np.where(words, 0, value), ptr)], 1)
                out.append((row["bucket"], 3, row["task"], None, None, row["rows"], None, None, None, sums.tobytes()))
        if out:
            yield _batch(out, _FOUND_NAMES, _FOUND_KINDS)


def _gather(table: pa.Table) -> pa.Table:
    """A task's documents with all their sums; equal tasks count as often as they are."""
    own = table.select(["kind", "rows", "ids", "hs", "sums"]).to_pylist()
    whole = [r for r in own if r["kind"] == 2]
    ids, hs = (np.frombuffer(whole[0][c], np.int64) for c in ("ids", "hs"))
    sums = np.frombuffer(whole[0]["sums"], np.int64).reshape(-1, len(_SUM_NAMES)) * len(whole)
    for r in own:
        if r["kind"] == 3:
            at = from_steps(r["rows"])
            sums[at, 2:] += np.frombuffer(r["sums"], np.int64).reshape(-1, 3)
    return pa.table({"_id": ids, "_h": hs, "docs": np.full(len(ids), len(whole), np.int64), **{x: np.ascontiguousarray(sums[:, i]) for i, x in enumerate(_SUM_NAMES)}})


def code_lengths(docs: DataFrame, train: Column, depth: int = DEPTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``_id``, ``n_bytes`` (the end counted), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    ``train`` is a condition on the columns of ``docs``; ``depth`` is 1 to 6.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth must be 1 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n = shuffle_partitions(spark)
    text = F.col(f"`{text_col}`").cast("string")
    packed = docs.select(F.coalesce(train, F.lit(False)).alias("train"), text.alias("text")).mapInArrow(_counter(depth, n), _PACK)
    counts = scratch.put(packed.repartitionById(n, F.col("bucket")).mapInArrow(_meet(depth), _PACK), "counts")
    sums = counts.mapInArrow(_upward(depth), ", ".join(f"{x} long" for x in _SUMS)).groupBy("kind", "name").agg(*(F.sum(x).alias(x) for x in _SUMS[2:])).toArrow()
    kind, name, a, b, log, rest = (sums.column(x).to_numpy() for x in _SUMS)
    nodes, words, often = (np.flatnonzero(kind == k) for k in (0, 1, 2))
    upper = UpperTrees(name[nodes].view(np.uint64), a[nodes], b[nodes], (log[nodes] + rest[nodes] / FINE) / COARSE, min(3, depth))
    total, distinct = (int(x[words].sum()) for x in (a, b))
    answers = scratch.put(counts.mapInArrow(_answerer(spark.sparkContext.broadcast(upper), depth, n), _ANSWER), "values")
    # the least frequency at which no more than ``hot`` keys are left
    order = often[np.argsort(-name[often])]
    fits = order[np.cumsum(a[order]) <= hot]
    least = int(name[fits].min()) if len(fits) else 1 << 62
    table = answers.mapInArrow(_hottest(least), "key long, value long").toArrow()
    sent = spark.sparkContext.broadcast((table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()))
    found = keyed(docs, id_col, text_col).mapInArrow(_scorer(sent, depth, n), _FOUND)
    both = answers.select("bucket", F.lit(0).alias("kind"), "keys", "value").unionByName(found, allowMissingColumns=True)
    part = both.repartitionById(n, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(_joiner, _FOUND).groupBy("task").applyInArrow(_gather, _PART)
    doc = part.groupBy("_id", "_h").agg(*(F.sum(x).alias(x) for x in ("docs", *_SUM_NAMES)))
    one = lambda x: F.col(x) / F.col("docs")
    whole = lambda x: F.expr(f"{x} div docs")
    out = doc.select(
        "_id",
        whole("size").alias("n_bytes"),
        whole("n_tokens").alias("n_tokens"),
        whole("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (one("base") / F.lit(float(UNIT)) - whole("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (one("score") / F.lit(float(UNIT))).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("docs"))).alias("twin"),
    ).drop("twin")
    return out.withColumn("bits_per_byte", -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes"))


def contract(docs: DataFrame) -> DataFrame:
    """The columns of ``op11``: remainder 2 of 7 is held out."""
    out = code_lengths(docs, remainder("doc_id", 7) != 2).withColumn("doc_id", plain_id())
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
