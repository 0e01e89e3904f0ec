"""Context-tree weighting, the Merkle manifest and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import codes, ctw, merkle
from tests.llm.test_brute_force import docs, texts  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(x) -> int:
    return zlib.crc32(b"" if x is None else str(x).encode())


def tokens_of(text):
    return WORDS.findall((text or "").translate(LOW))


class PlainTree:
    """One context tree of one decision node, by recursion over its definition."""

    def __init__(self, depth):
        self.depth, self.count = depth, defaultdict(lambda: [0, 0])

    def learn(self, context, bit):
        for d in range(self.depth + 1):
            self.count[context[:d]][bit] += 1

    def children(self, context):
        return [c for c in self.count if len(c) == len(context) + 1 and c[: len(context)] == context]

    @staticmethod
    def kt(n0, n1):
        return sum(math.log(i + 0.5) for i in range(n0)) + sum(math.log(i + 0.5) for i in range(n1)) - sum(math.log(i + 1) for i in range(n0 + n1))

    def weighted(self, context):
        own = self.kt(*self.count[context]) if context in self.count else 0.0
        if len(context) == self.depth:
            return own
        return np.logaddexp(own, sum(self.weighted(c) for c in self.children(context))) - math.log(2)

    def chance(self, context, bit, d=0):
        n = self.count[context[:d]] if context[:d] in self.count else [0, 0]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return own
        log_own, rest = self.kt(*n), sum(self.weighted(c) for c in self.children(context[:d]))
        w = math.exp(log_own - np.logaddexp(log_own, rest))
        return w * own + (1 - w) * self.chance(context, bit, d + 1)


def plain_scores(texts, train, depth):
    trees = defaultdict(lambda: PlainTree(depth))

    def steps(text):
        data = " ".join(tokens_of(text)).encode() + b"\xff"
        for i, byte in enumerate(data):
            before = (b"\xff" * depth + data[:i])[::-1][:depth]
            for b in range(8):
                yield (1 << b) | (byte >> (8 - b)), before, (byte >> (7 - b)) & 1

    for i, t in texts:
        if train(i):
            for node, before, bit in steps(t):
                trees[node].learn(before, bit)
    known: dict = {}

    def chance(node, before, bit):
        if (node, before, bit) not in known:
            known[node, before, bit] = math.log10(trees[node].chance(before, bit)) if node in trees else math.log10(0.5)
        return known[node, before, bit]

    return [sum(chance(*s) for s in steps(t)) for _, t in texts]


@pytest.fixture(scope="module")
def small():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["the", "Of", "the", "é", "漢x"])
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \n"), (4, "The the THE"), (4, "another text"), (5, "of the of"), (5, "of the of")]
    return rows + [(i, (" " if i % 2 else "\n\t").join(word() for _ in range(rnd.randrange(1, 7)))) for i in range(6, 26)]


@pytest.mark.parametrize(("depth", "hot"), [(6, ctw.HOT), (6, 20), (6, 0), (4, 50), (2, 0), (1, 10)])
def test_ctw_against_recursion(spark, small, depth, hot):
    held = lambda i: crc(i) % 7 == 2
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in small], "doc_id long, text string, _id string, bucket int, score int").repartition(3)
    got = defaultdict(list)
    for r in ctw.code_lengths(df, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2, depth=depth, hot=hot).collect():
        got[r._id if r._id >= 0 else None].append(r)
    want = plain_scores(small, lambda i: not held(i), depth)
    train = Counter(w for i, t in small if not held(i) for w in [*tokens_of(t), "\xff"])
    total, distinct = sum(train.values()), len(train)
    expected = defaultdict(list)
    for (i, t), score in zip(small, want, strict=True):
        own = [*tokens_of(t), "\xff"]
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in own)
        expected[i].append((len(own), sum(train[w] > 0 for w in own), base, score))
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in expected.items()}
    for i, rows in expected.items():
        mine = sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got[i])
        for a, b in zip(mine, sorted(rows), strict=True):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-6)
        assert all(r.train_tokens == total for r in got[i])


def test_ctw_contract_learns_and_takes_awkward_rows(spark, docs, texts):  # noqa: F811
    rows = ctw.contract(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*texts, 9])
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) and r.n_tokens == len(tokens_of(texts[r.doc_id])) + 1 for r in rows)
    assert all(math.isfinite(r.score) and r.score < 0 and 0 < r.bits_per_byte for r in rows)
    twins = [r for r in rows if r.doc_id == 9]
    assert twins[0] == twins[1]
    assert ctw.contract(docs.limit(0)).count() == 0
    none = ctw.code_lengths(docs.where("doc_id < 3"), F.lit(False)).collect()
    assert all(r.score == pytest.approx(8 * r.n_bytes * math.log10(0.5)) and r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_kt_and_gamma():
    n = np.arange(60)
    assert np.allclose(ctw.kt_log(n, n[::-1]), [PlainTree.kt(a, b) for a, b in zip(n, n[::-1], strict=True)], atol=1e-10)
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64))
    look = ctw.Lookup(keys, np.arange(len(keys)))
    value, known = look(np.concatenate([keys, keys + np.uint64(1)]))
    assert (value[: len(keys)] == np.arange(len(keys))).all() and known[: len(keys)].all() and not known[len(keys) :].any()


def sha(*parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_climb(levels, at, h):
    proof = []
    for nodes in levels[:-1]:
        lo = at // 3 * 3
        run = nodes[lo : lo + 3]
        proof += run[: at - lo] + run[at - lo + 1 :]
        h = sha(*run[: at - lo], h, *run[at - lo + 1 :])
        at //= 3
    return proof, h


@pytest.mark.parametrize("many", [1, 3, 700])
def test_merkle_against_lists(spark, many):
    rnd = random.Random(many)
    rows = [(None if i % 50 == 7 else i // 2 * 2 if i % 31 == 5 else i, [None, "web", "é", "", "web", "web"][rnd.randrange(6)] if many > 1 else "one", rnd.choice([None, "de", ""]), rnd.choice([None, 5]), rnd.choice([None, "", "a\nb", "c\n\n漢", f"t{i}"])) for i in range(many)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "clash", 0, "clash", "clash") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, g string, pos int, leaf string, path string").repartition(4)
    groups = defaultdict(list)
    for i, source, lang, n, text in rows:
        shown = text.replace("\n", "") if text is not None and crc(i) % 2 == 0 else text
        groups[source].append(((i is not None, i or 0, sha(*map(plain_field, (i, source, lang, n, text)))), sha(*map(plain_field, (i, source, lang, n, shown)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([k[2] for k, _ in sorted(groups[s])]) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names])
    want = []
    for at_top, s in enumerate(names):
        for at, ((real, i, leaf), shown) in enumerate(sorted(groups[s])):
            proof, h = plain_climb(trees[s], at, shown)
            more, h = plain_climb(top, at_top, h)
            want.append((i if real else None, leaf, trees[s][-1][0], top[-1][0], sha(*proof, *more), h, h == top[-1][0]))
    got = [tuple(r) for r in merkle.contract(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert merkle.contract(df.limit(0)).count() == 0


def test_merkle_paths_over_several_rounds(spark):
    df = spark.range(7000).select(F.lit("hot").alias("g"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.struct("id").alias("own")).repartition(5)
    levels = plain_levels([sha(str(i)) for i in range(7000)])
    got = {r.own.id: r for r in merkle.manifest(df).collect()}
    assert len(got) == 7000
    for i in (0, 1, 80, 81, 6560, 6561, 6999):
        proof, h = plain_climb(levels, i, sha(str(i)))
        path = got[i].path
        assert [p.slot for p in path] == [i // 3**k % 3 for k in range(len(levels) - 1)]
        assert "".join(p.pre[: 64 * p.slot] + p.pre[64 * p.slot + 64 :] for p in path) == "".join(proof)
        assert got[i].root == got[i].subroot == h


def plain_codes(rows, entries=16, rounds=6):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = max(8, -(-max((len(v) for *_, v in kept), default=1) // 8) * 8)
    kept = [(i, label, np.array(v + [0] * (size - len(v)), dtype=object).reshape(8, -1)) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))[:entries]
    books = [[r[2][p] for r in first] for p in range(8)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(8):
            own = defaultdict(list)
            for *_, v in kept:
                own[near(p, v[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e], strict=True)] if own[e] else c for e, c in enumerate(books[p])]
    out = [(i, label, [near(p, v[p]) for p in range(8)]) for i, label, v in kept]
    total = Counter()
    for _, label, found in out:
        total[label] += sum(g for g, _ in found)
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in found), sum(g for g, _ in found), total[label], digest) for i, label, found in out], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_codes_against_lists(spark, seed):
    rnd = random.Random(seed)
    grid = lambda: rnd.choice([-1.0, -0.5, 0.0, 0.5, 1.0, 1 / 3]) / (4096 if seed == 1 else 1)
    rows = [(i, [grid() for _ in range(16)], rnd.choice([None, 0, 1])) for i in range(60)]
    rows += [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 0), (103, [float("inf")] + [0.0] * 15, 0), (None, [0.25] * 16, None), rows[3], rows[3]]
    if seed == 2:
        rows += [(200, [], 5), (201, [0.5] * 13, 5)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, _id string, code int").repartition(3)
    got = [tuple(r) for r in codes.contract(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=repr) == plain_codes(rows)


def test_codes_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.contract(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, [0.5] * 8, 1), (1, [0.25] * 8, 1)]
    got = [tuple(r) for r in codes.contract(spark.createDataFrame(rows, schema)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == plain_codes(rows)
    coded, books = codes.product_codes(spark.createDataFrame(rows, schema))
    assert {r._id: codes.decoded(r.code, books).tolist() for r in coded.collect()} == {1: [1024] * 8, 2: [2048] * 8}


def test_kd_tree_keeps_the_lower_of_equal_entries():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 8):
        entries, points = rng.integers(-2, 3, (16, width)), rng.integers(-3, 4, (400, width))
        index, gap = codes.KdTree(entries).nearest(points)
        every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (gap == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
