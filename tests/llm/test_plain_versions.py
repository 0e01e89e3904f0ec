"""Toxicity sums and scores, the quality model and the rewriting of personal data against plain versions; clashing columns and null identifiers."""

import datetime
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import pieces, pii, quality, toxicity
from tagloom.llm import tokens as tk

regex = pytest.importorskip("regex")


# toxicity

def osa(a, b):
    """Edits between two words, two swapped neighbours counting once."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


LOOK = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}


def plain_sums(text, terms):
    low = "".join(LOOK.get(c, c.lower() if c.isascii() else c) for c in text)
    sums = [1, 0, 0, 0, 0, 0]
    for m in regex.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        best = min(((osa(m[0], t), t) for t in terms if osa(m[0], t) <= toxicity.edits_allowed(len(t))), default=None)
        if best is None:
            continue
        before, after = text[max(0, m.start() - 90) : m.start()].rpartition("\n")[2], text[m.end() : m.end() + 90].partition("\n")[0]
        quoted = (before.count('"') % 2 == 1 and '"' in after) or any(before.rfind(o) > before.rfind(c) and c in after for o, c in ("“”", "«»", "„“", "‘’"))
        near, behind = ([w.lower() for w in regex.findall(r"[^\W\d_]+", x)] for x in (before, after))
        mention = quoted or any(w in toxicity.REPORT for w in near[-5:])
        address = any(w in toxicity.ADDRESS for w in near[-5:][-3:] + behind[:3])
        sums[(1 if best[0] == 0 else 3) + mention] += 1 if best[0] < 2 else 0.5
        sums[5] += address and not mention
    return [1, *(math.log1p(x) for x in sums[1:])]


def test_toxicity_sums_and_scores():
    rnd = random.Random(1)
    terms = toxicity.INSULTS
    noise = ["you", "are", "a", "said", '"', "the", "word", "«", "»", "they", "\n", "plain", "1d10t", "st00pid", "m0r0n", "tras", "usless"]
    texts = ["", " "]
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(1, 14)):
            w = rnd.choice(terms) if rnd.random() < 0.3 else rnd.choice(noise)
            if w in terms and rnd.random() < 0.5:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "x" + w[k + 1 :], w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])
            words.append(w)
        texts.append(" ".join(words))
    data, offs = tk.string_buffer(pa.array(texts))
    got, _ = toxicity._features(toxicity.Lexicon(terms), data, offs, {})
    want = np.array([plain_sums(t, terms) for t in texts])
    assert np.allclose(got, want), [t for t, a, b in zip(texts, got, want, strict=True) if not np.allclose(a, b)]
    y = np.array([i % 3 == 0 for i in range(len(texts))], float)
    w = toxicity.fit_logistic(got, y, toxicity.PRIOR, toxicity.PRIOR_STRENGTH)
    # at the optimum the slope of the penalised likelihood is nothing
    p = 1 / (1 + np.exp(-(want @ w)))
    assert np.abs(want.T @ (p - y) + toxicity.PRIOR_STRENGTH * (w - toxicity.PRIOR)).max() < 1e-5


# quality

def plain_fit(sets, y, cost=1.0, rounds=12):
    """The same descent, with dictionaries."""
    size = 1 << quality.BITS
    count = {1: Counter(), 0: Counter()}
    for own, label in zip(sets, y, strict=True):
        count[label].update(own)
    total = {k: sum(c.values()) + 0.5 * size for k, c in count.items()}
    ratio = lambda i: math.log((count[1][i] + 0.5) / total[1]) - math.log((count[0][i] + 0.5) / total[0])
    rows = []
    for own in sets:
        v = {i: ratio(i) for i in own}
        norm = math.sqrt(sum(x * x for x in v.values()) + 1)
        rows.append({i: x / norm for i, x in v.items()})
    share = sum(y) / len(y)
    upper = [cost * 0.5 / (share if label else 1 - share) for label in y]
    w, bias, alpha = Counter(), 0.0, [0.0] * len(y)
    gen = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        for i in gen.permutation(len(y)).tolist():
            s = 1.0 if y[i] else -1.0
            margin = s * (sum(w[k] * x for k, x in rows[i].items()) + bias)
            new = min(max(alpha[i] - (margin - 1) / (sum(x * x for x in rows[i].values()) + 1), 0.0), upper[i])
            for k, x in rows[i].items():
                w[k] += (new - alpha[i]) * s * x
            bias += (new - alpha[i]) * s
            alpha[i] = new
    return ratio, w, bias


def test_quality_descent_against_dictionaries():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["good", "fine", "prose", "the"] if i % 3 else ["spam", "spam", "BUY", "!!"]) for _ in range(rnd.randrange(1, 30))) for i in range(60)] + ["", "  "]
    y = [int(i % 3 != 0) for i in range(60)] + [0, 0]
    data, offs = tk.string_buffer(pa.array(texts))
    row, key = quality.indicators(data, offs)
    sets = [key[row == i] for i in range(len(texts))]
    ratio, w, bias = quality.fit(sets, np.array(y))
    plain_ratio, plain_w, plain_bias = plain_fit([set(s.tolist()) for s in sets], y)
    assert bias == pytest.approx(plain_bias) and all(w[i] == pytest.approx(x) for i, x in plain_w.items()) and all(ratio[i] == pytest.approx(plain_ratio(i)) for i in plain_w)
    margins = quality._margin(row, key, len(texts), (ratio, w, bias))
    assert ((margins > 0).astype(int) == y).mean() > 0.95
    # a text's set is that of its n-grams, whatever their order and number
    a, b, c = (set(sets_of(t)) for t in ("one two one two one two one two", "one two one two one two one two", "one two one three"))
    assert a == b and a != c


def sets_of(text):
    data, offs = tk.string_buffer(pa.array([text]))
    return quality.indicators(data, offs)[1].tolist()


def test_quality_takes_no_more_indicators_than_it_may(spark, monkeypatch):
    rows = [(i, "good fine prose" if i % 2 else "spam spam buy") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    full = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    monkeypatch.setattr(quality, "INDICATORS", 500)
    few = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert len(few) == 40 and few != full and all((few[i] > 0.5) == (i % 2 == 1) for i in few)


# personal data

class Plain:
    def __init__(self, key):
        self.key = key

    def number(self, *parts):
        return int(hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()[:13], 16)

    def digits(self, d, kind):
        half = len(d) // 2
        a, b = d[:half], d[half:]
        for r in range(1, pii.ROUNDS + 1):
            a, b = b, str((int(a) + self.number(kind, len(d), r, b)) % 10 ** len(a)).zfill(len(a))
        return a + b

    def day(self, date):
        n = (date - datetime.date(1900, 1, 1)).days
        while 0 <= n < pii.DAYS:
            n = int(self.digits(str(n).zfill(5), "date"))
            if n < pii.DAYS:
                return datetime.date(1900, 1, 1) + datetime.timedelta(n)
            n = self.walk(n)
        return None

    def walk(self, n):
        while n >= pii.DAYS:
            n = int(self.digits(str(n).zfill(5), "date"))
        self.found = datetime.date(1900, 1, 1) + datetime.timedelta(n)
        return -1

    def date(self, m):
        for rx, order in ((r"(\d{4})-(\d\d)-(\d\d)", "ymd"), (r"(0[1-9]|1[0-2])/(\d\d)/(\d{4})", "mdy"), (r"(\d\d)/(\d\d)/(\d{4})", "dmy")):
            if (got := regex.fullmatch(rx, m)) is None:
                continue
            part = dict(zip(order, got.groups(), strict=True))
            try:
                real = datetime.date(int(part["y"]), int(part["m"]), int(part["d"]))
            except ValueError:
                continue
            if not 1900 <= real.year <= 2099:
                return None
            self.found = None
            new = self.day(real) or self.found
            show = {"y": f"{new.year:04}", "m": f"{new.month:02}", "d": f"{new.day:02}"}
            return ("-" if order == "ymd" else "/").join(show[c] for c in order)
        return None

    def pseudonym(self, kind, m):
        d = "".join(c for c in m if c.isdigit())
        hashed = hashlib.sha256((self.key + m.lower()).encode()).hexdigest()
        if kind == "mail":
            return f"u{hashed[:32]}@mail.example"
        if kind == "hex":
            return hashed[: len(m)].upper() if regex.search("[A-F]", m) and not regex.search("[a-f]", m) else hashed[: len(m)]
        if kind == "date":
            return self.date(m)
        if kind == "ssn":
            return self.refill(m, self.digits(d, "ssn"))
        if kind == "phone":
            return self.refill(m, d[:-10] + self.digits(d[-10:], "phone"))
        if kind == "ipv4":
            octets = [int(x) for x in m.split(".")]
            if max(octets) > 255:
                return None
            n = int.from_bytes(bytes(octets), "big")
            a, b = n >> 16, n & 65535
            for r in range(1, pii.ROUNDS + 1):
                a, b = b, (a + self.number("ipv4", r, b)) % 65536
            return ".".join(map(str, (a << 16 | b).to_bytes(4, "big")))
        if self.luhn(d) % 10:
            return None
        body = d[0] + self.digits(d[1:-1], "card")
        return self.refill(m, body + str(-self.luhn(body + "0") % 10))

    @staticmethod
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))

    @staticmethod
    def refill(m, digits):
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in m)

    def rewrite(self, text):
        found = []

        def one(m):
            kind = next((k for k, p in pii.KINDS.items() if regex.fullmatch(p, m[0])), "card")
            new = self.pseudonym(kind, m[0])
            if new is not None:
                found.append((kind, new))
            return m[0] if new is None else new

        return regex.sub(pii.ANY, one, text), found


def test_personal_data_against_plain_python(spark):
    rnd = random.Random(12)
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + n(14)
        return body + str(-Plain.luhn(body + "0") % 10)

    makers = [
        card, lambda: n(16), lambda: " ".join(regex.findall("....", card())), lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"{n(2)}.{n(2)}.{n(3)}.{n(1)}",
        lambda: f"19{n(2)}-{rnd.randrange(1, 14):02}-{rnd.randrange(1, 32):02}", lambda: f"{rnd.randrange(1, 32):02}/{rnd.randrange(1, 14):02}/20{n(2)}", lambda: f"a.{n(2)}@x{n(1)}.example.org", lambda: hashlib.md5(n(3).encode()).hexdigest(), lambda: "word", lambda: n(5), lambda: "é,",
    ]
    rows = [(i, " ".join(rnd.choice(makers)() for _ in range(rnd.randrange(1, 12))), "clash", "clash") for i in range(250)]
    rows += [(None, "19/10/1999 null id", "c", "c"), (500, None, "c", "c"), (501, "", "c", "c"), (502, "x" * 100_000 + " " + card(), "c", "c"), (500, card(), "c", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string, _text string")
    got = Counter((r.doc_id, r.text, tuple((f.kind, f.pseudonym) for f in r.found)) for r in pii.pseudonymize(df, "secret").collect())
    plain = Plain("secret")
    want = Counter((i, None, ()) if t is None else (i, (done := plain.rewrite(t))[0], tuple(done[1])) for i, t, *_ in rows)
    assert got == want
    kinds = {k for _, _, found in want for k, _ in found}
    assert kinds == set(pii.KINDS)


def test_sessions_without_a_key_get_a_secret_one(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64 and not hasattr(pii, "KEY")
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_classifiers_take_null_identifiers_and_clashing_columns(spark):
    rows = [(i if i else None, "you are an idiot and a moron" if i % 2 else "a fine text", "c", 1.0, "c") for i in range(30)] + [(7, "w " * 200_000, "c", 1.0, "c"), (8, None, "c", 1.0, "c"), (8, None, "c", 1.0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, score double, y string")
    labels = spark.createDataFrame([(i if i else None, i % 2, 1 - i % 2, "c") for i in range(30)] + [(5, None, None, "c"), (5, 1, 0, "c")], "doc_id long, toxic int, quality int, text string")
    for run, target in ((toxicity.contract, "toxic"), (quality.contract, "quality")):
        out = run(docs, labels)
        assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and out.count() == len(rows), target
        assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    tokenizers = pytest.importorskip("public_tokenizers")
    assert Counter(r.doc_id for r in pieces.contract(docs, tokenizers.path("piece_bpe_32k.model")).collect()) == Counter(r[0] for r in rows)
