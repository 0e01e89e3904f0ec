"""Each operator against a plain version, on fixtures with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import tokens as tk
from tagloom.llm import decontaminate, embeddings, folds, lines, minhash, pieces, pii, quality, suffixes, toxicity, windows
from tagloom.llm.components import connected_components
from tagloom.llm.scratch import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, _id string, f int, starts string, bucket int"


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """Identifiers to texts, with every awkward case."""
    rnd = random.Random(7)
    word = lambda: rnd.choice(["the", "of", "Ab", "éa", "x1", "zz,"]) + rnd.choice(["", "q", "rst", "漢", "!"])
    passage = " ".join(word() for _ in range(70))
    out = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "a b c d", 5: "long " * 3000}
    base = [word() for _ in range(120)]
    for i in range(6, 46):
        own = [word() for _ in range(rnd.randrange(5, 90))]
        if i % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = passage.split(" ")
        if i % 7 == 0:
            own = list(base)
            for _ in range(i % 5):
                own[rnd.randrange(len(own))] = word()
        if i % 11 == 0:
            own = own + own
        out[i] = "\n".join(" ".join(own[k : k + 12]) for k in range(0, len(own), 12))
    out[46] = out[7].upper()
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "clash", 1, "clash", 2) for i, t in texts.items()]
    return spark.createDataFrame(rows + [rows[9]], SCHEMA).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_windows(docs, texts):
    for size in (5, 20):
        seen, got = set(), by_id(windows.repeated_windows(docs, size))
        for i in sorted(texts):
            w = WORDS.findall(texts[i] or "")
            gone = set()
            for a in range(len(w) - size + 1):
                key = tuple(w[a : a + size])
                if key in seen:
                    gone.update(range(a, a + size))
                seen.add(key)
            assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), i
    assert windows.contract(docs).count() == len(texts) + 1


def test_suffixes(docs, texts):
    for length in (20, 60):
        raw = {i: (t or "").encode() for i, t in texts.items()}
        count = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
        got = by_id(suffixes.repeated_strings(docs, length))
        for i, b in raw.items():
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if count[b[k : k + length]] > 1:
                    gone[k : k + length] = True
            kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
            assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(b), int(gone.sum()), kept), i


def shingles(text):
    w = WORDS.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_minhash(docs, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = by_id(minhash.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert sum(1 for i in want if want[i] != i) >= 3
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == {i for i in want if want[i] == i}


def test_minhash_second_round(spark):
    """Chains: neighbours are linked, the ends are not, and no member is near all others."""
    rnd = random.Random(3)
    now = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    chain = []
    for _ in range(30):
        chain.append(" ".join(now))
        for _ in range(4):
            now[rnd.randrange(len(now))] = f"w{rnd.randrange(10**6)}"
    sets = {i: shingles(t) for i, t in enumerate(chain)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = by_id(minhash.near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == components(sets, links)


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(120, 16))
    near = base[:40] + rnd.normal(size=(40, 16)) * 0.08
    rows = [(i, v.tolist(), "x") for i, v in enumerate(np.concatenate([base, near, base[:5], np.repeat(base[7:8], 30, axis=0)]))]
    rows += [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] + [1.0] * 15, "x"), (903, [None] + [1.0] * 15, "x"), (904, [], "x"), (905, [1.0, 2.0], "x"), (906, [2.0, 4.0], "x"), (907, (base[3] * 1e200).tolist(), "x")]
    got = {r.vec_id: r for r in embeddings.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")).collect()}
    good = {i: np.array(v, float) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: (v / abs(v).max()) / np.linalg.norm(v / abs(v).max()) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    want = components([i for i, _, _ in rows], links)
    degree = Counter(x for pair in links for x in pair)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (degree[i], want[i], want[i] == i) for i in want}


def test_embeddings_of_several_cells(spark, monkeypatch):
    """Few strong dimensions and pairs along the line between two topics: links lean across the planes between cells."""
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(3000, 32)) * np.where(np.arange(32) < 4, 1.0, 0.03)
    turn = np.linspace(0, np.pi / 2, 600)[:, None]
    line = np.cos(turn) * np.eye(32)[5] + np.sin(turn) * np.eye(32)[6]
    x = np.concatenate([x, line + rnd.normal(size=line.shape) * 0.01])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    want = components(range(len(u)), np.argwhere(np.triu(linked)).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    for left, right in ((embeddings.LEFT, embeddings.RIGHT), (200, 500)):
        monkeypatch.setattr(embeddings, "LEFT", left)
        monkeypatch.setattr(embeddings, "RIGHT", right)
        got = {r.vec_id: r for r in embeddings.cosine_links(df).collect()}
        assert [got[i].n_links for i in range(len(u))] == linked.sum(axis=1).tolist()
        assert {i: r.component_id for i, r in got.items()} == want


def test_embeddings_of_shared_identifiers(spark):
    """Different vectors with one identifier or none are all compared, and an identifier's rows share a component."""
    rnd = np.random.default_rng(12)
    base = rnd.normal(size=(30, 12))
    ids = [None if i % 3 == 0 else i // 5 for i in range(60)]
    x = np.concatenate([base, base + rnd.normal(size=base.shape) * 0.05])
    rows = [(k, v.tolist()) for k, v in zip(ids, x, strict=True)] + [(50, (-base[0]).tolist()), (50, (-base[1]).tolist()), (40, (-base[1]).tolist())]
    got = embeddings.cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    name = [-1 if k is None else k for k, _ in rows]
    want = components(set(name), [(name[a], name[b]) for a, b in np.argwhere(linked)])
    show = lambda k: None if k == -1 else k
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter((show(k), int(d), show(want[k]), want[k] == k) for k, d in zip(name, linked.sum(axis=1), strict=True))
    assert {r.component_id for r in got if r.vec_id == 50} == {40}


def test_decontamination(spark, docs, texts):
    items = [(1, "the of"), (2, None), (3, ""), (4, " ".join(texts[9].split()[3:25])), (4, "one"), (None, "a B c d"), (50, "nowhere to be found " * 4)]
    table = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    seen = {}
    for item, t in items:
        w = rx.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            seen.setdefault(tuple(w[k : k + n]), set()).update([] if item is None else [str(item)])
    for limit in (decontaminate.MAX_ITEM_BYTES, 40):
        got = by_id(decontaminate.contamination(docs, table, max_item_bytes=limit))
        for i, t in texts.items():
            w = rx.findall((t or "").translate(LOW))
            hit, names = set(), set()
            for n in {len(k) for k in seen}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in seen:
                        hit.update(range(k, k + n))
                        names |= seen[tuple(w[k : k + n])]
            spans = {k for s in got[i].spans for k in range(s["first"], s["last"] + 1)}
            assert (got[i].n_words, spans, got[i]["items"]) == (len(w), hit, sorted(names)), (i, limit)
    assert decontaminate.contract(docs, table.limit(0)).where("contaminated").count() == 0


def test_lines(docs, texts):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    got = by_id(lines.repeated_lines(docs))
    seen, kept = [], {}
    for i in sorted(texts):
        kept[i] = None if texts[i] is None else []
        for line in texts[i].split("\n") if texts[i] is not None else []:
            if len(line) < lines.LEAST:
                kept[i].append(line)
                continue
            if line not in seen and not any(abs(len(s) - len(line)) <= 2 and distance(s, line) <= 2 for s in seen):
                kept[i].append(line)
            seen.append(line)
    assert {i: r.text for i, r in got.items()} == {i: None if k is None else "\n".join(k) for i, k in kept.items()}
    out = lines.without_repeats(docs)
    assert out.columns == docs.columns and {(r["_id"], r.f, r.bucket) for r in out.collect()} == {("clash", 1, 2)}


def test_lines_find_every_small_edit(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        line = "".join(rnd.choice("abcdéf ") for _ in range(rnd.randrange(20, 45)))
        other = list(line)
        for _ in range(2):
            k = rnd.randrange(len(other))
            rnd.choice([lambda k=k: other.pop(k), lambda k=k: other.insert(k, "z"), lambda k=k: other.__setitem__(k, "y")])()
        rows += [(2 * i, line), (2 * i + 1, "".join(other))]
    got = by_id(lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    short = {i for i, t in rows if len(t) < lines.LEAST}
    assert all(got[2 * i + 1]["_n_removed"] == 1 for i in range(60) if 2 * i + 1 not in short)


def test_pieces(spark, docs, texts):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    model = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i, r in by_id(pieces.encode_documents(docs, model)).items():
        want = sp.encode(texts[i] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == sp.decode(want), i
    enc = pieces.Encoder(*pieces.load_pieces(model))
    rnd = random.Random(1)
    signs, vocabulary = "ab  thein ▁\n\té😀xyzAB.,<s>0123ﬁ　", list(enc.ids)
    for k in range(3000):
        text = "".join(rnd.choice(signs if k % 2 else vocabulary) for _ in range(rnd.randrange(20))) + " " * rnd.randrange(30)
        assert enc.encode(text).tolist() == sp.encode(text, add_bos=True, add_eos=True)


def luhn(digits):
    d = [int(c) for c in digits if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10


def test_pii(spark):
    rows = [
        (0, None), (1, ""), (2, "card 4111 1111 1111 1111, no card 4111111111111112"), (3, "again 4111-1111-1111-1111."), (4, "+1 (017) 555-7713 and 123-45-6789"),
        (5, "on 12/31/1999, 31/12/1999 and 1999-12-31; not 1999-02-30 nor 2150-01-01"), (6, "ip 97.51.17.173, not 300.1.1.1 or 1.2.3.4.5"), (7, "a.b@mail7.example.com x"), (8, "4111 1111 1111 1111"),
        (9, "4111111111111111 12 apples, 4111111111111111 4111111111111111"), (10, "a" * 200_000 + " 1" * 50_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.pseudonymize(df))
    assert got[0].text is None and got[1].text == "" and not got[0].found
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", got[2].text)[1]
    assert card != "4111 1111 1111 1111" and card[0] == "4" and luhn(card) == 0 and "4111111111111112" in got[2].text
    assert got[3].text == f"again {card.replace(' ', '-')}." and got[8].text == card
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{2}-\d{4}", got[4].text) and "555-7713" not in got[4].text
    us, eu, iso = re.search(r"on (\S+), (\S+) and (\S+);", got[5].text).groups()
    assert (iso, eu) == (f"{us[6:]}-{us[:2]}-{us[3:5]}", f"{us[3:5]}/{us[:2]}/{us[6:]}") and us != "12/31/1999" and "1999-02-30" in got[5].text and "2150-01-01" in got[5].text
    assert "97.51.17.173" not in got[6].text and "not 300.1.1.1 or 1.2.3.4.5" in got[6].text and "mail7" not in got[7].text
    whole = card.replace(" ", "")
    assert got[9].text == f"{whole} 12 apples, {whole} {whole}" and got[10].text == rows[10][1]
    other = by_id(pii.pseudonymize(df, key="another"))
    assert other[8].text != got[8].text


def test_pii_upper_hex_and_spaced_phones(spark):
    secret = "9233A8EC" * 5
    rows = [(0, f"key {secret} here"), (1, f"key {secret.lower()} here"), (2, "call (555) 555 5657 or 555 555 5657 now")]
    got = by_id(pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string")))
    new = re.fullmatch(r"key ([0-9A-F]{40}) here", got[0].text)[1]
    assert new != secret and got[1].text == f"key {new.lower()} here"
    a, b = re.fullmatch(r"call (\(\d{3}\) \d{3} \d{4}) or (\d{3} \d{3} \d{4}) now", got[2].text).groups()
    assert "555 5657" not in got[2].text and re.sub("[()]", "", a) == b


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert n.select(pii.feistel_digits(F.col("d"), "k", "t").alias("p")).distinct().count() == 1000
    days = spark.range(3000).select(F.expr("date_add(date'2010-01-01', cast(id as int))").alias("d"))
    moved = days.select(pii._day(F.col("d"), "k").alias("p"))
    assert moved.distinct().count() == 3000 and moved.where("p < date'1900-01-01' or p > date'2099-12-31'").count() == 0


def test_feistel_in_python(spark):
    """The same network in plain Python."""
    from pyspark.sql import functions as F

    def plain(digits, key, kind):
        n, half = len(digits), len(digits) // 2
        a, b = digits[:half], digits[half:]
        for r in range(1, pii.ROUNDS + 1):
            f = int(hashlib.sha256(f"{key}|{kind}|{n}|{r}|{b}".encode()).hexdigest()[:13], 16)
            a, b = b, str((int(a) + f) % 10 ** len(a)).zfill(len(a))
        return a + b

    rows = [("12",), ("007",), ("1234567890",), ("999999999999999999",)]
    for r in spark.createDataFrame(rows, "d string").select("d", pii.feistel_digits(F.col("d"), "k", "t").alias("p")).collect():
        assert r.p == plain(r.d, "k", "t")


def test_toxicity(spark):
    lexicon = toxicity.Lexicon(toxicity.INSULTS)
    assert lexicon.best("idiot") == (0, "idiot") and lexicon.best("idoit") == (1, "idiot") and lexicon.best("wortless") == (1, "worthless")
    assert lexicon.best("table") is None and lexicon.best("") is None and lexicon.best("scam") is None
    plain = ["the tables were set for dinner and all was calm", "a page about rivers and hills", "", None]
    rows = [(i, plain[i % 4]) for i in range(200)] + [(i, f"you are an idiot and a moron, {i}") for i in range(200, 260)]
    rows += [(300, "you 1d1ot, you m0ron"), (301, 'the word "idiot" is said to be an insult'), (302, "such an iditot and a wortless lozer"), (303, "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 200)) for i in range(260)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.contract(docs, labels).collect()}
    assert all((got[i].predicted == 1) == (i >= 200) for i in range(260))
    assert got[300].predicted == 1 and got[302].predicted == 1 and got[301].predicted == 0 and got[303].predicted == 0
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    none = {r.doc_id: r for r in toxicity.contract(docs, labels.limit(0)).collect()}
    assert none[200].predicted == 1 and none[1].predicted == 0
    assert toxicity.keep_clean(docs, labels).count() == 260 - 60 + 2


def test_toxicity_edits_anywhere(spark):
    """Misspellings at every letter, the first included, against plain distances."""
    words = "tsupid olser ldiot noron athetic sidiot $tupid".split()
    docs = spark.createDataFrame([(i, f"what a {w} this was") for i, w in enumerate(words)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(docs, labels))
    assert [[(h.term, h.edits) for h in got[i].hits] for i in range(len(words))] == [[(t, 1)] for t in "stupid loser idiot moron pathetic idiot stupid".split()]

    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i == 0 or j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd, lexicon = random.Random(6), toxicity.Lexicon([*toxicity.INSULTS, "éclair", "naïveté", "漢字漢字漢"])
    tried = []
    for _ in range(400):
        w = list(rnd.choice(lexicon.terms))
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(w))
            rnd.choice([lambda k=k: w.insert(k, rnd.choice("aeé漢")), lambda k=k: w.__setitem__(k, rnd.choice("xoé漢")), lambda k=k: len(w) > 3 and w.pop(k), lambda k=k: w.insert(0, w.pop(k)) if k == 1 else None])()
        tried.append("".join(w))
    data, offs = tk.string_buffer(pa.array(tried))
    cut = tk.Words(data, offs, toxicity.look_alike_table())
    maybe = set(lexicon.candidates(cut).tolist())
    for i, w in enumerate(tried):
        want = min([(distance(t, w), t) for t in lexicon.terms if distance(t, w) <= toxicity.edits_allowed(len(t))], default=None)
        assert lexicon.best(w) == want and (want is None or i in maybe), w


def test_learned_terms(spark):
    """Copies of one text labelled toxic take no places, and frequent terms of many texts stay in."""
    rnd = random.Random(14)
    follow = [f"{a}{b}" for a in ("river", "hill", "tree", "stone", "road", "lake") for b in ("ab", "cd", "ef", "gh", "ij")]
    copy = " ".join(f"rare{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyz")
    rows = [(1, copy)] * 300 + [(1, f"{rnd.choice(follow)} zorglub {rnd.choice(follow)} {rnd.choice(follow)}") for _ in range(200)]
    rows += [(0, " ".join(rnd.choice(follow) for _ in range(6))) for _ in range(600)]
    assert toxicity.learned_terms(spark.createDataFrame(rows, "y int, _text string"), limit=20) == ["zorglub"]


def test_quality(spark):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice("river hill tree and the of stone walks over".split()) for _ in range(rnd.randrange(5, 60))) + "."
    bad = lambda: " ".join(rnd.choice("CLICK!! BUY!! ab%%% NOW!! cd$$$ $$$".split()) for _ in range(rnd.randrange(5, 60)))
    rows = [(i, good() if i % 4 else bad()) for i in range(600)] + [(700, None), (701, ""), (702, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.contract(docs, labels).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 > 0) for i in held) >= 0.98 * len(held) and len(held) > 80
    assert all(0 <= r.score <= 1 for r in got.values()) and got[700].score == got[701].score == got[702].score
    assert {r.score for r in quality.contract(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.contract(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_training_rows_are_bounded(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text")
    labels = spark.range(500).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert folds.training_rows(docs, labels, "toxic", folds.remainder("doc_id", 3) != 1, 50).count() == 50


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    want = components({n for pair in links for n in pair}, links)
    touched = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: want[n] for n in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (windows.contract(docs), suffixes.contract(docs), minhash.near_duplicates(docs), lines.contract(docs), pii.contract(docs), decontaminate.contract(docs, items), toxicity.contract(docs, labels), quality.contract(docs, labels), embeddings.contract(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.count() == 0


def test_null_identifiers(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text), (3, text), (5, "other words here")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in windows.contract(docs).collect()} == {(None, 0), (3, 60), (5, 0)}
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()} == {(None, None, True), (3, None, False), (5, 5, True)}
    assert {(r.doc_id, r.n_removed) for r in lines.contract(docs).collect()} == {(None, 0), (3, 1), (5, 0)}
    assert {r.doc_id for r in suffixes.contract(docs).collect()} == {None, 3, 5}
