"""Toxicity by a Levenshtein automaton intersected with a lexicon trie.

The lexicon is a fixed list of insults, extended by words that the training
labels show to be abusive: frequent in toxic documents, rare elsewhere, and in
many different contexts (so that copies of one mislabelled document do not
count). Every distinct word is walked through the lexicon trie together with
the states of its Levenshtein automaton, transpositions included; look-alike
digits count as the letters they stand for. Each hit gets a context: quoted or
reported words are mentions, the others are abuse, more so beside words of
address. Five sums per document enter a logistic model fitted on at most
``SAMPLE`` labelled training rows, with a prior that keeps the known meaning of
contexts that the labels do not show.

Defined results: null, empty and word-less texts get the score of a document
without hits; with no labels at all the prior alone scores; rows are
independent, so repeated rows get equal results; a very long text is read whole
in one task; quotations count line by line, within 90 bytes of the hit; an
empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .folds import remainder, training_rows
from .rows import keyed, plain_id, without
from .scratch import Scratch

#: Labelled training rows used, at most.
SAMPLE = 20_000
#: Distinct toxic texts that a learned word has to stand in.
FLOOR = 4
#: Insults that need no labels.
INSULTS = "bastard clown coward creep cretin degenerate disgusting dumbass filth garbage halfwit idiot imbecile jackass jerk loser lunatic maggot moron parasite pathetic pervert psycho scum scumbag sleazy stupid trash traitor useless vermin worthless".split()
#: Words that report or quote, and words of address.
REPORT = set("said says say called calls call wrote writes quote quoted quotes word words term insult insults slur phrase headline title reads labelled labeled named".split())
ADDRESS = set("you your youre u he she they them this these those such".split())
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"
_SPAN = 90
#: Prior weights: none, abuse, mention, misspelled abuse, misspelled mention, address.
PRIOR = np.array([-3.5, 4.0, 0.3, 3.5, 0.2, 1.0])
PRIOR_STRENGTH = np.array([0.02, 0.5, 2.0, 0.5, 2.0, 2.0])
_WORDS = re.compile(r"[^\W\d_]+")


def look_alike_table() -> np.ndarray:
    """Letters lower-cased, digits and signs that stand for letters mapped to them; other ASCII separates."""
    t = tk.alnum_table()
    for sign, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}.items():
        t[ord(sign)] = ord(letter) + 1
    return t


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class Lexicon:
    """A trie of terms walked together with a word's Levenshtein automaton."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(set(terms))
        self.known = set(self.terms)
        #: A node: its children by letter, the term that ends here, the largest allowance of a term at or below it.
        self.root: list = [{}, None, 0]
        for t in self.terms:
            at = self.root
            for ch in t:
                at[2] = max(at[2], edits_allowed(len(t)))
                at = at[0].setdefault(ch, [{}, None, 0])
            at[1], at[2] = t, max(at[2], edits_allowed(len(t)))
        masks = np.array([self._masks(t.encode()) for t in self.terms], np.uint64).reshape(-1, 2)
        self.once, self.twice = masks[:, 0], masks[:, 1]
        self.sizes = np.array([len(t) for t in self.terms], np.int64)
        self.slack = np.array([edits_allowed(len(t)) for t in self.terms], np.int64)

    @staticmethod
    def _masks(raw: bytes) -> tuple[int, int]:
        """First bytes of letters that occur, and those that occur twice."""
        once = twice = 0
        for b in (b for b in raw if b & 0xC0 != 0x80):
            bit = 1 << (b & 63)
            twice |= once & bit
            once |= bit
        return once, twice

    def candidates(self, words: tk.Words) -> np.ndarray:
        """Words that length and counts of letters (up to two of each) leave for some term.

        An edit takes at most one letter of the term away and adds at most one;
        letters go by their first byte. Equal words are decided once.
        """
        if not self.terms:
            return np.zeros(0, np.int64)
        lead = (words.codes - 1 & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(lead)])
        size = before[words.end] - before[words.start]
        every = np.flatnonzero((size >= int((self.sizes - self.slack).min())) & (size <= int((self.sizes + self.slack).max())))
        if not len(every):
            return every
        _, one, back = np.unique(words.hashes()[every], return_index=True, return_inverse=True)
        order = np.argsort(size[every[one]], kind="stable")
        at = every[one][order]
        once, twice = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        live, k = np.arange(len(at)), 0
        while len(live := live[words.start[at[live]] + k < words.end[at[live]]]):
            place = words.start[at[live]] + k
            bit = lead[place].astype(np.uint64) << (words.codes[place] - 1 & 63).astype(np.uint64)
            twice[live] |= once[live] & bit
            once[live] |= bit
            k += 1
        ok, own = np.zeros(len(at), bool), size[at]
        for m1, m2, s, k in zip(self.once, self.twice, self.sizes, self.slack, strict=True):
            some = slice(*np.searchsorted(own, [s - k, s + k + 1]))
            lost = np.bitwise_count(m1 & ~once[some]) + np.bitwise_count(m2 & ~twice[some])
            new = np.bitwise_count(once[some] & ~m1) + np.bitwise_count(twice[some] & ~m2)
            ok[some] |= (lost <= k) & (new <= k)
        good = np.zeros(len(at), bool)
        good[order] = ok
        return every[good[back]]

    def best(self, word: str) -> tuple[int, str] | None:
        """The nearest term within its allowance (smallest distance, then first in order).

        The automaton's states are bit sets: bit ``j`` of ``s0``, ``s1`` and ``s2``
        says that ``j`` letters of the word stand against the letters so far with
        at most no, one and two edits. ``t0`` and ``t1`` are the sets one letter
        earlier, from which two swapped letters go on.
        """
        if word in self.known:
            return 0, word
        found: list[tuple[int, str]] = []
        places: dict[str, int] = {}
        for j, ch in enumerate(word):
            places[ch] = places.get(ch, 0) | 1 << j
        end = 1 << len(word)
        every = 2 * end - 1
        stack = [(self.root, 0, 1, 3 & every, 7 & every, 0, 0)]
        while stack:
            node, last, s0, s1, s2, t0, t1 = stack.pop()
            for nxt, child in node[0].items():
                here = places.get(nxt, 0)
                swapped = here & last >> 1
                # a matched letter, one of the term left out, one put for another, one of the word added, two swapped
                u0 = (s0 & here) << 1
                u1 = ((s1 & here) << 1 | s0 | s0 << 1 | u0 << 1 | (t0 & swapped) << 2) & every
                u2 = ((s2 & here) << 1 | s1 | s1 << 1 | u1 << 1 | (t1 & swapped) << 2) & every
                if not (u2 if child[2] == 2 else u1 if child[2] else u0):
                    continue
                if child[1] is not None and u2 & end:
                    distance = 0 if u0 & end else 1 if u1 & end else 2
                    if distance <= edits_allowed(len(child[1])):
                        found.append((distance, child[1]))
                if child[0]:
                    stack.append((child, here, u0, u1, u2, s0, s1))
        return min(found) if found else None


def _context(raw: bytes, lo: int, hi: int, doc_lo: int, doc_hi: int) -> tuple[bool, bool]:
    """(mention, address) of the words around bytes lo:hi."""
    before = raw[max(doc_lo, lo - _SPAN) : lo].decode("utf-8", "ignore").rpartition("\n")[2]
    after = raw[hi : min(doc_hi, hi + _SPAN)].decode("utf-8", "ignore").partition("\n")[0]
    quoted = any(((before.count(o) % 2 == 1) if o == c else before.rfind(o) > before.rfind(c)) and c in after for o, c in zip(_OPEN, _CLOSE, strict=True))
    near = [w.lower() for w in _WORDS.findall(before)[-5:]]
    near_after = [w.lower() for w in _WORDS.findall(after)[:3]]
    return quoted or any(w in REPORT for w in near), any(w in ADDRESS for w in near[-3:] + near_after)


def _features(lexicon: Lexicon, data: np.ndarray, offs: np.ndarray, cache: dict) -> tuple[np.ndarray, list[list]]:
    """Sums per row, and the hits (first byte, last byte, term, distance, mention)."""
    words = tk.Words(data, offs, look_alike_table())
    out = np.zeros((len(offs) - 1, 6))
    out[:, 0] = 1
    hits: list[list] = [[] for _ in range(len(offs) - 1)]
    if not words.n:
        return out, hits
    maybe = lexicon.candidates(words)
    codes = words.codes
    rows = words.row_of()
    raw = None
    for i in maybe.tolist():
        lo, hi = int(words.start[i]), int(words.end[i])
        key = (codes[lo:hi] - 1).astype(np.uint8).tobytes()
        best = cache.get(key, 0)
        if best == 0:
            best = lexicon.best(key.decode("utf-8", "ignore"))
            if len(cache) > 500_000:
                cache.clear()
            cache[key] = best
        if best is None:
            continue
        raw = data.tobytes() if raw is None else raw
        row = int(rows[i])
        mention, address = _context(raw, lo, hi, int(offs[row]), int(offs[row + 1]))
        distance, term = best
        out[row, (1 if distance == 0 else 3) + mention] += 1 if distance < 2 else 0.5
        out[row, 5] += address and not mention
        hits[row].append((lo - int(offs[row]), hi - 1 - int(offs[row]), term, distance, mention))
    out[:, 1:] = np.log1p(out[:, 1:])
    return out, hits


def _train_features(sent):
    def run(batches):
        lexicon, cache = Lexicon(sent.value), {}
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(1))):
                x, _ = _features(lexicon, data, offs, cache)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(2).slice(lo, hi - lo)], ["x", "y"])

    return run


def _scorer(sent):
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("mention", pa.bool_())]))

    def run(batches):
        terms, weights = sent.value
        lexicon, cache = Lexicon(terms), {}
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                x, hits = _features(lexicon, data, offs, cache)
                score = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
                spans = pa.array([[dict(zip(("first", "last", "term", "edits", "mention"), h, strict=True)) for h in own] for own in hits], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(score), spans], ["_id", "_h", "score", "hits"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method for logistic regression with a Gaussian prior."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        move = np.linalg.solve(h, g)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def learned_terms(rows: DataFrame, limit: int | None = None) -> list[str]:
    """Words of toxic training rows that are rare elsewhere and stand in many contexts.

    A word needs ``FLOOR`` distinct toxic texts, twenty times the odds of the
    other rows, and either no other row at all or a log-likelihood ratio above
    the logarithm of the vocabulary, so that about one word passes by chance.
    All that pass are taken (their number is bounded by the training rows);
    ``limit`` asks for the strongest only.
    """
    words = rows.select("y", F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda w: F.length(w).between(4, 24)).alias("w"))
    total = words.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")).first()
    if not total.t:
        return []
    seen = words.select("y", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n"))
    vocabulary = seen.count()
    odds = ((F.col("t") + 0.5) / (total.t + 1)) / ((F.col("n") + 0.5) / (total.n + 1))
    share, both = total.t / (total.t + total.n), F.col("t") + F.col("n")
    ratio = F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / (both * (1 - share)))).otherwise(0)
    # contexts come from distinct texts, so that copies count once; next words grow like the square root of the texts, not in step with them
    texts = words.where("y = 1").select("w").distinct().withColumn("text", F.xxhash64("w"))
    pairs = texts.select("text", F.explode(F.arrays_zip(F.col("w").alias("word"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("next"))).alias("p")).select("text", "p.*").toDF("text", "word", "next")
    varied = pairs.groupBy("word").agg(F.count_distinct("next").alias("c"), F.count_distinct("text").alias("d"))
    varied = varied.where((F.col("d") >= FLOOR) & (F.col("c") >= F.greatest(F.lit(4), F.least(F.col("d") * 0.5, 2 * F.sqrt("d"))))).select("word")
    strong = seen.where((F.col("t") >= FLOOR) & (odds >= 20) & ((F.col("n") == 0) | (ratio >= math.log(vocabulary)))).join(varied, "word")
    if limit is not None:
        strong = strong.orderBy(F.desc(odds * F.col("t")), "word").limit(limit)
    return sorted(r.word for r in strong.select("word").collect())


def _scored(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """Per row: ``_id``, ``_h``, ``score`` and ``hits``."""
    spark = docs.sparkSession
    # read several times, so that only the first reading scans all documents
    train = Scratch(spark).put(training_rows(docs, labels, target, remainder(id_col, parts) != held, sample, id_col, text_col), "train")
    terms = sorted({*INSULTS, *learned_terms(train)})
    got = train.select("_id", "_text", "y").mapInArrow(_train_features(spark.sparkContext.broadcast(terms)), "x array<double>, y int").toPandas()
    weights = PRIOR if got.empty else fit_logistic(np.array(got["x"].tolist()), (got["y"].to_numpy() > 0).astype(float), PRIOR, PRIOR_STRENGTH)
    sent = spark.sparkContext.broadcast((terms, weights))
    return keyed(docs, id_col, text_col).mapInArrow(_scorer(sent), "_id long, _h long, score double, hits array<struct<first:bigint,last:bigint,term:string,edits:int,mention:boolean>>")


def toxicity(docs: DataFrame, labels: DataFrame, *args, **kwargs) -> DataFrame:
    """Per row: ``doc_id``, ``score`` and ``hits`` (byte span, term, edits, mention); arguments as for ``_scored``."""
    return _scored(docs, labels, *args, **kwargs).select(plain_id(), "score", "hits")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op2``."""
    return toxicity(docs, labels).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """Pipeline form: documents scored under ``least`` stay, columns unchanged."""
    return without(docs, _scored(docs, labels).where(F.col("score") >= least))
