"""Quality classifier: naive Bayes support vectors.

A document is a set of hashed indicators: word n-grams (n up to 2), n-grams of
word shapes (n up to 3), and how often words repeat. Indicators are scaled by
the log ratio of their class counts, and a linear hinge-loss model is fitted on
them by dual coordinate descent, then turned into probabilities by a logistic
curve on labelled rows set apart for it.

The classifier is fitted on at most ``SAMPLE`` labelled training rows with at
most ``INDICATORS`` indicators together, the ones with the smallest identifier
hashes; every document is scored on its whole text. A score of exactly the
threshold counts as label 1.

Defined results: null, empty and blank texts have no n-grams and get the score
of that; without labels of both classes every score is the share of label 1
(0.5 with none at all); rows are independent, so repeated rows get equal
results; a very long text is read whole in one task; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .folds import remainder, training_rows
from .rows import keyed, plain_id
from .scratch import Scratch
from .toxicity import fit_logistic

#: Labelled training rows used, at most.
SAMPLE = 8_000
#: Indicators are hashed to this many numbers.
BITS = 18
#: Indicators of all training rows together, at most: what the driver holds, four bytes each.
INDICATORS = 1 << 25


def _class_table() -> np.ndarray:
    """Character classes of bytes; punctuation keeps its own class."""
    t = np.arange(256, dtype=np.uint64) + np.uint64(16)
    t[ord("0") : ord("9") + 1] = 1
    t[ord("a") : ord("z") + 1] = 2
    t[ord("A") : ord("Z") + 1] = 3
    t[0x80:] = 4
    return t


_CLASS = _class_table()


def indicators(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, indicator) pairs in row order."""
    words = tk.Words(data, offs, tk.lower_space_table())
    n = len(offs) - 1
    rows = words.row_of()
    keys = [tk.mix(np.minimum(np.diff(words.ptr), 2).astype(np.uint64) + np.uint64(911))]
    owner = [np.arange(n)]
    if words.n:
        w = words.hashes()
        first, last = words.start, words.end - 1
        shape = np.zeros(words.n, np.uint64)
        for at in (first, np.minimum(first + 1, last), np.maximum(last - 2, first), np.maximum(last - 1, first), last):
            shape = shape * np.uint64(331) + _CLASS[data[at]]
        shape = tk.mix(shape + np.uint64(0xABCD))
        for codes, most, salt in ((w, 2, 1), (shape, 3, 2)):
            for k in range(1, most + 1):
                at = tk.window_starts(words.ptr, k, words.n)
                keys.append(tk.mix(tk.rolling(codes, k)[at] + np.uint64(salt * 100 + k)))
                owner.append(rows[at])
        # repetition: share of distinct words, of repeats of the word before, of words of odd shape, each in steps
        total = np.maximum(np.diff(words.ptr), 1)
        order = np.lexsort((w, rows))
        fresh = np.ones(words.n, bool)
        fresh[1:] = (w[order][1:] != w[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        distinct = np.bincount(rows[order], weights=fresh, minlength=n)
        again = np.zeros(words.n, bool)
        again[1:] = (w[1:] == w[:-1]) & (rows[1:] == rows[:-1])
        odd = (_CLASS[data[last]] > 4) & (_CLASS[data[np.maximum(last - 1, first)]] > 4)
        upper = (_CLASS[data[first]] == 3) & (_CLASS[data[np.minimum(first + 1, last)]] == 3)
        size = np.log2(total).astype(np.int64)
        for salt, x in enumerate((distinct, np.bincount(rows, weights=again, minlength=n), np.bincount(rows, weights=odd, minlength=n), np.bincount(rows, weights=upper, minlength=n))):
            step = np.floor(10 * x / total).astype(np.int64)
            for extra in (0, size + 1):
                keys.append(tk.mix((step + 100 * extra + 100_000 * (salt + 1)).astype(np.uint64)))
                owner.append(np.arange(n))
    pair = np.unique((np.concatenate(owner).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(keys) >> np.uint64(64 - BITS)))
    return (pair >> np.uint64(BITS)).astype(np.int64), (pair & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _train_features(batches):
    for batch in batches:
        for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(1))):
            row, key = indicators(data, offs)
            ptr = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ptr), pa.array(key.astype(np.int32))), batch.column(2).slice(lo, hi - lo)], ["_id", "x", "y"])


def fit(lists: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios, weights and the bias; rows are scaled to unit length after the log-count ratios."""
    size = 1 << BITS
    p, q = np.full(size, 0.5), np.full(size, 0.5)
    for own, label in zip(lists, y, strict=True):
        (p if label else q)[own] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    xs = []
    for own in lists:
        v = ratio[own]
        xs.append(v / max(np.sqrt(v @ v + 1), 1e-9))
    # dual coordinate descent for the L1-loss linear machine; rare labels weigh more
    sign = np.where(y > 0, 1.0, -1.0)
    share = max(y.mean(), 1e-9), max(1 - y.mean(), 1e-9)
    upper = cost * np.where(y > 0, 0.5 / share[0], 0.5 / share[1])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    norm = np.array([v @ v + 1 for v in xs])
    gen = np.random.Generator(np.random.PCG64(5))
    for _ in range(rounds):
        for i in gen.permutation(len(y)):
            own, v, s = lists[i], xs[i], sign[i]
            new = min(max(alpha[i] - (s * (w[own] @ v + bias) - 1) / norm[i], 0.0), upper[i])
            move = (new - alpha[i]) * s
            if move:
                w[own] += move * v
                bias += move
                alpha[i] = new
    return ratio, w, bias


def _margin(own_rows: np.ndarray, keys: np.ndarray, n: int, model) -> np.ndarray:
    ratio, w, bias = model
    v = ratio[keys]
    return np.bincount(own_rows, weights=v * w[keys], minlength=n) / np.sqrt(np.bincount(own_rows, weights=v * v, minlength=n) + 1) + bias


def _scorer(sent):
    def run(batches):
        model, curve, flat = sent.value
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2)), limit=1 << 20):
                n = hi - lo
                if flat is not None:
                    score = np.full(n, flat)
                else:
                    row, key = indicators(data, offs)
                    score = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * _margin(row, key, n, model), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(score)], ["_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per row: ``doc_id``, ``score`` (probability of label 1)."""
    spark = docs.sparkSession
    train = training_rows(docs, labels, target, remainder(id_col, parts) != held, sample, id_col, text_col)
    train = Scratch(spark).put(train.select("_id", "_text", "y").mapInArrow(_train_features, "_id long, x array<int>, y int"), "train")
    sizes = train.select("_id", F.size("x").alias("n"), F.xxhash64("_id").alias("o")).orderBy("o", "_id").toArrow()
    fits = np.cumsum(sizes.column("n").to_numpy()) <= INDICATORS
    if not fits.all():
        kept = spark.createDataFrame([(int(i),) for i in np.unique(sizes.column("_id").to_numpy()[fits])], "_id long")
        train = train.join(F.broadcast(kept), "_id", "left_semi")
    got = train.orderBy("_id").toArrow()
    y = (got.column("y").to_numpy() > 0).astype(np.int64)
    x = [np.asarray(v.values) for v in got.column("x")]
    model, curve, flat = None, None, None
    if len(set(y)) < 2:
        flat = float(y.mean()) if len(y) else 0.5
    else:
        apart = np.arange(len(y)) % 4 == 3
        if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
            apart = np.ones(len(y), bool)
            inside = apart
        else:
            inside = ~apart
        model = fit([v for v, k in zip(x, inside, strict=True) if k], y[inside])
        rows = np.repeat(np.arange(apart.sum()), [len(v) for v, k in zip(x, apart, strict=True) if k])
        m = _margin(rows, np.concatenate([v for v, k in zip(x, apart, strict=True) if k]), int(apart.sum()), model)
        curve = fit_logistic(np.stack([np.ones_like(m), m], 1), y[apart].astype(float), np.array([0.0, 2.0]), np.array([0.05, 0.05]))
    sent = spark.sparkContext.broadcast((model, curve, flat))
    out = keyed(docs, id_col, text_col).mapInArrow(_scorer(sent), "_id long, score double")
    return out.select(plain_id(), "score")


def contract(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op3``."""
    return quality(docs, labels).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
