"""Benchmark decontamination as a prefix-filtered set join.

Each item becomes windows of ``window`` words (a shorter item is one window).
A window must be contained whole, so with its words ordered by rarity over all
documents its necessary prefix is its rarest word: documents are probed only
where that word stands, length and position bounds drop candidates that would
leave the document, and the rest is verified word by word. Of equally rare
words the first is the prefix.

Up to ``MAX_ITEM_BYTES`` of item text the windows are broadcast as arrays.
Beyond that they meet the documents by a shuffle on their rarest word: the
places of words that pass a filter of all rarest words are moved with the words
around them. Both ways read the documents twice, whatever the items' size.
Words are told apart by 64-bit hashes: two different ones among n count as
equal with probability n squared / 2**65.

Defined results: null or word-less texts have no words and no hits; null or
word-less items never match; repeated items count once per identifier; items
with a null identifier cause hits but are not listed; a very long text is
probed whole, in one task at a time; an empty table of either
side gives clean documents or no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens as tk
from .rows import keyed, plain_id, without
from .scratch import Scratch

#: Text bytes of the items that one broadcast index may hold; it takes about 50 bytes for each while it is built, 5 when it is sent.
MAX_ITEM_BYTES = 4 << 20
#: Candidate windows verified at once.
SLICE = 1 << 18
_SPANS = "array<struct<first:bigint,last:bigint>>"


class WindowIndex:
    """Distinct item windows, addressed by their rarest word.

    All items' words stand in one array of vocabulary numbers; a window is a
    place and a length in it, so an item byte takes a few bytes here.
    """

    def __init__(self, ids: list, texts: list, window: int):
        data, offs = tk.string_buffer(pa.array(texts, pa.string()))
        words = tk.Words(data, offs, tk.alnum_table())
        self.vocab, codes = np.unique(words.hashes(), return_inverse=True)
        self.seq = np.concatenate([codes, np.full(window, -1)]).astype(np.int32)
        self.width = window
        count = np.diff(words.ptr)
        whole = np.flatnonzero((count > 0) & (count < window))
        start = np.concatenate([tk.window_starts(words.ptr, window, words.n), words.ptr[whole]]).astype(np.int64)
        size = np.concatenate([np.full(len(start) - len(whole), window), count[whole]]).astype(np.int64)
        item = np.searchsorted(words.ptr, start, side="right") - 1
        # equal windows are one: by a hash of their numbers first, then number by number
        mixed = tk.mix(codes.astype(np.uint64) + np.uint64(1))
        name = np.zeros(len(start), np.uint64)
        for j in range(window):
            inside = j < size
            name[inside] = tk.mix(name[inside] * np.uint64(31) + mixed[start[inside] + j])
        order = np.argsort(name, kind="stable")
        lead = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, bool)
        head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(order) else order
        same = size[order] == size[head]
        for j in range(window):
            inside = j < size[order]
            same[inside] &= self.seq[start[order][inside] + j] == self.seq[np.minimum(start[head][inside] + j, len(self.seq) - 1)]
        lead |= ~same
        number = np.cumsum(lead) - 1
        first = order[lead]
        self.start, self.size = start[first].astype(np.int32), size[first]
        named = np.array([x is not None for x in ids], bool)
        self.names, place = np.unique(np.array([str(x) for x in ids if x is not None], object), return_inverse=True) if named.any() else (np.zeros(0, object), np.zeros(0, np.int64))
        rank = np.full(len(ids), -1)
        rank[named] = place
        owner = rank[item[order]]
        pair = np.unique(number[owner >= 0] * np.int64(len(self.names) + 1) + owner[owner >= 0])
        self.owner = (pair % (len(self.names) + 1)).astype(np.int32)
        self.owner_ptr = np.searchsorted(pair // (len(self.names) + 1), np.arange(len(self.start) + 1)).astype(np.int64)
        self.names = self.names.tolist()
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.vocab & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def order_by_rarity(self, counts: np.ndarray) -> WindowIndex:
        """Choose each window's prefix, its rarest word by document-corpus count; of equally rare ones the first."""
        least, offset = np.full(len(self.start), np.iinfo(np.int64).max), np.zeros(len(self.start), np.int64)
        for j in range(self.width):
            own = np.where(j < self.size, counts[self.seq[self.start + j]], np.iinfo(np.int64).max)
            better = own < least
            least[better], offset[better] = own[better], j
        anchor = self.seq[self.start + offset]
        order = np.argsort(anchor, kind="stable")
        self.post_window, self.post_offset = order.astype(np.int32), offset[order].astype(np.int16)
        self.post_ptr = np.searchsorted(anchor[order], np.arange(len(self.vocab) + 1))
        return self

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.vocab, hashes[at]), len(self.vocab) - 1)
            known = self.vocab[place] == hashes[at]
            out[at[known]] = place[known]
        return out

    def matches(self, codes: np.ndarray, ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence; words of row r are ptr[r]:ptr[r + 1]."""
        at = np.flatnonzero(codes >= 0)
        many = self.post_ptr[codes[at] + 1] - self.post_ptr[codes[at]]
        at, many = at[many > 0], many[many > 0]
        ends = np.cumsum(many)
        starts, found = [], []
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
            pos = np.repeat(at[lo:hi], many[lo:hi])
            post = np.arange(len(pos)) - np.repeat(ends[lo:hi] - many[lo:hi] - (ends[lo - 1] if lo else 0), many[lo:hi]) + np.repeat(self.post_ptr[codes[at[lo:hi]]], many[lo:hi])
            window = self.post_window[post]
            first = pos - self.post_offset[post]
            row = rows[pos]
            ok = (first >= ptr[row]) & (first + self.size[window] <= ptr[row + 1])
            first, window = first[ok], window[ok]
            for j in range(self.width):
                ok = (j >= self.size[window]) | (codes[np.minimum(first + j, len(codes) - 1)] == self.seq[self.start[window] + j])
                first, window = first[ok], window[ok]
            starts.append(first)
            found.append(window)
            lo = hi
        empty = np.zeros(0, np.int64)
        return np.concatenate(starts or [empty]), np.concatenate(found or [empty])

    def items_of(self, windows: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, item number) pairs of matched windows."""
        many = self.owner_ptr[windows + 1] - self.owner_ptr[windows]
        item = self.owner[np.repeat(self.owner_ptr[windows] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many, many) + np.arange(many.sum())]
        pairs = np.unique(np.repeat(rows, many) * np.int64(len(self.names) + 1) + item)
        return pairs // (len(self.names) + 1), pairs % (len(self.names) + 1)


def _counter(index):
    def run(batches):
        ix = index.value
        total = np.zeros(len(ix.vocab), np.int64)
        table = tk.alnum_table()
        for batch in batches:
            for _, _, data, offs in tk.chunks(*tk.string_buffer(batch.column(0))):
                codes = ix.codes(tk.Words(data, offs, table).hashes())
                total += np.bincount(codes[codes >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["word", "n"])

    return run


def _prober(index):
    def run(batches):
        tk.release()
        ix = index.value
        table = tk.alnum_table()
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                words = tk.Words(data, offs, table)
                codes, rows = ix.codes(words.hashes()), words.row_of()
                first, window = ix.matches(codes, words.ptr, rows)
                n = hi - lo
                edge = np.zeros(words.n + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + ix.size[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
                old = hit.copy()
                old[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
                begin, end = np.flatnonzero(new), np.flatnonzero(old)
                base = words.ptr[rows[begin]]
                spans = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["first", "last"])
                of_span = np.searchsorted(rows[begin], np.arange(n + 1)).astype(np.int32)
                row, item = ix.items_of(window, rows[first])
                names = pa.array(ix.names, pa.string()).take(pa.array(item))
                of_item = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.diff(words.ptr)), pa.ListArray.from_arrays(pa.array(of_span), spans), pa.ListArray.from_arrays(pa.array(of_item), names)],
                    ["_id", "_h", "n_words", "spans", "items"],
                )

    return run


def _item_windows(window: int):
    """(item, words, numbers) of every window: the words' hashes in order, as bytes and as a list."""

    def run(batches):
        table = tk.alnum_table()
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(1))):
                words = tk.Words(data, offs, table)
                h, count = words.hashes(), np.diff(words.ptr)
                whole = np.flatnonzero((count > 0) & (count < window))
                at = np.concatenate([tk.window_starts(words.ptr, window, words.n), words.ptr[whole]])
                size = np.concatenate([np.full(len(at) - len(whole), window), count[whole]])
                item = pa.array(np.searchsorted(words.ptr, at, side="right") - 1 + lo)
                own = [h[x : x + n] for x, n in zip(at, size, strict=True)]
                lists = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(item), pa.array([x.tobytes() for x in own], pa.binary()), lists], ["item", "words", "numbers"])

    return run


def _word_counts(sent):
    """Counts of the words that pass the filter, once a task."""

    def run(batches):
        sieve, table, keys, counts = sent.value, tk.alnum_table(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for _, _, data, offs in tk.chunks(*tk.string_buffer(batch.column(0))):
                h = tk.Words(data, offs, table).hashes()
                one, n = np.unique(h[_passes(sieve, h)], return_counts=True)
                keys.append(one)
                counts.append(n)
            if sum(map(len, keys)) > SLICE * 8:
                yield _counted(keys, counts)
                keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        yield _counted(keys, counts)

    return run


def _counted(keys: list, counts: list) -> pa.RecordBatch:
    one, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate(counts), minlength=len(one)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], ["word", "n"])


def _passes(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sieve[(h & np.uint64(len(sieve) - 1)).astype(np.int64)]


def _places(sent, window: int):
    """Every place of a word that passes the filter, with the words around it that a window could hold."""

    def run(batches):
        sieve, table = sent.value, tk.alnum_table()
        for batch in batches:
            for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
                words = tk.Words(data, offs, table)
                h, row = words.hashes(), words.row_of()
                every = np.flatnonzero(_passes(sieve, h))
                for k in range(0, len(every), SLICE // 8):
                    at = every[k : k + SLICE // 8]
                    own = row[at]
                    before = np.minimum(at - words.ptr[own], window - 1)
                    after = np.minimum(words.ptr[own + 1] - at, window)
                    around = [h[x - b : x + a].tobytes() for x, b, a in zip(at, before, after, strict=True)]
                    doc = pa.array(own + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(doc), batch.column(1).take(doc), pa.array(h[at].view(np.int64)), pa.array(at - words.ptr[own]), pa.array(before), pa.array(around, pa.binary())], ["_id", "_h", "word", "at", "before", "around"]
                    )

    return run


def _lengths(batches):
    table = tk.alnum_table()
    for batch in batches:
        for lo, hi, data, offs in tk.chunks(*tk.string_buffer(batch.column(2))):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(tk.Words(data, offs, table).ptr))], ["_id", "_h", "n_words"])


def _bits(words: DataFrame, column: str) -> np.ndarray:
    """A filter of 2**22 places of words; false where no word can be."""
    sieve = np.zeros(1 << 22, bool)
    got = words.select(F.col(column).bitwiseAND(F.lit((1 << 22) - 1)).alias("x")).distinct().toArrow()
    sieve[got.column("x").to_numpy()] = True
    return sieve


def _joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """As :func:`_contamination` for any number of items: the prefix join by a shuffle on each window's rarest word."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # an item without a name still causes hits
    owned = items.select(F.col("item").cast("string"), "text").mapInArrow(_item_windows(window), "item string, words binary, numbers array<long>")
    windows = scratch.put(owned.groupBy("words").agg(F.array_compact(F.collect_set("item")).alias("items"), F.first("numbers").alias("numbers")), "windows")
    own = windows.select("words", F.posexplode("numbers").alias("offset", "word"))
    own = scratch.put(own, "words")
    vocabulary = spark.sparkContext.broadcast(_bits(own, "word"))
    counts = rows.select("_text").mapInArrow(_word_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = own.join(counts, "word", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "offset", "word")).alias("x"))
    anchored = scratch.put(ranked.join(windows, "words").select("words", "items", F.col("x.word").alias("word"), F.col("x.offset").alias("offset")), "anchored")
    anchors = spark.sparkContext.broadcast(_bits(anchored, "word"))
    places = rows.mapInArrow(_places(anchors, window), "_id long, _h long, word long, at long, before long, around binary")
    # the window's words must stand around the place: length and position bounds, then all of them
    begin = F.col("before") - F.col("offset")
    size = F.octet_length("words")
    met = scratch.put(places, "places").join(anchored, "word").where((begin >= 0) & (F.substring(F.col("around"), (begin * 8 + 1).cast("int"), size) == F.col("words")))
    hits = met.select("_id", "_h", (F.col("at") - F.col("offset")).alias("first"), (F.col("at") - F.col("offset") + size / 8 - 1).cast("long").alias("last"), "items")
    hits = hits.groupBy("_id", "_h", "first").agg(F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    # maximal runs: a gap before a window's first word begins a new one
    doc = W.partitionBy("_id", "_h").orderBy("first")
    reach = F.max("last").over(doc.rowsBetween(W.unboundedPreceding, -1))
    runs = hits.withColumn("fresh", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(doc))
    spans = runs.groupBy("_id", "_h", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = spans.groupBy("_id", "_h").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    counted = rows.mapInArrow(_lengths, "_id long, _h long, n_words long")
    return counted.join(found, ["_id", "_h"], "left").select("_id", "_h", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def _contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """Per document: ``_id``, ``_h``, ``n_words``, ``spans`` and ``items``."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    items = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_item_bytes:
        return _joined(rows, items, window)
    got = items.collect()
    index = WindowIndex([r.item for r in got], [r.text for r in got], window)
    counts = np.zeros(len(index.vocab) + 1, np.int64)
    if len(index.vocab):
        sent = spark.sparkContext.broadcast(index)
        for r in rows.select("_text").mapInArrow(_counter(sent), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[r.word] = r.n
    sent = spark.sparkContext.broadcast(index.order_by_rarity(counts))
    return rows.mapInArrow(_prober(sent), f"_id long, _h long, n_words long, spans {_SPANS}, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, *args, **kwargs) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``spans`` (first and last word of each maximal hit run), ``items`` (sorted); arguments as for ``_contamination``."""
    return _contamination(docs, items, *args, **kwargs).select(plain_id(), "n_words", "spans", F.array_sort("items").alias("items"))


def contract(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of ``op4``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + F.lit(1).cast("long"))
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pipeline form: documents without any hit, columns unchanged."""
    return without(docs, _contamination(docs, items).where(F.size("spans") > 0))
