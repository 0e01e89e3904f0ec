"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For a merge-type vocabulary every prefix of a word has exactly one encoding,
and that encoding ends in one token. The table stores this token for each
prefix: among the pieces that end there (a walk over the reversed-piece trie,
as an automaton on the text's suffixes), it is the one that is compatible with
the last token of the prefix before it, that is, the two side by side encode to
themselves. Ids are then recovered backwards from the last prefix.

Words start at the space mark, which no piece holds after another character,
so they are encoded one by one and kept in a bounded two-generation cache.
Pieces with the tied lowest score are runs of the space mark; they merge last
and leftmost first, so they are put together afterwards.

Defined results: null and empty texts give the begin and end ids and decode to
an empty text; the space mark itself in a text decodes to a space, as in the
library; a very long text is encoded word by word and may fill a task's
memory with its ids; characters outside the vocabulary become byte pieces. Rows are
independent, so repeated rows get equal results, an empty table gives no rows,
and extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .rows import keyed, plain_id

MARK = "▁"
#: Words held in each of the two cache generations of a worker.
CACHE = 300_000
#: Characters encoded before a batch of results is handed on.
CHUNK = 1 << 21


class Encoder:
    """Encodes and decodes with the pieces of one model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.bytes_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        seen: dict[float, list[str]] = {}
        for p, i in normal.items():
            if len(p) > 1:
                seen.setdefault(scores[i], []).append(p)
        tied = {p for same in seen.values() if len(same) > 1 for p in same}
        if any(set(p) != {MARK} for p in tied) or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("this vocabulary has tied scores, or pieces over word starts, that the prefix table does not cover")
        runs = {p for p in normal if len(p) > 1 and set(p) == {MARK}}
        if runs and tied and (runs != tied or any(scores[normal[p]] > min(scores[i] for q, i in normal.items() if len(q) > 1 and q not in runs) for p in runs)):
            raise ValueError("runs of the space mark must have the lowest score")
        self.runs = {len(p): normal[p] for p in runs}
        self.begin, self.end = (next(i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "control" and p == name) for name in ("<s>", "</s>"))
        self.mark = normal[MARK]
        self.ids = {p: i for p, i in normal.items() if p not in runs}
        self.rank = {p: -scores[i] for p, i in self.ids.items() if len(p) > 1}
        self.text = pieces
        self.trie: dict = {}
        for p in self.ids:
            at = self.trie
            for ch in reversed(p):
                at = at.setdefault(ch, {})
            # the piece, and the tokens known to stand before it or not
            at[None] = (p, {})
        self.known = 0
        self.whole: dict[str, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.out = {i: p.replace(MARK, " ").encode() for p, i in normal.items()}
        self.out |= {i: bytes([b]) for b, i in self.bytes_id.items()}
        self.out |= {i: b"" for i, k in enumerate(kinds) if k not in ("normal", "byte")}

    def merged(self, text: str) -> list[str]:
        """Plain merging by priority, leftmost first; only for strings of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str, fits: dict[str, bool]) -> bool:
        """Whether two neighbouring tokens stay as they are; characters outside the vocabulary merge with nothing."""
        self.known += 1
        if self.known > 2_000_000:
            self._forget(self.trie)
            self.known = 0
        out = fits[left] = self.stands(right) and (left not in self.ids or self.merged(left + right) == [left, right])
        return out

    def _forget(self, at: dict) -> None:
        for key, below in at.items():
            if key is None:
                below[1].clear()
            else:
                self._forget(below)

    def stands(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def word(self, text: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a text that holds the space mark at its start only."""
        last: list[str] = []
        trie = self.trie
        for i, ch in enumerate(text):
            at = trie.get(ch)
            choice = ch
            j = i
            while at is not None:
                entry = at.get(None)
                if entry is not None:
                    piece, fits = entry
                    if j:
                        left = last[j - 1]
                        ok = fits.get(left)
                        if ok or ok is None and self.compatible(left, piece, fits):
                            choice = piece
                            break
                    elif self.stands(piece):
                        choice = piece
                        break
                if not j:
                    break
                j -= 1
                at = at.get(text[j])
            last.append(choice)
        ids: list[int] = []
        i = len(text)
        while i:
            piece = last[i - 1]
            own = self.ids.get(piece)
            if own is None:
                ids.extend([self.bytes_id[b] for b in reversed(piece.encode("utf-8", "replace"))])
            else:
                ids.append(own)
            i -= len(piece)
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def cached(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            # a character outside the vocabulary, such as a line end, cuts a word into independent parts
            parts = word.split("\n") if "\n" in word and "\n" not in self.ids else None
            if parts is None:
                found = self.word(word)
            else:
                line = np.array([self.bytes_id[10]], "<u4").tobytes()
                found = line.join(self.young.get(p) or self.cached(p) if p else b"" for p in parts)
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """All ids with begin and end."""
        if text:
            get, miss = self.young.get, self.cached
            words = [MARK + w for w in text.replace(MARK, " ").split(" ")]
            ids = np.frombuffer(b"".join([get(w) or miss(w) for w in words]), "<u4")
            bare = ids == self.mark
            if self.runs and (bare[1:] & bare[:-1]).any():
                ids = self._join_runs(ids, bare)
        else:
            ids = np.zeros(0, "<u4")
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")

    def _join_runs(self, ids: np.ndarray, bare: np.ndarray) -> np.ndarray:
        """Neighbouring bare marks merge leftmost first, growing while a longer run is a piece."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], bare, [False]]).astype(np.int8)))
        out, done = [], 0
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo < 2:
                continue
            out.append(ids[done:lo])
            out.append(np.array([self.runs[n] if n > 1 else self.mark for n in self._run(hi - lo)], "<u4"))
            done = hi
        out.append(ids[done:])
        return np.concatenate(out)

    def _run(self, size: int) -> list[int]:
        """Sizes that a run of marks ends in when ties merge leftmost first; left of the last entry nothing can merge."""
        out: list[int] = []
        for _ in range(size):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        raw = b"".join([out[i] for i in ids.tolist()])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def load_pieces(model_file: str) -> tuple[list[str], list[float], list[str]]:
    """Pieces, scores and kinds of a model: its size is fixed, whatever the corpus."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    kind = lambda i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal"
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [kind(i) for i in range(n)]


_encoders: dict[str, Encoder] = {}


def _coder(sent, model_file: str):
    def run(batches):
        tk.release()
        enc = _encoders.get(model_file)
        if enc is None:
            _encoders.clear()  # a worker keeps the tables of one model
            enc = _encoders[model_file] = Encoder(*sent.value)
        for batch in batches:
            lo, size, ids, texts = 0, 0, [], []
            for i in range(len(batch)):
                text = batch.column(2)[i].as_py() or ""
                own = enc.encode(text)
                ids.append(own.tobytes())
                texts.append(enc.decode(own))
                size += len(text)
                if size > CHUNK or i + 1 == len(batch):
                    n = i + 1 - lo
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["_id", "n_tokens", "ids", "decoded"])
                    lo, size, ids, texts = i + 1, 0, [], []

    return run


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), ``decoded``."""
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model_file))
    out = keyed(docs, id_col, text_col).mapInArrow(_coder(sent, model_file), "_id long, n_tokens long, ids binary, decoded string")
    return out.select(plain_id(), "n_tokens", "ids", "decoded")


def contract(docs: DataFrame, model_file: str) -> DataFrame:
    """The digest columns of ``op5``."""
    return encode_documents(docs, model_file).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
