"""Rules, matches and conversions over tables of documents.

Documents are independent, so each is handled whole inside one task, in Arrow
batches; rule files are shared by all documents and are sent once, behind a
check of their size. One bad document never fails a job: conversions give it an
error row, and :func:`diagnostics` has a row for everything that the other
operators leave out or pass over.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tree import Node, parse
from ..sources.shred import dealt
from . import convert
from .match import match_all, merged, text_of
from .paths import path
from .rules import Diagnostics, containers

#: Text bytes of rule files that may be sent to every task.
MAX_FILES_BYTES = 64 << 20
#: Text bytes of documents whose results a task holds at once.
SLICE_BYTES = 1 << 20
_MATCH = "doc_id long, rule_seq int, rule_type string, match_pos int, match_size int, kind string, name string, path string, ptr array<struct<name:string,kind:string,path:string,value:string>>"
_PTR = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("value", pa.string())]))


def load_files(files: DataFrame | None) -> dict[str, str]:
    """Rule files (uri, content) as a map; raises where they are too large to send."""
    if files is None:
        return {}
    size = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if size > MAX_FILES_BYTES:
        raise ValueError(f"rule files hold {size} bytes; at most {MAX_FILES_BYTES} are sent to every task")
    return {r.uri: r.content for r in files.select("uri", "content").collect()}


def _documents(df: DataFrame, deal: bool = True) -> DataFrame:
    uri = F.col("uri") if "uri" in df.columns else F.lit("")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "doc_type", F.coalesce(uri, F.lit("")).alias("uri"), "content")
    return dealt(rows) if deal else rows


def _slices(batch):
    """A batch in parts that hold a bounded amount of text, whatever Spark puts into one, or one document."""
    sizes, start, held = pc.binary_length(batch.column(3)).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def _each(batch):
    return zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def match_documents(documents: DataFrame, files: DataFrame | None = None, rules: str | None = None) -> DataFrame:
    """Matches of every rule of every document, in application order.

    ``documents(doc_id, doc_type, content[, uri])``; ``rules`` is an XML text
    that replaces the documents' own rules.
    """
    sent = documents.sparkSession.sparkContext.broadcast(load_files(files))

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            out = []
            for doc_id, kind, uri, content in _each(batch):
                try:
                    doc = parse(content or "", kind)
                    notes = Diagnostics()
                    boxes = containers(doc, kind, uri, sent.value, parse(rules, "xml") if rules else None, notes)
                    found = match_all(boxes, doc, kind == "html", notes)
                except _BAD:  # a row of diagnostics()
                    continue
                for m in found:
                    ptr = [{"name": n, "kind": v.kind if isinstance(v, Node) else "LIT", "path": path(v) if isinstance(v, Node) else None, "value": text_of(v)} for n, v in m.pointers.items()]
                    out.append((doc_id, m.rule_seq, m.rule.kind, m.position, m.size, m.node.kind, m.node.name, path(m.node), ptr))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _PTR]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in ("doc_id", "rule_seq", "rule_type", "match_pos", "match_size", "kind", "name", "path", "ptr")])

    return _documents(documents).mapInArrow(run, _MATCH)


def effective_documents(documents: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, name, value): merged metadata of every selected node; local markup wins over rules."""
    sent = documents.sparkSession.sparkContext.broadcast(load_files(files))
    its = "http://www.w3.org/2005/11/its"

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            out = []
            for doc_id, kind, uri, content in _each(batch):
                try:
                    doc = parse(content or "", kind)
                    found = match_all(containers(doc, kind, uri, sent.value), doc, kind == "html", Diagnostics())
                except _BAD:  # a row of diagnostics()
                    continue
                values = merged(found)
                for n in doc.walk():
                    for x in (n, *n.attrs):
                        own = dict(values.get(id(x), {})) | {a.local: a.value for a in x.attrs if a.ns == its}
                        out.extend((doc_id, path(x), k, v) for k, v in sorted(own.items()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.string()) for i in (1, 2, 3))], names=["doc_id", "path", "name", "value"])

    return _documents(documents).mapInArrow(run, "doc_id long, path string, name string, value string")


#: What a document may do to an operator without failing the job; too deep nesting is its own error.
_BAD = (ValueError, StopIteration, RecursionError)
_NOTES = "doc_id long, level string, code string, message string"


def diagnostics(documents: DataFrame, files: DataFrame | None = None, rules: str | None = None) -> DataFrame:
    """(doc_id, level, code, message) of what matching and merging meet in each document, in order.

    Errors are documents that do not parse (``parse_error``). Warnings are
    includes that are missing, cyclic or malformed, rules without selectors,
    selectors and pointers that fail (``bad_selector``, ``bad_pointer``) or
    select what a rule cannot apply to (``skipped_match``), pointers that reach
    no node or several (``pointer_hits``) and unbound variables.
    """
    sent = documents.sparkSession.sparkContext.broadcast(load_files(files))

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            out = []
            for doc_id, kind, uri, content in _each(batch):
                notes = Diagnostics()
                try:
                    doc = parse(content or "", kind)
                    boxes = containers(doc, kind, uri, sent.value, parse(rules, "xml") if rules else None, notes)
                    match_all(boxes, doc, kind == "html", notes)
                except _BAD as e:
                    notes.add("error", "parse_error", str(e) or type(e).__name__)
                out.extend((doc_id, *r) for r in notes.rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "level", "code", "message"])

    return _documents(documents).mapInArrow(run, _NOTES)


CONVERTERS = {
    "xml2html": lambda text, uri, files, o: convert.xml_to_html(text, o.get("title", "Document"), uri, files),
    "xliff2html": lambda text, uri, files, o: convert.xliff_to_html(text, o.get("title", "Document"), o.get("labels", True), uri, files),
    "xml2xliff": lambda text, uri, files, o: convert.xml_to_xliff(text, uri, files, o.get("group"), o.get("tu")),
    "reduceHtml": lambda text, uri, files, o: convert.reduce_html(text, uri, files),
}


def convert_documents(documents: DataFrame, task: str, files: DataFrame | None = None, deal: bool = True, **options) -> DataFrame:
    """(doc_id, output, error, log): every document converted; a failure is that document's error.

    Without ``deal`` documents stay in the tasks that they come in, as what another conversion made may.
    """
    if task not in CONVERTERS:
        raise ValueError(f"no conversion {task}")
    sent = documents.sparkSession.sparkContext.broadcast(load_files(files))

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            ids, texts, errors, logs = [], [], [], []
            for doc_id, _, uri, content in _each(batch):
                text = error = None
                log: list[str] = []
                try:
                    text, notes = CONVERTERS[task](content or "", uri, sent.value, options)
                    log = [m for _, _, m in notes.rows]
                except _BAD as e:
                    error = str(e) or type(e).__name__
                for c, v in zip((ids, texts, errors, logs), (doc_id, text, error, log), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(logs, pa.list_(pa.string()))], names=["doc_id", "output", "error", "log"])

    return _documents(documents, deal).mapInArrow(run, "doc_id long, output string, error string, log array<string>")
