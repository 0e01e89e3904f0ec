"""Documents to node rows: the pre/post interval encoding of trees.

``nodes`` rows are keyed by (doc_id, pre). Descendants of ``a`` are the rows
with ``pre`` in ``(a.pre, a.pre + a.size)``; attributes hang off their element
and are no children. ``labels`` is the sequence of names from the root (see
:func:`label`), ``nth`` its place among
siblings with the same name, ``attrs`` and ``decls`` are an element's attributes and
namespace declarations, ``t_from`` and ``t_to`` the places of its first and
past its last character in the text of the document. The shredder is a ``mapInArrow`` over documents, so each
task holds one document tree at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paths import child_steps
from .stored import sized
from .tree import ATT, COM, DOC, ELT, PI, TXT, XHTML, XML, Node, ParseError, parse

NODES = "doc_id long, pre long, post long, size long, level int, parent long, sib_ord int, kind string, qname string, prefix string, local_name string, ns_uri string, value string, xml_id string, block boolean, nth int, labels string, attrs map<string,string>, decls map<string,string>, t_from long, t_to long, path string"
_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in NODES.split(", ")])
#: Before each step of ``labels``, and between a name and its namespace.
STEP, OF = "\x1f", "\x1e"
#: Steps of nodes without a name.
UNNAMED = {TXT: "#text", COM: "#comment", PI: "#pi", DOC: ""}
#: Rows handed on at once.
BATCH = 20_000


def label(kind: str, local: str, ns: str) -> str:
    """One step of ``labels``; attributes are marked by ``@``."""
    return STEP + (UNNAMED[kind] if kind in UNNAMED else f"{'@' if kind == ATT else ''}{local}{OF}{ns}") if kind != DOC else ""


def attribute_key(local: str, ns: str) -> str:
    """An attribute's name in ``attrs``."""
    return f"{{{ns}}}{local}" if ns else local


def node_rows(doc: Node) -> list[tuple]:
    """Rows of one numbered tree without the identifier, in ``pre`` order."""
    out: list[list] = []
    closed = chars = 0

    def opened(node: Node, level: int, parent: int | None, order: int, where: str, above: str, nth: int) -> str:
        nonlocal chars
        named = node.kind in (ELT, ATT)
        labels = above + label(node.kind, node.local, node.ns)
        begin = None if node.kind == ATT else chars
        if node.kind == TXT:
            chars += len(node.value)
        attrs = [(attribute_key(a.local, a.ns), a.value) for a in node.attrs] if node.kind == ELT else None
        decls = list(node.decls.items()) if node.decls else None
        own_id = (node.att("id") if node.ns == XHTML else node.att("id", XML)) if node.kind == ELT else None
        out.append([node.pre, None, None, level, parent, order, node.kind, node.name, node.prefix if named else "", node.local if named else node.name, node.ns, node.value, own_id, node.block(order) if node.kind == ELT else None, nth, labels, attrs, decls, begin, None, where or "/"])
        return labels

    def close(at: int) -> None:
        nonlocal closed
        out[at][1], out[at][2] = closed, out[-1][0] - out[at][0] + 1
        out[at][-2] = None if out[at][6] == ATT else chars
        closed += 1

    # an explicit stack, as documents may be nested deeply; a number closes the row that it stands for
    stack: list = [(doc, 0, None, 0, "", "", 1)]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            close(top)
            continue
        node, level, parent, order, where, above, nth = top
        labels = opened(node, level, parent, order, where, above, nth)
        stack.append(len(out) - 1)
        for i, a in enumerate(node.attrs):
            opened(a, level + 1, node.pre, i, f"{where}/@{a.name}", labels, 1)
            close(len(out) - 1)
        steps = child_steps(node.children)
        seen: dict[str, int] = {}
        nths: list[int] = []
        for c in node.children:
            own = label(c.kind, c.local, c.ns)
            seen[own] = seen.get(own, 0) + 1
            nths.append(seen[own])
        stack.extend((node.children[i], level + 1, node.pre, i, f"{where}/{steps[i]}", labels, nths[i]) for i in reversed(range(len(node.children))))
    return [tuple(r) for r in out]


#: A document that does not parse, as a row among the nodes: its message is the value.
ERROR = "ERR"


def _error_row(doc_id: int, message: str) -> tuple:
    row = dict.fromkeys(_COLUMNS)
    row |= {"doc_id": doc_id, "kind": ERROR, "value": message}
    return tuple(row.values())


def _shredder(fail_fast: bool, errors: bool = False):
    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if content is None:
                    continue
                try:
                    tree = parse(content, kind or "xml")
                except ParseError as e:
                    if fail_fast:
                        raise
                    if errors:
                        rows.append(_error_row(doc_id, str(e)))
                    continue
                rows.extend((doc_id, *r) for r in node_rows(tree))
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return run


def dealt(documents: DataFrame) -> DataFrame:
    """``documents`` dealt anew to tasks of like bytes, as many as they need: parsing takes far longer than reading, and a file may be one task."""
    if documents.isStreaming:
        return documents
    sized(documents.sparkSession)
    return documents.hint("rebalance")


def _sources(documents: DataFrame) -> DataFrame:
    return dealt(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "doc_type", "content"))


def shred(documents: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Node rows of ``documents(doc_id, doc_type, content)``.

    Malformed XML is left out (see :func:`parse_errors`) unless ``fail_fast``;
    HTML always parses.
    """
    return _sources(documents).mapInArrow(_shredder(fail_fast), NODES)


def shred_all(documents: DataFrame) -> DataFrame:
    """Node rows and error rows (``kind`` :data:`ERROR`) of one parse; written once, :func:`nodes_of` and :func:`errors_of` part them, and declarations are a column."""
    return _sources(documents).mapInArrow(_shredder(False, True), NODES)


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") != ERROR)


def errors_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == ERROR).select("doc_id", F.col("value").alias("message"))


def _errors(batches):
    for batch in batches:
        out = []
        for doc_id, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                if content is not None:
                    parse(content, kind or "xml")
            except ParseError as e:
                out.append((doc_id, str(e)))
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in out], pa.int64()), "message": pa.array([r[1] for r in out], pa.string())})


def parse_errors(documents: DataFrame) -> DataFrame:
    """(doc_id, message) of documents that do not parse."""
    return _sources(documents).mapInArrow(_errors, "doc_id long, message string")


def read_documents(spark, path: str, doc_type: str, glob: str | None = None) -> DataFrame:
    """Whole files below ``path`` as documents; ``doc_id`` is a hash of the location."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    return files.select(F.xxhash64("uri").alias("doc_id"), "uri", F.lit(doc_type).alias("doc_type"), "content")


#: By conversion, the endings of sample files and the words in a location below the folder that leave a file out.
SAMPLES = {
    "xml2html": ("xml", r"\.xml$", "rules|standoff|xliff"),
    "xml2xliff": ("xml", r"\.xml$", "rules|standoff"),
    "xliff2html": ("xml", r"\.xlf$", "rules"),
    "reduceHtml": ("html", r"\.html?$", "standoff|xliff"),
}


def sample_documents(spark, path: str, task: str) -> DataFrame:
    """The files of a sample tree that ``task`` converts: no rule, standoff or foreign files, told by their names."""
    kind, ending, left_out = SAMPLES[task]
    folder = path.partition("://")[2] if "://" in path else path
    folder = f"/{folder.strip('/')}/"
    start = F.locate(folder, F.col("uri"))
    below = F.when(start > 0, F.substring(F.col("uri"), start + len(folder), F.length("uri"))).otherwise(F.col("uri"))
    return read_documents(spark, path, kind).where(F.col("uri").rlike(ending) & ~F.lower(below).rlike(left_out))
