"""``spark-submit`` entry: conversions of files, each on its own, failures reported and passed over.

    python -m tagloom.cli --xml2html -i 'docs/*.xml' -o out [-w] [--rules 'rules/*.xml']
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.batch import convert_documents
from .shipping import ship

TASKS = {"xml2html": ("xml", "html"), "xliff2html": ("xml", "html"), "xml2xliff": ("xml", "xlf"), "reduceHtml": ("html", "html")}
#: Names of groups and units where none are given.
GROUPS, UNITS = ["sec"], ["para"]


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tagloom", description=__doc__.split("\n")[0])
    which = p.add_mutually_exclusive_group(required=True)
    for t in TASKS:
        which.add_argument(f"--{t}", dest="task", action="store_const", const=t)
    p.add_argument("-i", "--input", required=True, help="files, as a path or pattern")
    p.add_argument("-o", "--output", required=True, help="folder of the results, a Parquet table of (uri, name, output, error)")
    p.add_argument("-w", "--overwrite", action="store_true", help="replace an existing result")
    p.add_argument("--rules", help="rule files that documents may link to")
    p.add_argument("--title", default="Document")
    p.add_argument("--group", action="append", help="elements that are groups (xml2xliff; without --tu: sec)")
    p.add_argument("--tu", action="append", help="elements that are units (xml2xliff; without it: para)")
    p.add_argument("--by-markup", action="store_true", help="units by the documents' own rules instead of by names (xml2xliff)")
    return p.parse_args(argv)


def run(spark: SparkSession, o: argparse.Namespace) -> int:
    """Convert and write; returns the number of failures."""
    kind, ending = TASKS[o.task]
    texts = lambda path: ship(spark).read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    docs = texts(o.input).withColumns({"doc_id": F.xxhash64("uri"), "doc_type": F.lit(kind)})
    extra = {"title": o.title}
    if not o.by_markup:
        extra |= {"group": o.group or ([] if o.tu else GROUPS), "tu": o.tu or UNITS}
    out = convert_documents(docs, o.task, texts(o.rules) if o.rules else None, **extra).join(docs.select("doc_id", "uri"), "doc_id")
    # a name never equals the input's: the ending changes, or a mark is added
    # equal names of different folders get numbers in the order of their locations
    stem = F.regexp_replace(F.element_at(F.split("uri", "/"), -1), r"\.[^.]*$", "")
    same = F.concat(stem, F.lit(f".{ending}")) == F.element_at(F.split("uri", "/"), -1)
    nth = F.row_number().over(W.partitionBy(stem).orderBy("uri")) - F.when(same, 0).otherwise(1)
    name = F.concat(stem, F.when(nth > 0, F.concat(F.lit("-"), nth)).otherwise(F.lit("")), F.lit(f".{ending}"))
    out.select("uri", name.alias("name"), "output", "error").write.mode("overwrite" if o.overwrite else "errorifexists").parquet(o.output)
    bad = spark.read.parquet(o.output).where("error is not null")
    for r in bad.limit(100).toLocalIterator():
        print(f"{r.uri}: {r.error}", file=sys.stderr)
    return bad.count()


def main(argv: list[str] | None = None) -> int:
    return 1 if run(SparkSession.builder.appName("tagloom").getOrCreate(), options(sys.argv[1:] if argv is None else argv)) else 0


if __name__ == "__main__":
    sys.exit(main())
