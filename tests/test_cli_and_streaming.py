import re

from pyspark.sql import functions as F

from tagloom.cli import options, run
from tagloom.sources.shred import parse_errors, read_documents, sample_documents
from tagloom.streaming.ingest import convert_stream, document_stream, shred_stream, token_counts


def test_cli(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r>t</r>")
    (tmp_path / "b.xml").write_text("<r>")
    args = ["--xml2html", "-i", str(tmp_path / "*.xml"), "-o", str(tmp_path / "out"), "--title", "T"]
    assert run(spark, options(args)) == 1
    rows = {r.name: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "<title>T</title>" in rows["a.html"].output and rows["b.html"].error
    assert run(spark, options([*args, "-w"])) == 1
    docs = read_documents(spark, str(tmp_path), "xml", "*.xml")
    assert docs.count() == 2 and parse_errors(docs).count() == 1


def test_cli_segments_by_names_or_by_markup(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><sec><para>one</para></sec><x>two</x></r>")
    outs = {}
    for more in ([], ["--by-markup"], ["--tu", "x"]):
        to = str(tmp_path / f"out{len(outs)}")
        assert run(spark, options(["--xml2xliff", "-i", str(tmp_path / "*.xml"), "-o", to, *more])) == 0
        outs[" ".join(more)] = spark.read.parquet(to).first().output
    sources = {k: re.findall("<source>(.*?)</source>", v) for k, v in outs.items()}
    assert sources[""] == ["one"] and sources["--tu x"] == ["two"] and sorted(sources["--by-markup"]) == ["one", "two"]
    assert outs[""].count("<group") == 1


def test_sample_trees(spark, tmp_path):
    folder = tmp_path / "house_rules"  # only names below the folder count
    names = ["a.xml", "sub/b.xml", "myRules.xml", "sub/Standoff/c.xml", "xliff/d.xml", "e.xlf", "rules.xlf", "f.html", "g.htm", "standoff.html", "h.txt"]
    for n in names:
        (folder / n).parent.mkdir(parents=True, exist_ok=True)
        (folder / n).write_text("<r/>")
    got = lambda task: sorted(r.uri.rpartition("/")[2] for r in sample_documents(spark, str(folder), task).collect())
    assert got("xml2html") == ["a.xml", "b.xml"] and got("xml2xliff") == ["a.xml", "b.xml", "d.xml"]
    assert got("xliff2html") == ["e.xlf"] and got("reduceHtml") == ["f.html", "g.htm"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "xml", "<r>t<b/></r>"), (2, "xml", "<r")], "doc_id long, doc_type string, content string").write.parquet(str(tmp_path / "in"))
    for name, make in (("html", lambda d: convert_stream(d, "xml2html")), ("nodes", shred_stream)):
        q = make(document_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"s_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("select * from s_html where error is null").count() == 1
    assert spark.sql("select * from s_nodes where kind = 'ELT'").count() == 2


def test_windowed_tokens(spark):
    pages = spark.createDataFrame([("2024-01-01 00:01:00", "<p>x</p>"), ("2024-01-01 00:11:00", "<p>")], "ts string, content string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.window.start.minute, r.kind): r.n for r in token_counts(pages, "ts").collect()}
    assert got == {(0, "START"): 1, (0, "TXT"): 1, (0, "END"): 1, (10, "START"): 1}
