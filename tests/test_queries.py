import duckdb
import pytest

import __spark_entry__ as entry
from tagloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_conversions_do_not_fail(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0
    if "error" in df.columns:
        assert df.where("error is not null").count() == 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "href", "match_pos", "match_size"]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for n in ("2", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = QUERIES["future_ids"](spark, sf_dir)
        rows.append(normal(df.collect(), df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]


def test_id_references_cover_every_line_item(spark, sf_dir):
    df = QUERIES["id_references"](spark, sf_dir)
    tree = QUERIES["tree_nodes"](spark, sf_dir).where("local_name = 'lineitem'")
    assert df.count() == tree.count() > 0
    # an order holds its line items, so the node that the identifier finds is their parent
    assert df.join(tree.select("doc_id", "pre", "parent"), ["doc_id", "pre"]).where("target = parent").count() == tree.count()
