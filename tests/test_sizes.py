"""Plans that have to hold for tables far larger than the tests'."""

from pyspark.sql import functions as F

from tagloom.operators.xpath_plan import string_values
from tagloom.plans.edited import unique_paths
from tagloom.plans.structure import text_length
from tagloom.plans.trees import axis_descendant, false_inheritance_selectors
from tagloom.sources.relational import customer_nodes
from tagloom.sources.stored import store


def test_joins_of_stored_tables_send_none_to_the_driver(spark):
    # 1,000,000 rows in few bytes: in memory over the bound for broadcasts
    rows = store(spark.range(0, 1_000_000, 1, 4).select(F.floor(F.col("id") / 1000).alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("pre"), F.lit("order").alias("name"), F.lit("customer order").alias("labels")))
    other = rows.select("doc_id", F.col("pre").alias("parent")).where("parent > 0")
    plan = rows.withColumn("parent", F.col("pre")).join(other, ["doc_id", "parent"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keyed_node_rows_are_numbered_by_one_sort(spark, sf_dir):
    plan = customer_nodes(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # line items within orders, then all rows of a customer; nothing falls back from compiled code
    assert plan.count("Sort [") <= 2 and "map_filter" not in plan


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_condition_on_keyed_node_rows_reads_one_sort_of_node(spark, sf_dir):
    nodes = customer_nodes(spark, sf_dir)
    assert plan_of(nodes.where("kind = 'ELT' and local_name = 'order'").select("doc_id", "pre")).count("Relation [") == 1
    assert plan_of(nodes.where("kind = 'ATT' and local_name = 'flag'").select("doc_id", "value")).count("Relation [") == 1


def test_string_values_are_cut_from_offsets_without_a_sweep(spark, sf_dir):
    nodes = customer_nodes(spark, sf_dir)
    assert "MapInArrow" not in plan_of(text_length(spark, sf_dir))
    assert "MapInArrow" not in plan_of(string_values(nodes, nodes.where("kind = 'ELT'").select("doc_id", "pre", "size")))


def test_a_sweep_takes_only_what_passes_the_test(spark, sf_dir):
    plan = plan_of(axis_descendant(spark, sf_dir))
    sweep = plan[plan.index("MapInArrow") :]
    assert "TXT AS kind" not in sweep and "DOC AS kind" not in sweep


def test_sessions_with_sizes_of_their_own_keep_them(spark):
    store(spark.range(1))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(16 << 20)


def test_nodes_are_not_shuffled_by_label(spark, sf_dir):
    plan = false_inheritance_selectors(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # one sort of node is read, and one shuffle numbers the matches
    assert "hashpartitioning(labels" not in plan and plan.count("FileScan") == 2


def test_unique_paths_move_a_node_once(spark, sf_dir):
    plan = unique_paths(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # to its range of numbers, and nowhere else
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_bodies_tell_what_goes_by_labels(spark):
    from tagloom.operators import htmlize
    from tagloom.sources.shred import shred

    nodes = store(shred(spark.createDataFrame([(1, "xml", "<a k='1'>x<b/>y</a>")], "doc_id long, doc_type string, content string")))
    plan = htmlize.html_markup(htmlize.bodies(nodes))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
