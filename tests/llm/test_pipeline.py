import corpus_pipeline


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    from tagloom.llm.scratch import Scratch

    scratch = Scratch(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "lines", "minhash", "decontaminate", "pieces"]
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.put(stage(spark, docs, sf_dir), name)
        after = out.count()
        assert after <= before
        if name != names[-1]:
            assert out.columns == columns
            docs, before = out, after
    assert after == before and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_rejected_rows_take_no_others_along(spark):
    """Rows without an identifier, and rows that share one, are judged by their own text."""
    from tagloom.llm import decontaminate, toxicity

    bad, good = "you are an idiot, a moron and a stupid loser", "rivers and hills were seen from the road that day"
    docs = spark.createDataFrame([(None, bad), (None, good), (None, None), (7, bad), (7, good), (8, good)], "doc_id long, text string")
    left = [(None, good), (None, None), (7, good), (8, good)]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(toxicity.keep_clean(docs, labels)) == sorted(left, key=str)
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    assert rows(decontaminate.keep_clean(docs, items)) == sorted(left, key=str)
