"""Large groups dealt out as blocks, clashing names, and what a cluster needs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import lines, minhash, pieces, pii, scratch


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_is_the_plain_one(spark, edits):
    rnd, rows = random.Random(edits), []
    for _ in range(400):
        a = [rnd.choice("abé漢 ") for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 30]))]
        b = list(a)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(2)] = [rnd.choice("abé漢 ")] * rnd.randrange(2)
        rows.append(("".join(a), "".join(b)))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(chars("a"), chars("b"), edits).alias("near")).collect()
    assert [r.near for r in got] == [edit_distance(r.a, r.b) <= edits for r in got]


def test_lines_of_a_crowded_key_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    rnd = random.Random(3)
    base = "a line that many documents share, but for the words in "
    rows = [(i, base + "".join(rnd.choice("abcd") for _ in range(4)) + " end of it") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r._n_removed for r in lines.repeated_lines(docs).collect()}
    want = {i: int(any(edit_distance(t, u) <= 2 for _, u in rows[:i])) for i, t in rows}
    assert got == want and 0 < sum(want.values()) < len(rows)


def test_lines_with_the_operators_own_names_as_columns(spark):
    line = "this line stands in both documents"
    rows = [(1, f"{line}\nshort", 7, "x", 5, "r", 1, 40, "l"), (2, line, 8, "y", 6, "s", 2, 34, "m"), (None, None, 9, "z", 7, "t", 3, 0, "n"), (3, "", 1, "w", 8, "u", 4, 0, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_removed int, _n_lines string, n_removed int, row string, f int, n_chars long, lines string")
    out = {r.doc_id: r for r in lines.without_repeats(docs).collect()}
    assert out[1] == rows[0] and out[None] == rows[2] and out[3] == rows[3] and 2 not in out
    assert lines.without_repeats(docs).columns == docs.columns
    assert {r.doc_id: r._n_removed for r in lines.repeated_lines(docs).collect()} == {1: 0, 2: 1, None: 0, 3: 0}
    assert lines.without_repeats(docs.limit(0)).count() == 0


def test_overlaps_are_plain_intersections(monkeypatch):
    monkeypatch.setattr(minhash, "_COLUMNS", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50), dtype=np.uint64)) for _ in range(12)]
    got = minhash.overlaps(sets)
    # a set's own entry counts only what another set has too; pairs are what is asked for
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert minhash.overlaps([]).shape == (0, 0)


def test_chains_of_near_copies_in_several_blocks(spark, monkeypatch):
    """Every text is near its neighbours only, so components need links that no bucket's centre has."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "FAN", 3)
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)] + [(100 + i, " ".join(words[:110]) + f" v{i}") for i in range(20)] + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: top(i) for i in sets} and len(set(got.values())) < 10


def test_a_cluster_needs_a_shared_folder(spark):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
    assert scratch.shared_dir(spark)


def test_pii_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.org or 192.168.10.7"), (2, None)], "doc_id long, text string")
    first = {r.doc_id: r.text for r in pii.contract(docs).collect()}
    spark.conf.set(pii.KEY_SETTING, "another key")
    other = {r.doc_id: r.text for r in pii.contract(docs).collect()}
    spark.conf.unset(pii.KEY_SETTING)
    assert first[1] != other[1] and first[2] is None and other[2] is None
    assert first == {r.doc_id: r.text for r in pii.contract(docs).collect()}


def test_empty_tables(spark, tmp_path):
    import public_tokenizers

    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert pieces.contract(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
