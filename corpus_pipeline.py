"""The training-data pipeline: toxicity, line dedup, MinHash near-dedup, decontamination, tokenizing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; each result is written as Parquet and read again as the next one's
documents. All stages but the last return the columns of ``documents``:

* ``toxicity`` drops documents scored 0.7 or more;
* ``lines`` cuts lines that repeat earlier ones, and documents of which no word is left;
* ``minhash`` keeps the smallest identifier of each group of near duplicates;
* ``decontaminate`` drops documents that hold a window of a benchmark item;
* ``pieces`` encodes what is left and decodes it again.

Defined results: null texts pass all stages and are encoded as empty; empty
texts pass too; rows equal in identifier and text stand or fall together, and
of near copies one identifier stays, with all its rows; rows without an
identifier are never near copies' losers; extra columns, whatever their names,
are carried to the last stage, which returns the encoder's columns; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontaminate, lines, minhash, pieces, toxicity
from tagloom.llm.scratch import Scratch
from tagloom.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return lines.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return pieces.contract(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("lines", drop_lines), ("minhash", drop_near_copies), ("decontaminate", drop_contaminated), ("pieces", encode)]

#: The toxicity model and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
