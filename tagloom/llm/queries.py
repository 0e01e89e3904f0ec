"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.shipping import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import contract

    return contract(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import contract

    return contract(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import contract

    return contract(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contract

    return contract(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import contract

    return contract(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import contract

    return contract(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import contract

    return contract(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import contract

    return contract(_table(spark, sf_dir, "documents"))


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import contract

    return contract(_table(spark, sf_dir, "documents"))


def op11_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import contract

    return contract(_table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import contract

    return contract(_table(spark, sf_dir, "documents"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import contract

    return contract(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_pieces": op5_pieces,
    "op6_suffixes": op6_suffixes,
    "op7_minhash": op7_minhash,
    "op8_lines": op8_lines,
    "op9_pii": op9_pii,
    "op10_windows": op10_windows,
    "op11_ctw": op11_ctw,
    "op12_merkle": op12_merkle,
    "op13_codes": op13_codes,
}
