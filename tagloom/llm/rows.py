"""Uniform handling of identifiers: nulls, repeats and clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for a null identifier inside the operators; it sorts before all others.
NULL_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` (long, never null), ``_h`` (hash of the text) and ``_text``; other columns are dropped.

    Two rows with the same identifier stay apart by ``_h``; rows equal in both
    are the same document and get the same result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"))


def without(docs: DataFrame, bad: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the documents whose identifier and text are those of a row of ``bad`` (``_id``, ``_h``), columns unchanged."""
    bad = bad.select(F.col("_id").alias("_bad_id"), F.col("_h").alias("_bad_h")).distinct()
    own_id = F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID))
    return docs.join(bad, (own_id == bad["_bad_id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["_bad_h"]), "left_anti")


def plain_id(name: str = "doc_id"):
    """The identifier as it was, null included."""
    return F.when(F.col("_id") != F.lit(NULL_ID), F.col("_id")).alias(name)
