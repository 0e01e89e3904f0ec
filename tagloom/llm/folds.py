"""Training folds and bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the identifier as text, modulo ``parts``; a null identifier counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, train: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, y) of at most ``limit`` labelled rows whose identifier satisfies ``train``.

    The rows are those with the smallest identifier hashes, so the sample is
    the same on every run; its size is bounded, which is why it is broadcast.
    An identifier labelled more than once takes its largest label; null labels
    are no labels.
    """
    own = labels.where(F.col(f"`{target}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).where(train)
    own = own.groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{target}`")).cast("int").alias("y"))
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text")).where("_id is not null")
    return texts.join(F.broadcast(own), "_id")
