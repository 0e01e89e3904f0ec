"""Documents arriving as Parquet or text files, converted or matched as they come.

Every operator here works on one document at a time, so the streaming plan has
no state; late files need no watermark. ``foreachBatch`` sinks give exactly-once
output with a checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import convert_documents
from ..shipping import ship
from ..sources.shred import shred

DOCUMENTS = "doc_id long, doc_type string, content string"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENTS, max_files: int = 100) -> DataFrame:
    """Documents of Parquet files that appear below ``path``."""
    return ship(spark).readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def shred_stream(documents: DataFrame) -> DataFrame:
    """Node rows as documents arrive."""
    return shred(documents)


def convert_stream(documents: DataFrame, task: str, **options) -> DataFrame:
    """Conversions as documents arrive; a bad document is an error row."""
    return convert_documents(documents, task, **options)


def token_counts(pages: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Markup tokens by kind in tumbling windows of event time; rows later than ``late`` are left out."""
    from ..functions.columns import token_kind, tokens

    t = pages.withWatermark(time_col, late).select(time_col, F.explode(tokens(F.col("content"))).alias("t"))
    return t.groupBy(F.window(time_col, window), token_kind(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))
