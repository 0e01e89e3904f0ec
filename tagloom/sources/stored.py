"""Node rows written once, for several plans to read.

Tables go below the shared folder that ``spark.checkpoint.dir`` names, so a
lost executor loses none of them, and every plan reads only the columns and
row groups that it needs. They are deleted when the driver ends.

Node rows take some six bytes each as Parquet and forty times that in memory.
Spark estimates a table's size from its files, and would send tables of many
million rows to the driver and all executors for a join; so the session is told
of the factor (unless it has one of its own), and the joins stay shuffled until
Spark has seen that a side is small. Shuffled node rows shrink alike, so Spark's
64 MB are a task of several GB in memory: the session, where it has the default,
is told to make smaller ones, of which there may be as many as the input needs.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes in memory for a byte of the files, about.
SWELLS = "40.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes that one task reads from a shuffle, and the partitions that these are put together from.
_TASK, _DEALT = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TASK_BYTES, DEALT = 16 << 20, 1000

_local: list[str] = []
_kept: dict[tuple[str, str], str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; one of our own only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="tagloom-nodes-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def store(df: DataFrame) -> DataFrame:
    """``df`` written and read back."""
    return _read(df.sparkSession, _write(df), df)


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name, written at its first use in the application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        sized(spark)
        _kept[key] = _write(make())
    return spark.read.parquet(_kept[key])


def forget(spark: SparkSession, name: str) -> None:
    """Delete a table of :func:`once`; the next use writes it anew."""
    path = _kept.pop((spark.sparkContext.applicationId, name), None)
    if path is not None:
        _delete(spark, path)


def sized(spark: SparkSession) -> None:
    """Tell the session of the sizes above, where it has none of its own."""
    conf = spark.conf
    if float(conf.get(_FACTOR)) == 1:
        conf.set(_FACTOR, SWELLS)
    if conf.get(_TASK) in ("67108864b", "67108864", "64MB", "64m"):
        conf.set(_TASK, str(TASK_BYTES))
    if conf.get(_DEALT, None) is None and conf.get("spark.sql.shuffle.partitions") == "200":
        conf.set(_DEALT, str(DEALT))


def _write(df: DataFrame) -> str:
    sized(df.sparkSession)
    path = f"{folder(df.sparkSession)}/nodes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _local:
        atexit.register(_delete, df.sparkSession, path)
    return path


def _read(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended first; the folder is then left to whoever owns it
        return
