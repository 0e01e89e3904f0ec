"""Include chains over tables: which rule files a document pulls in, in which order, with which parameters.

``files(uri)`` and ``links(uri, ord, href)`` are tables; relative addresses are
resolved in SQL. The walk is semi-naive: every round joins only the paths that
the last one found, a file already on its own path is not entered again, and
the rounds' tables are written, so the plan does not grow with the depth. What
a file includes applies before the file itself (post-order), which a key of
the places on the path gives without any walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import store


def resolved(base: Column, href: Column) -> Column:
    """``href`` as seen from the file ``base``: scheme and host kept, ``.`` and ``..`` taken out, query and fragment of the base left off."""
    plain = F.regexp_replace(base, "[?#].*$", "")
    site = F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substring(plain, F.length(site) + 1, F.length(plain))
    folder = F.regexp_extract(path, "^(.*/)", 1)
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).otherwise(F.concat(site, F.when(href.startswith("/"), href).otherwise(F.concat(folder, href))))
    top = F.regexp_extract(full, "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    steps = F.filter(F.split(F.substring(full, F.length(top) + 1, F.length(full)), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.concat(top, F.when((top != "") | full.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def walk(files: DataFrame, links: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """(start, uri, depth, places, seen): every way from ``starts(uri)`` along links to known files, itself included.

    ``places`` are the links' numbers on the way, ``seen`` the files. More than ``most`` links in a chain are an error.
    """
    edges = links.select(F.col("uri").alias("from_uri"), F.col("ord").cast("long").alias("ord"), resolved(F.col("uri"), F.col("href")).alias("to_uri"))
    edges = store(edges.join(files.select(F.col("uri").alias("to_uri")).distinct(), "to_uri"))
    delta = store(starts.select(F.col("uri").alias("start"), "uri", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("places"), F.array("uri").alias("seen")))
    rounds = [delta]
    for depth in range(1, most + 1):
        more = delta.join(edges, F.col("uri") == F.col("from_uri")).where(~F.array_contains("seen", F.col("to_uri")))
        delta = store(more.select("start", F.col("to_uri").alias("uri"), F.lit(depth).alias("depth"), F.concat("places", F.array("ord")).alias("places"), F.concat("seen", F.array("to_uri")).alias("seen")))
        if delta.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(delta)
    raise ValueError(f"more than {most} links in a chain")


def unresolved(files: DataFrame, links: DataFrame) -> DataFrame:
    """(uri, ord, target): links to files that are not there."""
    edges = links.select("uri", "ord", resolved(F.col("uri"), F.col("href")).alias("target"))
    return edges.join(files.select(F.col("uri").alias("target")), "target", "left_anti").select("uri", "ord", "target")


def application_order(ways: DataFrame) -> DataFrame:
    """``ways`` with ``seq``, from 1 for each start: included files before the including one, in the order of their links."""
    # past all of its own links: a file comes after what it includes
    key = F.concat("places", F.array(F.lit((1 << 63) - 1)))
    return ways.withColumn("seq", F.row_number().over(W.partitionBy("start").orderBy(key)).cast("long"))


def parameters(ways: DataFrame, params: DataFrame) -> DataFrame:
    """(start, places, uri, name, value): parameters (uri, name, value) in force on each way's last file.

    Values pass down from including to included files, and the outer file's
    value stands where an inner one repeats its name; files beside each other
    share nothing.
    """
    above = ways.select("start", "places", "uri", F.posexplode("seen").alias("depth_above", "from_uri"))
    own = above.join(params.select(F.col("uri").alias("from_uri"), "name", "value"), "from_uri")
    return own.groupBy("start", "places", "uri", "name").agg(F.min_by("value", "depth_above").alias("value"))
