"""An index for substring search: postings of the names' short substrings.

Every substring of one, two or three characters of a folded name is a posting
(gram, key). A term's literal runs give the grams that a match must hold: all
of three characters of a longer run, and a run of one or two itself. Their
postings are intersected, and ``LIKE`` decides on the candidates, which are
looked up by key. Grams and names lie in folders by hash, so a search reads the
folders of its grams and of its candidates, not the dimension.

A term without any literal, such as ``%%``, asks for all names and reads them.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains, fold, folded
from ..session import materialised

GRAMS = 3
#: Candidates that are broadcast to the names; a longer list is joined by shuffle.
BROADCAST_KEYS = 100_000


def _folder(column: Column, folders: int) -> Column:
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(folders)).cast("int")


def grams_of(name: Column) -> Column:
    """Distinct substrings of one to three characters."""

    def of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - (size - 1))
        return F.when(F.length(name) >= size, F.transform(starts, lambda i: F.substr(name, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, GRAMS + 1))))


def needed_grams(term: str) -> list[str]:
    """Grams that every name holds which a folded term is found in; ``%`` and ``_`` are wildcards."""
    runs = [r for r in re.split("[%_]", term) if r]
    return sorted({r[i : i + GRAMS] for r in runs for i in range(max(1, len(r) - GRAMS + 1))})


def build_index(names: DataFrame, key: str, path: str, folders: int = 64) -> None:
    """Write the index of a dimension (``key``, ``name``); null names are found by no term, so they aren't in it."""
    rows = names.filter(F.col("name").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("key"), "name", fold("name").alias("folded"))
    placed = rows.withColumn("folder", _folder(F.col("key"), folders))
    placed.repartition("folder").sortWithinPartitions("folder", "key").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/names")
    stored = rows.sparkSession.read.parquet(f"{path}/names")
    grams = stored.select(F.explode(grams_of(F.col("folded"))).alias("gram"), "key").withColumn("folder", _folder(F.col("gram"), folders))
    # a frequent gram is spread, so no task holds all of it
    spread = grams.repartition("folder", F.pmod(F.xxhash64("key"), F.lit(8)))
    spread.sortWithinPartitions("folder", "gram", "key").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/grams")


def look_up(spark: SparkSession, path: str, keys: DataFrame, folders: int = 64) -> DataFrame:
    """(key, name, folded) of distinct ``keys`` (one column), from their folders only."""
    found = materialised(keys.select(F.col(keys.columns[0]).alias("key")).withColumn("folder", _folder(F.col("key"), folders)))
    counts = dict(found.groupBy("folder").count().collect())  # a row for each folder at most
    if sum(counts.values()) <= BROADCAST_KEYS:
        found = F.broadcast(found)
    return spark.read.parquet(f"{path}/names").filter(F.col("folder").isin(list(counts))).join(found, ["folder", "key"]).select("key", "name", "folded")


def matching(spark: SparkSession, path: str, term: str, folders: int = 64) -> DataFrame:
    """(key, name) of the indexed names that hold a term, folded like them."""
    grams = needed_grams(folded(term))
    if not grams:
        return spark.read.parquet(f"{path}/names").filter(contains(F.col("folded"), term)).select("key", "name")
    where = sorted({zlib.crc32(g.encode()) % folders for g in grams})
    postings = spark.read.parquet(f"{path}/grams").filter(F.col("folder").isin(where) & F.col("gram").isin(grams))
    held = postings.groupBy("key").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams)).select("key")
    return look_up(spark, path, held, folders).filter(contains(F.col("folded"), term)).select("key", "name")
