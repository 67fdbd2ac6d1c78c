"""Tables laid out by hash bucket of a key, of which a merge rewrites only the buckets that its keys fall in.

A bucket is a folder. What a merge reads and writes is in proportion to the
buckets with new keys, and other buckets' files keep their place and time. A
merge that dies while its folders are replaced is run again: merges that take
the newest row of a key give the same table twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialised


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, order: list[str] | None = None, only_these: bool = False) -> None:
    """Write ``rows`` as a table, or, with ``only_these``, in place of the buckets that they fall in."""
    placed = rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").sortWithinPartitions("bucket", *(order or keys))
    placed.write.option("partitionOverwriteMode", "dynamic" if only_these else "static").mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str, only: list[int] | None = None) -> DataFrame:
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return (rows if only is None else rows.filter(F.col("bucket").isin(only))).drop("bucket")


def merge_buckets(spark: SparkSession, path: str, schema: str, keys: list[str], new: DataFrame, merge: Callable[[DataFrame], DataFrame], buckets: int = 64, order: list[str] | None = None) -> list[int]:
    """Replace the buckets that ``new`` has keys in by ``merge`` of their rows; the buckets.

    ``merge`` gets those buckets' rows and must keep their keys in their buckets.
    """
    touched = [r[0] for r in new.select(bucket_of(keys, buckets)).distinct().collect()]  # at most ``buckets``
    if not touched:
        return []
    rows = materialised(merge(read_buckets(spark, path, schema, touched)))  # read before files are replaced
    left = {r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect()}
    write_buckets(rows, path, keys, buckets, order, only_these=True)
    for b in set(touched) - left:  # a bucket without rows has no file to replace its old ones
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return sorted(touched)
