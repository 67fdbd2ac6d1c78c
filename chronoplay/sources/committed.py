"""Tables of committed batches: a Parquet folder for each batch, and a marker that makes it count.

A batch is written whole before its marker is created, which is one atomic
call. One that dies in between has no marker: nobody reads it, and when it runs
again its folder is overwritten. A batch with a marker is never written again.
Batches only add folders, so no other file is touched.

``compact`` writes several batches as one; a marker names the first and last
batch it stands for, and counts instead of those inside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a partition in a merged batch, so none is one task's.
SPREAD = 8


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _name(first: int, last: int) -> str:
    return f"batch={first}-{last}"


def committed(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) of the batches that count, in order."""
    where, fs = _files(spark, f"{path}/committed")
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    spans = [tuple(map(int, n.removeprefix("batch=").split("-"))) for n in names if n.startswith("batch=")]
    found: list[tuple[int, int]] = []
    for first, last in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not found or last > found[-1][1]:  # else it lies in the one before
            found.append((first, last))
    return found


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    return any(first <= batch <= last for first, last in committed(spark, path))


def _commit(spark: SparkSession, path: str, first: int, last: int) -> None:
    where, fs = _files(spark, f"{path}/committed/{_name(first, last)}")
    fs.createNewFile(where)


def write_batch(rows: DataFrame, path: str, batch: int, by: list[str]) -> bool:
    """Add ``rows``, partitioned ``by``, as a batch; whether it wasn't there yet."""
    spark = rows.sparkSession
    if is_committed(spark, path, batch):
        return False
    rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data/{_name(batch, batch)}")
    _commit(spark, path, batch, batch)
    return True


def read_batches(spark: SparkSession, path: str, schema: str, batch: int | None = None) -> DataFrame:
    """Rows of all committed batches, or of one that is committed by itself. Filters on partition columns prune folders."""
    spans = [(batch, batch)] if batch is not None else committed(spark, path)
    if not spans:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(f"{schema}, batch string").option("basePath", f"{path}/data")
    return read.parquet(*(f"{path}/data/{_name(*s)}" for s in spans)).drop("batch")


def _size_class(batches: int, fan_in: int) -> int:
    size = 0
    while batches >= fan_in:
        batches, size = batches // fan_in, size + 1
    return size


def compact(spark: SparkSession, path: str, schema: str, by: list[str], fan_in: int = 8) -> tuple[int, int] | None:
    """Write the last ``fan_in`` batches of one size class as one, if there are so many; the folder's (first, last).

    Each row is so written once a class, so of n batches some log n times.
    """
    spans = committed(spark, path)
    if len(spans) < fan_in:
        return None
    last = spans[-fan_in:]
    if len({_size_class(b - a + 1, fan_in) for a, b in last}) > 1:
        return None
    read = spark.read.schema(f"{schema}, batch string").option("basePath", f"{path}/data").parquet(*(f"{path}/data/{_name(*s)}" for s in last))
    span = (last[0][0], last[-1][1])
    rows = read.drop("batch")
    rows.repartition(*by, F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))).write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data/{_name(*span)}")
    _commit(spark, path, *span)
    return span
