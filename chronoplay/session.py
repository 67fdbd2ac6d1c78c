"""The Spark session that jobs use outside a cluster manager."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted frame is broadcast.
BROADCAST_ROWS = 100_000


def session(app: str = "chronoplay", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys have ``_`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, the cluster's; only where none is set (local runs) a temporary one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="chk"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to ``spark.checkpoint.dir``, for plans that use it several times.

    Plans on it read those files, whatever executor is lost.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Free the disk of shuffles and checkpoints that nothing needs any more.

    Spark removes them when the driver's garbage is collected, which a driver
    that runs no tasks hardly does by itself.
    """
    for _ in range(2):  # what the first collection frees lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes a frame once, like ``materialised``, for long jobs over long frames: its files are columns and go at the end.

    They take a fraction of a checkpoint's disk, which may stay as long as the
    application. Each call also releases the shuffles of the steps before it.
    """
    top, n = f"{checkpoint_dir(spark)}/scratch_{uuid.uuid4().hex}", 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        path, n = f"{top}/{n}", n + 1
        df.write.parquet(path)
        release(spark)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """``df``, computed and counted, with a broadcast hint if it is short: a join on a column of few values else gives a task all rows of one."""
    rows = materialised(df)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
