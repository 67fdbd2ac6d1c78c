"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a join may broadcast: of an id or two (some 50 bytes each once hashed), and of row keys (some 120).
BROADCAST_IDS, BROADCAST_KEYS = 2_000_000, 1_000_000
#: Most bytes that its texts and binaries may have together, whatever their number.
BROADCAST_BYTES = 64 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` materialised in ``spark.checkpoint.dir``, which all executors share.

    Only where no directory is set (local tests) a temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="chk"))
    return df.checkpoint()


def cut(df: DataFrame) -> DataFrame:
    """``checkpointed`` for a step of a loop: what Spark infers about the columns (a = least(b, c), …) isn't carried on.

    A checkpoint keeps such constraints, and over some ten rounds they grow until
    planning takes longer than the work.
    """
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return checkpointed(df.select("*"))  # planned anew, without them
    finally:
        conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Free the disk of shuffles and checkpoints that nothing needs any more.

    Spark removes them when the driver's garbage is collected, which it else
    does on a timer (spark.cleaner.periodicGC.interval). Call it between the
    phases of a long job, once the frames of the last one are out of scope.
    """
    for _ in range(2):  # what the first collection frees lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def bound_batches(spark: SparkSession) -> None:
    """Let this session's Arrow batches, which Python tasks get their rows in, hold at most ``BATCH_BYTES`` or ``BATCH_ROWS``.

    Each running task holds a batch in the JVM and in its worker, so jobs over
    long texts set this once, before their frames are planned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def small_side(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if it has at most ``bound`` rows and its texts ``BROADCAST_BYTES``, else as it is.

    Counting is a job of its own, so pass a checkpointed frame.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in ids.schema if f.dataType.simpleString() in ("string", "binary")]
    rows, size = ids.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(ids) if rows <= bound and size <= BROADCAST_BYTES else ids


def text_sha(text: Column) -> Column:
    """SHA-256 of a text; null has none."""
    return F.sha2(text.cast("string"), 256)


def row_key(id_col: str = "doc_id", sha: Column | None = None) -> Column:
    """16 bytes that stand for a row's id and text (by default ``text``, else the digest ``sha``); never null, whatever is null in the row."""
    sha = text_sha(F.col("text")) if sha is None else sha
    known = F.coalesce(F.concat(F.lit("s"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.substring(F.sha2(F.concat(F.coalesce(sha, F.lit("n")), F.lit(":"), known), 256), 1, 32))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with ``_`` after it a name that ``df`` has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, dropped: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows of ``docs`` whose ``key`` (by default ``row_key()``) isn't in ``dropped`` (one column of keys).

    A short list of dropped keys is broadcast, so the texts aren't shuffled; a
    long one is joined by shuffle.
    """
    own = fresh(docs, "_key")
    gone = checkpointed(dropped.select(F.col(dropped.columns[0]).alias(own)).distinct())
    return docs.withColumn(own, row_key() if key is None else key).join(small_side(gone, BROADCAST_KEYS), own, "left_anti").select(*docs.columns)
