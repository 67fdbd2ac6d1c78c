"""Files: history imports in two formats, service feeds as JSON, and exports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import materialised

EXTENDED = "ts string, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, ms_played long"
BASIC = "endTime string, trackName string, artistName string, msPlayed long"
EXTENDED_FIELDS = [field.split()[0] for field in EXTENDED.split(", ")]
PLAYED_ITEMS = "user_id long, played_at string, track struct<id:string,name:string,duration_ms:long,popularity:int,album:struct<id:string,name:string>,artists:array<struct<id:string,name:string>>>, context struct<type:string,uri:string>"
SNAPSHOTS = "user_id long, at timestamp, is_playing boolean, item_id string, progress_ms long, duration_ms long"


#: Small files that a task reads one after the other are this many times as many as the scan would give it.
PACKED = 16


def _extended() -> dict[str, Column]:
    uri = F.col("spotify_track_uri")
    return {
        "played_at": F.expr("try_to_timestamp(ts)"), "track_name": F.col("master_metadata_track_name"),
        "artist_name": F.col("master_metadata_album_artist_name"), "album_name": F.col("master_metadata_album_album_name"),
        "given_track_id": F.when(F.coalesce(uri, F.lit("")) != "", F.element_at(F.split(uri, ":"), -1)), "ms_played": F.col("ms_played"),
    }


def _basic() -> dict[str, Column]:
    return {
        "played_at": F.expr("try_to_timestamp(concat(endTime, ' UTC'), 'yyyy-MM-dd HH:mm z')"), "track_name": F.col("trackName"),
        "artist_name": F.col("artistName"), "album_name": F.lit(None).cast("string"), "given_track_id": F.lit(None).cast("string"), "ms_played": F.col("msPlayed"),
    }


def normalise_extended(raw: DataFrame) -> DataFrame:
    """Entries of the extended format; the id is the tail of its URI."""
    return raw.select("user_id", "seq", *(c.alias(n) for n, c in _extended().items()))


def normalise_basic(raw: DataFrame) -> DataFrame:
    """Entries of the basic format; its times are UTC to the minute, and it has neither albums nor ids."""
    return raw.select("user_id", "seq", *(c.alias(n) for n, c in _basic().items()))


def normalise(raw: DataFrame) -> DataFrame:
    """Entries of either format, in one pass: with ``ts`` an extended one, else with ``endTime`` a basic one, else none."""
    extended, basic = _extended(), _basic()
    return raw.filter("ts is not null or endTime is not null").select("user_id", "seq", *(F.when(F.col("ts").isNotNull(), extended[n]).otherwise(basic[n]).alias(n) for n in extended))


def import_files(spark: SparkSession, path: str, user_id: int, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(normalised entries, (file, status, entries)) of all files of that pattern under a path, of either format.

    A file's status is ``read``; ``skipped`` if it holds JSON but no array; or
    ``error`` if it holds no JSON, and then it is named here and gives no
    entries. An empty file isn't there at all. ``seq`` orders entries by file
    and place in it. Files are read and parsed once; both results come from what
    that leaves. A file is one task's, as it is one JSON text. A scan gives a task
    few files, however small they are, so tasks are joined (``PACKED``).
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).filter("length > 0")
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col("content").cast("string").alias("value"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-read.rdd.getNumPartitions() // PACKED))
    parsed = read.coalesce(tasks).select("file", F.try_parse_json("value").alias("v")).withColumn("items", F.try_variant_get("v", "$", "array<variant>"))
    status = F.when(F.col("v").isNull(), "error").when(F.col("items").isNull(), "skipped").otherwise("read")
    fields = [f.split() for f in f"{EXTENDED}, {BASIC}".split(", ")]
    each = F.transform("items", lambda x: F.struct(*(F.try_variant_get(x, f"$.{name}", kind).alias(name) for name, kind in fields)))
    files = materialised(parsed.select("file", status.alias("status"), each.alias("items")))
    items = files.select("file", F.posexplode("items").alias("n", "i"))
    rows = items.select("i.*", F.lit(user_id).cast("long").alias("user_id"), F.struct("file", "n").alias("seq"))
    return normalise(rows), files.select("file", "status", F.coalesce(F.array_size("items"), F.lit(0)).alias("entries"))


def read_import(spark: SparkSession, path: str, user_id: int, pattern: str = "*.json") -> DataFrame:
    """The entries of ``import_files``."""
    return import_files(spark, path, user_id, pattern)[0]


def write_texts(texts: DataFrame, path: str) -> None:
    """Each of ``texts`` (name, value) as the file ``name`` in one folder; where that isn't a mounted one, in a folder ``name=…`` of its own.

    Tasks write files into a mounted folder themselves, each whole before it
    takes its name: Spark's writers start processes for each local file's
    permissions, and give no names but those of partitions.
    """
    spark = texts.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        texts.select("name", "value").write.partitionBy("name").text(path)
        return
    folder = where.toUri().getPath()
    os.makedirs(folder)

    def put(rows: Iterator[Row]) -> None:
        for name, value in rows:
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as file:
                file.write(value)
            os.replace(part, f"{folder}/{name}")

    texts.select("name", "value").foreachPartition(put)


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Landed JSON lines as a stream; the checkpoint of its sink is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def read_pages(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Items of landed API pages ``{"items": […]}``."""
    return spark.read.schema(f"items array<struct<{item_schema}>>").json(path).select(F.explode("items").alias("i")).select("i.*")


#: Exports keep microseconds, which Spark's own formats of text cut.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def write_json(rows: DataFrame, path: str) -> None:
    """Plays as JSON lines, each file newest first; ranges of time don't overlap between files."""
    rows.repartitionByRange(F.col("played_at").desc()).sortWithinPartitions(F.col("played_at").desc()).write.mode("overwrite").options(**TIMES).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Plays as CSV with a header, quoted and escaped; nulls are empty."""
    ordered = rows.repartitionByRange(F.col("played_at").desc()).sortWithinPartitions(F.col("played_at").desc())
    ordered.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').options(**TIMES).csv(path)


def write_plays(rows: DataFrame, path: str) -> None:
    """Plays partitioned by month, so that a period's filter prunes files."""
    rows.withColumn("play_month", F.date_format("played_at", "yyyy-MM")).repartition("play_month", F.pmod(F.xxhash64("user_id"), F.lit(16))).write.mode("overwrite").partitionBy("play_month").parquet(path)
