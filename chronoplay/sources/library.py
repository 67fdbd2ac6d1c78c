"""A play library: the canonical frames, and how the driver's tables map to them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = datetime(2024, 1, 31)
STAR_AS_OF = datetime(2001, 8, 2)
#: Rows that a task gets of frames as long as the plays or credits.
TASK_ROWS = 1 << 19


@dataclass(frozen=True)
class Library:
    """Frames: plays (user_id, played_at, track_id, and more), tracks, albums, artists, track_artists, playlists, playlist_tracks, merge_rules."""

    plays: DataFrame
    tracks: DataFrame
    albums: DataFrame
    artists: DataFrame
    track_artists: DataFrame
    playlists: DataFrame
    playlist_tracks: DataFrame
    merge_rules: DataFrame
    as_of: datetime
    #: The table that plays or credits come from, whose rows say how many there are about.
    sized: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.plays.sparkSession

    @cached_property
    def tasks(self) -> int:
        """Tasks over which long frames are dealt; without a table to count, the session's number."""
        if self.sized is None:
            return int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return tasks_for(self.spark, self.sized.count())

    def dealt(self, rows: DataFrame, *keys: str, times: int = 1) -> DataFrame:
        """``rows`` by ``keys`` over a number of tasks that follows the tables, ``times`` as many where they fan out.

        Else partitions are joined up to a number of bytes as compressed for the
        shuffle, and a task sorts or counts many times that.
        """
        return rows.repartition(self.tasks * times, *keys)

    @cached_property
    def primary_artists(self) -> DataFrame:
        """(track_id, artist_id) of first position; the smallest artist if several."""
        return self.track_artists.filter("position = 0").groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))

    def but(self, **frames: DataFrame) -> Library:
        return replace(self, **frames)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks of at most ``TASK_ROWS`` rows, but one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, supplier, item = (_read(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    tasks = tasks_for(spark, item.count())
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    tracks = part.select(
        F.col("p_partkey").alias("track_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 17 != 0, F.col("p_brand")).alias("album_id"),
        ((F.col("p_partkey") % 240 + 60) * 1000).cast("long").alias("duration_ms"), F.col("p_size").alias("popularity"),
    )
    places = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    artists = places.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), F.array("n_name", "r_name").alias("genres")
    )
    by_track, by_playlist = item.repartition(tasks, "l_partkey"), item.repartition(tasks, "l_suppkey")
    pairs = by_track.select(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("artist_id")).distinct()
    position = (F.expr("row_number() over (partition by track_id order by artist_id)") - 1).alias("position")
    spt = by_playlist.select(F.col("l_suppkey").alias("playlist_id"), F.col("l_partkey").alias("track_id")).distinct()
    return {
        "tracks": tracks,
        "albums": part.select(F.col("p_brand").alias("album_id")).distinct().withColumn("name", F.col("album_id")),
        "artists": artists,
        "track_artists": pairs.select("track_id", "artist_id", position).filter("position < 3"),
        "playlists": places.select(F.col("s_suppkey").alias("playlist_id"), F.col("n_regionkey").cast("long").alias("user_id"), F.col("s_name").alias("name")),
        "playlist_tracks": spt.select("playlist_id", "track_id", F.expr("row_number() over (partition by playlist_id order by track_id) - 1").alias("position")),
        "merge_rules": spark.createDataFrame(
            [(0, "Brand#24", "Brand#1"), (1, "Brand#24", "Brand#1"), (1, "Brand#25", "Brand#1"), (2, "Brand#25", "Brand#2")],
            "user_id long, source_id string, target_id string",
        ),
    }


def events_library(spark: SparkSession, sf_dir: str) -> Library:
    """Plays from ``events``: hours, unique times, a month."""
    plays = _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("play_id"), "user_id", F.col("ts").alias("played_at"),
        F.get_json_object("props", "$.k").cast("long").alias("track_id"), F.col("event_type").alias("context_type"),
    )
    return Library(plays, **_dimensions(spark, sf_dir), as_of=EVENTS_AS_OF, sized=_read(spark, sf_dir, "lineitem"))


def star_library(spark: SparkSession, sf_dir: str) -> Library:
    """Plays from ``lineitem``: six years of weeks, five users, whole days."""
    item, orders, customer, nation = (_read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    tasks = tasks_for(spark, item.count())
    # users are found for orders, before these meet several times as many items; no join takes either by bytes
    timed = (
        orders.repartition(tasks, "o_custkey").join(customer.repartition(tasks, "c_custkey"), orders["o_custkey"] == customer["c_custkey"])
        .join(nation, customer["c_nationkey"] == nation["n_nationkey"])
        .select("o_orderkey", F.col("n_regionkey").cast("long").alias("user_id"), F.col("o_orderdate").alias("played_at"))
    )
    plays = (
        item.repartition(tasks, "l_orderkey").join(timed.repartition(tasks, "o_orderkey"), item["l_orderkey"] == timed["o_orderkey"])
        .select("user_id", "played_at", F.col("l_partkey").alias("track_id"))
    )
    return Library(plays, **_dimensions(spark, sf_dir), as_of=STAR_AS_OF, sized=item)
