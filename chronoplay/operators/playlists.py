"""Playlist analytics, presence, and the rules that generate playlists."""

from __future__ import annotations

import math
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_label, window_of
from ..functions.text import is_real
from ..sources.library import Library
from .facts import in_window, metric

#: Candidates for each track asked for.
OVERSAMPLE = 2.5


def library_playlists(lib: Library, user_id: int | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """Playlists that have tracks; a page of a user's, or all of everyone's."""
    rows = lib.playlists.join(lib.playlist_tracks, "playlist_id", "left_semi")
    if user_id is None:
        return rows
    return rows.filter(F.col("user_id") == user_id).orderBy("playlist_id").offset((page - 1) * size).limit(size)


def track_stats(lib: Library) -> DataFrame:
    """Each playlist track with its owner's plays: zeros and a null time if unplayed."""
    counts = lib.plays.groupBy("user_id", "track_id").agg(F.count("*").alias("_n"), F.max("played_at").alias("_last"))
    counts = counts.join(lib.tracks.select("track_id", "duration_ms"), "track_id")
    rows = lib.playlist_tracks.join(lib.playlists.select("playlist_id", "user_id"), "playlist_id").join(counts, ["user_id", "track_id"], "left")
    n = F.coalesce("_n", F.lit(0))
    return rows.select("playlist_id", "user_id", "position", "track_id", n.alias("play_count"), (n * F.coalesce("duration_ms", F.lit(0))).alias("total_ms"), F.col("_last").alias("last_played"))


def coverage(stats: DataFrame) -> DataFrame:
    """(playlist_id, tracks_played, total_tracks, percent, total_plays, total_ms); half a percent rounds up."""
    out = stats.groupBy("playlist_id").agg(
        F.count_if(F.col("play_count") > 0).alias("tracks_played"), F.count("*").alias("total_tracks"),
        F.sum("play_count").alias("total_plays"), F.sum("total_ms").alias("total_ms"),
    )
    return out.withColumn("percent", F.floor((200 * F.col("tracks_played") + F.col("total_tracks")) / (2 * F.col("total_tracks"))).cast("long"))


def playlist_genres(lib: Library, limit: int = 20) -> DataFrame:
    """Genres of each playlist by its tracks' credits, not by plays."""
    rows = lib.dealt(lib.playlist_tracks.select("playlist_id", "track_id"), "track_id").join(lib.track_artists.select("track_id", "artist_id"), "track_id")
    rows = lib.dealt(rows, "playlist_id", times=2).groupBy("playlist_id", "artist_id").agg(F.count("*").alias("_n"))
    each = rows.join(lib.artists.select("artist_id", F.explode("genres").alias("genre")), "artist_id")
    counts = each.groupBy("playlist_id", "genre").agg(F.sum("_n").alias("track_count"))
    w = Window.partitionBy("playlist_id").orderBy(F.col("track_count").desc(), "genre")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def playlist_series(lib: Library, granularity: str = "month") -> DataFrame:
    """The owner's plays of each playlist's tracks by period."""
    counts = lib.plays.groupBy("user_id", "track_id", period_label(F.col("played_at"), granularity).alias("period")).agg(F.count("*").alias("_n"))
    counts = counts.join(lib.tracks.select("track_id", "duration_ms"), "track_id")
    members = lib.playlist_tracks.select("playlist_id", "track_id").distinct().join(lib.playlists.select("playlist_id", "user_id"), "playlist_id")
    return members.join(counts, ["user_id", "track_id"]).groupBy("playlist_id", "period").agg(F.sum("_n").alias("play_count"), F.sum(F.col("_n") * F.col("duration_ms")).alias("total_ms"))


def presence(lib: Library, entity: str) -> DataFrame:
    """(user_id, entity_id, playlist_id, name): the playlists that hold an entity; artists by any credit."""
    rows = lib.playlist_tracks.select("playlist_id", "track_id")
    if entity == "artist":
        rows = lib.dealt(lib.dealt(rows, "track_id").join(lib.track_artists.select("track_id", "artist_id"), "track_id"), "playlist_id", times=2)
    elif entity == "album":
        rows = rows.join(lib.tracks.filter("album_id is not null"), "track_id")
    rows = rows.select("playlist_id", F.col(f"{entity}_id").alias("entity_id")).distinct()
    return rows.join(lib.dealt(lib.playlists, "playlist_id", times=2 if entity == "artist" else 1), "playlist_id").select("user_id", "entity_id", "playlist_id", "name")


def _candidates(counts: DataFrame, order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*order, F.col("track_id"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= math.ceil(limit * OVERSAMPLE))


def _counted(lib: Library, preset: str, plays: DataFrame | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    plays = in_window(lib.plays if plays is None else plays, *window_of(preset, lib.as_of, start, end))
    return plays.filter(is_real(F.col("track_id")) | F.lower(F.col("track_id").cast("string")).startswith("import:")).groupBy("user_id", "track_id").agg(F.count("*").alias("play_count"))


def _with_time(lib: Library, counts: DataFrame) -> DataFrame:
    return counts.join(lib.tracks.select("track_id", "duration_ms"), "track_id").withColumn("total_ms", F.col("play_count") * F.col("duration_ms")).drop("duration_ms")


def top_range(lib: Library, preset: str = "month", limit: int = 20, sort: str = "time", start: date | None = None, end: date | None = None) -> DataFrame:
    """Candidates: a range's top tracks. Local files are never candidates."""
    return _candidates(_with_time(lib, _counted(lib, preset, start=start, end=end)), [F.col(metric(sort)).desc()], limit)


def top_artist(lib: Library, artist_id, preset: str = "all", limit: int = 20, sort: str = "time", start: date | None = None, end: date | None = None) -> DataFrame:
    """Candidates: top tracks that credit an artist."""
    counts = _with_time(lib, _counted(lib, preset, start=start, end=end)).join(lib.track_artists.filter(F.col("artist_id") == artist_id), "track_id", "left_semi")
    return _candidates(counts, [F.col(metric(sort)).desc()], limit)


def top_genre(lib: Library, genre: str, preset: str = "all", limit: int = 20, sort: str = "time", start: date | None = None, end: date | None = None) -> DataFrame:
    """Candidates: top tracks of a genre; a play counts for each credited artist of that genre."""
    times = lib.artists.select("artist_id", F.explode("genres").alias("_g")).filter(F.col("_g") == genre)
    times = lib.track_artists.join(times, "artist_id").groupBy("track_id").agg(F.count("*").alias("_times"))
    counts = _with_time(lib, _counted(lib, preset, start=start, end=end)).join(times, "track_id")
    counts = counts.select("user_id", "track_id", *((F.col(c) * F.col("_times")).alias(c) for c in ("play_count", "total_ms")))
    return _candidates(counts, [F.col(metric(sort)).desc()], limit)


def deep_cuts(lib: Library, preset: str = "all", limit: int = 20, max_popularity: int = 15, min_plays: int = 2, start: date | None = None, end: date | None = None) -> DataFrame:
    """Candidates: little known tracks that are played, least known first."""
    known = lib.tracks.filter(F.col("popularity").isNotNull() & (F.col("popularity") <= max_popularity)).select("track_id", "popularity")
    counts = _counted(lib, preset, start=start, end=end).filter(F.col("play_count") >= min_plays).join(known, "track_id")
    return _candidates(counts, [F.col("popularity"), F.col("play_count").desc()], limit)


def time_vibes(lib: Library, days: list[int], hours: list[int], preset: str = "all", limit: int = 20, start: date | None = None, end: date | None = None) -> DataFrame:
    """Candidates: tracks played on those days of the week (0: Sunday) at those hours."""
    plays = lib.plays.filter((F.dayofweek("played_at") - 1).isin(days) & F.hour("played_at").isin(hours))
    return _candidates(_counted(lib, preset, plays, start, end), [F.col("play_count").desc()], limit)


def rediscovery(lib: Library, limit: int = 20, min_plays: int = 5, recency_days: int = 60) -> DataFrame:
    """Candidates: tracks with many plays, but none lately."""
    counts = lib.plays.filter(~F.lower(F.col("track_id").cast("string")).startswith("local:")).groupBy("user_id", "track_id").agg(F.count("*").alias("play_count"), F.max("played_at").alias("last_played"))
    cutoff = F.lit(lib.as_of - timedelta(days=recency_days)).cast("timestamp_ntz")
    return _candidates(counts.filter((F.col("play_count") >= min_plays) & (F.col("last_played") < cutoff)), [F.col("play_count").desc()], limit)


STRATEGIES = {"top_range": top_range, "top_artist": top_artist, "top_genre": top_genre, "deep_cuts": deep_cuts, "time_vibes": time_vibes, "rediscovery": rediscovery}


def generate(lib: Library, strategy: str, limit: int = 20, seed: int = 17, **params) -> DataFrame:
    """(user_id, position, track_id): a playlist from a strategy's candidates, in an order that the seed decides."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    found = STRATEGIES[strategy](lib, limit=limit, **params)
    w = Window.partitionBy("user_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "user_id", "track_id")), "track_id")
    return found.select("user_id", "track_id", (F.row_number().over(w) - 1).cast("long").alias("position")).filter(F.col("position") < limit)


def auto_name(strategy: str, **params) -> str:
    """Name of a generated playlist: the strategy's, and what it was asked for."""
    asked = params.get("genre") or params.get("artist_id") or params.get("preset")
    return strategy.replace("_", " ").capitalize() + (f": {asked}" if asked is not None else "")


def save_generated(playlists: DataFrame, tracks: DataFrame, playlist_id: int, user_id: int, strategy: str, members: DataFrame, **params) -> tuple[DataFrame, DataFrame]:
    """Both tables with a generated playlist in them; one of that id is replaced, which is how it is run again."""
    spark = playlists.sparkSession
    row = spark.createDataFrame([(playlist_id, user_id, auto_name(strategy, **params), strategy, {k: str(v) for k, v in params.items()})], "playlist_id long, user_id long, name string, strategy string, params map<string,string>")
    kept = delete_generated(playlists, tracks, playlist_id)
    own = members.filter(F.col("user_id") == user_id).select(F.lit(playlist_id).cast("long").alias("playlist_id"), "position", "track_id")
    return kept[0].unionByName(row), kept[1].unionByName(own)


def delete_generated(playlists: DataFrame, tracks: DataFrame, playlist_id: int) -> tuple[DataFrame, DataFrame]:
    return playlists.filter(F.col("playlist_id") != playlist_id), tracks.filter(F.col("playlist_id") != playlist_id)


def sync_playlists(stored: DataFrame, stored_tracks: DataFrame, feed: DataFrame, feed_tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a sync with a user's whole feed.

    Tracks of a playlist are replaced if its snapshot_id differs, else kept;
    playlists that are gone, or empty, go. Feeds may list several users.
    """
    keys = ["user_id", "playlist_id"]
    users = feed.select("user_id").distinct()
    same = stored.select(*keys, "snapshot_id").join(feed.select(*keys, "snapshot_id"), [*keys, "snapshot_id"]).select(keys)
    kept = stored_tracks.join(same, keys, "left_semi").unionByName(stored_tracks.join(users, "user_id", "left_anti"))
    fresh = feed_tracks.filter("track_id is not null").dropDuplicates([*keys, "track_id"]).join(feed.select(keys), keys, "left_semi").join(same, keys, "left_anti")
    tracks = kept.unionByName(fresh.select(kept.columns))
    others = stored.join(users, "user_id", "left_anti")
    return others.unionByName(feed.select(others.columns).join(tracks.select(keys).distinct(), keys, "left_semi")), tracks


def is_algorithmic(owner: Column, service: str) -> Column:
    """Whether the service itself owns a playlist."""
    return owner == service
