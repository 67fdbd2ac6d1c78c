"""Play histories: pages, recent plays, deletion, export rows, details of tracks and albums."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.library import Library
from .facts import in_window

PAGE_CAP, DELETE_CAP = 100, 5000


def recent_plays(lib: Library, per: str = "track", limit: int = 10) -> DataFrame:
    """The last plays of every entity of every user, newest first."""
    rows = lib.plays
    if per == "artist":
        rows = rows.join(lib.track_artists.select("track_id", "artist_id"), "track_id")
    elif per == "album":
        rows = rows.join(lib.tracks.select("track_id", "album_id"), "track_id")
    w = Window.partitionBy("user_id", f"{per}_id").orderBy(F.col("played_at").desc(), F.col("play_id"))
    return rows.withColumn("n", F.row_number().over(w).cast("long")).filter(F.col("n") <= limit).select("user_id", F.col(f"{per}_id").alias("entity_id"), "n", "play_id", "track_id", "played_at")


def history_filter(lib: Library, user_id: int, day: date | None = None, album: str | None = None, track: int | None = None, artist: int | None = None) -> DataFrame:
    """A user's plays, by day, album (as stored), track or artist. Dimensions are joined only for what asks for them."""
    rows = lib.plays.filter(F.col("user_id") == user_id)
    if day is not None:
        start = datetime(day.year, day.month, day.day)
        rows = in_window(rows, start, start + timedelta(days=1), half_open=True)
    if track is not None:
        rows = rows.filter(F.col("track_id") == track)
    if album is not None:
        rows = rows.join(lib.tracks.filter(F.col("album_id") == album), "track_id", "left_semi")
    if artist is not None:
        rows = rows.join(lib.track_artists.filter(F.col("artist_id") == artist), "track_id", "left_semi")
    return rows


def history_page(rows: DataFrame, page: int = 1, size: int = 50, after: tuple[datetime, int] | None = None) -> DataFrame:
    """A page of plays, newest first, with ``has_more``: whether any come after it.

    ``after`` is the (played_at, play_id) that the last page ended with. It
    pages without an offset, at the same cost for any page, and between plays of
    one instant too.
    """
    size, order = min(size, PAGE_CAP), [F.col("played_at").desc(), F.col("play_id")]
    if after is None:
        found = rows.orderBy(*order).offset((page - 1) * size)
    else:
        at = F.lit(after[0]).cast("timestamp_ntz")
        later = (F.col("played_at") < at) | ((F.col("played_at") == at) & (F.col("play_id") > after[1]))
        found = rows.filter((F.col("played_at") <= at) & later).orderBy(*order)
    one_more = found.limit(size + 1)  # so few rows that numbering them is one task's work
    numbered = one_more.withColumns({"_n": F.row_number().over(Window.orderBy(*order)), "_all": F.count("*").over(Window.partitionBy(F.lit(0)))})
    return numbered.filter(F.col("_n") <= size).withColumn("has_more", F.col("_all") > size).drop("_n", "_all")


def history_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def delete_plays(lib: Library, user_id: int, play_ids: list[int]) -> DataFrame:
    """The plays that stay when a user deletes some of their own; at most 5000 ids at once."""
    if not 0 < len(play_ids) <= DELETE_CAP:
        raise ValueError(f"1 to {DELETE_CAP} ids, not {len(play_ids)}")
    gone = lib.spark.createDataFrame([(user_id, i) for i in play_ids], "user_id long, play_id long")
    return lib.plays.join(F.broadcast(gone), ["user_id", "play_id"], "left_anti")


def track_artist_names(lib: Library) -> DataFrame:
    """(track_id, artist_names): names in order of credit, comma-joined."""
    named = lib.track_artists.join(lib.artists.select("artist_id", F.col("name").alias("_name")), "artist_id")
    listed = named.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("position", "_name"))).alias("_l"))
    return listed.select("track_id", F.array_join(F.transform("_l", lambda x: x["_name"]), ", ").alias("artist_names"))


def export_rows(lib: Library) -> DataFrame:
    """One row a play, with the names of its track, album and artists."""
    tracks = lib.tracks.select("track_id", F.col("name").alias("track_name"), "album_id", "duration_ms")
    albums = lib.albums.select("album_id", F.col("name").alias("album_name"))
    rows = lib.plays.join(tracks, "track_id").join(albums, "album_id", "left").join(track_artist_names(lib), "track_id", "left")
    return rows.select("user_id", "played_at", "track_id", "track_name", "artist_names", "album_name", "duration_ms")


def enrich_tracks(lib: Library) -> DataFrame:
    """Tracks with their album and an ordered array of artists."""
    credits = lib.track_artists.join(lib.artists.select("artist_id", F.col("name").alias("artist_name")), "artist_id")
    listed = credits.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("position", "artist_id", "artist_name"))).alias("artists"))
    albums = lib.albums.select("album_id", F.col("name").alias("album_name"))
    return lib.tracks.join(albums, "album_id", "left").join(listed, "track_id", "left")


def ordered_track_artists(lib: Library) -> DataFrame:
    return lib.track_artists.join(lib.artists.select("artist_id", "name"), "artist_id").select("track_id", "position", "artist_id", "name")


def track_album_breakdown(lib: Library) -> DataFrame:
    """Plays of each track under its album."""
    counts = lib.plays.groupBy("user_id", "track_id").agg(F.count("*").alias("play_count"))
    rows = counts.join(lib.tracks.select("track_id", "album_id", "duration_ms"), "track_id").join(lib.albums.select("album_id", F.col("name").alias("album_name")), "album_id")
    return rows.select("user_id", "track_id", "album_id", "album_name", "play_count", (F.col("play_count") * F.col("duration_ms")).alias("total_ms"))


def album_ids(lib: Library) -> DataFrame:
    """(user_id, album_id, member_id): a target with itself and the albums that the user merged into it."""
    users = lib.merge_rules.select("user_id", F.col("target_id").alias("album_id")).distinct()
    own = users.withColumn("member_id", F.col("album_id"))
    return own.unionByName(lib.merge_rules.select("user_id", F.col("target_id").alias("album_id"), F.col("source_id").alias("member_id")).distinct())


def album_artists(lib: Library) -> DataFrame:
    """Each album's artists: those stored with it, else those that lead half of its tracks or more."""
    per_album = lib.tracks.filter("album_id is not null").groupBy("album_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("_least"))
    led = lib.track_artists.filter("position = 0").join(lib.tracks.select("track_id", "album_id"), "track_id")
    led = led.groupBy("album_id", "artist_id").agg(F.count_distinct("track_id").alias("track_count"))
    guess = led.join(per_album, "album_id").filter("track_count >= _least").select("album_id", "artist_id", "track_count")
    if "artist_ids" in lib.albums.columns:
        stored = lib.albums.filter(F.size("artist_ids") > 0).select("album_id", F.explode("artist_ids").alias("artist_id"), F.lit(None).cast("long").alias("track_count"))
        guess = stored.unionByName(guess.join(stored, "album_id", "left_anti"))
    return guess.join(lib.artists.select("artist_id", "name"), "artist_id").select("album_id", "artist_id", "name", "track_count")


def album_tracks(lib: Library, user_id: int) -> DataFrame:
    """All tracks of all albums with a user's plays, zero for those not played."""
    counts = lib.plays.filter(F.col("user_id") == user_id).groupBy("track_id").agg(F.count("*").alias("_n"))
    rows = lib.tracks.filter("album_id is not null").join(counts, "track_id", "left").withColumn("play_count", F.coalesce("_n", F.lit(0)))
    return rows.select("album_id", "track_id", "name", "duration_ms", "play_count", (F.col("play_count") * F.col("duration_ms")).alias("total_ms"))


def lookup(frame: DataFrame, key: str, ids: list | DataFrame) -> DataFrame:
    """Rows by key: a filter for a few keys, a semi-join for a frame of them."""
    return frame.join(ids, key, "left_semi") if isinstance(ids, DataFrame) else frame.filter(F.col(key).isin(ids))


def total_plays(lib: Library) -> DataFrame:
    return lib.plays.groupBy("user_id").agg(F.count("*").alias("total"))


def set_cover(albums: DataFrame, album_id: str, image_url: Column | str) -> DataFrame:
    """Albums with one cover set."""
    url = F.lit(image_url) if isinstance(image_url, str) else image_url
    return albums.withColumn("image_url", F.when(F.col("album_id") == album_id, url).otherwise(F.col("image_url")))
