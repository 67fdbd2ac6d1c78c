"""Top lists with rank changes, statistics, series, rankings over ranges and months."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_label, range_start, series_bucket, window_before, window_days, window_of
from ..session import materialised
from ..sources.library import Library
from .charts import since
from .facts import in_window, metric, period_plays, play_counts, ranked, resolved_albums, tally

PREVIOUS_LIMIT = 200


def _inside(at: Column, start: datetime | None, end: datetime | None, half_open: bool = False) -> Column:
    bounds = [at >= F.lit(start).cast("timestamp_ntz")] if start is not None else []
    if end is not None:
        bound = F.lit(end).cast("timestamp_ntz")
        bounds.append(at < bound if half_open else at <= bound)
    return reduce(and_, bounds, F.lit(True))


def top_entities(lib: Library, entity: str, preset: str = "month", sort: str = "time", limit: int = 50, start: date | None = None, end: date | None = None) -> DataFrame:
    """Each user's top list, of a preset or of the days from ``start`` to ``end``, with its change against the window before.

    Only the first 200 of the window before count as known there. Without such
    a window, previous_rank and rank_change are null and is_new is false. Both
    windows are counted in one pass over the plays.
    """
    window, before = window_of(preset, lib.as_of, start, end), window_before(preset, lib.as_of, start, end)
    if before is None:
        now = ranked(play_counts(lib, entity, plays=in_window(lib.plays, *window)), ["user_id"], sort, limit)
        return now.select("user_id", "rank", "entity_id", "play_count", "total_ms", F.lit(None).cast("long").alias("previous_rank"), F.lit(None).cast("long").alias("rank_change"), F.lit(False).alias("is_new"))
    at = F.col("played_at")
    in_window(lib.plays, *before, half_open=True)  # refuses bounds that partials by day don't have
    plays = in_window(lib.plays, before[0], window[1]).filter(_inside(at, *window) | _inside(at, *before, half_open=True))
    counts = play_counts(lib, entity, {"_now": _inside(at, *window)}, plays)
    both = counts.groupBy("user_id", "entity_id").agg(*(F.sum(F.when(flag, F.col(c))).alias(name) for flag, names in ((F.col("_now"), ("play_count", "total_ms")), (~F.col("_now"), ("_plays", "_ms"))) for c, name in zip(("play_count", "total_ms"), names, strict=True)))
    place = lambda value: F.row_number().over(Window.partitionBy("user_id").orderBy(F.col(value).desc_nulls_last(), "entity_id")).cast("long")
    known = F.when(F.col("_plays").isNotNull() & (F.col("_place") <= PREVIOUS_LIMIT), F.col("_place"))
    rows = both.withColumn("_place", place("_plays" if metric(sort) == "play_count" else "_ms")).withColumn("rank", place(metric(sort))).filter(F.col("play_count").isNotNull() & (F.col("rank") <= limit))
    rows = rows.select("user_id", "rank", "entity_id", "play_count", "total_ms", known.alias("previous_rank"))
    return rows.withColumns({"rank_change": F.col("previous_rank") - F.col("rank"), "is_new": F.col("previous_rank").isNull()})


def entity_stats(lib: Library, entity: str) -> DataFrame:
    """Plays, time, first and last play of every entity of every user."""
    return play_counts(lib, entity)


def total_stats(lib: Library, plays: DataFrame | None = None) -> DataFrame:
    """One row over all plays, also when there are none: zeros, and null times."""
    rows = (lib.plays if plays is None else plays).join(lib.tracks.select("track_id", "duration_ms"), "track_id")
    return rows.agg(F.count("*").alias("play_count"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("total_ms"), F.min("played_at").alias("first_played"), F.max("played_at").alias("last_played"))


def series(lib: Library, granularity: str, plays: DataFrame | None = None) -> DataFrame:
    """Plays and time of each user by period."""
    plays = lib.plays if plays is None else plays
    rows = plays.groupBy("user_id", "track_id", period_label(F.col("played_at"), granularity).alias("period")).agg(tally(plays)[0].alias("_n"))
    rows = rows.join(lib.tracks.select("track_id", "duration_ms"), "track_id")
    return rows.groupBy("user_id", "period").agg(F.sum("_n").alias("play_count"), F.sum(F.col("_n") * F.col("duration_ms")).alias("total_ms"))


def entity_series(lib: Library, entity: str, preset: str = "all", start: date | None = None, end: date | None = None) -> DataFrame:
    """Plays and time of each entity by period, over a preset or from ``start`` to ``end``; the window's length picks the granularity."""
    bucket = series_bucket(window_days(preset, start, end))
    plays = in_window(lib.plays, *window_of(preset, lib.as_of, start, end))
    return play_counts(lib, entity, {"period": period_label(F.col("played_at"), bucket)}, plays).drop("first_played", "last_played")


def rankings(lib: Library, entity: str, sort: str = "time") -> DataFrame:
    """Each entity's rank over a week, a month, this year and all time, in one scan.

    Rank is one more than the number of better values; null without plays in
    the range. Null albums have no rank.
    """
    names = ("week", "month", "thisYear")
    flags = {f"in_{n}": F.col("played_at") >= F.lit(range_start(n, lib.as_of)).cast("timestamp_ntz") for n in names}
    # plays fall into few combinations of the flags, so this is one aggregation by track
    counts = play_counts(lib, entity, flags)
    value = F.col(metric(sort))
    values = counts.groupBy("user_id", "entity_id").agg(
        *(F.sum(F.when(F.col(f"in_{n}"), value).otherwise(0)).alias(f"val_{n}") for n in names), F.sum(value).alias("val_all")
    )

    def rank(n: str):
        r = F.rank().over(Window.partitionBy("user_id").orderBy(F.col(f"val_{n}").desc())).cast("long")
        return r if n == "all" else F.when(F.col(f"val_{n}") > 0, r)

    return values.select("user_id", "entity_id", *(rank(n).alias(f"rank_{a}") for n, a in (("week", "week"), ("month", "month"), ("thisYear", "this_year"), ("all", "all"))))


def ranking_history(lib: Library, entity: str, sort: str = "time", facts: DataFrame | None = None) -> DataFrame:
    """(user_id, period, entity_id, total, rank): each month's rank by the total until then.

    An entity has a row in every month with plays of its user, from its first
    month on; the rank is among all entities seen until then. ``facts`` are
    stored ``period_plays`` by month, else one pass over the plays gives counts
    and months.
    """
    facts = materialised(period_plays(lib, "month")) if facts is None else facts
    monthly = play_counts(lib, entity, {"period": F.col("period")}, facts)
    monthly = materialised(monthly.select("user_id", "period", "entity_id", F.col(metric(sort)).alias("_v")))
    months = facts.select("user_id", "period").distinct()
    spine = since(monthly.groupBy("user_id", "entity_id").agg(F.min("period").alias("_since")), months, "_since")
    running = Window.partitionBy("user_id", "entity_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    totals = spine.join(monthly, ["user_id", "period", "entity_id"], "left").withColumn("total", F.sum(F.coalesce("_v", F.lit(0))).over(running))
    rank = F.rank().over(Window.partitionBy("user_id", "period").orderBy(F.col("total").desc())).cast("long")
    return totals.select("user_id", "period", "entity_id", "total", rank.alias("rank"))


def genres(lib: Library, preset: str = "all", limit: int = 50, start: date | None = None, end: date | None = None) -> DataFrame:
    """Each user's genres by plays, over a preset or from ``start`` to ``end``; a play counts for each genre of each credited artist."""
    counts = play_counts(lib, "artist", plays=in_window(lib.plays, *window_of(preset, lib.as_of, start, end)))
    each = counts.join(lib.artists.select(F.col("artist_id").alias("entity_id"), F.explode("genres").alias("genre")), "entity_id")
    totals = each.groupBy("user_id", "genre").agg(F.sum("play_count").alias("play_count"), F.sum("total_ms").alias("total_ms"))
    return ranked(totals, ["user_id"], "plays", limit, tie="genre")


def heatmap(lib: Library) -> DataFrame:
    """Plays by day of the week (0: Sunday) and hour."""
    return lib.plays.groupBy("user_id", (F.dayofweek("played_at") - 1).alias("dow"), F.hour("played_at").alias("hour")).agg(F.count("*").alias("play_count"))


def artist_top_tracks(lib: Library, sort: str = "time", limit: int = 10) -> DataFrame:
    """Each artist's most played tracks, by user; credits of any position."""
    counts = play_counts(lib, "track").withColumnRenamed("entity_id", "track_id").join(lib.track_artists.select("track_id", "artist_id"), "track_id")
    return ranked(counts, ["user_id", "artist_id"], sort, limit, tie="track_id").select("user_id", "artist_id", "rank", "track_id", "play_count", "total_ms")


def artist_top_albums(lib: Library, sort: str = "time", limit: int = 10) -> DataFrame:
    """Each artist's albums by user: those with a track that the artist leads, merge rules applied.

    Plays are of the album's tracks that credit the artist.
    """
    counts = play_counts(lib, "track").select("user_id", F.col("entity_id").alias("track_id"), "play_count", "total_ms")
    credited = counts.join(lib.track_artists.select("track_id", "artist_id"), "track_id").join(lib.tracks.select("track_id", "album_id"), "track_id")
    led = lib.track_artists.filter("position = 0").join(lib.tracks.select("track_id", "album_id"), "track_id").select("artist_id", "album_id").distinct()
    albums = resolved_albums(lib, credited.join(led, ["artist_id", "album_id"], "left_semi"))
    albums = albums.groupBy("user_id", "artist_id", "album_id").agg(F.sum("play_count").alias("play_count"), F.sum("total_ms").alias("total_ms"))
    return ranked(albums, ["user_id", "artist_id"], sort, limit, tie="album_id").select("user_id", "artist_id", "rank", "album_id", "play_count", "total_ms")

