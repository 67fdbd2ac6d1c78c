"""Batch ingestion: imports, upserts, resolution of aliases, deduplication.

Tables are values here: every function returns the frames as they are
afterwards, and the caller writes them to a new path and swaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_real, synthetic_id
from ..session import materialised
from ..sources.buckets import bucket_of, merge_buckets, read_buckets

LEAST_PLAYED_MS = 30_000


@dataclass(frozen=True)
class Imported:
    """New rows for each table, and counters (user_id, total, imported, duplicates, skipped)."""

    plays: DataFrame
    tracks: DataFrame
    albums: DataFrame
    artists: DataFrame
    track_artists: DataFrame
    counters: DataFrame


def _first_per(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_ids(entries: DataFrame, artists: DataFrame | None = None, albums: DataFrame | None = None, tracks: DataFrame | None = None, prefix: str = "import:") -> DataFrame:
    """Normalised entries with track, artist and album ids: the given id, a known name's, else a hash.

    Artists are known by name, albums by name alone, tracks by name and artist;
    case never matters. The smallest id wins where several share a name.
    """
    rows = entries
    for frame, key, name in ((artists, "artist_id", "artist_name"), (albums, "album_id", "album_name")):
        if frame is None:
            rows = rows.withColumn(f"_{key}", F.lit(None).cast("string"))
        else:
            known = frame.groupBy(F.lower("name").alias("_k")).agg(F.min(key).alias(f"_{key}"))
            rows = rows.join(known, F.lower(name) == F.col("_k"), "left").drop("_k")
    rows = rows.withColumn("artist_id", F.coalesce("_artist_id", synthetic_id(prefix, F.col("artist_name"))))
    rows = rows.withColumn("album_id", F.when(F.coalesce("album_name", F.lit("")) != "", F.coalesce("_album_id", synthetic_id(prefix, F.col("artist_name"), F.col("album_name")))))
    if tracks is None:
        rows = rows.withColumn("_track_id", F.lit(None).cast("string"))
    else:
        known = tracks.groupBy(F.lower("name").alias("_k"), F.col("artist_id").alias("_a")).agg(F.min("track_id").alias("_track_id"))
        rows = rows.join(known, (F.lower("track_name") == F.col("_k")) & (F.col("artist_id") == F.col("_a")), "left").drop("_k", "_a")
    given = F.col("given_track_id") if "given_track_id" in entries.columns else F.lit(None).cast("string")
    rows = rows.withColumn("track_id", F.coalesce(given, "_track_id", synthetic_id(prefix, F.col("artist_name"), F.col("track_name"))))
    return rows.drop("_artist_id", "_album_id", "_track_id", "given_track_id")


def import_history(raw: DataFrame, plays: DataFrame | None = None, artists: DataFrame | None = None, albums: DataFrame | None = None, tracks: DataFrame | None = None, track_artists: DataFrame | None = None) -> Imported:
    """New rows from normalised entries (user_id, seq, played_at, track_name, artist_name, album_name, given_track_id, ms_played).

    Entries without names, without a time or under 30 seconds are skipped. A
    user has one play an instant: the first entry by ``seq``, unless ``plays``
    has one already. A new track's length is that of its first entry.
    """
    named = (F.coalesce("track_name", F.lit("")) != "") & (F.coalesce("artist_name", F.lit("")) != "")
    valid = F.coalesce(named & (F.col("ms_played") >= LEAST_PLAYED_MS) & F.col("played_at").isNotNull(), F.lit(False))
    by_artist = None
    if tracks is not None:
        credit = track_artists.filter("position = 0").groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
        by_artist = tracks.select("track_id", "name").join(credit, "track_id")
    entries = with_ids(raw.filter(valid), artists, albums, by_artist)
    once = _first_per(entries, ["user_id", "played_at"], ["seq"])
    new = once if plays is None else once.join(plays.select("user_id", "played_at"), ["user_id", "played_at"], "left_anti")
    totals = raw.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(~valid).alias("skipped"))
    added = new.groupBy("user_id").agg(F.count("*").alias("imported"))
    counters = totals.join(added, "user_id", "left").withColumn("imported", F.coalesce("imported", F.lit(0)))
    counters = counters.select("user_id", "total", "imported", (F.col("total") - F.col("skipped") - F.col("imported")).alias("duplicates"), "skipped")

    def unknown(rows: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
        return rows if old is None else rows.join(old.select(keys), keys, "left_anti")

    def dimension(key: str, columns: list[Column], old: DataFrame | None, rows: DataFrame = entries) -> DataFrame:
        return unknown(_first_per(rows, [key], ["seq"]).select(key, *columns), old, [key])

    return Imported(
        new.select("user_id", "played_at", "track_id", "ms_played"),
        dimension("track_id", [F.col("track_name").alias("name"), "album_id", F.col("ms_played").alias("duration_ms")], tracks),
        dimension("album_id", [F.col("album_name").alias("name")], albums, entries.filter("album_id is not null")),
        dimension("artist_id", [F.col("artist_name").alias("name")], artists),
        unknown(entries.select("track_id", "artist_id").distinct().withColumn("position", F.lit(0)), track_artists, ["track_id", "artist_id"]),
        counters,
    )


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """``table`` with those rows of ``new`` whose keys it doesn't have, the first by ``order`` of equal ones."""
    once = _first_per(new, keys, order) if order else new.dropDuplicates(keys)
    return table.unionByName(once.join(table.select(keys), keys, "left_anti").select(table.columns))


def upsert(table: DataFrame, new: DataFrame, key: str, seq: str, overwrite: list[str] = (), if_given: list[str] = ()) -> DataFrame:
    """``table`` with the newest row of each key of ``new`` merged in.

    ``overwrite`` columns take the new value, ``if_given`` ones unless it is
    null, all others only for keys that are new. One shuffle by key.
    """
    last = _first_per(new, [key], [F.col(seq).desc()])
    fresh = last.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in table.columns if c != key))
    both = table.join(fresh, table[key] == F.col("_k"), "full_outer")
    old = F.col(key).isNotNull()

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_k").alias(c)
        if c in overwrite:
            value = F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
        elif c in if_given:
            value = F.coalesce(f"_{c}", c)
        else:
            value = F.when(old, F.col(c)).otherwise(F.col(f"_{c}"))
        return value.alias(c)

    return both.select(*(merged(c) for c in table.columns))


def upsert_tracks(tracks: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Name and popularity follow the source; length and album stay as first seen."""
    return upsert(tracks, new, "track_id", seq, overwrite=["name", "popularity"])


def upsert_albums(albums: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """The name follows the source, image and artists if it has them; the rest stays as first seen."""
    return upsert(albums, new, "album_id", seq, overwrite=["name"], if_given=[c for c in ("image_url", "artist_ids") if c in albums.columns])


def upsert_stored(spark: SparkSession, path: str, schema: str, key: str, new: DataFrame, seq: str = "seq", overwrite: list[str] = (), if_given: list[str] = (), buckets: int = 64) -> list[int]:
    """``upsert`` into a table in buckets of ``key`` (``sources.buckets``): only those with keys of ``new`` are read and written; which."""
    return merge_buckets(spark, path, schema, [key], new, lambda old: upsert(old, new, key, seq, overwrite, if_given), buckets)


def insert_stored(spark: SparkSession, path: str, schema: str, key: str, new: DataFrame, order: list[Column | str], buckets: int = 64) -> list[int]:
    """``insert_ignore`` into a table in buckets of ``key``, of which only those with keys that aren't there yet are written."""
    near = [r[0] for r in new.select(bucket_of([key], buckets)).distinct().collect()]  # at most ``buckets``
    unknown = materialised(new.join(read_buckets(spark, path, schema, near).select(key), key, "left_anti"))
    return merge_buckets(spark, path, schema, [key], unknown, lambda old: insert_ignore(old, unknown, [key], order), buckets)


def enrich_artists(artists: DataFrame, found: DataFrame) -> DataFrame:
    """Image, genres and popularity from a look-up, for real artists without an image."""
    columns = [c for c in ("image_url", "genres", "popularity") if c in found.columns]
    rows = artists.join(found.select("artist_id", *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit")), "artist_id", "left")
    take = F.col("_hit").isNotNull() & F.col("image_url").isNull() & is_real(F.col("artist_id"))
    return rows.select(*(F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in artists.columns))


def missing_covers(albums: DataFrame) -> DataFrame:
    """Local and imported albums that nobody has searched a cover for; the empty text means searched in vain."""
    return albums.filter(~is_real(F.col("album_id")) & F.col("image_url").isNull())


def missing_metadata(tracks: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """Counts of what lacks metadata, one row."""
    a = artists.agg(F.count("*").alias("artists"), F.count_if(F.size("genres") <= 0).alias("artists_without_genres"))
    b = albums.agg(F.count("*").alias("albums"))
    t = tracks.agg(F.count("*").alias("tracks"), F.count_if(F.col("album_id").isNull()).alias("tracks_without_album"), F.count_if(F.col("popularity").isNull()).alias("tracks_without_popularity"))
    return t.withColumn("_j", F.lit(0)).join(a.withColumn("_j", F.lit(0)), "_j").join(b.withColumn("_j", F.lit(0)), "_j").drop("_j")


def fix_links(tracks: DataFrame, source: DataFrame, albums: DataFrame | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Tracks with the album ids that a trusted source (track_id, album_id, album_name) has; with ``albums``, those too, new ones added."""
    rows = tracks.join(source.select("track_id", F.col("album_id").alias("_a")), "track_id", "left")
    rows = rows.withColumn("album_id", F.coalesce("_a", "album_id")).select(tracks.columns)
    if albums is None:
        return rows
    named = source.filter("album_id is not null").join(tracks.select("track_id"), "track_id", "left_semi").groupBy("album_id").agg(F.min("album_name").alias("name"))
    new = named.join(albums.select("album_id"), "album_id", "left_anti")
    return rows, albums.unionByName(new, allowMissingColumns=True)


def fix_credits(tracks: DataFrame, artists: DataFrame, track_artists: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, artists, track_artists) after a trusted source (track_id, artist_id, artist_name, position) was asked for real tracks.

    Imported credits of a track that it knows go, its own are added unless they
    are there, names of artists follow it. A track that it was asked for is
    marked ``verified_artists``, with credits (a null artist: none) or without.
    """
    todo = tracks.filter(is_real(F.col("track_id")) & ~F.coalesce("verified_artists", F.lit(False))).select("track_id")
    asked = source.join(todo, "track_id", "left_semi")
    given = asked.filter("artist_id is not null")
    stale = F.lower(F.col("artist_id").cast("string")).startswith("import:")
    answered = given.select("track_id").distinct().withColumn("_known", F.lit(True))
    kept = track_artists.join(answered, "track_id", "left").filter(~(stale & F.coalesce("_known", F.lit(False)))).select(track_artists.columns)
    credits = insert_ignore(kept, given.select(*track_artists.columns), ["track_id", "artist_id"], ["position"])
    names = given.groupBy("artist_id").agg(F.min("artist_name").alias("_name"))
    both = artists.join(names, "artist_id", "full_outer").withColumn("name", F.coalesce("_name", "name"))
    done = asked.select("track_id").distinct().withColumn("_done", F.lit(True))
    marked = tracks.join(done, "track_id", "left").withColumn("verified_artists", F.coalesce("_done", "verified_artists"))
    return marked.select(tracks.columns), both.select(artists.columns), credits


def local_ids(entries: DataFrame, artists: DataFrame, albums: DataFrame, tracks: DataFrame, prefix: str = "local:") -> DataFrame:
    """Local files (…, track_name, artist_name, album_name) with artist, album and track ids: known ones, else hashes.

    Artists are known by name; albums by name, tracks by name and album, both
    only among local ids; case doesn't matter, and the smallest id wins. Missing
    names count as "Unknown Artist" and "Unknown Album".
    """
    rows = entries.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(d)).otherwise(F.col(c)) for c, d in (("artist_name", "Unknown Artist"), ("album_name", "Unknown Album"))})
    is_local = lambda c: F.lower(F.col(c).cast("string")).startswith(prefix)
    known = artists.groupBy(F.lower("name").alias("_k")).agg(F.min("artist_id").alias("_artist"))
    rows = rows.join(known, F.lower("artist_name") == F.col("_k"), "left").drop("_k")
    known = albums.filter(is_local("album_id")).groupBy(F.lower("name").alias("_k")).agg(F.min("album_id").alias("_album"))
    rows = rows.join(known, F.lower("album_name") == F.col("_k"), "left").drop("_k")
    rows = rows.withColumn("artist_id", F.coalesce("_artist", synthetic_id(prefix, F.col("artist_name"), F.col("artist_name"))))
    rows = rows.withColumn("album_id", F.coalesce("_album", synthetic_id(prefix, F.col("artist_name"), F.col("album_name"))))
    known = tracks.filter(is_local("track_id")).groupBy(F.lower("name").alias("_k"), F.col("album_id").alias("_a")).agg(F.min("track_id").alias("_track"))
    rows = rows.join(known, (F.lower("track_name") == F.col("_k")) & (F.col("album_id") == F.col("_a")), "left").drop("_k", "_a")
    return rows.withColumn("track_id", F.coalesce("_track", synthetic_id(prefix, F.col("artist_name"), F.col("track_name")))).drop("_artist", "_album", "_track")


def add_covers(covers: DataFrame, new: DataFrame) -> DataFrame:
    """Covers (album_id, image_url, source, observed_at) with those that are new; of equal ones the first stays."""
    return insert_ignore(covers, new, ["album_id", "image_url"], ["observed_at"])


def album_covers(covers: DataFrame, album_id: str) -> DataFrame:
    """An album's covers, the latest first."""
    return covers.filter(F.col("album_id") == album_id).orderBy(F.col("observed_at").desc(), "image_url")


# --- canonical rows: a map (old, new) and what follows from it


def repoint(rows: DataFrame, mapping: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with ``column`` sent through ``mapping`` (old, new); with ``keys``, rows that became equal are one (smallest position)."""
    out = rows.join(mapping, rows[column] == mapping["old"], "left").withColumn(column, F.coalesce("new", column)).select(rows.columns)
    return _first_per(out, keys, [c for c in ("position",) if c in rows.columns] or keys) if keys else out


def type_score(album_type: Column) -> Column:
    return F.when(album_type == "album", 0).when(album_type.isNull(), 1).when(album_type == "compilation", 2).otherwise(3)


def _canonical(groups: DataFrame, keys: list[str], id_: str, order: list[Column]) -> DataFrame:
    """(old, new) of the members of groups that aren't their group's first."""
    best = F.first(id_).over(Window.partitionBy(*keys).orderBy(*order, F.col(id_)))
    return groups.select(F.col(id_).alias("old"), best.alias("new")).filter("old <> new")


def closed(mapping: DataFrame) -> DataFrame:
    """A map (old, new) followed to its end: no ``new`` is an ``old`` any more.

    Each round sends every ``new`` through the map, so chains shrink by half;
    rounds are materialised. Chains end as each step goes to a better member of a group.
    """
    mapping = materialised(mapping)
    while True:
        on = mapping.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        steps = materialised(mapping.join(on, mapping["new"] == on["_o"], "left").select("old", F.coalesce("_n", "new").alias("new"), F.col("_n").isNotNull().alias("_moved")))
        mapping = steps.select("old", "new")
        if steps.filter("_moved").isEmpty():
            return mapping


def duplicate_tracks(tracks: DataFrame, albums: DataFrame, track_artists: DataFrame, plays: DataFrame) -> DataFrame:
    """(old, new): real tracks of one name and first artist; an album's track stays, then the most played."""
    artist = track_artists.filter("position = 0").groupBy("track_id").agg(F.min("artist_id").alias("artist_id"))
    counts = plays.groupBy("track_id").agg(F.count("*").alias("_n"))
    kind = albums.select("album_id", F.col("album_type").alias("_t")) if "album_type" in albums.columns else albums.select("album_id", F.lit(None).cast("string").alias("_t"))
    rows = tracks.filter(is_real(F.col("track_id"))).select("track_id", F.lower("name").alias("_name"), "album_id")
    rows = rows.join(artist, "track_id").join(kind, "album_id", "left").join(counts, "track_id", "left")
    return _canonical(rows, ["_name", "artist_id"], "track_id", [type_score(F.col("_t")), F.coalesce("_n", F.lit(0)).desc()])


def _albums_by_artist(tracks: DataFrame, albums: DataFrame, track_artists: DataFrame) -> DataFrame:
    lead = track_artists.filter("position = 0").join(tracks.select("track_id", "album_id"), "track_id")
    return lead.select("album_id", "artist_id").distinct().join(albums, "album_id").withColumn("_name", F.lower("name"))


def duplicate_albums(tracks: DataFrame, albums: DataFrame, track_artists: DataFrame) -> DataFrame:
    """(old, new): real albums of one name and first artist; one with an image stays, then by type and size.

    An album in groups of several artists follows the first of them, and the
    map is followed to its end.
    """
    rows = _albums_by_artist(tracks, albums.filter(is_real(F.col("album_id"))), track_artists)
    order = []
    if "image_url" in albums.columns:
        order.append(F.when(F.coalesce("image_url", F.lit("")) != "", 0).otherwise(1))
    if "album_type" in albums.columns:
        order.append(type_score(F.col("album_type")))
    if "total_tracks" in albums.columns:
        order.append(F.coalesce("total_tracks", F.lit(0)).desc())
    return closed(_canonical(rows, ["_name", "artist_id"], "album_id", order).groupBy("old").agg(F.min("new").alias("new")))


def duplicate_local_albums(tracks: DataFrame, albums: DataFrame, track_artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((old, new) of local albums, (old, new) of the tracks that then share a name); the album with most tracks stays."""
    local = albums.filter(F.lower("album_id").startswith("local:"))
    sizes = tracks.groupBy("album_id").agg(F.count("*").alias("_n"))
    rows = _albums_by_artist(tracks, local, track_artists).join(sizes, "album_id", "left")
    album_map = closed(_canonical(rows, ["_name", "artist_id"], "album_id", [F.coalesce("_n", F.lit(0)).desc()]).groupBy("old").agg(F.min("new").alias("new")))
    touched = album_map.select(F.col("old").alias("album_id")).unionByName(album_map.select(F.col("new").alias("album_id"))).distinct()
    members = tracks.join(touched, "album_id", "left_semi").select("track_id", "album_id", F.lower("name").alias("_name"))
    own = members.withColumn("_was", F.col("album_id"))
    moved = repoint(own, album_map, "album_id")
    return album_map, _canonical(moved, ["album_id", "_name"], "track_id", [F.when(F.col("_was") == F.col("album_id"), 0).otherwise(1)])


def artist_aliases(artists: DataFrame) -> DataFrame:
    """(old, new): imported or local artists that have the name of a real one; case doesn't matter."""
    real = artists.filter(is_real(F.col("artist_id"))).groupBy(F.lower("name").alias("_n")).agg(F.min("artist_id").alias("new"))
    return artists.filter(~is_real(F.col("artist_id"))).select(F.col("artist_id").alias("old"), F.lower("name").alias("_n")).join(real, "_n").select("old", "new")


def album_aliases(albums: DataFrame) -> DataFrame:
    """(old, new) for albums, as for artists."""
    return artist_aliases(albums.withColumnRenamed("album_id", "artist_id"))


def with_found_covers(albums: DataFrame, found: DataFrame) -> DataFrame:
    """Albums after a search (album_id, image_url; null: nothing found) for those of ``missing_covers``; the empty text marks a search in vain."""
    wanted = ~is_real(F.col("album_id")) & F.col("image_url").isNull() & F.col("_hit").isNotNull()
    rows = albums.join(found.select("album_id", F.col("image_url").alias("_url"), F.lit(True).alias("_hit")), "album_id", "left")
    return rows.withColumn("image_url", F.when(wanted, F.coalesce("_url", F.lit(""))).otherwise(F.col("image_url"))).select(albums.columns)


def apply_track_map(mapping: DataFrame, tracks: DataFrame, track_artists: DataFrame, plays: DataFrame, playlist_tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All tables after tracks were merged: no play is lost, credits are united, playlists follow."""
    return (
        tracks.join(mapping, tracks["track_id"] == mapping["old"], "left_anti"),
        repoint(track_artists, mapping, "track_id", ["track_id", "artist_id"]),
        repoint(plays, mapping, "track_id"),
        repoint(playlist_tracks, mapping, "track_id", ["playlist_id", "track_id"]),
    )


def apply_album_map(mapping: DataFrame, albums: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return albums.join(mapping, albums["album_id"] == mapping["old"], "left_anti"), repoint(tracks, mapping, "album_id")


def apply_artist_map(mapping: DataFrame, artists: DataFrame, track_artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    return artists.join(mapping, artists["artist_id"] == mapping["old"], "left_anti"), repoint(track_artists, mapping, "artist_id", ["track_id", "artist_id"])


SETTINGS = ("week_start", "sort", "language")


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """Settings (user_id, key, value) with the newest by ``seq`` of each known key merged in."""
    return upsert(settings.withColumn("_id", F.struct("user_id", "key")), new.filter(F.col("key").isin(*SETTINGS)).withColumn("_id", F.struct("user_id", "key")), "_id", "seq", overwrite=["value"]).select(settings.columns)


def records_due(new: DataFrame) -> DataFrame:
    """Users whose stored records are stale after new settings: those that changed the week's start or the metric."""
    return new.filter(F.col("key").isin("week_start", "sort")).select("user_id").distinct()


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a table has more than once: empty for a sound table."""
    return table.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")
