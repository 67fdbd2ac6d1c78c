"""Every query by name: a plan over the driver's tables with fixed parameters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, history, ingest, islands, partials, playlists, records, search, top
from ..operators.facts import period_plays, resolved_albums
from ..session import materialised, scratch
from ..sources import buckets, files
from ..sources.files import normalise_basic, normalise_extended
from ..sources.library import Library, events_library, star_library
from ..streaming import plays as stream

Query = Callable[[SparkSession, str], DataFrame]


def _on(binding: Callable[[SparkSession, str], Library], plan: Callable[[Library], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(binding(spark, sf_dir))


def _star(plan: Callable[[Library], DataFrame]) -> Query:
    return _on(star_library, plan)


def _events(plan: Callable[[Library], DataFrame]) -> Query:
    return _on(events_library, plan)


def _history_rows(lib: Library) -> DataFrame:
    return history.history_filter(lib, 1, artist=1)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as entries of the extended format: some short, some without names or ids."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.select(
        "user_id", F.col("event_id").alias("seq"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts"),
        F.when(F.col("k") % 10 != 0, F.concat(F.lit("Track "), F.col("k").cast("string"))).alias("master_metadata_track_name"),
        F.concat(F.lit("Artist "), (F.col("k") % 7).cast("string")).alias("master_metadata_album_artist_name"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("Album "), (F.col("k") % 5).cast("string"))).alias("master_metadata_album_album_name"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("service:track:t"), F.col("k").cast("string"))).alias("spotify_track_uri"),
        (F.col("k") * 1000).alias("ms_played"),
    )


def _import_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries, all twice."""
    raw = _entries(spark, sf_dir)
    again = raw.withColumn("seq", F.col("seq") + 1_000_000_000)
    return normalise_extended(raw.unionByName(again))


def _import_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return normalise_basic(e.select(
        "user_id", F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("endTime"), F.concat(F.lit("Track "), F.col("k").cast("string")).alias("trackName"),
        F.concat(F.lit("Artist "), (F.col("k") % 7).cast("string")).alias("artistName"), (F.col("k") * 1000).alias("msPlayed"),
    ))


def _utc_plays(plays: DataFrame) -> DataFrame:
    """Imported plays with their times as text in UTC, whatever the session's zone."""
    at = F.to_utc_timestamp("played_at", F.current_timezone())
    return plays.select("user_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("played_at"), "track_id", "ms_played")


def import_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc_plays(ingest.import_history(_import_extended(spark, sf_dir)).plays)


def import_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc_plays(ingest.import_history(_import_basic(spark, sf_dir)).plays)


def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_history(_import_extended(spark, sf_dir)).counters


def import_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_history(_import_extended(spark, sf_dir)).tracks


def _copied_tracks(lib: Library) -> Library:
    """The library with names that several tracks and albums share, and types of albums."""
    name = F.concat(F.lit("Song "), (F.col("track_id") % 40).cast("string"))
    number = F.substring("album_id", 7, 3).cast("long")  # of Brand#number
    kind = F.when(number % 4 == 0, "album").when(number % 4 == 1, "single").when(number % 4 == 2, "compilation")
    albums = lib.albums.withColumns({"name": F.concat(F.lit("Record "), (number % 6).cast("string")), "album_type": kind, "total_tracks": number % 9})
    return lib.but(tracks=lib.tracks.withColumn("name", name), albums=albums)


def dedup_tracks(lib: Library) -> DataFrame:
    lib = _copied_tracks(lib)
    return ingest.duplicate_tracks(lib.tracks, lib.albums, lib.track_artists, lib.plays)


def dedup_tracks_plays(lib: Library) -> DataFrame:
    """Plays by track after deduplication: none is lost."""
    c = _copied_tracks(lib)
    mapping = ingest.duplicate_tracks(c.tracks, c.albums, c.track_artists, c.plays)
    plays = ingest.apply_track_map(mapping, c.tracks, c.track_artists, c.plays.select("user_id", "played_at", "track_id"), c.playlist_tracks)[2]
    return plays.groupBy("track_id").agg(F.count("*").alias("play_count"))


def dedup_albums(lib: Library) -> DataFrame:
    lib = _copied_tracks(lib)
    return ingest.duplicate_albums(lib.tracks, lib.albums, lib.track_artists)


def _local(lib: Library) -> Library:
    lib = _copied_tracks(lib)
    local = F.concat(F.lit("local:"), F.col("album_id"))
    return lib.but(tracks=lib.tracks.withColumn("album_id", local), albums=lib.albums.withColumn("album_id", local))


def dedup_local_albums(lib: Library) -> DataFrame:
    lib = _local(lib)
    return ingest.duplicate_local_albums(lib.tracks, lib.albums, lib.track_artists)[0]


def artist_alias_merge(lib: Library) -> DataFrame:
    """Credits after imported artists, half of all, were merged into real ones of their name."""
    key = F.when(F.col("artist_id") % 2 == 0, F.concat(F.lit("import:"), F.col("artist_id").cast("string"))).otherwise(F.col("artist_id").cast("string"))
    artists = lib.artists.select(key.alias("artist_id"), F.concat(F.when(F.col("artist_id") % 2 == 0, F.lit("ARTIST ")).otherwise(F.lit("Artist ")), ((F.col("artist_id") / 2).cast("long") % 20).cast("string")).alias("name"))
    credits = lib.track_artists.select("track_id", key.alias("artist_id"), "position")
    return ingest.apply_artist_map(ingest.artist_aliases(artists), artists, credits)[1]


def _new_tracks(lib: Library) -> DataFrame:
    new = lib.tracks.filter("track_id % 3 = 0").select(
        F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), (F.col("track_id") * 2).alias("track_id"), "name", "album_id", (F.col("duration_ms") + 1).alias("duration_ms"), "popularity"
    )
    return new.withColumns({"name": F.concat("name", F.lit(" v"), F.col("seq").cast("string")), "popularity": F.col("popularity") + F.col("seq")})


def upsert_tracks(lib: Library) -> DataFrame:
    return ingest.upsert_tracks(lib.tracks, _new_tracks(lib))


def _flat_tracks(lib: Library) -> DataFrame:
    rows = history.enrich_tracks(lib)
    names = F.array_join(F.transform("artists", lambda a: F.concat(a["artist_id"].cast("string"), F.lit(":"), a["artist_name"])), "|")
    return rows.select("track_id", "name", "album_id", "album_name", "duration_ms", names.alias("artists"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as now-playing snapshots of local files."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    item = F.when(F.col("k") % 4 == 0, F.concat(F.lit("s"), F.col("k").cast("string"))).otherwise(F.concat(F.lit("local:"), (F.col("k") % 3).cast("string")))
    return e.select("user_id", "at", (F.col("k") % 5 != 0).alias("is_playing"), item.alias("item_id"), (F.col("k") * 100).alias("progress_ms"), (F.col("k") * 1000 + 60_000).alias("duration_ms"))


def _streamed(spark: SparkSession, sf_dir: str, name: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of a stream over the events' file, run until it is read: Parquet files, which with the state lie in ``spark.checkpoint.dir``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="chk")  # a temporary one in local tests only
    where, rows = f"{shared}/streams/{name}_{uuid.uuid4().hex}", plan(source)
    query = rows.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{where}/rows")


PLAYS = "user_id long, played_at timestamp, track_id long"


def _appended(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Tables of plays and of their partials after a stream of four files: each holds a quarter of the events, and a quarter that came before."""
    where = _shared(spark, "plays", "streams")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("played_at"), F.get_json_object("props", "$.k").cast("long").alias("track_id"), F.pmod("event_id", F.lit(4)).alias("part"))
    for part in range(4):
        rows.filter(F.col("part").isin(part, max(0, part - 1))).drop("part").write.mode("append").parquet(f"{where}/feed")
    sink = stream.append_new(f"{where}/plays", PLAYS, f"{where}/partials")
    files = len(spark.read.schema(PLAYS).parquet(f"{where}/feed").inputFiles())
    feed = spark.readStream.schema(PLAYS).option("maxFilesPerTrigger", max(1, files // 4)).parquet(f"{where}/feed")
    feed.writeStream.foreachBatch(sink).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return f"{where}/plays", f"{where}/partials"


def stream_dedupe_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays that came late and more than once, appended to a table of committed batches."""
    rows = stream.read_plays(spark, _appended(spark, sf_dir)[0], PLAYS)
    return rows.select("user_id", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("played_at"), "track_id")


def stream_partial_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings from the partials that the same stream keeps."""
    return top.rankings(events_library(spark, sf_dir).but(plays=partials.partial_plays(spark, _appended(spark, sf_dir)[1])), "track")


def stream_local_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over the stream of snapshots."""

    def plan(events: DataFrame) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        item = F.when(k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.concat(F.lit("local:"), (k % 3).cast("string")))
        return stream.local_plays(events.select("user_id", F.col("ts").cast("timestamp").alias("at"), (k % 5 != 0).alias("is_playing"), item.alias("item_id"), (k * 100).alias("progress_ms"), (k * 1000 + 60_000).alias("duration_ms")))

    rows = _streamed(spark, sf_dir, "local_plays", plan)
    return rows.select("user_id", "track_id", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"), "duration_ms")


def stream_timed_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine with timers: a user who sends nothing for six hours has stopped."""
    k = F.get_json_object("props", "$.k").cast("long")
    item = F.when(k % 4 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise(F.concat(F.lit("local:"), (k % 3).cast("string")))

    def plan(events: DataFrame) -> DataFrame:
        return stream.timed_plays(events.select("user_id", F.col("ts").cast("timestamp").alias("at"), (k % 5 != 0).alias("is_playing"), item.alias("item_id"), (k * 100).alias("progress_ms"), (k * 1000 + 60_000).alias("duration_ms")), timedelta(hours=6))

    conf, store = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store)
    conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = _streamed(spark, sf_dir, "timed_plays", plan).filter("kind = 'play'")
    finally:
        conf.set(store, before)
    return rows.select("user_id", "track_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("played_at"), "duration_ms")


def _spelled(lib: Library) -> DataFrame:
    """Entries of local files: a quarter are known by name in another case, some lack names."""
    n = F.col("track_id")
    return lib.tracks.select(
        n.alias("entry"), F.when(n % 11 != 0, F.upper("name")).alias("track_name"), F.when(n % 13 != 0, F.concat(F.lit("SUPPLIER "), (n % 50).cast("string"))).alias("artist_name"),
        F.when(n % 17 != 0, F.concat(F.lit("Record "), (n % 30).cast("string"))).alias("album_name"),
    )


def _local_ids(lib: Library) -> DataFrame:
    artists = lib.artists.select(F.concat(F.lit("a"), F.col("artist_id").cast("string")).alias("artist_id"), F.concat(F.lit("Supplier "), (F.col("artist_id") % 40).cast("string")).alias("name"))
    albums = lib.albums.select(F.concat(F.when(F.substring("album_id", 7, 3).cast("int") % 2 == 0, F.lit("local:")).otherwise(F.lit("")), "album_id").alias("album_id"), F.concat(F.lit("record "), F.substring("album_id", 7, 3)).alias("name"))
    tracks = lib.tracks.filter("track_id % 4 = 0").select(F.concat(F.lit("local:t"), F.col("track_id").cast("string")).alias("track_id"), "name", F.concat(F.lit("local:Brand#"), (F.col("track_id") % 30).cast("string")).alias("album_id"))
    return ingest.local_ids(_spelled(lib), artists, albums, tracks).select("entry", "artist_id", "album_id", "track_id")


def _covered(lib: Library) -> DataFrame:
    """Albums, every third imported and every fifth local, some with covers and some searched in vain."""
    n = F.substring("album_id", 7, 3).cast("int")
    prefix = F.when(n % 3 == 0, "import:").when(n % 5 == 0, "local:").otherwise("")
    return lib.albums.select(F.concat(prefix, "album_id").alias("album_id"), F.concat(F.lit("Name "), (n % 4).cast("string")).alias("name"), F.when(n % 7 == 0, "").when(n % 4 == 0, "old").alias("image_url"))


def _covers_found(lib: Library) -> DataFrame:
    albums = _covered(lib)
    found = ingest.missing_covers(albums).select("album_id", F.when(F.length("album_id") % 2 == 0, F.concat(F.lit("img of "), "name")).alias("image_url"))
    return ingest.with_found_covers(albums, found)


def _covers(lib: Library) -> DataFrame:
    """Covers of all albums after tracks brought some: of equal ones the first stays."""
    seen = lib.tracks.filter("album_id is not null").select("album_id", F.concat(F.lit("c"), (F.col("track_id") % 3).cast("string")).alias("image_url"), F.lit("track").alias("source"), F.col("track_id").alias("observed_at"))
    return ingest.add_covers(seen.filter("observed_at % 5 = 0").dropDuplicates(["album_id", "image_url"]).withColumns({"observed_at": F.lit(0).cast("long"), "source": F.lit("old")}), seen)


def now_playing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's last snapshot, and whether it is still shown."""
    rows = stream.last_snapshots(_snapshots(spark, sf_dir)).withColumn("shown", stream.is_shown("2024-01-31 00:00:00", "36 hours"))
    return rows.select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "is_playing", "item_id", "progress_ms", "shown")


def local_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.local_plays_batch(_snapshots(spark, sf_dir))
    return rows.select("user_id", "track_id", F.date_format("played_at", "yyyy-MM-dd HH:mm:ss").alias("played_at"), "duration_ms")


def _flat_charts(lib: Library) -> DataFrame:
    rows = charts.charts(charts.chart_facts(lib, "artist"))
    return rows.withColumn("peak_periods", F.array_join("peak_periods", ","))


def _folded(plan: Callable[[Library], DataFrame]) -> Query:
    return _star(lambda lib: plan(search.with_folded_names(lib)))


def _rules(lib: Library) -> DataFrame:
    """Rules that users ask for, one after the other, from the tracks: sound ones, and any that must not be added."""
    number = F.expr("track_id div 7") % 26  # there is no Brand#0
    return lib.tracks.select(
        (F.col("track_id") % 7).alias("user_id"), F.coalesce("album_id", F.lit("Nowhere")).alias("source_id"), F.concat(F.lit("Brand#"), number.cast("string")).alias("target_id"), F.col("track_id").alias("seq")
    )


def _added(lib: Library) -> DataFrame:
    return search.add_merge_rules(lib.merge_rules, _rules(lib), lib.albums)[0]


def _merge_problems(lib: Library) -> DataFrame:
    return search.merge_problems(_rules(lib).drop("seq"))


def _rule_deletion(lib: Library) -> DataFrame:
    rules = _added(lib)
    return search.delete_merge_rules(rules, rules.filter("user_id = 1"))


def _shared(spark: SparkSession, name: str, kind: str = "tables") -> str:
    """A new folder of its own in the cluster's shared one; a temporary one in local tests only."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="chk")
    return f"{shared}/{kind}/{name}_{uuid.uuid4().hex}"


def _from_partials(lib: Library) -> Library:
    """The library whose plays are stored partials, added in three batches that share days."""
    path, spark = _shared(lib.spark, "partials"), lib.spark
    plays = materialised(lib.plays.withColumn("_batch", F.pmod(F.xxhash64("user_id", "track_id", "played_at"), F.lit(3))))
    for number in range(3):
        partials.add_plays(path)(plays.filter(F.col("_batch") == number).drop("_batch"), number)
    return lib.but(plays=partials.partial_plays(spark, path))


def _import_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of import files, a hundred entries each: of five, one is cut off and one holds an object."""
    path = _shared(spark, "imports")
    entry = F.struct("seq", F.to_json(F.struct(*files.EXTENDED_FIELDS)).alias("json"))
    texts = _entries(spark, sf_dir).groupBy(F.floor(F.col("seq") / 100).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["json"]), ",").alias("all"))
    begin, end = F.when(F.col("n") % 5 == 4, '{"entries":[').otherwise("["), F.when(F.col("n") % 5 == 4, "]}").when(F.col("n") % 5 == 3, ",").otherwise("]")
    name = F.concat(F.lit("f"), F.lpad(F.col("n").cast("string"), 12, "0"), F.lit(".txt"))
    files.write_texts(texts.select(name.alias("name"), F.concat(begin, "all", end).alias("value")), path)
    return path


def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each file of an import."""
    report = files.import_files(spark, _import_folder(spark, sf_dir), 1, "*.txt")[1]
    return report.select(F.regexp_extract("file", "[/=]f([0-9]{12})[.]txt", 1).cast("long").alias("number"), "status", F.col("entries").cast("long").alias("entries"))


def import_files_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of the files that could be read."""
    entries = files.read_import(spark, _import_folder(spark, sf_dir), 1, "*.txt")
    return _utc_plays(ingest.import_history(entries).plays)


def _exported(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str, str], DataFrame]) -> Query:
    """All plays after an export to files, as these say them."""

    def plan(lib: Library) -> DataFrame:
        path, rows = _shared(lib.spark, "export"), history.export_rows(lib)
        write(rows, path)
        return read(lib.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))

    return _events(plan)


def _read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def _paged(lib: Library) -> DataFrame:
    """Tracks of playlists, from landed pages of fifty."""
    path = _shared(lib.spark, "pages")
    item = F.struct("position", "track_id", "playlist_id")
    pages = lib.playlist_tracks.groupBy("playlist_id", F.floor(F.col("position") / 50)).agg(F.array_sort(F.collect_list(item)).alias("items"))
    pages.select("items").write.json(path)
    return files.read_pages(lib.spark, path, "playlist_id: long, track_id: long, position: long")


def _by_month(lib: Library) -> Library:
    """The library whose plays are stored by month."""
    path = _shared(lib.spark, "plays_by_month")
    files.write_plays(lib.plays, path)
    return lib.but(plays=lib.spark.read.parquet(path))


def _stored(lib: Library, name: str, rows: DataFrame) -> DataFrame:
    path = _shared(lib.spark, name)
    rows.write.parquet(path)
    return lib.spark.read.schema(rows.schema).parquet(path)


def _chart_changes(lib: Library) -> DataFrame:
    """Charts stored as changes of rank."""
    return _stored(lib, "chart_changes", charts.run_length(charts.chart_facts(lib, "artist").select("user_id", "period", "entity_id", "rank"), charts.available_periods(lib), ["rank"]))


def _chart_history_from_changes(lib: Library, start: str | None = None, end: str | None = None) -> DataFrame:
    return charts.expanded(_chart_changes(lib), charts.available_periods(lib), start, end)


def _ranking_history_from_changes(lib: Library) -> DataFrame:
    facts = materialised(period_plays(lib, "month"))  # one pass over the plays gives counts and months
    months = materialised(facts.select("user_id", "period").distinct())
    return charts.expanded(_stored(lib, "ranking_changes", charts.run_length(top.ranking_history(lib, "artist", facts=facts), months, ["total", "rank"])), months)


def _upserted_buckets(lib: Library) -> DataFrame:
    """The upsert of tracks, into a table in buckets."""
    path, schema = _shared(lib.spark, "tracks"), "track_id long, name string, album_id string, duration_ms long, popularity int"
    buckets.write_buckets(lib.tracks.withColumn("track_id", F.col("track_id").cast("long")), path, ["track_id"], 16)
    ingest.upsert_stored(lib.spark, path, schema, "track_id", _new_tracks(lib).withColumn("track_id", F.col("track_id").cast("long")), overwrite=["name", "popularity"], buckets=16)
    return buckets.read_buckets(lib.spark, path, schema)


def _indexed(plan: Callable[[Library, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lib, path = star_library(spark, sf_dir), _shared(spark, "search")
        search.index_names(lib, path)
        return plan(lib, path)

    return run


def _own_settings(lib: Library) -> DataFrame:
    """Settings of some users, by their number: beginnings of the week and metrics, and values that aren't known."""
    users = lib.plays.select("user_id").distinct()
    week = F.when(F.col("user_id") % 4 == 0, "monday").when(F.col("user_id") % 4 == 1, "sunday").when(F.col("user_id") % 4 == 2, "whenever")
    sort = F.when(F.col("user_id") % 2 == 0, "plays")
    each = F.explode(F.array(F.struct(F.lit("week_start").alias("key"), week.alias("value")), F.struct(F.lit("sort").alias("key"), sort.alias("value"))))
    return users.select("user_id", each.alias("_s")).select("user_id", "_s.*").filter("value is not null")


def records_by_settings(lib: Library) -> DataFrame:
    """Stored boards after a user without settings chose weeks from Monday and was refreshed."""
    path = _shared(lib.spark, "records")
    with scratch(lib.spark) as keep:  # the tables that every step reads again, in place of the joins that make them
        lib = lib.but(plays=keep(lib.plays), track_artists=keep(lib.track_artists), playlist_tracks=keep(lib.playlist_tracks.select("playlist_id", "track_id")))
        settings = _own_settings(lib)
        records.store_records(lib, settings, path, buckets=8, limit=10)
        new = lib.plays.filter("user_id = 3").select("user_id").distinct().select("user_id", F.lit("week_start").alias("key"), F.lit("monday").alias("value"), F.lit(1).alias("seq"))
        records.refresh_records(lib, ingest.put_settings(settings, new), path, ingest.records_due(new), buckets=8, limit=10)
    return records.stored_records(lib.spark, path)


def _album_artists(lib: Library) -> DataFrame:
    """Artists of albums of two tracks; a third of them have two artists stored."""
    number = F.expr("track_id div 2")
    tracks = lib.tracks.withColumn("album_id", F.concat(F.lit("P"), number.cast("string")))
    ids = F.when(number % 3 == 0, F.array(number % 5 + 1, number % 5 + 2))
    albums = lib.tracks.select(F.concat(F.lit("P"), number.cast("string")).alias("album_id"), ids.alias("artist_ids")).distinct()
    return history.album_artists(lib.but(tracks=tracks, albums=albums))


def _synced(lib: Library) -> DataFrame:
    """Tracks of playlists after a sync, each with its playlist's count and sum of ids: a quarter are gone, those whose snapshot changed have other tracks."""
    stored = lib.playlists.withColumn("snapshot_id", F.lit("v0"))
    members = lib.playlist_tracks.join(lib.playlists.select("playlist_id", "user_id"), "playlist_id")
    feed = stored.filter("playlist_id % 4 <> 0").withColumn("snapshot_id", F.concat(F.lit("v"), (F.col("playlist_id") % 3).cast("string")))
    moved = members.filter("playlist_id % 4 <> 0").withColumn("track_id", F.col("track_id") + 1)
    synced = playlists.sync_playlists(stored, members, feed, moved)[1].select("playlist_id", "track_id")
    sums = synced.groupBy("playlist_id").agg(F.count("*").alias("tracks"), F.sum("track_id").alias("ids"))
    return synced.join(sums, "playlist_id")


def _inserted(lib: Library) -> DataFrame:
    """Albums with those of a feed that aren't there yet, the first of equal ones."""
    new = lib.spark.range(3).select(F.concat(F.lit("New#"), F.col("id").cast("string")).alias("album_id"), F.explode(F.array(F.lit("second"), F.lit("first"))).alias("name"))
    return ingest.insert_ignore(lib.albums, new.unionByName(lib.albums.withColumn("name", F.lit("changed"))), ["album_id"], ["name"])


def settings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    new = e.select("user_id", F.lit("sort").alias("key"), F.when(F.col("event_id") % 2 == 0, "plays").otherwise("time").alias("value"), F.col("event_id").alias("seq"))
    new = new.unionByName(e.select("user_id", F.lit("nonsense").alias("key"), F.lit("x").alias("value"), F.col("event_id").alias("seq")))
    return ingest.put_settings(e.select("user_id", F.lit("language").alias("key"), F.lit("en").alias("value")).distinct(), new)


def _enriched(lib: Library) -> DataFrame:
    """Artists after a look-up that has half of them; a third have an image of their own."""
    artists = lib.artists.withColumn("image_url", F.when(F.col("artist_id") % 3 == 0, F.lit("old")))
    found = lib.artists.filter("artist_id % 2 = 0").select("artist_id", F.concat(F.lit("img"), F.col("artist_id").cast("string")).alias("image_url"))
    return ingest.enrich_artists(artists, found).select("artist_id", "image_url")


def _credits_fixed(lib: Library) -> DataFrame:
    """Credits after a source was asked for half of the tracks; a third of the artists were imported."""
    key = F.concat(F.when(F.col("artist_id") % 3 == 0, F.lit("import:")).otherwise(F.lit("")), F.col("artist_id").cast("string"))
    credits = lib.track_artists.select(F.col("track_id").cast("string").alias("track_id"), key.alias("artist_id"), "position")
    source = lib.track_artists.filter("track_id % 2 = 0").select(
        F.col("track_id").cast("string").alias("track_id"), (F.col("artist_id") + 1).cast("string").alias("artist_id"), F.lit("found").alias("artist_name"), "position"
    )
    tracks = lib.tracks.select(F.col("track_id").cast("string").alias("track_id"), "name", F.lit(None).cast("boolean").alias("verified_artists"))
    return ingest.fix_credits(tracks, lib.artists.select(F.col("artist_id").cast("string").alias("artist_id"), "name"), credits, source)[2].select("track_id", "artist_id")


def _album_resolution(lib: Library) -> DataFrame:
    counts = lib.plays.groupBy("user_id", "track_id").agg(F.count("*").alias("n")).join(lib.tracks.select("track_id", "album_id"), "track_id")
    return resolved_albums(lib, counts).groupBy("user_id", "album_id").agg(F.sum("n").alias("play_count"))


def _weekly_artists(lib: Library) -> DataFrame:
    return records.weekly_ranks(lib, "artist")


def _period_entries(lib: Library) -> DataFrame:
    rows = charts.chart(lib, "artist", "1997-W20")[0]
    return rows.withColumn("peak_periods", F.array_join("peak_periods", ","))


#: A custom range of whole days.
FROM, UNTIL = date(2024, 1, 12), date(2024, 1, 18)

QUERIES: dict[str, Query] = {
    "top_tracks": _star(lambda lib: top.top_entities(lib, "track", "year")),
    "top_artists": _star(lambda lib: top.top_entities(lib, "artist", "year", "plays")),
    "top_albums_merged": _star(lambda lib: top.top_entities(lib, "album", "year")),
    "top_tracks_week": _events(lambda lib: top.top_entities(lib, "track", "week")),
    "top_tracks_this_year": _star(lambda lib: top.top_entities(lib, "track", "thisYear")),
    "top_tracks_all": _star(lambda lib: top.top_entities(lib, "track", "all")),
    "entity_stats_track": _star(lambda lib: top.entity_stats(lib, "track")),
    "entity_stats_artist": _star(lambda lib: top.entity_stats(lib, "artist")),
    "entity_stats_album": _star(lambda lib: top.entity_stats(lib, "album")),
    "total_stats": _star(top.total_stats),
    "series_day": _events(lambda lib: top.series(lib, "day")),
    "series_week": _star(lambda lib: top.series(lib, "week")),
    "series_month": _star(lambda lib: top.series(lib, "month")),
    "entity_series_auto": _star(lambda lib: top.entity_series(lib, "artist", "year")),
    "entity_series_week": _star(lambda lib: top.entity_series(lib, "artist", "6months")),
    "recent_plays": _events(lambda lib: history.recent_plays(lib, "track", 3)),
    "history_page": _events(lambda lib: history.history_page(_history_rows(lib), 2, 5)),
    "history_day": _events(lambda lib: history.history_filter(lib, 1, day=date(2024, 1, 10))),
    "history_total": _events(lambda lib: history.history_total(_history_rows(lib))),
    "delete_history": _events(lambda lib: history.delete_plays(lib, 1, list(range(0, 900, 3)))),
    "rankings_four_ranges": _events(lambda lib: top.rankings(lib, "track")),
    "rankings_albums": _star(lambda lib: top.rankings(lib, "album", "plays")),
    "ranking_history_cumulative": _star(lambda lib: top.ranking_history(lib, "artist")),
    "artist_top_tracks": _star(top.artist_top_tracks),
    "artist_top_albums": _star(top.artist_top_albums),
    "album_artists": _star(_album_artists),
    "album_tracks": _star(lambda lib: history.album_tracks(lib, 1)),
    "album_ids_resolved": _star(lambda lib: history.album_ids(lib.but(merge_rules=_added(lib)))),
    "album_resolution": _star(_album_resolution),
    "enrich_track": _star(_flat_tracks),
    "track_artists_ordered": _star(history.ordered_track_artists),
    "track_album_breakdown": _star(history.track_album_breakdown),
    "lookup_tracks": _star(lambda lib: history.lookup(lib.tracks, "track_id", [1, 17, 42])),
    "week_chart_monday": _star(lambda lib: charts.chart_facts(lib, "artist")),
    "week_chart_friday": _star(lambda lib: charts.chart_facts(lib, "artist", week_start="friday")),
    "week_chart_sunday": _star(lambda lib: charts.chart_facts(lib, "album", week_start="sunday", sort="plays")),
    "month_chart": _star(lambda lib: charts.chart_facts(lib, "track", "month")),
    "year_chart": _star(lambda lib: charts.chart_facts(lib, "album", "year")),
    "period_chart": _star(lambda lib: charts.period_chart(lib, "track", "1997-W20")),
    "period_chart_entries": _star(_period_entries),
    "period_chart_dropouts": _star(lambda lib: charts.chart(lib, "artist", "1997-W20")[1]),
    "chart_rank_change": _star(lambda lib: charts.with_changes(charts.chart_facts(lib, "artist"))),
    "chart_peaks": _star(_flat_charts),
    "chart_consecutive": _star(lambda lib: charts.with_peaks(charts.chart_facts(lib, "track", "month")).select("user_id", "period", "entity_id", "rank", "consecutive")),
    "chart_dropouts": _star(lambda lib: charts.dropouts(charts.chart_facts(lib, "artist"))),
    "chart_periods": _star(charts.available_periods),
    "entity_chart_history": _star(lambda lib: charts.chart_history(lib, "artist")),
    "entity_chart_summary": _star(lambda lib: charts.chart_summary(lib, "artist")),
    "rec_peak_week": _star(lambda lib: records.peak_week(_weekly_artists(lib))),
    "rec_debuts": _star(lambda lib: records.biggest_debut(_weekly_artists(lib))),
    "rec_weeks_no1": _star(lambda lib: records.weeks_at(_weekly_artists(lib), "weeksAtNo1", 1)),
    "rec_weeks_in_chart": _star(lambda lib: records.weeks_at(_weekly_artists(lib), "weeksInChart", 25)),
    "rec_longest_run": _star(lambda lib: records.longest_run(_weekly_artists(lib))),
    "rec_no1_tracks": _star(lambda lib: records.most_number_ones(lib, "track", records.weekly_leaders(lib, "track"))),
    "rec_no1_albums": _star(lambda lib: records.most_number_ones(lib, "album", records.weekly_leaders(lib, "album"))),
    "rec_most_playlists": _star(lambda lib: records.in_most_playlists(lib, "artist")),
    "rec_most_playlists_track": _star(lambda lib: records.in_most_playlists(lib, "track")),
    "rec_most_playlists_album": _star(lambda lib: records.in_most_playlists(lib, "album")),
    "records_track": _star(lambda lib: records.records(lib, "track")),
    "records_album": _star(lambda lib: records.records(lib, "album", "friday", "plays")),
    "records_artist": _star(lambda lib: records.records(lib, "artist")),
    "accolades": _star(lambda lib: records.accolades(lib, "album")),
    "top_genres": _events(top.genres),
    "heatmap": _events(top.heatmap),
    "missing_metadata": _star(lambda lib: ingest.missing_metadata(lib.tracks, lib.albums, lib.artists)),
    "streaks": _events(islands.streaks),
    "search_artists": _folded(lambda lib: search.search_artists(lib, 1, "0003")),
    "search_albums": _folded(lambda lib: search.search_albums(lib, 1, "brand#2")),
    "search_tracks": _folded(lambda lib: search.search_tracks(lib, 1, "00_1")),
    "merge_info": _star(search.merge_info),
    "merge_list": _star(search.merge_list),
    "merge_suggestions": _star(lambda lib: search.merge_suggestions(lib, 1)),
    "merge_problems": _star(_merge_problems),
    "merge_rules_added": _star(_added),
    "merge_rules_deleted": _star(_rule_deletion),
    "search_accents": _folded(lambda lib: search.search_artists(lib, 1, "SÚPPLÏER#00000000_\u0301")),
    "playlists_synced": _star(_synced),
    "generated_playlists": _events(lambda lib: playlists.generate(lib, "rediscovery", 10, min_plays=2, recency_days=10)),
    "albums_inserted": _star(_inserted),
    "settings_merged": settings_merged,
    "artists_enriched": _star(_enriched),
    "credits_fixed": _star(_credits_fixed),
    "library_playlists": _events(playlists.library_playlists),
    "playlist_track_stats": _star(playlists.track_stats),
    "playlist_genres": _star(playlists.playlist_genres),
    "playlist_series": _star(lambda lib: playlists.playlist_series(lib, "month")),
    "playlist_coverage": _star(lambda lib: playlists.coverage(playlists.track_stats(lib))),
    "presence_track": _star(lambda lib: playlists.presence(lib, "track")),
    "presence_artist": _star(lambda lib: playlists.presence(lib, "artist")),
    "presence_album": _star(lambda lib: playlists.presence(lib, "album")),
    "strategy_top_range": _events(lambda lib: playlists.top_range(lib, "month", 10)),
    "strategy_top_artist": _events(lambda lib: playlists.top_artist(lib, 1, limit=10)),
    "strategy_top_genre": _events(lambda lib: playlists.top_genre(lib, "ASIA", limit=10)),
    "strategy_deep_cuts": _events(lambda lib: playlists.deep_cuts(lib, limit=10)),
    "strategy_time_vibes": _events(lambda lib: playlists.time_vibes(lib, [0, 6], [20, 21, 22, 23], limit=10)),
    "strategy_rediscovery": _events(lambda lib: playlists.rediscovery(lib, 10, 2, 10)),
    "export_plays": _events(history.export_rows),
    "total_plays": _events(history.total_plays),
    "import_extended": import_extended,
    "import_basic": import_basic,
    "import_dedupe": import_dedupe,
    "import_tracks": import_tracks,
    "dedup_tracks": _events(dedup_tracks),
    "dedup_tracks_plays": _events(dedup_tracks_plays),
    "dedup_albums": _star(dedup_albums),
    "dedup_local_albums": _star(dedup_local_albums),
    "artist_alias_merge": _star(artist_alias_merge),
    "upsert_tracks": _star(upsert_tracks),
    "local_plays": local_plays,
    "now_playing": now_playing,
    "stream_dedupe_plays": stream_dedupe_plays,
    "stream_local_plays": stream_local_plays,
    "top_tracks_custom": _events(lambda lib: top.top_entities(lib, "track", start=FROM, end=UNTIL)),
    "top_albums_custom": _star(lambda lib: top.top_entities(lib, "album", sort="plays", start=date(1997, 3, 1), end=date(1997, 5, 31))),
    "genres_custom": _events(lambda lib: top.genres(lib, start=FROM, end=UNTIL)),
    "entity_series_custom": _events(lambda lib: top.entity_series(lib, "artist", start=FROM, end=UNTIL)),
    "entity_series_one_day": _events(lambda lib: top.entity_series(lib, "artist", start=FROM, end=FROM)),
    "strategy_top_range_custom": _events(lambda lib: playlists.top_range(lib, limit=10, start=FROM, end=UNTIL)),
    "strategy_top_artist_custom": _events(lambda lib: playlists.top_artist(lib, 1, limit=10, start=FROM, end=UNTIL)),
    "strategy_top_genre_custom": _events(lambda lib: playlists.top_genre(lib, "ASIA", limit=10, start=FROM, end=UNTIL)),
    "strategy_deep_cuts_custom": _events(lambda lib: playlists.deep_cuts(lib, limit=10, min_plays=1, start=FROM, end=UNTIL)),
    "strategy_time_vibes_custom": _events(lambda lib: playlists.time_vibes(lib, [0, 6], [20, 21, 22, 23], limit=10, start=FROM, end=UNTIL)),
    "records_by_settings": _star(records_by_settings),
    "partial_top_artists": _star(lambda lib: top.top_entities(_from_partials(lib), "artist", "year", "plays")),
    "partial_week_chart": _star(lambda lib: charts.chart_facts(_from_partials(lib), "artist", week_start="friday")),
    "partial_series_week": _star(lambda lib: top.series(_from_partials(lib), "week")),
    "partial_ranking_history": _star(lambda lib: top.ranking_history(_from_partials(lib), "artist")),
    "partial_records": _star(lambda lib: records.records(_from_partials(lib), "track")),
    "stream_partial_rankings": stream_partial_rankings,
    "chart_history_from_changes": _star(_chart_history_from_changes),
    "chart_history_part": _star(lambda lib: _chart_history_from_changes(lib, "1997-W10", "1997-W30")),
    "ranking_history_from_changes": _star(_ranking_history_from_changes),
    "upsert_tracks_buckets": _star(_upserted_buckets),
    "stream_timed_plays": stream_timed_plays,
    "local_ids": _star(_local_ids),
    "album_aliases": _star(lambda lib: ingest.album_aliases(_covered(lib))),
    "covers_missing": _star(lambda lib: ingest.missing_covers(_covered(lib))),
    "covers_found": _star(_covers_found),
    "covers_added": _star(_covers),
    "accolades_track": _star(lambda lib: records.accolades(lib, "track", "friday", "plays")),
    "accolades_artist": _star(lambda lib: records.accolades(lib, "artist")),
    "history_page_keyset": _events(lambda lib: history.history_page(lib.plays, size=20, after=(datetime(2024, 1, 20), 0))),
    "search_index_artists": _indexed(lambda lib, path: search.search_artists(lib, 1, "0003", index=path)),
    "search_index_albums": _indexed(lambda lib, path: search.search_albums(lib, 1, "brand#2", index=path)),
    "search_index_tracks": _indexed(lambda lib, path: search.search_tracks(lib, 1, "00_1", index=path)),
    "import_files": import_files,
    "import_files_plays": import_files_plays,
    "export_csv": _exported(files.write_csv, _read_csv),
    "export_json": _exported(files.write_json, lambda spark, path, schema: spark.read.schema(schema).json(path)),
    "playlist_pages": _star(_paged),
    "series_day_stored": _events(lambda lib: top.series(_by_month(lib), "day")),
    "month_chart_stored": _events(lambda lib: charts.period_chart(_by_month(lib), "track", "2024-01", "month")),
}
