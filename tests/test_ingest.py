"""Imports, upserts, deduplication, streams and files."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoplay.functions.text import synthetic_id
from chronoplay.operators import ingest
from chronoplay.sources import files
from chronoplay.streaming import plays as stream

AT = datetime(2024, 1, 1)


def test_import_names_broken_files(spark, tmp_path):
    """A file of invalid JSON is an error by name, one without an array is skipped, and neither loses the others' entries."""
    entry = {"endTime": "2024-01-01 10:00", "trackName": "T", "artistName": "A", "msPlayed": 50000}
    texts = {"a.json": json.dumps([entry, entry]), "b.json": json.dumps([entry])[:-3], "c.json": json.dumps(entry), "d.json": "[]", "e.json": " \n [1, null, " + json.dumps(entry) + "]", "f.json": "", "g.json": '"text"', "h.txt": "["}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    entries, report = files.import_files(spark, str(tmp_path), 1)
    got = {r["file"].rsplit("/", 1)[-1]: (r["status"], r["entries"]) for r in report.collect()}
    assert got == {"a.json": ("read", 2), "b.json": ("error", 0), "c.json": ("skipped", 0), "d.json": ("read", 0), "e.json": ("read", 3), "g.json": ("skipped", 0)}
    assert sorted((r["seq"]["file"][-6:], r["seq"]["n"]) for r in entries.collect()) == [("a.json", 0), ("a.json", 1), ("e.json", 2)]


def test_import_files(spark, tmp_path):
    """import_mixed: both formats, thresholds, missing names, duplicates within and across files."""
    ext = [
        {"ts": "2024-01-01T10:00:00Z", "master_metadata_track_name": "Été", "master_metadata_album_artist_name": "É", "master_metadata_album_album_name": "Al", "spotify_track_uri": "service:track:abc", "ms_played": 30000},
        {"ts": "2024-01-01T10:00:00Z", "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "ms_played": 40000},
        {"ts": "2024-01-01T11:00:00Z", "master_metadata_track_name": "T", "master_metadata_album_artist_name": "A", "ms_played": 29999},
        {"ts": "2024-01-01T12:00:00Z", "master_metadata_track_name": None, "master_metadata_album_artist_name": "A", "ms_played": 90000},
    ]
    (tmp_path / "a.json").write_text(json.dumps(ext))
    (tmp_path / "b.json").write_text(json.dumps([{"endTime": "2024-01-01 10:00", "trackName": "T", "artistName": "A", "msPlayed": 50000}, {"endTime": "2024-01-01 13:00", "trackName": "t", "artistName": "a", "msPlayed": 60000}]))
    (tmp_path / "c.txt").write_text("no json")
    entries = files.read_import(spark, str(tmp_path), 5)
    got = ingest.import_history(entries)
    assert got.counters.first().asDict() == {"user_id": 5, "total": 6, "imported": 2, "duplicates": 2, "skipped": 2}
    plays = {r["played_at"]: r["track_id"] for r in got.plays.collect()}
    assert plays[datetime(2024, 1, 1, 10)] == "abc" and plays[datetime(2024, 1, 1, 13)].startswith("import:")
    again = ingest.import_history(entries, got.plays, got.artists, got.albums, got.tracks, got.track_artists)
    row = again.counters.first()
    assert (row["imported"], row["duplicates"]) == (0, 4)
    assert again.tracks.count() == again.albums.count() == again.artists.count() == again.track_artists.count() == 0


def test_import_files_are_packed(spark, tmp_path):
    """many small files lie in one folder, under their names, and tasks read many of them; each is read once for both formats."""
    texts = [(f"f{i:04}.txt", json.dumps([{"endTime": "2024-01-01 10:00", "trackName": f"Ü{i}", "artistName": "A", "msPlayed": 50000}] * 2)) for i in range(300)]
    files.write_texts(spark.createDataFrame(texts, "name string, value string"), f"{tmp_path}/in")
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == [name for name, _ in texts]
    assert all((tmp_path / "in" / name).read_text(encoding="utf-8") == value for name, value in texts)
    entries, report = files.import_files(spark, f"{tmp_path}/in", 1, "*.txt")
    assert report.rdd.getNumPartitions() == entries.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted((r["seq"]["file"][-9:], r["seq"]["n"], r["track_name"]) for r in entries.collect()) == [(name, n, f"Ü{i}") for i, (name, _) in enumerate(texts) for n in range(2)]


def test_synthetic_ids(spark):
    import hashlib

    row = spark.createDataFrame([("The Band", "Älbum")], "a string, b string").select(synthetic_id("local:", F.col("a"), F.col("b"))).first()
    assert row[0] == "local:" + hashlib.sha256("the band|älbum".encode()).hexdigest()[:16]


def test_upsert_and_insert_ignore(spark):
    table = spark.createDataFrame([(1, "a", "x", 5)], "track_id long, name string, album_id string, popularity int")
    new = spark.createDataFrame([(1, "b", "y", None, 1), (1, "c", "z", 7, 2), (2, "n", "q", 1, 1)], "track_id long, name string, album_id string, popularity int, seq int")
    assert sorted(map(tuple, ingest.upsert_tracks(table, new).collect())) == [(1, "c", "x", 7), (2, "n", "q", 1)]
    assert sorted(map(tuple, ingest.insert_ignore(table, new, ["track_id"], ["seq"]).collect())) == [(1, "a", "x", 5), (2, "n", "q", 1)]
    albums = spark.createDataFrame([("a", "old", "img", "album")], "album_id string, name string, image_url string, album_type string")
    fresh = spark.createDataFrame([("a", "new", None, "single", 1)], "album_id string, name string, image_url string, album_type string, seq int")
    assert [tuple(r) for r in ingest.upsert_albums(albums, fresh).collect()] == [("a", "new", "img", "album")]


def test_deduplication_keeps_plays_and_is_a_fixpoint(spark):
    """dedup_tracks: types, plays, local and imported ids."""
    tracks = spark.createDataFrame([("1", "Song", "s", 1), ("2", "song", "a", 1), ("3", "SONG", "a", 1), ("local:4", "song", "a", 1), ("5", "song", "a", 1)], "track_id string, name string, album_id string, duration_ms long")
    albums = spark.createDataFrame([("s", "S", "single"), ("a", "A", "album")], "album_id string, name string, album_type string")
    credits = spark.createDataFrame([("1", 1, 0), ("2", 1, 0), ("3", 1, 0), ("local:4", 1, 0), ("5", 2, 0), ("1", 7, 1)], "track_id string, artist_id long, position int")
    plays = spark.createDataFrame([(1, AT + timedelta(hours=i), t) for i, t in enumerate("1111332")], "user_id long, played_at timestamp, track_id string")
    members = spark.createDataFrame([(1, "1", 0), (1, "3", 1), (1, "5", 2)], "playlist_id long, track_id string, position int")
    mapping = ingest.duplicate_tracks(tracks, albums, credits, plays)
    assert sorted(map(tuple, mapping.collect())) == [("1", "3"), ("2", "3")]
    tracks, credits, plays, members = ingest.apply_track_map(mapping, tracks, credits, plays, members)
    assert plays.count() == 7 and plays.filter("track_id = '3'").count() == 7
    assert sorted(map(tuple, members.select("track_id", "position").collect())) == [("3", 0), ("5", 2)]
    assert sorted(r["artist_id"] for r in credits.filter("track_id = '3'").collect()) == [1, 7]
    assert ingest.duplicate_tracks(tracks, albums, credits, plays).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_no_track_is_left_without_its_album(spark, seed):
    """dedup_albums: whatever artists share albums of one name, maps end at an album that stays."""
    rng = random.Random(seed)
    led = [(rng.randrange(8), rng.randrange(4)) for _ in range(14)]
    albums = spark.createDataFrame([(f"a{i}", "Same", rng.randrange(3)) for i in range(8)], "album_id string, name string, total_tracks int")
    tracks = spark.createDataFrame([(f"t{i}", f"n{i}", f"a{a}") for i, (a, _) in enumerate(led)], "track_id string, name string, album_id string")
    credits = spark.createDataFrame([(f"t{i}", x, 0) for i, (_, x) in enumerate(led)], "track_id string, artist_id int, position int")
    left, moved = ingest.apply_album_map(ingest.duplicate_albums(tracks, albums, credits), albums, tracks)
    assert moved.count() == len(led) and moved.join(left, "album_id", "left_anti").count() == 0 and left.count() < 8


def test_album_chains_are_followed_for_local_albums_too(spark):
    albums = spark.createDataFrame([(f"local:{x}", "Same") for x in "abc"], "album_id string, name string")
    tracks = spark.createDataFrame([("1", "x", "local:c"), ("2", "y", "local:b"), ("3", "z", "local:b"), ("4", "x", "local:a"), ("5", "w", "local:a"), ("6", "v", "local:a")], "track_id string, name string, album_id string")
    credits = spark.createDataFrame([("1", 1, 0), ("2", 1, 0), ("3", 2, 0), ("4", 2, 0)], "track_id string, artist_id int, position int")
    album_map, _ = ingest.duplicate_local_albums(tracks, albums, credits)
    assert sorted(map(tuple, album_map.collect())) == [("local:b", "local:a"), ("local:c", "local:a")]


def test_local_ids_credits_covers(spark):
    entries = spark.createDataFrame([("Song", "ABBA", "Gold"), ("Song", None, ""), ("Other", "abba", "Real")], "track_name string, artist_name string, album_name string")
    artists = spark.createDataFrame([("9", "Abba")], "artist_id string, name string")
    albums = spark.createDataFrame([("local:g", "gold"), ("7", "real")], "album_id string, name string")
    tracks = spark.createDataFrame([("local:s", "SONG", "local:g"), ("8", "other", "local:g")], "track_id string, name string, album_id string")
    got = {r["track_name"] + str(r["album_name"]): r for r in ingest.local_ids(entries, artists, albums, tracks).collect()}
    assert (got["SongGold"]["artist_id"], got["SongGold"]["album_id"], got["SongGold"]["track_id"]) == ("9", "local:g", "local:s")
    assert got["OtherReal"]["artist_id"] == "9" and got["OtherReal"]["album_id"].startswith("local:") and got["OtherReal"]["album_id"] != "7" and got["OtherReal"]["track_id"] != "8"
    assert got["SongUnknown Album"]["artist_name"] == "Unknown Artist" and got["SongUnknown Album"]["track_id"] != "local:s"

    tracks = spark.createDataFrame([("t", "x", None), ("u", "y", True), ("local:v", "z", None)], "track_id string, name string, verified_artists boolean")
    credits = spark.createDataFrame([("t", "import:1", 0), ("t", "5", 1), ("u", "import:1", 0), ("local:v", "import:1", 0)], "track_id string, artist_id string, position int")
    source = spark.createDataFrame([("t", "5", "Five", 0), ("t", "6", "Six", 1), ("u", "6", "Six", 0), ("local:v", "6", "Six", 0)], "track_id string, artist_id string, artist_name string, position int")
    marked, named, fixed = ingest.fix_credits(tracks, spark.createDataFrame([("5", "five"), ("import:1", "one")], "artist_id string, name string"), credits, source)
    assert sorted(map(tuple, fixed.collect())) == [("local:v", "import:1", 0), ("t", "5", 1), ("t", "6", 1), ("u", "import:1", 0)]
    assert {r["artist_id"]: r["name"] for r in named.collect()} == {"5": "Five", "6": "Six", "import:1": "one"}
    assert {r["track_id"]: r["verified_artists"] for r in marked.collect()} == {"t": True, "u": True, "local:v": None}

    kind = "album_id string, image_url string, source string, observed_at int"
    covers = ingest.add_covers(spark.createDataFrame([("a", "x", "s", 1)], kind), spark.createDataFrame([("a", "x", "t", 2), ("a", "y", "t", 3), ("a", "y", "u", 4)], kind))
    assert [tuple(r) for r in ingest.album_covers(covers, "a").collect()] == [("a", "y", "t", 3), ("a", "x", "s", 1)]
    albums = spark.createDataFrame([("local:a", None), ("import:b", None), ("local:c", "c"), ("d", None)], "album_id string, image_url string")
    assert sorted(r["album_id"] for r in ingest.missing_covers(albums).collect()) == ["import:b", "local:a"]
    found = spark.createDataFrame([("local:a", "u"), ("import:b", None), ("local:c", "u"), ("d", "u")], "album_id string, image_url string")
    assert {r["album_id"]: r["image_url"] for r in ingest.with_found_covers(albums, found).collect()} == {"local:a": "u", "import:b": "", "local:c": "c", "d": None}
    assert sorted(map(tuple, ingest.album_aliases(spark.createDataFrame([("import:b", "N"), ("1", "n"), ("local:c", "z")], "album_id string, name string")).collect())) == [("import:b", "1")]


def test_links_with_new_albums(spark):
    tracks = spark.createDataFrame([("t", "a"), ("u", None)], "track_id string, album_id string")
    source = spark.createDataFrame([("u", "b", "B"), ("w", "c", "C")], "track_id string, album_id string, album_name string")
    rows, albums = ingest.fix_links(tracks, source, spark.createDataFrame([("a", "A")], "album_id string, name string"))
    assert sorted(map(tuple, rows.collect())) == [("t", "a"), ("u", "b")] and sorted(map(tuple, albums.collect())) == [("a", "A"), ("b", "B")]


def test_aliases_and_links(spark):
    artists = spark.createDataFrame([("import:1", "abba", None, []), ("9", "ABBA", None, []), ("local:2", "other", "i", [])], "artist_id string, name string, image_url string, genres array<string>")
    credits = spark.createDataFrame([("t", "import:1", 0), ("t", "9", 1), ("u", "import:1", 0)], "track_id string, artist_id string, position int")
    left, merged = ingest.apply_artist_map(ingest.artist_aliases(artists), artists, credits)
    assert left.count() == 2 and sorted(map(tuple, merged.collect())) == [("t", "9", 0), ("u", "9", 0)]
    found = spark.createDataFrame([("9", "img", ["pop"])], "artist_id string, image_url string, genres array<string>")
    assert {r["artist_id"]: r["image_url"] for r in ingest.enrich_artists(artists, found).collect()} == {"import:1": None, "9": "img", "local:2": "i"}
    tracks = spark.createDataFrame([("t", "a"), ("u", None)], "track_id string, album_id string")
    fixed = ingest.fix_links(tracks, spark.createDataFrame([("u", "b")], "track_id string, album_id string"))
    assert sorted(map(tuple, fixed.collect())) == [("t", "a"), ("u", "b")]
    assert ingest.duplicate_keys(credits, ["artist_id"]).count() == 1


def test_settings(spark):
    old = spark.createDataFrame([(1, "sort", "time")], "user_id long, key string, value string")
    new = spark.createDataFrame([(1, "sort", "plays", 2), (1, "nonsense", "x", 1), (2, "week_start", "friday", 1)], "user_id long, key string, value string, seq int")
    assert sorted(map(tuple, ingest.put_settings(old, new).collect())) == [(1, "sort", "plays"), (2, "week_start", "friday")]
    assert [r["user_id"] for r in ingest.records_due(new).orderBy("user_id").collect()] == [1, 2]
    assert ingest.records_due(new.filter("key = 'nonsense'")).count() == 0


def test_sink_adds_nothing_twice(spark, tmp_path):
    """A batch that runs again, and late plays."""
    path, schema = str(tmp_path / "plays"), "user_id long, played_at timestamp, track_id string"
    sink = stream.append_new(path, schema)
    batch = spark.createDataFrame([(1, AT, "a"), (1, AT, "b"), (1, AT + timedelta(days=40), "c")], schema)
    for _ in range(2):
        sink(batch, 0)
    sink(spark.createDataFrame([(1, AT - timedelta(days=400), "z"), (1, AT + timedelta(days=40), "late")], schema), 1)
    rows = stream.read_plays(spark, path, schema)
    assert rows.count() == 3 and {r["track_id"] for r in rows.collect()} - {"a", "b"} == {"c", "z"}


@pytest.mark.parametrize("dies_at", ["plays", "partials"])
def test_a_killed_batch_adds_nothing_and_is_repeated_whole(spark, tmp_path, monkeypatch, dies_at):
    """The stream dies after a batch's files are written and before they count; started again, plays and partials are as without that."""
    from chronoplay.operators import partials
    from chronoplay.sources import committed

    rows = [(u, AT + timedelta(hours=7 * h), h % 3) for u in (1, 2) for h in range(24)]
    schema, where = "user_id long, played_at timestamp, track_id long", str(tmp_path)
    for k in range(4):  # each file has a part of the one before it again
        spark.createDataFrame(rows[max(0, 12 * k - 5) : 12 * k + 12], schema).coalesce(1).write.mode("append").parquet(f"{where}/feed")
    counts, commit = {"plays": 0, "partials": 0}, committed._commit

    def dying(session, path, first, last):
        kind = path.rsplit("/", 1)[-1]
        counts[kind] += 1
        if kind == dies_at and counts[kind] == 3:
            raise RuntimeError("killed")
        commit(session, path, first, last)

    def run():
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/feed")
        feed.writeStream.foreachBatch(stream.append_new(f"{where}/plays", schema, f"{where}/partials")).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(committed, "_commit", dying)
    with pytest.raises(Exception, match="killed"):
        run()
    seen = stream.read_plays(spark, f"{where}/plays", schema).count()
    assert 0 < seen < len(rows)
    run()
    got = sorted((r["user_id"], r["played_at"], r["track_id"]) for r in stream.read_plays(spark, f"{where}/plays", schema).collect())
    assert got == sorted(rows)
    kept = partials.partial_plays(spark, f"{where}/partials").groupBy("user_id", "track_id", "day").agg(F.sum("n_plays").alias("n"), F.min("first_played").alias("a"), F.max("last_played").alias("b"))
    want = partials.day_partials(spark.createDataFrame(rows, schema).withColumn("played_at", F.col("played_at").cast("timestamp_ntz"))).drop("play_month").select("user_id", "track_id", "day", "n_plays", "first_played", "last_played")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


@given(st.lists(st.tuples(st.sampled_from([None, "local:a", "local:b"]), st.integers(0, 5)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_play_steps_do_not_depend_on_batches(snaps):
    """local_loop: the machine gives the same plays however its input is cut."""
    rows = [(t, AT + timedelta(seconds=30 * i), p, 100) for i, (t, p) in enumerate(snaps)]
    whole, end = stream.play_steps(rows, None)
    parts, state = [], None
    for r in rows:
        done, state = stream.play_steps([r], state)
        parts += done
    assert parts == whole and state == end
    naive, now = [], None
    for t, at, p, d in rows:
        if now and (t != now[0] or p < now[2]):
            naive.append((now[0], now[1], 100))
            now = None
        if t:
            now = [t, at, p] if now is None else [t, now[1], p]
    assert naive == whole


def test_now_playing_hides_old_snapshots(spark):
    rows = spark.createDataFrame([(1, AT, "x"), (1, AT + timedelta(minutes=5), "y"), (2, AT, "z")], "user_id long, at timestamp, item_id string")
    assert [(r["user_id"], r["item_id"]) for r in stream.now_playing(rows, "2024-01-01 00:06:00").collect()] == [(1, "y")]


def test_windows_and_sessions(spark):
    rows = spark.createDataFrame([(1, AT + timedelta(minutes=m)) for m in (0, 10, 50, 200)], "user_id long, played_at timestamp")
    assert sorted(r["play_count"] for r in stream.windowed_counts(rows, "1 hour").collect()) == [1, 3]
    assert sorted(r["play_count"] for r in stream.sessions(rows, "30 minutes").collect()) == [1, 1, 2]


def test_exports_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, AT, 'a "quoted", name'), (1, AT + timedelta(days=1), None)], "user_id long, played_at timestamp, track_name string")
    files.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["track_name"] for r in back.collect()} == {'a "quoted", name', None}
    files.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    files.write_plays(rows, str(tmp_path / "plays"))
    assert (tmp_path / "plays" / "play_month=2024-01").exists()


def test_pages_and_stream_source(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"id": "a", "name": "x"}, {"id": "b", "name": "y"}]}))
    assert files.read_pages(spark, str(tmp_path), "id: string, name: string").count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text('{"user_id": 1, "at": "2024-01-01T00:00:00Z", "is_playing": true, "item_id": "local:a"}')
    query = files.read_stream(spark, str(tmp_path / "s"), files.SNAPSHOTS).writeStream.format("memory").queryName("snaps_test").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("snaps_test").count() == 1


@pytest.mark.parametrize("name", ["stream_dedupe_plays", "stream_local_plays"])
def test_stream_results_are_shared_files(spark, name):
    """The rows don't go through the driver's memory; they and the state lie where all executors see them."""
    from chronoplay.plans.catalog import QUERIES

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    files = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all(f.removeprefix("file://").startswith(f"{shared}/streams/") for f in files)


def test_snapshots_are_sorted_in_bounded_parts():
    rows = [(f"t{i}", (i * 7919) % 500, i, 0) for i in range(2000)] + [("last", None, 0, 0)]
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0))
    for held, runs in ((7, 3), (100, 64), (10_000, 64), (len(rows), 2)):
        assert list(stream.in_order(iter(rows), held, runs)) == want
    assert list(stream.in_order([])) == []
