"""Operators on small hand-made libraries, against naive Python and pinned cases."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoplay.operators import charts, facts, history, islands, playlists, records, search, top
from chronoplay.sources.library import Library

MONDAY = datetime(2024, 1, 8)


def library(spark, plays, tracks=None, credits=None, rules=(), as_of=datetime(2024, 3, 1), albums=None, artists=None):
    """A library from (user, time, track) plays; tracks are one second long unless given."""
    tracks = tracks or {t: ("a", 1000) for _, _, t in plays} or {0: ("a", 1000)}
    credits = credits or [(t, 1, 0) for t in tracks]
    rows = [(i, u, at, t) for i, (u, at, t) in enumerate(plays)]
    names = albums or sorted({a for a, _ in tracks.values() if a})
    return Library(
        spark.createDataFrame(rows, "play_id long, user_id long, played_at timestamp_ntz, track_id long"),
        spark.createDataFrame([(t, f"track {t}", a, d, 10) for t, (a, d) in tracks.items()], "track_id long, name string, album_id string, duration_ms long, popularity int"),
        spark.createDataFrame([(a, f"Álbum {a}") for a in names], "album_id string, name string"),
        spark.createDataFrame(artists or [(a, f"artist {a}", ["g"]) for a in sorted({a for _, a, _ in credits})], "artist_id long, name string, genres array<string>"),
        spark.createDataFrame(credits, "track_id long, artist_id long, position int"),
        spark.createDataFrame([(1, 1, "p")], "playlist_id long, user_id long, name string"),
        spark.createDataFrame([(1, t, i) for i, t in enumerate(tracks)], "playlist_id long, track_id long, position int"),
        spark.createDataFrame(list(rules), "user_id long, source_id string, target_id string"),
        as_of,
    )


def week(n: int, tracks: dict[int, int], user: int = 1):
    return [(user, MONDAY + timedelta(weeks=n, minutes=60 * i + t), t) for t, k in tracks.items() for i in range(k)]


def test_ties_go_to_the_smaller_id(spark):
    lib = library(spark, [(1, MONDAY, 7), (1, MONDAY + timedelta(hours=1), 3)])
    assert [(r["entity_id"], r["rank"]) for r in top.top_entities(lib, "track", "all").orderBy("rank").collect()] == [(3, 1), (7, 2)]


def test_windows_are_closed_or_half_open(spark):
    at = [MONDAY - timedelta(milliseconds=1), MONDAY, MONDAY + timedelta(days=1) - timedelta(milliseconds=1), MONDAY + timedelta(days=1)]
    plays = library(spark, [(1, a, 1) for a in at]).plays
    assert facts.in_window(plays, MONDAY, MONDAY + timedelta(days=1)).count() == 3
    assert facts.in_window(plays, MONDAY, MONDAY + timedelta(days=1), half_open=True).count() == 2


def test_rank_change_and_new(spark):
    lib = library(spark, [*week(0, {1: 3, 2: 1}), *week(1, {2: 2, 3: 1, 1: 1})], as_of=MONDAY + timedelta(weeks=2))
    got = {r["entity_id"]: (r["rank"], r["previous_rank"], r["rank_change"], r["is_new"]) for r in top.top_entities(lib, "track", "week").collect()}
    assert got == {2: (1, 2, 1, False), 1: (2, 1, -1, False), 3: (3, None, None, True)}


def test_merge_rules_are_the_users_own_and_null_albums_drop(spark):
    plays = [(u, MONDAY + timedelta(hours=h), t) for u in (1, 2) for h, t in enumerate((1, 2, 3))]
    lib = library(spark, plays, {1: ("a", 1), 2: ("b", 1), 3: (None, 1)}, rules=[(1, "a", "b")])
    got = {(r["user_id"], r["entity_id"]): r["play_count"] for r in facts.play_counts(lib, "album").collect()}
    assert got == {(1, "b"): 2, (2, "a"): 1, (2, "b"): 1}


def test_artist_totals_fan_out(spark):
    lib = library(spark, [(1, MONDAY, 1)], credits=[(1, 1, 0), (1, 2, 1)])
    assert facts.play_counts(lib, "artist").agg(F.sum("play_count")).first()[0] == 2
    assert top.total_stats(lib).first()["play_count"] == 1


def test_empty_total_is_one_row(spark):
    assert top.total_stats(library(spark, [])).first().asDict() == {"play_count": 0, "total_ms": 0, "first_played": None, "last_played": None}


def test_chart_reentry_gap_and_dropout(spark):
    """chart_reentry, gap_weeks: 1 leaves and comes back; a week without plays ends no run."""
    lib = library(spark, [*week(0, {1: 2, 2: 1}), *week(1, {2: 1}), *week(3, {1: 1, 2: 3})])
    facts_ = charts.chart_facts(lib, "track")
    rows = {(r["period"], r["entity_id"]): r for r in charts.charts(facts_).collect()}
    w = ["2024-W02", "2024-W03", "2024-W05"]
    assert sorted({k[0] for k in rows}) == w
    back = rows[w[2], 1]
    assert (back["is_reentry"], back["is_new"], back["weeks_on_chart"], back["consecutive"], back["peak_rank"], back["peak_period"]) == (True, False, 2, 1, 1, w[0])
    assert rows[w[2], 2]["consecutive"] == 3 and rows[w[1], 2]["rank_change"] == 1 and rows[w[0], 1]["is_new"]
    assert rows[w[2], 2]["peak_periods"] == [w[1], w[2]] and rows[w[2], 2]["times_at_peak"] == 2
    out = [(r["period"], r["entity_id"], r["previous_rank"], r["weeks_on_chart"]) for r in charts.dropouts(facts_).collect()]
    assert out == [(w[1], 1, 1, 1)]
    hist = [(r["period"], r["rank"]) for r in charts.chart_history(lib, "track").filter("entity_id = 1").orderBy("period").collect()]
    assert hist == [(w[0], 1), (w[1], None), (w[2], 2)]
    entries, gone = charts.chart(lib, "track", w[1])
    assert [r["entity_id"] for r in entries.collect()] == [2] and [r["entity_id"] for r in gone.collect()] == [1]


def test_records(spark):
    """active_run, peak week on ties, debut."""
    lib = library(spark, [*week(0, {1: 2, 2: 1}), *week(1, {1: 2, 2: 3}), *week(2, {2: 3})])
    weekly = records.weekly_ranks(lib, "track", sort="plays")
    runs = {r["entity_id"]: (r["value"], r["week"]) for r in records.longest_run(weekly).collect()}
    assert runs == {2: (3, "active"), 1: (2, None)}
    assert {r["entity_id"]: (r["value"], r["week"]) for r in records.peak_week(weekly).collect()} == {1: (2, "2024-W03"), 2: (3, "2024-W04")}
    assert {r["entity_id"]: r["value"] for r in records.biggest_debut(weekly).collect()} == {1: 2, 2: 1}
    assert {r["entity_id"]: r["value"] for r in records.weeks_at(weekly, "no1", 1).collect()} == {1: 1, 2: 2}
    boards = records.accolades(lib, "track", sort="plays")
    assert {r["board"] for r in boards.collect()} == {"peakWeek", "biggestDebut", "weeksAtNo1", "weeksInChart", "longestRun"}


@pytest.mark.parametrize(("days", "longest", "current"), [((-1, 0), 2, 2), ((-2, -1), 2, 2), ((-9, -8, -7, -2), 3, 0), ((0,), 1, 1)])
def test_streaks(spark, days, longest, current):
    now = datetime(2024, 3, 1, 5)
    row = islands.streaks(library(spark, [(1, now + timedelta(days=d), 1) for d in days], as_of=now)).first()
    assert (row["longest"], row["current"]) == (longest, current)


def test_cumulative_rank(spark):
    plays = [(1, datetime(2024, 1, 2, h), 1) for h in range(2)] + [(1, datetime(2024, 2, 2, h), 2) for h in range(3)] + [(1, datetime(2024, 3, 2), 3)]
    got = {(r["period"], r["entity_id"]): r["rank"] for r in top.ranking_history(library(spark, plays), "track", "plays").collect()}
    assert got == {("2024-01", 1): 1, ("2024-02", 1): 2, ("2024-02", 2): 1, ("2024-03", 1): 2, ("2024-03", 2): 1, ("2024-03", 3): 3}


def test_genres_null_empty_and_double(spark):
    artists = [(1, "x", ["rock", "rock"]), (2, "y", []), (3, "z", None)]
    lib = library(spark, [(1, MONDAY, 1)], credits=[(1, 1, 0), (1, 2, 1), (1, 3, 2)], artists=artists)
    assert [(r["genre"], r["play_count"]) for r in top.genres(lib).collect()] == [("rock", 2)]


def test_search_folds_accents(spark):
    lib = search.with_folded_names(library(spark, [(1, MONDAY, 1)], artists=[(1, "Beyoncé", []), (2, "ÉTIENNE", []), (3, "100%", [])], credits=[(1, 1, 0)]))
    found = lambda t: [r["artist_id"] for r in search.search_artists(lib, 1, t).orderBy("rank").collect()]
    assert found("beyonce") == [1] and found("etienne") == [2] and found("0%") == [3] and set(found("%e%")) == {1, 2}
    assert found("BEYONCÉ") == found("Beyonce\u0301") == [1] and found("étienne") == [2]
    assert found("a\\b") == [] and found("\\%") == []
    with pytest.raises(ValueError):
        search.check_term("x")


def test_merge_problems(spark):
    rules = spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], "user_id long, source_id string, target_id string")
    new = spark.createDataFrame([(1, "x", "x"), (1, "a", "b"), (1, "b", "a"), (1, "b", "z"), (1, "y", "a"), (1, "a", "q"), (2, "b", "a"), (1, "n", "m")], rules.schema)
    got = defaultdict(set)
    for r in search.merge_problems(rules, new).collect():
        got[r["user_id"], r["source_id"], r["target_id"]].add(r["problem"])
    assert got[1, "x", "x"] >= {"self"} and "duplicate" in got[1, "a", "b"] and "reverse" in got[1, "b", "a"]
    assert "chain" in got[1, "b", "z"] and "chain" in got[1, "y", "a"] and "two_targets" in got[1, "a", "q"]
    assert (2, "b", "a") not in got and (1, "n", "m") not in got


def test_merge_rules_are_added_and_deleted(spark):
    keys = "user_id long, source_id string, target_id string"
    rules = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], keys)
    albums = spark.createDataFrame([(x,) for x in "abcdexy"], "album_id string")
    new = [(1, "x", "y"), (1, "x", "x"), (1, "b", "a"), (1, "a", "b"), (1, "a", "e"), (1, "b", "e"), (1, "e", "a"), (1, "c", "b"), (1, "q", "b"), (2, "a", "q"), (2, "a", "b"), (1, "x", "y")]
    added, problems = search.add_merge_rules(rules, spark.createDataFrame([(*r, i) for i, r in enumerate(new)], f"{keys}, seq int"), albums)
    assert sorted(map(tuple, added.collect())) == [(1, "a", "b"), (1, "c", "b"), (1, "x", "y"), (2, "a", "b"), (2, "c", "d")]
    got = {(r["user_id"], r["source_id"], r["target_id"], r["problem"]) for r in problems.collect()}
    assert {(1, "x", "x", "self"), (1, "b", "a", "reverse"), (1, "a", "b", "duplicate"), (1, "a", "e", "two_targets"), (1, "b", "e", "chain"), (1, "e", "a", "chain"), (1, "q", "b", "unknown_source"), (2, "a", "q", "unknown_target")} <= got
    assert search.delete_merge_rules(added, rules.filter("user_id = 1")).count() == 4 and search.delete_merge_rules(rules, spark.createDataFrame([(2, "a", "b")], keys)).count() == 2


def test_history_pages_and_deletion(spark):
    lib = library(spark, [(1, MONDAY + timedelta(hours=h), h % 3) for h in range(10)])
    rows = history.history_filter(lib, 1)
    second = [r["play_id"] for r in history.history_page(rows, 2, 4).collect()]
    keyset = [r["play_id"] for r in history.history_page(rows, size=4, after=(MONDAY + timedelta(hours=6), 6)).collect()]
    assert second == keyset == [5, 4, 3, 2]
    assert {r["has_more"] for r in history.history_page(rows, 2, 4).collect()} == {True} and {r["has_more"] for r in history.history_page(rows, 2, 5).collect()} == {False}
    same = library(spark, [(u, MONDAY, 0) for u in range(9)]).plays  # pages end between plays of one instant
    seen, after = [], None
    while got := history.history_page(same, size=2, after=after).collect():
        seen += [r["play_id"] for r in got]
        after = (got[-1]["played_at"], got[-1]["play_id"])
    assert seen == list(range(9))
    assert history.delete_plays(lib, 2, [1]).count() == 10 and history.delete_plays(lib, 1, [1, 2, 99]).count() == 8
    with pytest.raises(ValueError):
        history.delete_plays(lib, 1, [])


def test_playlists(spark):
    lib = library(spark, [(1, MONDAY + timedelta(hours=h), h % 4) for h in range(12)], as_of=MONDAY + timedelta(days=1))
    made = playlists.generate(lib, "top_range", 2, preset="week")
    assert made.count() == 2 and sorted(made.collect()) == sorted(playlists.generate(lib, "top_range", 2, preset="week").collect())
    row = playlists.coverage(playlists.track_stats(lib)).first()
    assert (row["tracks_played"], row["total_tracks"], row["percent"], row["total_plays"]) == (4, 4, 100, 12)
    lists = spark.createDataFrame([], "playlist_id long, user_id long, name string, strategy string, params map<string,string>")
    members = spark.createDataFrame([], "playlist_id long, position long, track_id long")
    for _ in range(2):  # running it again replaces it
        lists, members = playlists.save_generated(lists, members, 9, 1, "top_range", made, preset="week")
    assert lists.count() == 1 and members.count() == 2 and lists.first()["name"] == "Top range: week"
    assert playlists.delete_generated(lists, members, 9)[1].count() == 0


def test_playlist_sync(spark):
    head, body = "user_id long, playlist_id long, snapshot_id string, name string", "user_id long, playlist_id long, track_id long"
    stored = spark.createDataFrame([(1, 1, "s1", "a"), (1, 2, "s1", "b"), (1, 3, "s1", "c"), (2, 9, "s", "z")], head)
    tracks = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, 30), (2, 9, 90)], body)
    feed = spark.createDataFrame([(1, 1, "s1", "a2"), (1, 2, "s2", "b"), (1, 4, "s", "empty")], head)
    new = spark.createDataFrame([(1, 1, 11), (1, 2, 21), (1, 2, 21), (1, 2, None)], body)
    lists, members = playlists.sync_playlists(stored, tracks, feed, new)
    assert sorted((r["playlist_id"], r["name"]) for r in lists.collect()) == [(1, "a2"), (2, "b"), (9, "z")]
    assert sorted((r["playlist_id"], r["track_id"]) for r in members.collect()) == [(1, 10), (2, 21), (9, 90)]


def test_now_playing_query_has_every_user(spark):
    """users whose last snapshot is old are in the result too, marked as not shown."""
    from chronoplay.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["now_playing"](spark, sf)
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    assert rows.count() == users.count() and {r[0] for r in rows.select("shown").distinct().collect()} == {True, False}


def test_synced_playlists_have_their_sums(spark):
    """beside its tracks, each playlist's count and sum of ids are there."""
    from chronoplay.plans.catalog import QUERIES

    rows = QUERIES["playlists_synced"](spark, "/root/testdata/sf0.001").collect()
    tracks = {}
    for r in rows:
        tracks.setdefault(r["playlist_id"], []).append(r["track_id"])
    assert rows and all((r["tracks"], r["ids"]) == (len(tracks[r["playlist_id"]]), sum(tracks[r["playlist_id"]])) for r in rows)


def test_tasks_follow_the_tables(spark, monkeypatch):
    """long frames are dealt over tasks by their number of rows, not by bytes as compressed for the shuffle."""
    from chronoplay.operators.facts import period_plays
    from chronoplay.sources import library

    lib = library.star_library(spark, "/root/testdata/sf0.001")
    rows = lib.sized.count()
    monkeypatch.setattr(library, "TASK_ROWS", 100)
    lib = library.star_library(spark, "/root/testdata/sf0.001")
    assert lib.tasks == -(-rows // 100) > spark.sparkContext.defaultParallelism
    for frame in (period_plays(lib), lib.track_artists, lib.playlist_tracks):
        assert frame.rdd.getNumPartitions() == lib.tasks


@pytest.mark.parametrize("name", ["rec_peak_week", "rec_weeks_in_chart"])
def test_weekly_boards_are_dealt_by_rows(spark, name):
    """Whatever carries plays or credits goes by their number; only what a ranking has cut to its first rows goes by bytes."""
    from chronoplay.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = plan.split("Exchange hashpartitioning")[1:]  # each with what lies between it and the one before
    by_bytes = [s for s in shuffles if "REPARTITION_BY_NUM" not in s.splitlines()[0]]
    assert len(shuffles) > len(by_bytes) > 0 and all("WindowGroupLimit" in s for s in by_bytes)


def test_plays_find_their_users_by_rows(spark):
    """Customers that are too many for a broadcast meet orders, not items, and nothing goes by bytes for it."""
    from chronoplay.sources.library import star_library

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1500")  # nations, not customers
        plan = star_library(spark, "/root/testdata/sf0.001").plays._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [o_custkey" in plan and "BroadcastHashJoin [c_nationkey" in plan
    assert "ENSURE_REQUIREMENTS" not in plan
    assert "l_orderkey" not in plan[plan.index("SortMergeJoin [o_custkey") :]


def test_few_users_periods_are_broadcast(spark, monkeypatch, tmp_path):
    """a history stored as changes is computed once, and is expanded where its rows lie, not by user, of whom a task would get all."""
    from chronoplay.operators import charts

    rows = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 1), (1, "d", 7, 2), (2, "a", 7, 5), (2, "b", 8, 5)], "user_id long, period string, entity_id long, rank long")
    rows.write.parquet(f"{tmp_path}/rows")
    periods = spark.createDataFrame([(1, p) for p in "abcd"] + [(2, p) for p in "abc"], "user_id long, period string")
    changes = charts.run_length(spark.read.parquet(f"{tmp_path}/rows"), periods, ["rank"])
    assert sorted(map(tuple, changes.collect()), key=str) == sorted([(1, 7, "a", 1), (1, 7, "c", None), (1, 7, "d", 2), (2, 7, "a", 5), (2, 7, "b", None), (2, 8, "b", 5), (2, 8, "c", None)], key=str)
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    changes.write.parquet(f"{tmp_path}/changes")
    want = [(1, 7, 1, "a"), (1, 7, 1, "b"), (1, 7, None, "c"), (1, 7, 2, "d"), (2, 7, 5, "a"), (2, 7, None, "b"), (2, 7, None, "c"), (2, 8, 5, "b"), (2, 8, None, "c")]
    for most in (charts.BROADCAST_ROWS, 0):
        monkeypatch.setattr(charts, "BROADCAST_ROWS", most)
        whole = charts.expanded(spark.read.parquet(f"{tmp_path}/changes"), periods)
        assert sorted(map(tuple, whole.collect()), key=str) == sorted(want, key=str)
        assert ("ResolvedHint (strategy=broadcast)" in whole._jdf.queryExecution().analyzed().toString()) == (most > 0)


def test_own_settings_are_broadcast(spark):
    """few users' settings don't deal the plays by user, of whom a task would get all."""
    from chronoplay.operators import records
    from chronoplay.plans.catalog import _own_settings
    from chronoplay.sources.library import star_library

    lib = star_library(spark, "/root/testdata/sf0.001")
    weeks = records.weekly_plays_by_settings(lib, _own_settings(lib))
    plan = weeks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" not in plan
