"""Stored tables: partial counts, boards by settings, the search index; custom ranges; merge rules one by one."""

from __future__ import annotations

import os
import random
import re
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import MONDAY, library, week

from chronoplay.functions.text import folded
from chronoplay.operators import charts, ingest, partials, records, search, search_index, top
from chronoplay.sources import buckets, committed


def files(path):
    """Every data file below a folder, and when it was written."""
    found = {}
    for where, _, names in os.walk(path):
        found |= {os.path.join(where, n): os.stat(os.path.join(where, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def many_plays(n=400, users=3, tracks=6, days=90):
    rng = random.Random(4)
    return [(rng.randrange(users), MONDAY + timedelta(seconds=rng.randrange(days * 86400)), rng.randrange(tracks)) for _ in range(n)]


def test_partials_equal_a_recount_and_batches_touch_only_their_own(spark, tmp_path):
    """A1, A5: late and repeated batches, charts, rankings, histories and records from partials; files that are there stay as they are."""
    plays = many_plays()
    lib = library(spark, plays, {t: ("a" if t % 2 else "b", 1000 * (t + 1)) for t in range(6)}, [(t, t % 3, 0) for t in range(6)] + [(t, 4, 1) for t in range(3)], as_of=MONDAY + timedelta(days=80))
    path, sink, before = str(tmp_path / "partials"), partials.add_plays(str(tmp_path / "partials")), {}
    for number in range(4):
        sink(lib.plays.filter(F.col("play_id") % 4 == number), number)
        now = files(path)
        assert before.items() <= now.items() and all(f"batch={number}-{number}" in f for f in now.keys() - before.keys())
        before = now
        sink(lib.plays.filter(F.col("play_id") % 4 == number), number)  # again: nothing
        assert files(path) == before
    own = lib.but(plays=partials.partial_plays(spark, path))
    for plan in (
        lambda x: top.top_entities(x, "artist", "month", "plays"), lambda x: top.top_entities(x, "track", "all"), lambda x: top.entity_stats(x, "album"), lambda x: top.series(x, "week"),
        lambda x: top.rankings(x, "track"), lambda x: top.ranking_history(x, "artist"), lambda x: charts.chart_facts(x, "artist", week_start="friday"), lambda x: records.records(x, "album"), lambda x: top.genres(x),
    ):
        assert rows(plan(own)) == rows(plan(lib))
    with pytest.raises(ValueError, match="whole days"):
        top.genres(replace(own, as_of=lib.as_of + timedelta(hours=1)), "week")
    sink(spark.createDataFrame([(9, 0, datetime(2024, 5, 1, 3), 1)], lib.plays.schema), 4)
    assert {f.split("play_month=")[1][:7] for f in files(path).keys() - before.keys()} == {"2024-05"} and before.items() <= files(path).items()


def test_batches_are_merged_by_size(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "x long, p long"
    add = lambda k: committed.write_batch(spark.createDataFrame([(k, k % 2)], schema), path, k, ["p"])
    seen = lambda: sorted(r["x"] for r in committed.read_batches(spark, path, schema).collect())
    assert seen() == [] and committed.compact(spark, path, schema, ["p"], 3) is None
    for k in range(9):
        assert add(k) and not add(k)
        merged = committed.compact(spark, path, schema, ["p"], 3)
        assert seen() == list(range(k + 1)) and (merged is not None) == (k % 3 == 2)
        assert not add(k)  # counts, though its own marker may not
    assert committed.compact(spark, path, schema, ["p"], 3) == (0, 8) and committed.committed(spark, path) == [(0, 8)] and seen() == list(range(9))
    pruned = committed.read_batches(spark, path, schema).filter("p = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in pruned


def test_boards_by_each_users_settings(spark, tmp_path):
    """T7, #47: two users with equal plays and other settings get other boards; a refresh rewrites the stale users' buckets only."""
    plays = [(u, at, t) for u in range(1, 9) for _, at, t in [*week(0, {1: 5, 2: 1}), *week(1, {2: 9}), (1, MONDAY + timedelta(days=4, hours=1), 3)]]
    lib = library(spark, plays, {1: ("a", 1000), 2: ("b", 3000), 3: ("a", 90_000)}, as_of=MONDAY + timedelta(weeks=3))
    settings = spark.createDataFrame([(1, "sort", "plays"), (1, "week_start", "monday"), (2, "sort", "time"), (2, "week_start", "friday"), (3, "week_start", "never"), (4, "language", "en")], "user_id long, key string, value string")
    path = str(tmp_path / "records")
    records.store_records(lib, settings, path, buckets=16, limit=5)

    def boards(user):
        return sorted(tuple(r)[1:] for r in records.stored_records(spark, path).filter(F.col("user_id") == user).collect() if r["board"] != "inMostPlaylists")

    def alone(user, week_start, sort):
        mine = lib.but(plays=lib.plays.filter(F.col("user_id") == user))
        return sorted((e, r["board"], r["position"], str(r["entity_id"]), r["value"], r["week"]) for e in ("track", "album", "artist") for r in records.records(mine, e, week_start, sort, 5).collect() if r["board"] != "inMostPlaylists")

    key = lambda x: [tuple(map(str, r)) for r in x]
    assert key(boards(1)) == key(alone(1, "monday", "plays")) and key(boards(2)) == key(alone(2, "friday", "time")) and boards(1) != boards(2)
    assert boards(2) == boards(3) == boards(4) == boards(8)  # defaults
    before = files(path)
    new = spark.createDataFrame([(3, "week_start", "monday", 1), (4, "language", "de", 1)], "user_id long, key string, value string, seq int")
    assert records.refresh_records(lib, ingest.put_settings(settings, new), path, ingest.records_due(new), buckets=16, limit=5)
    assert key(boards(3)) == key(alone(3, "monday", "time")) and boards(2) == boards(4) == boards(8) and key(boards(1)) == key(alone(1, "monday", "plays"))
    bucket = lib.spark.range(1).select(F.pmod(F.xxhash64(F.lit(3).cast("long")), F.lit(16))).first()[0]
    changed = {f for f in before.keys() | files(path).keys() if before.get(f) != files(path).get(f)}
    assert changed and all(f"bucket={bucket}/" in f for f in changed)
    assert not records.refresh_records(lib, settings, path, new.filter("user_id = 99").select("user_id"), buckets=16)
    gone = lib.but(plays=lib.plays.filter("user_id <> 3"))
    assert records.refresh_records(gone, settings, path, new.filter("user_id = 3").select("user_id"), buckets=16, limit=5) and boards(3) == [] and boards(2) == boards(8)


NAMES = ["Beyoncé", "ÉTIENNE", "100%", "a_b", "ab", "日本の歌", "xx", "abcabc", "", "back\\slash", "The Long Road", "the  long road", "Ångström", "😀 smile", "o", None]


def test_search_index_equals_a_scan(spark, tmp_path):
    """F9, #28: wildcards, short terms, accents, characters beyond ASCII, terms without literals."""
    rng = random.Random(8)
    names = NAMES + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(names)), "artist_id long, name string").repartition(3)
    search_index.build_index(frame, "artist_id", str(tmp_path), folders=8)
    like = lambda t: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in f"%{folded(t)}%"), re.S)
    for term in ["be", "BEYONCÉ", "é", "a", "ab", "abc", "b_c", "%%", "__", "0%", "a%b%c", "本の", "😀", "\\", "k\\s", "the  l", "zzz", "a b", "_ab_", "e" + "́"]:
        got = sorted(r["key"] for r in search_index.matching(spark, str(tmp_path), term, folders=8).collect())
        assert got == sorted(i for i, n in enumerate(names) if n is not None and like(term).fullmatch(folded(n))), term


def test_search_index_reads_only_folders_it_needs(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"name {i:05d}") for i in range(2000)], "artist_id long, name string")
    search_index.build_index(frame, "artist_id", str(tmp_path), folders=32)
    found = search_index.matching(spark, str(tmp_path), "e 01999", folders=32)
    assert [r["key"] for r in found.collect()] == [1999]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*folder#\d+ = \d+", plan)  # one folder of the names, the candidate's


@pytest.mark.parametrize("entity", ["track", "artist"])
def test_custom_ranges_and_the_range_before(spark, entity):
    """#2, #3, #51: closed at both ends; the range before is as long, to the millisecond, and half open."""
    first, last = date(2024, 1, 15), date(2024, 1, 17)
    start = datetime(2024, 1, 15)
    at = [start - timedelta(days=3), start - timedelta(days=3) + timedelta(milliseconds=1), start - timedelta(milliseconds=1), start, datetime(2024, 1, 17, 23, 59, 59, 999000), datetime(2024, 1, 18)]
    lib = library(spark, [(1, t, k) for k, t in enumerate(at)], credits=[(k, k, 0) for k in range(6)])
    got = {r["entity_id"]: (r["rank"], r["previous_rank"], r["is_new"]) for r in top.top_entities(lib, entity, start=first, end=last).collect()}
    assert got == {3: (1, None, True), 4: (2, None, True)}
    before = {r["entity_id"]: r["previous_rank"] for r in top.top_entities(library(spark, [(1, at[1], 7), (1, at[2], 7), (1, at[0], 7), (1, start, 7)]), "track", start=first, end=last).collect()}
    assert before == {7: 1}
    series = {r["period"] for r in top.entity_series(lib, entity, start=first, end=last).collect()}
    assert series == {"2024-01-15", "2024-01-17"} and {r["period"] for r in top.entity_series(lib, entity, start=first, end=first).collect()} == {"2024-01"}
    assert top.genres(lib, start=first, end=last).first()["play_count"] == 2


def test_top_lists_read_the_plays_once(spark, tmp_path):
    plays = many_plays()
    library(spark, plays).plays.write.parquet(str(tmp_path / "plays"))
    lib = library(spark, plays).but(plays=spark.read.parquet(str(tmp_path / "plays")))
    plan = top.top_entities(lib, "track", "month")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def brute_rules(rules, new, albums):
    """What adding rules one by one to a table gives."""
    have = list(rules)
    for user, a, b, _ in sorted(new, key=lambda r: (r[3], r[1], r[2])):
        mine = [(s, t) for u, s, t in have if u == user]
        if a != b and a in albums and b in albums and all(a not in (s, t) and b != s for s, t in mine):
            have.append((user, a, b))
    return sorted(have)


def test_merge_rules_are_taken_one_by_one(spark):
    """A reverse rule, a chain and a fork in one batch; and random batches against adding them singly."""
    keys = "user_id long, source_id string, target_id string"
    albums = spark.createDataFrame([(x,) for x in "abcdefgh"], "album_id string")
    batch = [(1, "a", "b", 1), (1, "b", "a", 2), (1, "b", "c", 3), (1, "a", "d", 4)]
    added, problems = search.add_merge_rules(spark.createDataFrame([], keys), spark.createDataFrame(batch, f"{keys}, seq int"), albums)
    assert rows(added) == [(1, "a", "b")]
    assert {(r["source_id"], r["target_id"], r["problem"]) for r in problems.collect()} == {("b", "a", "reverse"), ("b", "a", "chain"), ("b", "c", "chain"), ("a", "d", "two_targets")}
    rng = random.Random(6)
    rules = [(u, "a", "b") for u in range(2)]
    new = [(rng.randrange(6), rng.choice("abcdefghx"), rng.choice("abcdefghx"), rng.randrange(40)) for _ in range(200)]
    added, problems = search.add_merge_rules(spark.createDataFrame(rules, keys), spark.createDataFrame(new, f"{keys}, seq int"), albums)
    assert rows(added) == brute_rules(rules, new, set("abcdefgh"))
    assert search.merge_problems(added).count() == 0 and problems.count() > 0


def test_changes_of_rank_are_few_and_expand_to_the_histories(spark):
    """Gaps, re-entries, drops at the end, periods without charts; parts of the time; storage follows changes."""
    lib = library(spark, [*week(0, {1: 3, 2: 1}), *week(1, {1: 3, 2: 1}), *week(2, {2: 2}), *week(4, {1: 1, 3: 2}), *week(5, {3: 2, 1: 1}), *week(6, {3: 2, 1: 1}), *week(3, {7: 1}, user=2)])
    facts, periods = charts.chart_facts(lib, "track", sort="plays").select("user_id", "period", "entity_id", "rank"), charts.available_periods(lib)
    changes = charts.run_length(facts, periods, ["rank"]).persist()
    whole = charts.chart_history(lib, "track", sort="plays")
    pick = lambda df: rows(df.select("user_id", "entity_id", "period", "rank"))
    assert pick(charts.expanded(changes, periods)) == pick(whole)
    assert [tuple(r) for r in changes.filter("entity_id = 1").select("since", "rank").orderBy("since").collect()] == [("2024-W02", 1), ("2024-W04", None), ("2024-W06", 2)]
    for start, end in [("2024-W03", "2024-W06"), (None, "2024-W04"), ("2024-W07", None), ("2024-W05", "2024-W05")]:
        inside = whole.filter(F.lit(True) if start is None else F.col("period") >= start).filter(F.lit(True) if end is None else F.col("period") <= end)
        assert pick(charts.expanded(changes, periods, start, end)) == pick(inside)
    steady = library(spark, [x for n in range(40) for x in week(n, {1: 3, 2: 2, 3: 1})])
    few = charts.run_length(charts.chart_facts(steady, "track", sort="plays"), charts.available_periods(steady), ["rank"])
    assert few.count() == 3 and charts.chart_history(steady, "track", sort="plays").count() == 120
    months = charts.available_periods(lib, "month")
    ranked = top.ranking_history(lib, "track")
    again = charts.expanded(charts.run_length(ranked, months, ["total", "rank"]), months)
    assert rows(again.select(*ranked.columns)) == rows(ranked)


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    """Newest by seq, insert-only columns; files of other buckets keep their times; bytes follow the change."""
    path, schema = str(tmp_path / "t"), "id long, name string, first string"
    table = spark.createDataFrame([(i, f"n{i}", f"f{i}") for i in range(400)], schema)
    buckets.write_buckets(table, path, ["id"], 32)
    before = files(path)
    new = spark.createDataFrame([(7, "old", "x", 1), (7, "new", "y", 2), (1000, "z", "w", 1)], f"{schema}, seq int")
    touched = ingest.upsert_stored(spark, path, schema, "id", new, overwrite=["name"], buckets=32)
    changed = {f for f in before.keys() | files(path).keys() if before.get(f) != files(path).get(f)}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in changed} == set(touched) and len(touched) <= 2
    want = rows(ingest.upsert(table, new, "id", "seq", overwrite=["name"]))
    assert rows(buckets.read_buckets(spark, path, schema)) == want and (7, "new", "f7") in want and (1000, "z", "w") in want
    now = files(path)
    assert sum(os.path.getsize(f) for f in changed & now.keys()) < sum(map(os.path.getsize, now)) / 8
    assert ingest.insert_stored(spark, path, schema, "id", spark.createDataFrame([(7, "no", "no"), (8, "no", "no")], schema), ["name"], 32) == [] and files(path) == now
    assert len(ingest.insert_stored(spark, path, schema, "id", spark.createDataFrame([(2000, "b", "b"), (2000, "a", "a"), (8, "no", "no")], schema), ["name"], 32)) == 1
    assert rows(buckets.read_buckets(spark, path, schema)) == sorted([*want, (2000, "a", "a")], key=repr)


def test_boards_by_settings_take_little_disk(spark, monkeypatch):
    """shuffles of a step are gone before the next one, plays are shuffled few times, and no files of columns are left."""
    from chronoplay.plans.catalog import QUERIES
    from chronoplay.session import checkpoint_dir, release

    env, store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get(), spark.sparkContext._jsc.sc().statusStore()
    shuffles = lambda: env.mapOutputTracker().shuffleStatuses().size()
    doubles, none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList()
    written = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: map(x.apply, range(x.size())))(store.stageList(None, False, False, doubles, none))}
    release(spark)
    alive, start, found = [], max(written(), default=-1), records.in_most_playlists
    before = shuffles()
    monkeypatch.setattr(records, "in_most_playlists", lambda *a: alive.append(shuffles() - before) or found(*a))
    assert QUERIES["records_by_settings"](spark, "/root/testdata/sf0.001").count() > 0
    rows = sum(n for stage, n in written().items() if stage > start)
    plays = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(alive) == 6 and max(alive) <= 8 and rows <= 25 * plays  # before: 55 and 40
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    names = [f.getPath().getName() for f in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    assert not [n for n in names if n.startswith("scratch")]
