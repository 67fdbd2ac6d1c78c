"""Search without accents, merge rules, and suggestions for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains, fold, is_real
from ..session import materialised
from ..sources.library import Library
from .facts import play_counts
from .search_index import build_index, look_up, matching

LEAST_TERM = 2


def with_folded_names(lib: Library) -> Library:
    """The library with ``name_folded`` in its dimensions. Store these: searches are then native."""
    folded = {k: getattr(lib, k).withColumn("name_folded", fold("name")) for k in ("tracks", "albums", "artists")}
    return lib.but(**folded)


#: Dimensions that are searched, and their keys.
SEARCHED = {"artists": "artist_id", "albums": "album_id", "tracks": "track_id"}


def index_names(lib: Library, path: str) -> None:
    """Write a search index (``search_index``) of each dimension; with it searches don't scan them."""
    for kind, key in SEARCHED.items():
        build_index(getattr(lib, kind), key, f"{path}/{kind}")


def _hits(lib: Library, kind: str, term: str, index: str | None) -> DataFrame:
    """(key, name) of a dimension's real rows whose folded name holds the term: by the index at that path, else by ``name_folded``."""
    key = SEARCHED[kind]
    if index is None:
        rows = getattr(lib, kind).filter(contains(F.col("name_folded"), check_term(term))).select(key, "name")
    else:
        rows = matching(lib.spark, f"{index}/{kind}", check_term(term)).withColumnRenamed("key", key)
    return rows.filter(is_real(F.col(key)))


def _listed(rows: DataFrame, counts: DataFrame, key: str, limit: int) -> DataFrame:
    """The first matches for a user by plays, unplayed ones too: a top-k of each task, and of what those leave."""
    found = rows.join(counts, key, "left").withColumn("play_count", F.coalesce("play_count", F.lit(0)))
    order = [F.col("play_count").desc(), F.col(key)]
    top = found.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over at most ``limit`` rows


def check_term(term: str) -> str:
    """The term, if it is long enough; ``contains`` folds it as names are folded."""
    if len(term) < LEAST_TERM:
        raise ValueError("a search needs two characters")
    return term


def search_artists(lib: Library, user_id: int, term: str, limit: int = 20, index: str | None = None) -> DataFrame:
    hits = _hits(lib, "artists", term, index)
    counts = lib.plays.filter(F.col("user_id") == user_id).groupBy("track_id").agg(F.count("*").alias("_n"))
    counts = counts.join(lib.track_artists.join(hits, "artist_id", "left_semi"), "track_id").groupBy("artist_id").agg(F.sum("_n").alias("play_count"))
    return _listed(hits, counts, "artist_id", limit)


def search_albums(lib: Library, user_id: int, term: str, limit: int = 20, index: str | None = None) -> DataFrame:
    """Albums with the plays of those merged into them; the user's merged albums are hidden."""
    merged = lib.merge_rules.filter(F.col("user_id") == user_id).select(F.col("source_id").alias("album_id"))
    hits = _hits(lib, "albums", term, index).join(merged, "album_id", "left_anti")
    counts = play_counts(lib, "album", plays=lib.plays.filter(F.col("user_id") == user_id)).select(F.col("entity_id").alias("album_id"), "play_count")
    return _listed(hits, counts, "album_id", limit)


def search_tracks(lib: Library, user_id: int, term: str, limit: int = 20, index: str | None = None) -> DataFrame:
    """Tracks whose own name or first artist's name matches."""
    counts = lib.plays.filter(F.col("user_id") == user_id).groupBy("track_id").agg(F.count("*").alias("play_count"))
    if index is None:
        artists = lib.artists.select("artist_id", F.col("name").alias("artist_name"), F.col("name_folded").alias("_artist"))
        tracks = lib.tracks.select("track_id", "name", "name_folded").join(lib.primary_artists, "track_id", "left").join(artists, "artist_id", "left")
        hits = tracks.filter(is_real(F.col("track_id")) & (contains(F.col("name_folded"), check_term(term)) | F.coalesce(contains(F.col("_artist"), term), F.lit(False))))
        return _listed(hits.select("track_id", "name", "artist_name"), counts, "track_id", limit)
    own = matching(lib.spark, f"{index}/tracks", check_term(term)).select(F.col("key").alias("track_id"))
    by_artist = matching(lib.spark, f"{index}/artists", term).select(F.col("key").alias("artist_id"))
    keys = materialised(own.unionByName(lib.primary_artists.join(by_artist, "artist_id", "left_semi").select("track_id")).distinct().filter(is_real(F.col("track_id"))))
    names = look_up(lib.spark, f"{index}/tracks", keys).select(F.col("key").alias("track_id"), "name")
    first = materialised(lib.primary_artists.join(keys, "track_id", "left_semi"))
    credits = look_up(lib.spark, f"{index}/artists", first.select("artist_id").distinct()).select(F.col("key").alias("artist_id"), F.col("name").alias("artist_name"))
    hits = names.join(first, "track_id", "left").join(credits, "artist_id", "left")
    return _listed(hits.select("track_id", "name", "artist_name"), counts, "track_id", limit)


def merge_info(lib: Library) -> DataFrame:
    """(user_id, album_id, direction, other_id, other_name): what each album was merged from or into."""
    names = lib.albums.select(F.col("album_id").alias("other_id"), F.col("name").alias("other_name"))
    into = lib.merge_rules.select("user_id", F.col("source_id").alias("album_id"), F.lit("into").alias("direction"), F.col("target_id").alias("other_id"))
    from_ = lib.merge_rules.select("user_id", F.col("target_id").alias("album_id"), F.lit("from").alias("direction"), F.col("source_id").alias("other_id"))
    return into.unionByName(from_).join(names, "other_id").select("user_id", "album_id", "direction", "other_id", "other_name")


def merge_list(lib: Library) -> DataFrame:
    """Rules with their albums' names and each artist that leads a track of the target."""
    source = lib.albums.select(F.col("album_id").alias("source_id"), F.col("name").alias("source_name"))
    target = lib.albums.select(F.col("album_id").alias("target_id"), F.col("name").alias("target_name"))
    lead = lib.track_artists.filter("position = 0").join(lib.tracks.select("track_id", "album_id"), "track_id").select(F.col("album_id").alias("target_id"), "artist_id").distinct()
    lead = lead.join(lib.artists.select("artist_id", F.col("name").alias("artist_name")), "artist_id")
    return lib.merge_rules.join(source, "source_id", "left").join(target, "target_id", "left").join(lead, "target_id", "left").select(
        "user_id", "source_id", "source_name", "target_id", "target_name", "artist_id", "artist_name"
    )


def merge_suggestions(lib: Library, user_id: int) -> DataFrame:
    """(artist_id, album_id, name, plays): an artist's albums that the user hasn't merged, for every artist."""
    counts = lib.plays.filter(F.col("user_id") == user_id).groupBy("track_id").agg(F.count("*").alias("_n"))
    plays = counts.join(lib.tracks.filter("album_id is not null").select("track_id", "album_id"), "track_id").groupBy("album_id").agg(F.sum("_n").alias("plays"))
    led = lib.track_artists.filter("position = 0").join(lib.tracks.select("track_id", "album_id"), "track_id").select("artist_id", "album_id").distinct()
    merged = lib.merge_rules.filter(F.col("user_id") == user_id).select(F.col("source_id").alias("album_id"))
    rows = led.join(merged, "album_id", "left_anti").join(lib.albums, "album_id").join(plays, "album_id", "left")
    return rows.select("artist_id", "album_id", "name", F.coalesce("plays", F.lit(0)).alias("plays"))


def merge_problems(rules: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """(user_id, source_id, target_id, problem) of rules that must not be added, or of a table that isn't sound.

    Problems: self, duplicate, reverse, chain (a source that is a target, or a
    target that is a source), two_targets.
    """
    new = rules if new is None else new
    keys = ["user_id", "source_id", "target_id"]
    both = rules if new is rules else rules.unionByName(new)
    dup = new.join(both.groupBy(*keys).count().filter(F.col("count") >= 2), keys, "left_semi") if new is rules else new.join(rules, keys, "left_semi")
    flip = rules.select("user_id", F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    sources = both.select("user_id", F.col("source_id").alias("_a")).distinct()
    targets = both.select("user_id", F.col("target_id").alias("_a")).distinct()
    chain = new.withColumn("_a", F.col("target_id")).join(sources, ["user_id", "_a"], "left_semi").unionByName(new.withColumn("_a", F.col("source_id")).join(targets, ["user_id", "_a"], "left_semi")).drop("_a")
    forks = both.groupBy("user_id", "source_id").agg(F.count_distinct("target_id").alias("_n")).filter(F.col("_n") >= 2)
    found = [
        (new.filter("source_id = target_id"), "self"), (dup, "duplicate"), (new.filter("source_id <> target_id").join(flip, keys, "left_semi"), "reverse"),
        (chain.filter("source_id <> target_id"), "chain"), (new.join(forks, ["user_id", "source_id"], "left_semi"), "two_targets"),
    ]
    out = None
    for rows, name in found:
        part = rows.select(*keys, F.lit(name).alias("problem")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


RULE_FAULT = "user_id long, source_id string, target_id string, problem string"


def rule_faults(source, target, rules: dict, targets: set) -> list[str]:
    """Problems of a rule beside a user's rules (source: target), whose targets are ``targets``."""
    found = ["self"] if source == target else []
    if rules.get(source) == target:
        found.append("duplicate")
    elif source in rules:
        found.append("two_targets")
    if source != target:
        if rules.get(target) == source:
            found.append("reverse")
        if target in rules or source in targets:
            found.append("chain")
    return found


def add_merge_rules(rules: DataFrame, new: DataFrame, albums: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with what may be added of ``new``, (user_id, source_id, target_id, problem) of the rest).

    New rules (user_id, source_id, target_id, seq) are taken one by one, by
    ``seq``, each beside those taken before it, as if they were added to the
    table singly: of (a, b), (b, a), (b, c), (a, d) only (a, b) is taken.
    Problems are those of ``merge_problems``, and unknown_source and
    unknown_target. Ties go by source and target. A user's rules are folded in
    one task; a user has at most as many as albums.
    """
    known = albums.select(F.col("album_id").alias("_known")).distinct()
    for side in ("source", "target"):
        new = new.join(known.withColumnRenamed("_known", f"{side}_id").withColumn(f"_{side}", F.lit(True)), f"{side}_id", "left")
    told = F.filter(F.array(*(F.when(F.col(f"_{side}").isNull(), F.lit(f"unknown_{side}")) for side in ("source", "target"))), lambda x: x.isNotNull())
    asked = new.select("user_id", "source_id", "target_id", "seq", told.alias("_told"))
    old = rules.select("user_id", "source_id", "target_id")

    def fold(have: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        mine = dict(zip(have["source_id"], have["target_id"], strict=True))
        targets, out = set(mine.values()), []
        for user, source, target, _, told in asked.sort_values(["seq", "source_id", "target_id"]).itertuples(index=False):
            faults = [*rule_faults(source, target, mine, targets), *told]
            if not faults:
                mine[source] = target
                targets.add(target)
            out += [(user, source, target, f) for f in faults or [None]]
        return pd.DataFrame(out, columns=["user_id", "source_id", "target_id", "problem"])

    checked = materialised(old.groupBy("user_id").cogroup(asked.groupBy("user_id")).applyInPandas(fold, RULE_FAULT))
    good = checked.filter("problem is null").select(rules.columns)
    return rules.unionByName(good), checked.filter("problem is not null").distinct()


def delete_merge_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Rules without those of ``gone`` (user_id, source_id, target_id); a user's request removes only rules of that user."""
    keys = ["user_id", "source_id", "target_id"]
    return rules.join(gone.select(keys), keys, "left_anti")
