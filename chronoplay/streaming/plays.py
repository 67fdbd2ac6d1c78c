"""Streams of plays: deduplication, sinks, the local-play state machine, views and windows."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.partials import add_plays
from ..session import materialised
from ..sources.committed import is_committed, read_batches, write_batch

LOCAL_PLAY = "user_id long, track_id string, played_at timestamp, duration_ms long"
LOCAL_STATE = "track_id string, started_at timestamp, duration_ms long, progress_ms long, seen_at timestamp"

#: Most snapshots of a user that a task holds at once, sorted runs that it merges at once, and snapshots or plays in a piece.
HELD, RUNS, PIECE = 100_000, 64, 10_000


def deduplicated(plays: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """One play a user and instant. With bounded lateness the state is bounded too; None keeps every key."""
    plays = plays.withColumn("played_at", F.col("played_at").cast("timestamp"))
    keys = ["user_id", "played_at"]
    return plays.dropDuplicates(keys) if lateness is None else plays.withWatermark("played_at", lateness).dropDuplicatesWithinWatermark(keys)


def append_new(path: str, schema: str, partials: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``: plays that the table at ``path`` lacks are appended, of any lateness.

    Of equal (user_id, played_at) the first batch's stays. A batch counts from
    its marker on (``sources.committed``), so one that dies at any point adds
    nothing when it runs again. Only months that the batch touches are looked
    up. With ``partials``, the day counts of the new plays are added there
    (``operators.partials``), once as well.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not is_committed(spark, path, number):
            new = materialised(batch.dropDuplicates(["user_id", "played_at"]).withColumn("play_month", F.date_format("played_at", "yyyy-MM")))
            months = [r[0] for r in new.select("play_month").distinct().collect()]  # a batch touches few
            old = read_plays(spark, path, schema).filter(F.col("play_month").isin(months)).select("user_id", "played_at")
            write_batch(new.join(old, ["user_id", "played_at"], "left_anti"), path, number, ["play_month"])
        if partials is not None and not is_committed(spark, partials, number):
            add_plays(partials)(read_batches(spark, path, f"{schema}, play_month string", number), number)

    return sink


def read_plays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All committed plays, with ``play_month``, whose filters prune folders."""
    return read_batches(spark, path, f"{schema}, play_month string")


def play_steps(rows: Iterator[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Plays that a user's snapshots (track or None, at, progress_ms, duration_ms), in order of time, complete; and the state after them.

    A play ends when the track changes, stops, or starts again (its progress
    falls). It counts from when the track was first seen.
    """
    out = []
    for track, at, progress, length in rows:
        if state is not None and at < state[4]:
            continue  # older than what was seen
        if state is not None and (track != state[0] or progress < state[3]):
            out.append((state[0], state[1], state[2]))
            state = None
        if track is not None:
            state = (track, at, length, progress, at) if state is None else (*state[:3], progress, at)
    return out, state


def in_order(rows: Iterable[tuple], held: int = HELD, runs: int = RUNS) -> Iterator[tuple]:
    """Rows (track, at, ...) by time, ties as they come and nulls last; beyond ``held`` rows, sorted runs wait on the task's disk."""
    by_time = lambda r: (1,) if pd.isna(r[1]) else (0, r[1])

    def written(some: Iterable[tuple]) -> Iterator[tuple]:
        file, some = tempfile.TemporaryFile(), iter(some)
        while piece := list(islice(some, min(held, PIECE))):
            pickle.dump(piece, file)
        pickle.dump([], file)

        def read() -> Iterator[tuple]:
            with file:
                file.seek(0)
                while piece := pickle.load(file):
                    yield from piece

        return read()

    sorted_runs, rows = [], iter(rows)
    while part := sorted(islice(rows, held), key=by_time):
        if len(part) < held:
            sorted_runs.append(iter(part))
            break
        sorted_runs.append(written(part))
        if len(sorted_runs) == runs:
            sorted_runs = [written(heapq.merge(*sorted_runs, key=by_time))]
    return heapq.merge(*sorted_runs, key=by_time)


def local_plays(snapshots: DataFrame) -> DataFrame:
    """Plays from a stream of now-playing snapshots (user_id, at, is_playing, item_id, progress_ms, duration_ms) of local files.

    State is a few values a user, and survives restarts with the checkpoint. A
    batch's frames come in no order of time, so they are sorted outside memory;
    a task holds a bounded part of a user's snapshots and plays.
    """

    def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for rows in frames:
            local = rows["is_playing"].fillna(False).astype(bool) & rows["item_id"].fillna("").str.startswith("local:")
            tracks = rows["item_id"].where(local, None)
            for t, a, p, d in zip(tracks, rows["at"], rows["progress_ms"].fillna(0), rows["duration_ms"].fillna(0), strict=True):
                yield None if pd.isna(t) else t, a, int(p), int(d)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, new = in_order(rows_of(frames)), state.getOption
        while piece := list(islice(rows, PIECE)):
            done, new = play_steps(piece, new)
            if done:
                yield pd.DataFrame({"user_id": key[0], "track_id": [d[0] for d in done], "played_at": [d[1] for d in done], "duration_ms": [d[2] for d in done]})
        if new is not None:
            state.update(new)
        elif state.exists:
            state.remove()

    return snapshots.groupBy("user_id").applyInPandasWithState(step, LOCAL_PLAY, LOCAL_STATE, "append", GroupStateTimeout.NoTimeout)


#: A user who sends nothing for so long has stopped, and a now-playing row is shown for so long.
ABANDONED, SHOWN = timedelta(minutes=10), timedelta(minutes=2)
TIMED_OUT = "user_id long, kind string, track_id string, at timestamp, duration_ms long"
_TRACK = "track_id string, started_at timestamp, duration_ms long, progress_ms long, seen_at timestamp"
_ROW = "item_id string, at timestamp"


class _Player(StatefulProcessor):
    """A user's track and now-playing row, each with a timer in event time that ends it."""

    def __init__(self, abandoned: timedelta, shown: timedelta):
        self.abandoned, self.shown = abandoned, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.track, self.row = handle.getValueState("track", _TRACK), handle.getValueState("row", _ROW)

    def _timers(self, track: tuple | None, row: tuple | None, known: bool) -> None:
        """One timer for each thing that may end; of those that are left from before, none. A user who wasn't known has none."""
        ends = {_millis(track[4] + self.abandoned) + 1} if track is not None else set()
        ends |= {_millis(row[1] + self.shown) + 1} if row is not None else set()
        left = set(self.handle.listTimers()) if known else set()
        for at in left - ends:
            self.handle.deleteTimer(at)
        for at in ends - left:
            self.handle.registerTimer(at)

    def _frame(self, user: int, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            kind, track, at, length = zip(*rows, strict=True)
            yield pd.DataFrame({"user_id": user, "kind": kind, "track_id": track, "at": at, "duration_ms": length})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track_before, row, out, last = self.track.get(), self.row.get(), [], None  # each call of a state is a round trip to the JVM
        state = None if track_before is None else tuple(track_before)
        for track, at, progress, length, playing, item in in_order(_snapshot_rows(rows)):
            if state is not None and at - state[4] > self.abandoned:
                out.append(("play", *state[:3]))  # its timer would have fired between these two
                state = None
            done, state = play_steps([(track, at, progress, length)], state)
            out += [("play", *d) for d in done]
            if last is None or at >= last[1]:
                last = (item if playing else None, at)
        if state is not None:
            self.track.update(state)
        elif track_before is not None:
            self.track.clear()
        known = track_before is not None or row is not None
        if last is not None and (row is None or last[1] >= row[1]):
            row = last
            self.row.update(row)
            out.append(("now", row[0], row[1], None))
        self._timers(state, row, known)
        yield from self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What has ended leaves the state, and Spark takes its timer away; the timer of what is left stands as it is."""
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        track, row = self.track.get(), self.row.get()
        if track is not None and _millis(track[4] + self.abandoned) < now:
            out.append(("play", *track[:3]))
            self.track.clear()
        if row is not None and _millis(row[1] + self.shown) < now:
            out.append(("hidden", row[0], row[1], None))
            self.row.clear()
        yield from self._frame(key[0], out)

    def close(self) -> None:
        pass


def _millis(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _snapshot_rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for rows in frames:
        playing = rows["is_playing"].fillna(False).astype(bool)
        local = playing & rows["item_id"].fillna("").str.startswith("local:")
        tracks = rows["item_id"].where(local, None)
        for t, a, p, d, on, item in zip(tracks, rows["at"], rows["progress_ms"].fillna(0), rows["duration_ms"].fillna(0), playing, rows["item_id"], strict=True):
            yield None if pd.isna(t) else t, a.to_pydatetime(), int(p), int(d), bool(on), None if pd.isna(item) else item


def timed_plays(snapshots: DataFrame, abandoned: timedelta = ABANDONED, shown: timedelta = SHOWN, lateness: str = "1 minute") -> DataFrame:
    """``TIMED_OUT`` rows of a stream of snapshots, with timers in event time.

    ``play``: a local track ended, as ``local_plays`` has it, or because its user
    has sent nothing for longer than ``abandoned``; ``at`` is when it began.
    ``now``: a user's newest snapshot of a batch. ``hidden``: that row is older
    than ``shown``. What ends leaves the state, so it holds only users who are
    there. Needs the RocksDB state store.
    """
    marked = snapshots.filter("at is not null").withWatermark("at", lateness)
    return marked.groupBy("user_id").transformWithStateInPandas(_Player(abandoned, shown), TIMED_OUT, "append", "eventtime")


def last_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each user's last snapshot, however old. Works on batches and, in complete mode, on streams."""
    return snapshots.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "user_id"]), "at").alias("_s")).select("user_id", "_s.*")


def is_shown(as_of, max_age: str = "2 minutes") -> Column:
    """Whether a snapshot is young enough to be shown."""
    return F.col("at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {max_age}")


def now_playing(snapshots: DataFrame, as_of, max_age: str = "2 minutes") -> DataFrame:
    """``last_snapshots``, hidden once they are older than two minutes."""
    return last_snapshots(snapshots).filter(is_shown(as_of, max_age))


def windowed_counts(plays: DataFrame, length: str = "1 hour", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Extension: plays by tumbling or sliding window."""
    at = F.window("played_at", length, slide) if slide else F.window("played_at", length)
    return plays.withWatermark("played_at", lateness).groupBy(at, "user_id").agg(F.count("*").alias("play_count")).select(F.col("window.start").alias("start"), "user_id", "play_count")


def sessions(plays: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """Extension: listening sessions, ended by a gap."""
    rows = plays.withWatermark("played_at", lateness).groupBy(F.session_window("played_at", gap), "user_id").agg(F.count("*").alias("play_count"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "play_count")


def local_plays_batch(snapshots: DataFrame) -> DataFrame:
    """What ``local_plays`` gives once all snapshots have come, as windows over a table."""
    local = F.coalesce("is_playing", F.lit(False)) & F.coalesce(F.col("item_id").startswith("local:"), F.lit(False))
    w = Window.partitionBy("user_id").orderBy("at")
    rows = snapshots.select("user_id", "at", F.when(local, F.col("item_id")).alias("t"), F.coalesce("progress_ms", F.lit(0)).alias("p"), F.coalesce("duration_ms", F.lit(0)).alias("d"))
    starts = ~F.col("t").eqNullSafe(F.lag("t").over(w)) | (F.col("p") < F.lag("p").over(w))
    rows = rows.withColumn("_s", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))
    runs = rows.groupBy("user_id", "_s").agg(F.min_by(F.struct("t", "at", "d"), "at").alias("_f"))
    last = Window.partitionBy("user_id")
    done = runs.withColumn("_end", F.max("_s").over(last)).filter("_s < _end and _f.t is not null")
    return done.select("user_id", F.col("_f.t").alias("track_id"), F.col("_f.at").alias("played_at"), F.col("_f.d").alias("duration_ms"))
