"""Stored partial counts: plays by user, track and day, which add up.

A batch of plays adds the partials of its own days as a batch of its own
(``sources.committed``); nothing that is stored is read or written again. As
counts, sums, minima and maxima merge, several partials of one day are as good
as one, and a late play is just another partial.

``partial_plays`` is the stored table in the shape of plays, a row with
``n_plays`` for many. All that counts plays by day, week, month or year takes
it in place of them: top lists, series, rankings, charts, histories, records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.committed import compact, read_batches, write_batch
from .facts import tally

PARTIAL = "user_id long, track_id long, n_plays long, first_played timestamp_ntz, last_played timestamp_ntz, day date, play_month string"
#: Files of a month in a batch, by users, so a month's plays aren't one task's.
SPREAD = 8


def day_partials(plays: DataFrame) -> DataFrame:
    """(user_id, track_id, n_plays, first_played, last_played, day, play_month), of plays or of other partials."""
    n, first, last = tally(plays)
    rows = plays.groupBy("user_id", "track_id", F.to_date("played_at").alias("day")).agg(n.alias("n_plays"), first.alias("first_played"), last.alias("last_played"))
    return rows.select("user_id", "track_id", "n_plays", "first_played", "last_played", "day", F.date_format("day", "yyyy-MM").alias("play_month"))


def add_plays(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``foreachBatch``, or for batches of one's own numbering: their partials are added once, however often a batch runs."""

    def sink(batch: DataFrame, number: int) -> None:
        rows = day_partials(batch.withColumn("played_at", F.col("played_at").cast("timestamp_ntz")))
        write_batch(rows.repartition("play_month", F.pmod(F.xxhash64("user_id"), F.lit(SPREAD))).sortWithinPartitions("play_month", "day"), path, number, ["play_month"])

    return sink


def partial_plays(spark: SparkSession, path: str, schema: str = PARTIAL) -> DataFrame:
    """The stored partials as plays: ``played_at`` is their day's beginning, and windows prune the months' folders. ``schema`` says of which types the ids are."""
    return read_batches(spark, path, schema).withColumn("played_at", F.col("day").cast("timestamp_ntz"))


def compact_partials(spark: SparkSession, path: str, fan_in: int = 8) -> tuple[int, int] | None:
    return compact(spark, path, PARTIAL, ["play_month"], fan_in)
