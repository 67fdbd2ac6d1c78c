"""Gaps and islands: runs of consecutive numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.library import Library


def number_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """``rows`` (user_id, period, …) with ``_i``: the period's place among the user's periods that have data."""
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("period")).alias("_i")
    return rows.join(periods.select("user_id", "period").distinct().select("user_id", "period", order), ["user_id", "period"])


def run_lengths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Numbered rows (``_i``) with ``_island`` and ``_run``, the length of the run up to the row."""
    w = Window.partitionBy(*keys).orderBy("_i")
    rows = rows.withColumn("_island", F.col("_i") - F.row_number().over(w))
    return rows.withColumn("_run", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("_i")).cast("long"))


def streaks(lib: Library, as_of: datetime | None = None) -> DataFrame:
    """(user_id, days, longest, current): runs of days with plays.

    The current run counts only if it reaches today or yesterday.
    """
    today = F.to_date(F.lit(as_of or lib.as_of).cast("timestamp_ntz"))
    days = lib.plays.select("user_id", F.to_date("played_at").alias("day")).distinct()
    days = days.withColumn("_i", F.datediff("day", F.lit("1970-01-01").cast("date")))
    runs = run_lengths(days, ["user_id"]).groupBy("user_id", "_island").agg(F.max("_run").alias("_run"), F.max("day").alias("_last"))
    return runs.groupBy("user_id").agg(
        F.sum("_run").alias("days"),
        F.max("_run").alias("longest"),
        F.coalesce(F.max(F.when(F.col("_last") >= F.date_sub(today, 1), F.col("_run"))), F.lit(0)).alias("current"),
    )
