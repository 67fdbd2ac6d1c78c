"""Period charts: ranks, changes, peaks, runs, dropouts and histories, for all periods at once.

Everything here is a window or a join over ``chart_facts``: few rows (25 a user
and period), which plans that use them several times materialise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_bounds, period_label, previous_label, previous_period
from ..session import BROADCAST_ROWS, broadcast_if_few, materialised
from ..sources.library import Library
from .facts import in_window, period_plays, play_counts, ranked
from .islands import number_periods, run_lengths

CHART_SIZE = 25


def period_ranks(lib: Library, entity: str, granularity: str = "week", week_start: str = "monday", sort: str = "time", plays: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(user_id, period, entity_id, play_count, total_ms, rank) of every entity in every period."""
    counts = play_counts(lib, entity, {"period": period_label(F.col("played_at"), granularity, week_start)}, plays)
    return ranked(counts.drop("first_played", "last_played"), ["user_id", "period"], sort, limit)


def chart_facts(lib: Library, entity: str, granularity: str = "week", week_start: str = "monday", sort: str = "time") -> DataFrame:
    """The charts of all periods."""
    return period_ranks(lib, entity, granularity, week_start, sort, limit=CHART_SIZE)


def period_chart(lib: Library, entity: str, period: str, granularity: str = "week", week_start: str = "monday", sort: str = "time", limit: int = CHART_SIZE) -> DataFrame:
    """One period's chart. The period is a range of times, which the scan filters on."""
    start, end = period_bounds(period, granularity, week_start)
    return period_ranks(lib, entity, granularity, week_start, sort, in_window(lib.plays, start, end, half_open=True), limit)


def available_periods(lib: Library, granularity: str = "week", week_start: str = "monday") -> DataFrame:
    return lib.plays.select("user_id", period_label(F.col("played_at"), granularity, week_start).alias("period")).distinct()


def with_peaks(facts: DataFrame) -> DataFrame:
    """Chart rows with what was true at their period: peak_rank, peak_period, peak_periods, times_at_peak, weeks_on_chart, consecutive.

    Runs step over periods that have data, so a week without plays doesn't end one.
    """
    return _peaks(materialised(facts))


def _peaks(facts: DataFrame) -> DataFrame:
    until = Window.partitionBy("user_id", "entity_id").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.withColumns({"peak_rank": F.min("rank").over(until), "weeks_on_chart": F.count("*").over(until)})
    # the peak so far only falls, so its rows stand together, and the first of them set it
    at_peak = Window.partitionBy("user_id", "entity_id", "peak_rank").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.when(F.col("rank") == F.col("peak_rank"), F.col("period"))
    rows = rows.withColumns({"peak_period": F.min("period").over(at_peak), "peak_periods": F.collect_list(peak).over(at_peak)})
    rows = rows.withColumn("times_at_peak", F.size("peak_periods").cast("long"))
    rows = run_lengths(number_periods(rows, facts), ["user_id", "entity_id"])
    return rows.withColumnRenamed("_run", "consecutive").drop("_i", "_island")


def with_changes(facts: DataFrame, granularity: str = "week") -> DataFrame:
    """Chart rows with previous_rank and rank_change against the period before (by label)."""
    facts = materialised(facts)
    return _changes(facts, facts, granularity)


def _changes(rows: DataFrame, facts: DataFrame, granularity: str) -> DataFrame:
    before = facts.select("user_id", F.col("period").alias("_p"), "entity_id", F.col("rank").alias("previous_rank"))
    rows = rows.withColumn("_p", previous_label(F.col("period"), granularity))
    return rows.join(before, ["user_id", "_p", "entity_id"], "left").drop("_p").withColumn("rank_change", F.col("previous_rank") - F.col("rank"))


def charts(facts: DataFrame, granularity: str = "week") -> DataFrame:
    """Complete charts: changes, peaks, and whether an entity is new or back."""
    facts = materialised(facts)
    rows = _changes(_peaks(facts), facts, granularity)
    absent = F.col("previous_rank").isNull()
    return rows.withColumns({"is_new": absent & (F.col("weeks_on_chart") <= 1), "is_reentry": absent & (F.col("weeks_on_chart") > 1)})


def dropouts(facts: DataFrame, granularity: str = "week") -> DataFrame:
    """(user_id, period, entity_id, previous_rank, peak_rank, peak_period, weeks_on_chart): in the chart before, not in this one.

    Always against the whole chart, and for every period that has one.
    """
    facts = materialised(facts)
    charted = facts.select("user_id", "period").distinct().withColumn("_p", previous_label(F.col("period"), granularity))
    before = _peaks(facts).select("user_id", F.col("period").alias("_p"), "entity_id", F.col("rank").alias("previous_rank"), "peak_rank", "peak_period", "weeks_on_chart")
    return charted.join(before, ["user_id", "_p"]).join(facts, ["user_id", "period", "entity_id"], "left_anti").drop("_p")


def with_period_arrays(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """``rows`` (user_id, …) with ``_periods``, their user's periods, sorted. A user has as many as there were weeks, some fifty a year.

    Few users' lists are broadcast: by user, a task would get all rows of one, and expand them.
    """
    periods = materialised(periods.select("user_id", "period").distinct())
    lists = periods.groupBy("user_id").agg(F.array_sort(F.collect_list("period")).alias("_periods"))
    return rows.join(F.broadcast(lists) if periods.count() <= BROADCAST_ROWS else lists, "user_id")


def since(firsts: DataFrame, periods: DataFrame, first: str) -> DataFrame:
    """``firsts`` (user_id, …) with a row for each of the user's periods from the column ``first`` on.

    Rows meet their user's list of periods, not the periods, so nothing is joined that is dropped again.
    """
    rows = with_period_arrays(firsts, periods)
    return rows.withColumn("period", F.explode(F.filter("_periods", lambda p: p >= F.col(first)))).drop("_periods", first)


def _facts_and_periods(lib: Library, entity: str, week_start: str, sort: str) -> tuple[DataFrame, DataFrame]:
    """Weekly charts, and the users' weeks, from one pass over the plays."""
    plays = materialised(period_plays(lib, "week", week_start))
    counts = play_counts(lib, entity, {"period": F.col("period")}, plays).drop("first_played", "last_played")
    return materialised(ranked(counts, ["user_id", "period"], sort, CHART_SIZE)), plays.select("user_id", "period").distinct()


def chart_history(lib: Library, entity: str, week_start: str = "monday", sort: str = "time") -> DataFrame:
    """(user_id, entity_id, period, rank): every period from an entity's first chart to the user's latest; null off the chart."""
    facts, periods = _facts_and_periods(lib, entity, week_start, sort)
    first = facts.groupBy("user_id", "entity_id").agg(F.min("period").alias("_first"))
    spine = since(first, periods, "_first")
    return spine.join(facts.select("user_id", "entity_id", "period", "rank"), ["user_id", "entity_id", "period"], "left").select("user_id", "entity_id", "period", "rank")


def run_length(rows: DataFrame, periods: DataFrame, values: list[str]) -> DataFrame:
    """(user_id, entity_id, since, *values) of rows (user_id, period, entity_id, *values): one where the values change, so that many can be stored as few.

    An entity that has no row in its user's next period gets one of nulls there.
    What comes later adds rows only where something changes. Both kinds of rows
    come from one pass over ``rows``.
    """
    order = Window.partitionBy("user_id").orderBy("period")
    numbered = periods.select("user_id", "period").distinct().select("user_id", "period", F.row_number().over(order).alias("_i"), F.lead("period").over(order).alias("_next"))
    own = Window.partitionBy("user_id", "entity_id").orderBy("_i")
    each = rows.join(broadcast_if_few(numbered), ["user_id", "period"]).withColumn("_v", F.struct(*values))
    each = each.withColumns({"_before": F.lag(F.struct("_i", "_v")).over(own), "_after": F.lead("_i").over(own)})
    same = (F.col("_before._i") == F.col("_i") - 1) & F.col("_before._v").eqNullSafe(F.col("_v"))
    gone = F.col("_next").isNotNull() & (F.coalesce("_after", F.lit(0)) != F.col("_i") + 1)
    nothing = [F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in values]
    starts = F.when(~F.coalesce(same, F.lit(False)), F.struct(F.col("period").alias("since"), *values))
    ends = F.when(gone, F.struct(F.col("_next").alias("since"), *nothing))
    return each.select("user_id", "entity_id", F.explode(F.array_compact(F.array(starts, ends))).alias("_c")).select("user_id", "entity_id", "_c.*")


def expanded(changes: DataFrame, periods: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``run_length`` rows with one for each of the user's periods again, of those from ``start`` to ``end`` only if given."""
    if end is not None:
        changes, periods = changes.filter(F.col("since") <= end), periods.filter(F.col("period") <= end)
    if start is not None:
        periods = periods.filter(F.col("period") >= start)
    until = F.lead("since").over(Window.partitionBy("user_id", "entity_id").orderBy("since"))
    rows = changes.withColumn("_until", until)
    if start is not None:
        rows = rows.filter(F.col("_until").isNull() | (F.col("_until") > start))
    rows = with_period_arrays(rows, periods)
    inside = F.filter("_periods", lambda p: (p >= F.col("since")) & (F.col("_until").isNull() | (p < F.col("_until"))))
    return rows.withColumn("period", F.explode(inside)).drop("_periods", "_until", "since")


def chart_summary(lib: Library, entity: str, week_start: str = "monday", sort: str = "time") -> DataFrame:
    """One row an entity: its last chart's peaks, and its rank in the user's latest week (null off the chart)."""
    facts, periods = _facts_and_periods(lib, entity, week_start, sort)
    rows = _peaks(facts)
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "entity_id").orderBy(F.col("period").desc()))).filter("_r = 1")
    latest = periods.groupBy("user_id").agg(F.max("period").alias("current_period"))
    return last.join(latest, "user_id").select(
        "user_id", "entity_id", "current_period", F.when(F.col("period") == F.col("current_period"), F.col("rank")).alias("current_rank"),
        "peak_rank", "peak_period", "times_at_peak", "weeks_on_chart",
    )


def chart(lib: Library, entity: str, period: str, granularity: str = "week", week_start: str = "monday", sort: str = "time", previous: str = "label") -> tuple[DataFrame, DataFrame]:
    """(entries, dropouts) of one period. Only plays up to its end are read."""
    _, end = period_bounds(period, granularity, week_start)
    facts = materialised(period_ranks(lib, entity, granularity, week_start, sort, in_window(lib.plays, None, end, half_open=True), CHART_SIZE))
    entries = _peaks(facts).filter(F.col("period") == period)
    before = previous_period(period, granularity, previous)
    old = _peaks(facts.filter(F.col("period") <= before)).filter(F.col("period") == before)
    known = old.select("user_id", "entity_id", F.col("rank").alias("previous_rank"))
    entries = entries.join(known, ["user_id", "entity_id"], "left")
    absent = F.col("previous_rank").isNull()
    entries = entries.withColumns({"rank_change": F.col("previous_rank") - F.col("rank"), "is_new": absent & (F.col("weeks_on_chart") <= 1), "is_reentry": absent & (F.col("weeks_on_chart") > 1)})
    gone = old.join(entries, ["user_id", "entity_id"], "left_anti").select("user_id", "entity_id", F.col("rank").alias("previous_rank"), "peak_rank", "peak_period", "weeks_on_chart")
    return entries, gone
