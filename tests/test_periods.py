"""Calendar rules: week labels, windows, previous periods."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoplay.functions import periods as p

NOW = datetime(2024, 3, 15, 12)


def label(d: date) -> str:
    return f"{d.year}-W{d.strftime('%W')}"


def test_labels_on_a_cluster(spark):
    """weeks_newyear and week_shift: every day of six years, in all modes."""
    from pyspark.sql import functions as F

    days = [date(2019, 12, 20) + timedelta(days=i) for i in range(2200)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", *(p.period_label(F.col("d"), "week", m).alias(m) for m in p.WEEK_SHIFT), *(p.period_label(F.col("d"), g).alias(g) for g in ("day", "month", "year")))
    for r in rows.collect():
        d = r["d"]
        for mode, shift in p.WEEK_SHIFT.items():
            assert r[mode] == label(d + timedelta(days=shift))
        assert (r["day"], r["month"], r["year"]) == (f"{d:%Y-%m-%d}", f"{d:%Y-%m}", f"{d.year}")


@given(st.dates(date(1990, 1, 1), date(2035, 12, 31)), st.sampled_from(sorted(p.WEEK_SHIFT)))
@settings(max_examples=300, deadline=None)
def test_bounds_hold_exactly_the_days_of_a_label(d, mode):
    shift = p.WEEK_SHIFT[mode]
    start, end = p.period_bounds(label(d + timedelta(days=shift)), "week", mode)
    at = datetime(d.year, d.month, d.day)
    assert start <= at < end
    for edge, inside in ((start, True), (end, False), (start - timedelta(days=1), False)):
        assert (label(edge.date() + timedelta(days=shift)) == label(d + timedelta(days=shift))) == inside


@pytest.mark.parametrize(("g", "now", "before"), [("week", "2025-W00", "2024-W52"), ("week", "2024-W01", "2024-W00"), ("week", "2024-W10", "2024-W09"), ("month", "2024-01", "2023-12"), ("year", "2024", "2023"), ("day", "2024-03-01", "2024-02-29")])
def test_previous_period(spark, g, now, before):
    from pyspark.sql import functions as F

    assert p.previous_period(now, g) == before
    assert spark.range(1).select(p.previous_label(F.lit(now), g)).first()[0] == before


def test_previous_by_calendar():
    assert p.previous_period("2025-W00", "week", "calendar") == "2024-W53"


def test_windows():
    assert p.range_start("week", NOW) == NOW - timedelta(days=7)
    assert p.range_start("thisYear", NOW) == datetime(2024, 1, 1)
    assert p.range_start("all", NOW) is None and p.previous_range("all", NOW) is None
    assert p.previous_range("week", NOW) == (NOW - timedelta(days=14), NOW - timedelta(days=7))
    assert p.previous_range("thisYear", NOW) == (datetime(2023, 1, 1), datetime(2023, 3, 15, 12))
    start, end = p.custom_range(date(2024, 1, 1), date(2024, 1, 2))
    assert end == datetime(2024, 1, 2, 23, 59, 59, 999000)
    assert p.previous_custom(start, end)[1] == start
    assert [p.series_bucket(n) for n in (0, 1, 30, 31, 180, 181, -1)] == ["month", "day", "day", "week", "week", "month", "month"]


def test_unknown_names_are_refused():
    for call in (lambda: p.range_start("decade", NOW), lambda: p.check_label("2024-13-1", "day"), lambda: p.period_bounds("2024W1", "week")):
        with pytest.raises(ValueError):
            call()
