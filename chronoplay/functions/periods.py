"""Calendar arithmetic: presets, windows, period labels and their bounds.

Weeks are labelled ``YYYY-WNN`` with Monday-based weeks of the year from 00, so
they split at New Year. All times are UTC, and "now" is always an argument.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of each preset; -1 counts from New Year, 0 has no start.
PRESETS = {"week": 7, "month": 30, "3months": 90, "6months": 180, "year": 365, "thisYear": -1, "all": 0}
#: Days by which a time is moved before its week is labelled. "sunday" weeks
#: begin on Tuesday, as in the catalogue we reproduce; "true_sunday" is right.
WEEK_SHIFT = {"monday": 0, "sunday": -1, "friday": -4, "true_sunday": 1}
GRANULARITIES = ("day", "week", "month", "year")
_LABEL = {"day": r"\d{4}-\d{2}-\d{2}", "week": r"\d{4}-W\d{2}", "month": r"\d{4}-\d{2}", "year": r"\d{4}"}


def range_start(preset: str, as_of: datetime) -> datetime | None:
    """Start of a preset window that is open to the future; None: no bound."""
    if preset not in PRESETS:
        raise ValueError(f"unknown range {preset!r}")
    days = PRESETS[preset]
    return None if days == 0 else datetime(as_of.year, 1, 1) if days < 0 else as_of - timedelta(days=days)


def previous_range(preset: str, as_of: datetime) -> tuple[datetime, datetime] | None:
    """The half-open window before a preset's; None where there is none."""
    start = range_start(preset, as_of)
    if start is None:
        return None
    if preset == "thisYear":
        return datetime(as_of.year - 1, 1, 1), as_of.replace(year=as_of.year - 1, day=min(as_of.day, 28) if as_of.month == 2 else as_of.day)
    return start - timedelta(days=PRESETS[preset]), start


def custom_range(start: date, end: date) -> tuple[datetime, datetime]:
    """The closed window of whole days from ``start`` to ``end``."""
    return datetime(start.year, start.month, start.day), datetime(end.year, end.month, end.day, 23, 59, 59, 999000)


def previous_custom(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The half-open window of the same length before a custom one."""
    return start - (end - start), start


def window_of(preset: str, as_of: datetime, start: date | None = None, end: date | None = None) -> tuple[datetime | None, datetime | None]:
    """(start, end) of a custom range of whole days, if both are given, else of a preset; None: no bound. Ends are closed."""
    return custom_range(start, end) if start and end else (range_start(preset, as_of), None)


def window_before(preset: str, as_of: datetime, start: date | None = None, end: date | None = None) -> tuple[datetime, datetime] | None:
    """The half-open window before ``window_of``; None where there is none."""
    return previous_custom(*custom_range(start, end)) if start and end else previous_range(preset, as_of)


def window_days(preset: str, start: date | None = None, end: date | None = None) -> int:
    """Days that pick a series' granularity: of a custom range from its first to its last, so a single day has none."""
    return (end - start).days if start and end else PRESETS[preset]


def series_bucket(days: int) -> str:
    """Granularity of a time series over so many days; 0, a single day or no bound, gives months."""
    return "day" if 1 <= days <= 30 else "week" if 31 <= days <= 180 else "month"


def week_label(ts: Column) -> Column:
    d = F.to_date(ts)
    number = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def period_label(ts: Column, granularity: str, week_start: str = "monday") -> Column:
    """Label of the period a time falls in."""
    if granularity == "week":
        shift = WEEK_SHIFT[week_start]
        return week_label(F.date_add(F.to_date(ts), shift) if shift else ts)
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}")
    d = F.to_date(ts)
    if granularity == "day":
        return d.cast("string")
    year = F.year(d).cast("string")
    return year if granularity == "year" else F.concat(year, F.lit("-"), F.lpad(F.month(d).cast("string"), 2, "0"))


def check_label(label: str, granularity: str) -> str:
    if not re.fullmatch(_LABEL[granularity], label):
        raise ValueError(f"{label!r} is no {granularity}")
    return label


def period_bounds(label: str, granularity: str, week_start: str = "monday") -> tuple[datetime, datetime]:
    """[start, end) of a label, so that a filter on it reaches the scan."""
    check_label(label, granularity)
    year = int(label[:4])
    if granularity == "year":
        return datetime(year, 1, 1), datetime(year + 1, 1, 1)
    if granularity == "month":
        month = int(label[5:7])
        return datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)
    if granularity == "day":
        start = datetime.strptime(label, "%Y-%m-%d")
        return start, start + timedelta(days=1)
    new_year, shift = date(year, 1, 1), WEEK_SHIFT[week_start]
    first_monday = new_year + timedelta(days=-new_year.weekday() % 7)
    monday = first_monday + timedelta(weeks=int(label[6:]) - 1)
    start, end = max(monday, new_year), min(monday + timedelta(days=7), date(year + 1, 1, 1))
    whole = [datetime(d.year, d.month, d.day) - timedelta(days=shift) for d in (start, max(start, end))]
    return whole[0], whole[1]


def previous_period(label: str, granularity: str, mode: str = "label") -> str:
    """The period before: by arithmetic on the label, or by the calendar.

    On labels, week 00 follows week 52 of the year before, and week 01 follows
    week 00 even in a year that has none.
    """
    check_label(label, granularity)
    if mode == "calendar" or granularity in ("day", "year", "month"):
        start, _ = period_bounds(label, granularity)
        before = start - timedelta(days=1)
        week = (before.timetuple().tm_yday + 6 - before.weekday()) // 7
        return {"day": f"{before:%Y-%m-%d}", "week": f"{before.year}-W{week:02d}", "month": f"{before:%Y-%m}", "year": f"{before.year}"}[granularity]
    year, week = int(label[:4]), int(label[6:])
    return f"{year - 1}-W52" if week == 0 else f"{year}-W{week - 1:02d}"


def previous_label(label: Column, granularity: str) -> Column:
    """``previous_period`` on a column, by label."""
    year = F.substring(label, 1, 4).cast("int")
    if granularity == "year":
        return (year - 1).cast("string")
    if granularity == "day":
        return F.date_sub(F.to_date(label), 1).cast("string")
    if granularity == "month":
        before = F.add_months(F.to_date(F.concat(label, F.lit("-01"))), -1)
        return F.substring(before.cast("string"), 1, 7)
    week = F.substring(label, 7, 2).cast("int")
    earlier = F.concat(year.cast("string"), F.lit("-W"), F.lpad((week - 1).cast("string"), 2, "0"))
    return F.when(week == 0, F.concat((year - 1).cast("string"), F.lit("-W52"))).otherwise(earlier)
