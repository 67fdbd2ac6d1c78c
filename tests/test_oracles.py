"""Every query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import oracle_rows, spark_rows

from chronoplay.plans.catalog import QUERIES
from chronoplay.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    if name in ORACLES:
        assert (columns, rows) == oracle_rows(SF, ORACLES[name])
    assert columns


def test_stream_equals_batch(spark):
    """The state machine over a stream gives what windows over the table give."""
    stream = QUERIES["stream_local_plays"](spark, SF)
    got = sorted((r["user_id"], r["track_id"], r["played_at"], r["duration_ms"]) for r in stream.collect())
    want = sorted((r["user_id"], r["track_id"], r["played_at"], r["duration_ms"]) for r in QUERIES["local_plays"](spark, SF).collect())
    assert got == want and got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_period_filter_reaches_the_scan(spark, tmp_path):
    """a period is a range of times, which parquet gets."""
    from datetime import datetime

    from chronoplay.operators.charts import period_chart
    from chronoplay.sources.library import events_library

    lib = events_library(spark, SF)
    lib.plays.write.parquet(str(tmp_path / "plays"))
    rows = period_chart(lib.but(plays=spark.read.parquet(str(tmp_path / "plays"))), "track", "2024-W02")
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(played_at" in plan and "LessThan(played_at" in plan
    assert datetime(2024, 1, 8) and rows.count() > 0
