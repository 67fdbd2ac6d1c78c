"""The state machine with timers: abandoned tracks end, rows are hidden, state shrinks, a restart loses nothing."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from chronoplay.sources.files import SNAPSHOTS
from chronoplay.streaming import plays as stream

AT = datetime(2024, 1, 1, 12)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def minutes(m):
    return AT + timedelta(minutes=m)


def test_timers_end_what_is_left_and_restarts_lose_nothing(spark, tmp_path, rocksdb):
    where = str(tmp_path)
    snap = lambda u, m, item, p, on=True: (u, minutes(m), on, item, p, 180_000)

    def run(rows):
        """One batch, by a query that is started anew; its output, and the rows of state after it."""
        spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(f"{where}/feed")
        feed = spark.readStream.schema(SNAPSHOTS).parquet(f"{where}/feed")
        query = stream.timed_plays(feed).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        out = sorted(tuple(r) for r in spark.read.schema(stream.TIMED_OUT).parquet(f"{where}/out").collect()) if query.recentProgress else []
        return [(u, k, t, int((at - AT).total_seconds() // 60)) for u, k, t, at, _ in out], [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if json.loads(p.json)["stateOperators"]]

    first, state = run([snap(1, 0, "local:a", 0), snap(2, 0, "local:b", 0), snap(3, 0, "s1", 0)])
    assert first == [(1, "now", "local:a", 0), (2, "now", "local:b", 0), (3, "now", "s1", 0)]
    second, _ = run([snap(1, 1, "local:a", 60_000), snap(1, 3, "local:c", 0)])  # the restart was in mid-track
    assert (1, "play", "local:a", 0) in second and (2, "play", "local:b", 0) not in second
    third, _ = run([snap(9, 40, "local:z", 0)])  # time goes on without users 1, 2 and 3
    fourth, after = run([snap(9, 41, "local:z", 60_000)])
    assert {(1, "play", "local:c", 3), (2, "play", "local:b", 0)} <= set(fourth)  # abandoned
    assert {(1, "hidden", "local:c", 3), (2, "hidden", "local:b", 0), (3, "hidden", "s1", 0)} <= set(fourth)
    assert sum(k == "play" for _, k, *_ in fourth) == 3 and (9, "play", "local:z", 40) not in fourth
    assert after[-1] < state[0]  # only user 9 is left


def test_timers_never_fire_between_snapshots_of_one_batch(spark, tmp_path, rocksdb):
    """A gap longer than the limit ends the track also where both sides of it come together."""
    rows = [(1, minutes(0), True, "local:a", 0, 1), (1, minutes(30), True, "local:a", 1000, 1), (1, minutes(31), False, "local:a", 1000, 1)]
    spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.parquet(f"{tmp_path}/feed")
    query = stream.timed_plays(spark.readStream.schema(SNAPSHOTS).parquet(f"{tmp_path}/feed")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    plays = [r["at"] for r in spark.read.schema(stream.TIMED_OUT).parquet(f"{tmp_path}/out").filter("kind = 'play'").collect()]
    assert sorted(plays) == [minutes(0), minutes(30)]


def test_a_new_user_takes_few_calls_of_the_state():
    """each call is a round trip to the JVM: two reads, two writes and two timers, and what was before is only looked up where something was."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self):
            self.value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def exists(self):
            calls.append("exists")
            return self.value is not None

    class Handle:
        at: set = set()

        def getValueState(self, name, schema):
            return State()

        def listTimers(self):
            calls.append("list")
            return iter(self.at)

        def registerTimer(self, at):
            calls.append("register")
            self.at.add(at)

    player = stream._Player(timedelta(minutes=10), timedelta(minutes=2))
    player.init(Handle())
    rows = pd.DataFrame({"at": [AT], "is_playing": [True], "item_id": ["local:a"], "progress_ms": [0], "duration_ms": [1]})
    list(player.handleInputRows((1,), iter([rows]), None))
    assert sorted(calls) == ["get", "get", "register", "register", "update", "update"]
