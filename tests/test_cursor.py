"""The cursor source, against a service of plain files."""

from __future__ import annotations

import json

from chronoplay.sources.cursor import CursorReader, CursorSource, landed_files


def answer(path, user, cursors):
    (path / f"{user}.json").write_text(json.dumps([{"cursor": c, "n": f"item {c}"} for c in cursors]))


def test_cursors_move_only_when_one_is_returned(tmp_path):
    answer(tmp_path, 1, range(1, 121))
    answer(tmp_path, 3, [5])
    files = landed_files({"path": str(tmp_path)})
    reader, seen = CursorReader(lambda u, after, n: (files(u, after, n)[0], None) if u == 3 else files(u, after, n), [1, 2, 3], 50), []
    at = reader.initialOffset()
    for _ in range(4):
        rows, end = reader.read(at)
        rows = list(rows)
        assert len(rows) <= 50 and rows == list(reader.readBetweenOffsets(at, end))  # a batch can be read again
        seen += [r[1] for r in rows if r[0] == 1]
        at = end
    assert seen == list(range(1, 121)) and at == {"1": 120, "2": 0, "3": 0}


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    """Stopped in the middle and started again: no gap, no repeat, at most 50 items of a user a batch."""
    spark.dataSource.register(CursorSource)
    out, sizes = str(tmp_path / "out"), []

    def run():
        rows = spark.readStream.format("cursor").options(path=str(tmp_path), users="1,2", limit="50").load()
        query = rows.writeStream.foreachBatch(lambda b, i: sizes.append(b.groupBy("user_id").count().collect()) or b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()

    answer(tmp_path, 1, range(1, 71))
    answer(tmp_path, 2, [10, 20])
    run()
    answer(tmp_path, 1, range(1, 181))
    answer(tmp_path, 2, [10, 20, 30])
    run()
    got = sorted((r["user_id"], r["cursor"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, i) for i in range(1, 181)] + [(2, 10), (2, 20), (2, 30)]
    assert max(r["count"] for b in sizes for r in b) == 50
