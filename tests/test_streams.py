"""The item fold as a stream: several batches, repeats, late events, items that fall silent."""

import os

from pyspark.sql import functions as F

from tilewright.streaming import folds

ROW = "item long, seq long, kind string, done long, total long, device string, ts timestamp"


def _stream(spark, folder, batches, with_ts):
    for k, rows in enumerate(batches):
        made = [(i, s, kind, d, t, "GPU" if kind == "device" else None, 1_700_000_000 + ts) for i, s, kind, d, t, ts in rows]
        spark.createDataFrame(made, ROW.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(str(folder / "in" / f"b{k}"))
        for f in (folder / "in" / f"b{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(folder / "in" / "*"))
    return stream if with_ts else stream.drop("ts")


def _run(stream, folder, **more):
    seen = []

    def keep(batch, n):
        seen.extend((n, tuple(r)) for r in batch.collect())

    query = folds.stream_items(stream, **more).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for _, row in sorted(seen, key=lambda r: r[0]):
        last[row[0]] = row[1:]
    return last, [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_late_events_are_counted_once_and_repeats_are_not(spark, tmp_path):
    batches = [
        [(1, 5, "progress", 3, 9, 0), (1, 2, "started", 0, 0, 0), (2, 1, "started", 0, 0, 0), (3, 1, "failed", 0, 0, 0), (4, 9, "noise", 0, 0, 0)],
        [(1, 5, "progress", 3, 9, 0), (1, 3, "device", 0, 0, 0), (1, 7, "saving", 0, 0, 0), (3, 1, "failed", 0, 0, 0), (3, 2, "completed", 0, 0, 0)],
        [(1, 3, "device", 0, 0, 0), (1, 7, "saving", 0, 0, 0), (1, 4, "progress", 1, 1, 0), (2, 4, "progress", 2, 8, 0), (2, 3, "progress", 1, 8, 0)],
        [(1, 8, "completed", 0, 0, 0), (1, 6, "cancelled", 0, 0, 0), (1, 9, "failed", 0, 0, 0)],
    ]
    last, _ = _run(_stream(spark, tmp_path, batches, False), tmp_path)
    assert last == {1: ("completed", 9, 9, None, 4, 3), 2: ("processing", 2, 8, None, 3, 0), 3: ("failed", 0, 0, None, 1, 0)}


def test_silent_items_leave_the_state(spark, tmp_path):
    day = 86_400
    batches = [
        [(1, 1, "started", 0, 0, 0), (2, 1, "started", 0, 0, 0), (3, 1, "started", 0, 0, 0)],
        [(1, 2, "completed", 0, 0, day // 2), (2, 2, "progress", 1, 2, day // 2)],
        [(4, 1, "started", 0, 0, 3 * day)],
        [(5, 1, "started", 0, 0, 3 * day + 1)],
        [(5, 2, "progress", 1, 2, 3 * day + 2), (1, 1, "started", 0, 0, 3 * day + 2)],
    ]
    last, state = _run(_stream(spark, tmp_path, batches, True), tmp_path, lateness="1 hour", keep_s=day)
    assert last[2] == ("processing", 1, 2, None, 2, 0) and last[5] == ("processing", 1, 2, None, 2, 0)
    assert last[1] == ("processing", 0, 0, None, 1, 0)  # begun anew: its old state is gone
    assert max(state) > state[-1]


def test_many_events_of_one_item_keep_a_bounded_state(spark, tmp_path, monkeypatch):
    batches = [[(1, 1000 * b + k, "progress", k, 999, 0) for k in range(1000)] for b in range(4)] + [[(1, 5, "progress", 5, 5, 0), (1, 3999, "progress", 999, 999, 0)]]
    last, state = _run(_stream(spark, tmp_path, batches, False), tmp_path)
    assert last[1] == ("waiting", 999, 999, None, 4000, 1)  # number 5 is too old to be known: counted, not applied
    assert max(state) <= 2 * folds.REMEMBERED + 1000
