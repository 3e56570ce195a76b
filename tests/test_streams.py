"""Streams as streams: late rows, duplicates over batches, joins of two streams, and batches that fail."""

import datetime as dt
import json
import os

import pytest

from docmill.streaming import events as E

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


def feed(spark, folder, batches):
    """A stream that reads one file a batch, in order."""
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches):
        path = os.path.join(folder, f"{n}.json")
        with open(path, "w") as out:
            out.writelines(json.dumps(dict(zip(("event_id", "user_id", "event_type", "value", "ts"), row, strict=True))) + "\n" for row in rows)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def drained(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    early = [(1, 1, "view", 1.0, "2024-01-01 10:00:00"), (2, 1, "view", 2.0, "2024-01-03 10:00:00")]
    late = [(3, 1, "view", 4.0, "2024-01-01 11:00:00"), (4, 1, "view", 8.0, "2024-01-03 09:55:00")]
    # Spark drops rows behind the watermark of the batch before the last, so one batch stands between
    between = [(6, 1, "view", 16.0, "2024-01-03 10:01:00")]
    last = [(5, 1, "click", 1.0, "2024-01-09 00:00:00")]
    got = drained(E.tumbling(E.timed(feed(spark, tmp_path / "in", [early, between, late, last]))), "late_rows", tmp_path)
    # event 3 comes two days behind; event 4 is late too, but its window is still open
    assert sorted((r["start"], r["n"], r["total"]) for r in got) == [(dt.datetime(2024, 1, 1), 1, 1.0), (dt.datetime(2024, 1, 3), 3, 26.0)]


def test_duplicates_over_batches(spark, tmp_path):
    one = [(1, 7, "view", 1.0, "2024-01-01 10:00:00"), (2, 7, "view", 1.0, "2024-01-01 10:01:00")]
    two = [(3, 7, "view", 1.0, "2024-01-01 10:02:00"), (4, 8, "view", 1.0, "2024-01-01 10:02:00")]
    got = drained(E.once(E.timed(feed(spark, tmp_path / "in", [one, two])), ["user_id", "event_type"]), "once_rows", tmp_path)
    assert sorted(r["user_id"] for r in got) == [7, 8]


def test_join_of_two_streams(spark, tmp_path):
    views = [[(1, 1, "view", 0.0, "2024-01-01 10:00:00")], [(2, 2, "view", 0.0, "2024-01-01 10:30:00")]]
    bought = [[(3, 1, "purchase", 9.0, "2024-01-01 10:40:00"), (4, 1, "purchase", 9.0, "2024-01-01 11:01:00")], [(5, 2, "purchase", 9.0, "2024-01-01 10:20:00"), (6, 2, "purchase", 9.0, "2024-01-01 11:30:00")]]
    joined = E.with_purchases(E.timed(feed(spark, tmp_path / "v", views)), E.timed(feed(spark, tmp_path / "p", bought)))
    assert sorted(map(tuple, drained(joined, "bought_rows", tmp_path))) == [(1, 3), (2, 6)]


def test_a_batch_that_fails_is_tried_again(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[(1, 1, "view", 0.0, "2024-01-01 10:00:00")], [(2, 1, "view", 0.0, "2024-01-01 10:01:00")]])
    seen, broken = [], [True]

    def process(batch, number):
        ids = [r["event_id"] for r in batch.collect()]
        if 2 in ids and broken.pop():
            broken.append(False)
            raise ValueError("store is away")
        seen.append((number, ids))

    with pytest.raises(Exception, match="store is away"):
        E.sync(stream, process, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert seen == [(0, [1])]
    assert E.sync(stream, process, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert seen == [(0, [1]), (1, [2])]
