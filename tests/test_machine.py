"""The state machine as batch and stream, syncs that break off, and stream joins that emit late."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docmill.streaming import events as E
from docmill.streaming import machine as M
from docmill.streaming.sync import Sync

LOG = "key string, at timestamp, seq long, state string, force boolean, error string"


def feed(spark, folder, batches, schema):
    """A stream that reads one file a batch, in order."""
    os.makedirs(folder, exist_ok=True)
    names = [c.split()[0] for c in schema.split(", ")]
    for n, rows in enumerate(batches):
        path = os.path.join(folder, f"{n}.json")
        if not os.path.exists(path):
            with open(path, "w") as out:
                out.writelines(json.dumps(dict(zip(names, row, strict=True)), default=str) + "\n" for row in rows)
            os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def random_log(seed, n=300):
    rnd = random.Random(seed)
    states = list(E.TRANSITIONS)
    at, rows, now = dt.datetime(2024, 1, 1), [], {}
    for seq in range(n):
        key = rnd.choice([*"abcdefg", "hot", "hot", "hot", "hot"])
        at += dt.timedelta(minutes=rnd.randrange(1, 30))
        likely = E.TRANSITIONS.get(now.get(key, ""), []) or states
        state = rnd.choice(likely if rnd.random() < 0.7 else [*states, None, "unknown"])
        now[key] = state or now.get(key, "")
        rows.append((key if key != "g" else None, at, seq, state, rnd.choice([None, False, False, True]), rnd.choice([None, f"e{seq}"])))
    return rows


def plain_machine(rows):
    """A dictionary of documents, one row after another."""
    at, out = {}, []
    for key, _, seq, state, force, error in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in at:
            before, taken, at[key] = None, True, (state, int(state == "failed"), error)
        else:
            before, attempts, last = at[key]
            taken = bool(force) or state in E.TRANSITIONS.get(before, [])
            if taken:
                at[key] = (state, attempts + (state == "failed"), error if error is not None else last)
        out.append((key, seq, before, state, "taken" if taken else "refused", at[key][1], at[key][2]))
    return out


def test_machine_in_batch(spark):
    rows = random_log(1)
    log = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG).repartition(5)
    want = plain_machine(rows)
    steps = M.transitions(log)
    assert sorted(map(tuple, steps.collect()), key=str) == sorted(want, key=str)
    assert {s[4] for s in want} == {"taken", "refused"}
    last = {}
    for key, _, _, state, kind, attempts, error in want:
        if kind == "taken":
            last[key] = (key, state, attempts, error)
    assert sorted(map(tuple, M.current(steps).collect()), key=str) == sorted(last.values(), key=str)
    assert M.transitions(log.limit(0)).count() == 0
    # where each row is legal or the first, the machine says what the plain log does
    simple = log.withColumn("force", F.lit(True))
    assert sorted((r["key"] or "", r["state"] or "", r["attempts"]) for r in M.current(M.transitions(simple)).collect()) == sorted((r["key"] or "", r["state"] or "", r["attempts"]) for r in E.latest_state(log).collect())


@pytest.fixture
def rocks(spark):
    for k, v in M.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k in M.ROCKS:
        spark.conf.unset(k)


def run_stream(stream, path):
    query = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)


def test_machine_as_stream_over_a_restart(spark, rocks, tmp_path):
    rows = random_log(5, 120)
    batches = [rows[k : k + 40] for k in range(0, 120, 40)]
    for upto in (1, 3):  # the second query goes on from the state of the first
        run_stream(M.transition_stream(feed(spark, tmp_path / "in", batches[:upto], LOG), patience="1000 days"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((tuple(r[c] for c in ("key", "seq", "before", "state", "kind", "attempts", "error")) for r in got), key=str) == sorted(plain_machine(rows), key=str)


def test_documents_that_stop_are_reported_once(spark, rocks, tmp_path):
    t = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    batches = [
        [("slow", t(1), 1, "discovered", False, None), ("quick", t(1), 2, "discovered", False, None), ("ended", t(1), 3, "indexed", False, None)],
        [("quick", t(1, 5), 4, "downloading", False, None), ("slow", t(1, 5), 5, "indexed", False, None)],  # the second is refused: no step
        [("other", t(1, 9), 6, "indexed", False, None)],
        [("other", t(2), 7, "failed", False, None), ("slow", t(2), 8, "failed", False, "gone")],
        [("other", t(5), 9, "failed", False, None)],
        [("other", t(9), 10, "failed", False, None)],
    ]
    run_stream(M.transition_stream(feed(spark, tmp_path / "in", batches, LOG), patience="6 hours", late="0 seconds"), tmp_path)
    steps = spark.read.parquet(str(tmp_path / "out"))
    stalled = sorted((r["key"], r["before"]) for r in steps.filter("kind = 'stalled'").collect())
    assert stalled == [("quick", "downloading"), ("slow", "discovered"), ("slow", "failed")]  # slow stopped twice
    assert sorted(map(tuple, M.review_queue(steps, 1).collect())) == [("quick", "downloading", 0, "stalled"), ("slow", "failed", 1, "dead_letter")]


# ---------------------------------------------------------------- sync

FILES = "id string, modified timestamp, size long, trashed boolean"


def catalog(spark, *more):
    day = lambda d: dt.datetime(2024, 1, d)
    return spark.createDataFrame([("file_1", day(2), 1000, False), ("file_2", day(3), 2000, False), ("file_3", day(4), 3000, None), ("gone", day(4), 10, True), ("untimed", None, 5, False), *more], FILES)


def all_good(rows):
    return rows.select("id", F.lit(True).alias("ok"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_baselines(spark, tmp_path):
    sync, files = Sync(spark, str(tmp_path / "s")), catalog(spark)
    assert ids(sync.pending(files, catalog_since="2024-01-01")[0]) == ["file_1", "file_2", "file_3"]
    assert ids(sync.pending(files, since="2024-01-02", catalog_since="2024-01-03")[0]) == ["file_2", "file_3"]  # strictly later
    assert ids(sync.pending(files)[0]) == ["file_1", "file_2", "file_3"]  # no baseline: all that have a time
    done = sync.run(files, all_good, catalog_since="2024-01-01", now="2024-01-03 12:00:00")
    assert (done["total_changed"], done["reprocessed"], done["failed"], done["status"]) == (3, 3, 0, "completed")
    assert sync.baseline(None, "2020-01-01") == "2024-01-03 12:00:00" and sync.baseline("2019-01-01") == "2019-01-01"
    # file_3 is later than the watermark but equals its checkpoint
    moved, todo = sync.pending(files)
    assert ids(moved) == ["file_3"] and ids(todo) == []
    assert sync.run(files, all_good, now="2024-02-01 00:00:00")["status"] == "nothing_changed" and sync.watermark() == "2024-01-03 12:00:00"
    assert ids(sync.pending(catalog(spark).withColumn("size", F.lit(1)))[1]) == ["file_3"]
    assert ids(sync.pending(files, since="2024-01-01", everything=True)[1]) == ["file_1", "file_2", "file_3"]


def test_failures_leave_the_watermark(spark, tmp_path):
    sync, files = Sync(spark, str(tmp_path / "s")), catalog(spark)
    no_second = lambda rows: rows.filter("id <> 'file_3'").select("id", (F.col("id") != "file_2").alias("ok"))
    done = sync.run(files, no_second, now="2024-02-01 00:00:00")
    assert (done["reprocessed"], done["failed"], done["status"]) == (1, 2, "completed_with_errors") and sync.watermark() is None
    assert ids(sync.pending(files)[1]) == ["file_2", "file_3"]
    limited = sync.run(files, all_good, most=1, now="2024-02-02 00:00:00")
    assert (limited["reprocessed"], limited["waiting"]) == (1, 1) and sync.watermark() is None
    assert sync.run(files, all_good, now="2024-02-03 00:00:00")["reprocessed"] == 1 and sync.watermark() == "2024-02-03 00:00:00"


def test_breaking_off_between_write_and_commit(spark, tmp_path, monkeypatch):
    sync, files, seen = Sync(spark, str(tmp_path / "s")), catalog(spark), []

    def process(rows):
        seen.append(ids(rows))
        return all_good(rows)

    with monkeypatch.context() as m:
        m.setattr(Sync, "_write", lambda *a: (_ for _ in ()).throw(OSError("the store is away")))
        with pytest.raises(OSError, match="away"):
            sync.run(files, process, "batch-0", now="2024-02-01 00:00:00")
    assert os.path.isdir(tmp_path / "s/runs/batch-0/checkpoints") and sync.checkpoints().count() == 0 and sync.watermark() is None
    assert sync.run(files, process, "batch-0", now="2024-02-01 00:00:00")["reprocessed"] == 3
    assert sync.run(files, process, "batch-0")["status"] == "done_before"
    assert len(seen) == 2 and seen[0] == seen[1] and sync.checkpoints().count() == 3  # written over, not beside


def test_compaction_and_streams(spark, tmp_path):
    sync = Sync(spark, str(tmp_path / "s"))
    schema = "id string, modified timestamp, size long"
    day = lambda d: dt.datetime(2024, 1, d)
    batches = [[("a", day(1), 1), ("b", day(1), 1)], [("a", day(2), 2), ("a", day(3), 3)], [("b", day(1), 1)]]
    for upto in (1, 3, 3):
        assert sync.stream(feed(spark, tmp_path / "in", batches[:upto], schema), all_good, str(tmp_path / "c")).awaitTermination(120)
    want = [("a", day(3), 3), ("b", day(1), 1)]
    assert sorted(map(tuple, sync.checkpoints().collect())) == want
    assert [v["reprocessed"] for v in sync.commits().values()] == [2, 1, 0]
    mark = sync.watermark()
    sync.compact()
    assert len(sync.commits()) == 1 and sorted(map(tuple, sync.checkpoints().collect())) == want and sync.watermark() == mark


# ---------------------------------------------------------------- joins

EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp"


def drained(stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted((tuple(r) for r in stream.sparkSession.table(name).collect()), key=str)


def test_views_without_purchase_come_late(spark, tmp_path):
    at = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
    views = [[(1, 1, "view", 0.0, at(10)), (2, 2, "view", 0.0, at(10))], [(7, 9, "view", 0.0, at(0, 0, 3))], [(8, 9, "view", 0.0, at(0, 0, 4))]]
    bought = [[(3, 1, "purchase", 9.0, at(10, 40))], [(4, 2, "purchase", 9.0, at(11, 30)), (5, 9, "purchase", 9.0, at(0, 0, 3))], [(6, 9, "purchase", 9.0, at(0, 30, 4))]]
    joined = E.with_purchases_or_none(E.timed(feed(spark, tmp_path / "v", views, EVENTS)), E.timed(feed(spark, tmp_path / "p", bought, EVENTS)))
    # view 2 had a purchase too late; it comes out when the watermark has passed, exactly once
    assert drained(joined, "late_views", tmp_path) == [(1, 3), (2, None), (7, 5), (8, 6)]


def test_stream_with_a_table(spark, tmp_path):
    people = spark.createDataFrame([(1, "ann"), (1, "zoe"), (2, None)], "id long, name string")
    rows = [[(1, 1, "view", 0.0, "2024-01-01 10:00:00"), (2, 2, "view", 0.0, "2024-01-01 10:00:00")], [(3, 3, "view", 0.0, "2024-01-01 10:00:00"), (4, None, "view", 0.0, "2024-01-01 10:00:00")]]
    got = drained(E.with_dimension(feed(spark, tmp_path / "in", rows, EVENTS).select("event_id", "user_id"), people, "user_id", "id"), "with_names", tmp_path)
    assert got == [(1, 1, "ann"), (2, 2, None), (3, 3, None), (4, None, None)]
