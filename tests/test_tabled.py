"""Table functions, calibration and the cache, against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from docmill.functions import tabled
from docmill.functions import values as V
from docmill.operators import calibration as K
from docmill.operators.cache import QueryCache


def test_mentions_agree_with_the_column_form(spark):
    texts = ["Rs. 50,000 and 1 lakh in 2024", "12,34,567 of 75000", "", None, "none", "5 5 5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    native = rows.select("id", F.posexplode(V.number_spans(F.col("text"))).alias("n", "s")).select("id", "n", "s.start", "s.end", "s.raw")
    got = tabled.mentions(rows)
    key = lambda r: (r["id"], r["n"], r["start"], r["end"], r["raw"])
    assert sorted(map(key, got.collect())) == sorted(map(key, native.collect())) != []
    tabled.register_functions(spark)
    assert spark.sql("SELECT raw FROM number_mentions('Rs. 2 crore')").first()["raw"] == "Rs. 2 crore"
    assert spark.sql("SELECT nfkc('ﬁ') AS x").first()["x"] == "fi"


def test_sessions_by_partition(spark):
    rnd = random.Random(3)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(u, at(rnd.randrange(0, 40_000))) for u in (1, 2, 2, 2) for _ in range(60)] + [(None, at(5)), (None, at(9000)), (3, None), (4, at(0)), (4, at(100))]
    got = tabled.sessions(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(5), 100).collect()
    want, by = [], {}
    for u, t in rows:
        if t is not None:
            by.setdefault(u, []).append(t)
    for u, times in by.items():
        held = []
        for t in sorted(times):
            if held and (t - held[-1]).total_seconds() >= 100:
                want.append((u, held[0], held[-1], len(held)))
                held = []
            held.append(t)
        want.append((u, held[0], held[-1], len(held)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def plain_isotonic(pairs):
    """Least squares over rising functions of the score, by pooling one row at a time."""
    sums = {}
    for s, y in pairs:
        a = sums.setdefault(s, [0.0, 0])
        a[0] += y
        a[1] += 1
    stack = []
    for s in sorted(sums):
        stack.append([s, s, *sums[s]])
        while len(stack) > 1 and stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3]:
            low, _, t, w = stack.pop(-2)
            stack[-1] = [low, stack[-1][1], t + stack[-1][2], w + stack[-1][3]]
    return [(a, b, round(t / w, 9), float(w)) for a, b, t, w in stack]


def test_isotonic_fit(spark):
    rnd = random.Random(7)
    pairs = []
    for _ in range(3000):
        s = round(rnd.random(), rnd.choice([1, 3, 9]))
        pairs.append((s, int(rnd.random() < s * s)))
    odd = [(None, 1), (0.5, None), (float("nan"), 1)]
    rows = spark.createDataFrame(pairs + odd, "score double, label int").repartition(9)
    steps = K.isotonic(rows)
    got = sorted((r["low"], r["high"], round(r["value"], 9), r["weight"]) for r in steps.collect())
    assert got == plain_isotonic(pairs)
    assert all(a[2] < b[2] for a, b in zip(got, got[1:], strict=False))
    told = {r["score"]: r["calibrated"] for r in K.calibrated(spark.createDataFrame([(-1.0,), (got[0][1],), (2.0,), (None,)], "score double"), steps).collect()}
    assert told[None] is None and round(told[-1.0], 9) == got[0][2] and round(told[2.0], 9) == got[-1][2]
    assert K.isotonic(rows.limit(0)).count() == 0
    assert K.calibrated(rows.limit(3), steps.limit(0)).filter("calibrated is not null").count() == 0


def test_reliability(spark):
    rows = spark.createDataFrame([(0.0, 0), (0.05, 1), (1.0, 1), (0.999, 0), (0.55, 1), (None, 1)], "score double, label int")
    assert [tuple(r) for r in K.reliability(rows).orderBy("bin").collect()] == [(0, 2, 0.025, 0.5, 0.475), (5, 1, 0.55, 1.0, 0.45), (9, 2, 0.9995, 0.5, 0.4995)]
    e = K.errors(rows).first()
    assert (e["n"], e["worst"]) == (5, 0.4995) and abs(e["ece"] - (2 * 0.475 + 0.45 + 2 * 0.4995) / 5) < 1e-6


def test_cache_counts_and_bounds(spark, tmp_path):
    at = lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    cache = QueryCache(spark, str(tmp_path / "cache"), most=3, ttl=1800.0)
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "z"), (5, None)], "query_id int, text string")
    values = lambda *texts: spark.createDataFrame([(t, f"value {t}") for t in texts], "text string, value string")

    def ask(version, minute):
        found, seen = cache.lookup(asked, version, at(minute))
        rows = {r["query_id"]: (r["state"], r["value"]) for r in found.collect()}
        return rows, cache.counted(seen)

    rows, counts = ask(1, 0)
    assert counts == {"hits": 0, "misses": 5, "stale": 0, "expired": 0} and set(rows.values()) == {("miss", None)}
    assert cache.put(values("a", "b"), 1, at(0)) == {"kept": 2, "expired": 0, "evicted": 0}
    rows, counts = ask(1, 5)
    assert rows[1] == rows[3] == ("hit", "value a") and rows[4] == ("miss", None) and counts["hits"] == 3
    assert ask(2, 5)[1] == {"hits": 0, "misses": 2, "stale": 3, "expired": 0}
    assert ask(1, 30)[1]["expired"] == 3  # at its time to live an entry is gone
    # three fit: those used last; a was used again, b was not
    hits = asked.filter("text = 'a'")
    assert cache.put(values("c", "d"), 1, at(10), used=hits) == {"kept": 3, "expired": 0, "evicted": 1}
    assert sorted(r["value"] for r in cache.entries().collect()) == ["value a", "value c", "value d"]
    assert cache.entries().filter("value = 'value a'").first()["uses"] == 2
    assert cache.put(values("e"), 1, at(35)) == {"kept": 3, "expired": 1, "evicted": 0}
    assert cache.counts == {"hits": 3, "misses": 5 + 2 + 2 + 2, "stale": 3, "expired": 3, "evicted": 1}
    (tmp_path / "cache/generation-00000099").mkdir()  # a write that broke off
    assert cache.entries().count() == 3


def test_cache_keeps_all_entries_unless_bounded(spark, tmp_path):
    cache = QueryCache(spark, str(tmp_path / "whole"))
    told = cache.put(spark.range(100_001).select(F.col("id").cast("string").alias("text"), F.lit("v").alias("value")), 1)
    assert told == {"kept": 100_001, "expired": 0, "evicted": 0}
