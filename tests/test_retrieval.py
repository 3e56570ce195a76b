"""Routed retrieval, interval joins and the approximate index, against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docmill.functions import text
from docmill.operators import index as I
from docmill.operators import intervals, lsh, routing


def test_legs_and_bounds(spark):
    asked = [(1, "sum of fees and the president since 2021"), (2, "who was president before 2020"), (3, "Alpha"), (4, None), (5, "a and b"), (6, "export rows during 2022 until 2023")]
    got = {}
    for r in routing.legs(spark.createDataFrame(asked, "query_id int, text string")).collect():
        got[r["leg"]["query_id"], r["leg"]["part"]] = r
    assert {k for k in got if k[0] == 1} == {(1, 0), (1, 1), (1, 2)}
    assert (got[1, 1]["text"], got[1, 2]["text"]) == ("sum of fees", "the president since 2021")
    assert got[1, 1]["intent"] == "structured_data" and got[1, 1]["since"] == [] and got[1, 2]["since"] == [2021]
    assert got[2, 0]["before"] == [2020] and got[2, 0]["years"] == [2020] and not got[2, 0]["structured"]
    assert got[6, 0]["during"] == [2022] and got[6, 0]["until"] == [2023] and got[6, 0]["structured"]
    assert list(got[3, 0]["strategies"]) == ["bm25", "exact", "dense"] and (4, 0) in got
    assert (5, 0) not in got and (5, 1) not in got  # compound alone, its parts too short


def test_only_the_plans_lists_run(spark):
    docs = spark.createDataFrame([(k, f"president report {k}") for k in range(2019, 2025)], "doc_id long, text string")
    years = docs.select("doc_id", F.when(F.col("doc_id") != 2022, F.col("doc_id")).cast("int").alias("year"))
    asked, seen = [(1, "president before 2022"), (2, "president"), (3, "the president since 2023 and reports after 2023")], {}

    def listing(name):
        def search(q, k):
            seen.setdefault(name, set()).update((r["query_id"]["query_id"], r["query_id"]["part"]) for r in q.collect())
            return q.crossJoin(docs.select("doc_id")).select("query_id", "doc_id", (F.col("doc_id") - 2018).cast("int").alias("rank"))

        return search

    queries = spark.createDataFrame(asked, "query_id int, text string")
    lists = {name: listing(name) for name in ("bm25", "metadata", "structured")}
    got = {}
    for r in routing.routed(queries, lists, years).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["part"], r["score"]))
    strategies = {(r["leg"]["query_id"], r["leg"]["part"]): list(r["strategies"]) for r in routing.legs(queries).collect()}
    assert seen == {n: {leg for leg, s in strategies.items() if n in s} for n in seen}
    assert sorted(d for _, d, _, _ in got[1]) == [2019, 2020, 2021]  # not the one without a year
    assert len(got[2]) == 6  # no bounds, all
    assert {d for _, d, _, _ in got[3]} == {2023, 2024}  # 2023 by the first part alone
    lists_of = lambda leg: sum(n in lists for n in strategies[leg])
    for _, d, part, score in got[3]:
        assert score == round(lists_of((3, part)) / (60 + d - 2018), 6)
    assert routing.routed(queries, {"dense": listing("dense")}, years).filter("query_id = 1").count() == 0
    assert routing.routed(queries, {}).count() == 0


@pytest.mark.parametrize("least", [None, 5, 10**9])
def test_intervals(spark, least):
    rnd = random.Random(4)
    span = lambda: (lambda a, n: (a, a + n))(rnd.randrange(-500, 500), rnd.choice([0, 0, 1, 3, 40, 400, 3000]))
    a = [(k, *span()) for k in range(150)] + [(900, None, 5), (901, 5, None), (902, 9, 3), (903, -(10**6), 10**6)]
    b = [(k, *span()) for k in range(150)] + [(900, None, 5), (902, 9, 3), (904, 0, 0), (904, 0, 0)]
    left, right = spark.createDataFrame(a, "ida long, a0 long, a1 long"), spark.createDataFrame(b, "idb long, b0 long, b1 long")
    joined = intervals.interval_join(left, right, ("a0", "a1"), ("b0", "b1"), least)
    whole = lambda r: None not in r and r[1] <= r[2]
    want = sorted((x[0], y[0]) for x in a for y in b if whole(x) and whole(y) and x[1] <= y[2] and y[1] <= x[2])
    assert sorted((r["ida"], r["idb"]) for r in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(left.limit(0), right, ("a0", "a1"), ("b0", "b1")).count() == 0


def test_intervals_of_times(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    left = spark.createDataFrame([(1, t(1), t(2)), (2, t(5), t(5)), (3, t(0), t(23))], "a int, a0 timestamp_ntz, a1 timestamp_ntz")
    right = spark.createDataFrame([(7, t(2)), (8, t(5)), (9, t(23, 1))], "b int, at timestamp_ntz")
    got = intervals.interval_join(left, right, ("a0", "a1"), ("at", "at"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 7), (2, 8), (3, 7), (3, 8)]


def test_approximate_index(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    odd = [(9000, None), (9001, [0.0] * 24), (9002, [1.0]), (9003, [float("nan")] * 24)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = I.dense(vectors.filter("vec_id < 9000"), queries.filter("query_id < 9000"), 10)
    index = lsh.LshIndex.build(vectors, bits=10)
    assert index.vectors.count() == 3000 and index.placed.count() == 3000 * lsh.TABLES
    assert lsh.recall(index.search(queries, 10, probes=4), exact) >= 0.95
    assert index.candidates(queries, 4).count() < 0.5 * 30 * 3000  # clusters: a few probes, far from all pairs
    index.save(str(tmp_path / "index"))
    again = lsh.LshIndex.load(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, again.search(queries, 5).collect())) == sorted(map(tuple, index.search(queries, 5).collect()))
    none = lsh.LshIndex.build(vectors.limit(0))
    assert none.search(queries, 5).count() == 0


def test_probes_go_by_distance():
    x = np.array([[0.1, -2.0, 0.5]])
    flips = [np.array(c, np.int64) for c in ([], [0], [1], [2], [0, 2])]
    assert lsh.probes_of(x, flips, 4).tolist() == [[0, 1, 4, 5]]


def test_index_search_makes_no_row_a_pair(spark):
    """Copies, repeated ids and several tables: each row counts once, and no join makes pairs of queries and vectors."""
    rng = np.random.default_rng(6)
    rows = [(i % 900, [float(x) for x in rng.normal(size=8)]) for i in range(1000)] + [(2000 + i, [1.0] * 8) for i in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0] * 8), (2, rows[5][1])], "query_id long, q array<float>")
    found = lsh.LshIndex.build(vectors, bits=3).search(queries, 12, probes=8)  # all buckets
    key = lambda r: (r["query_id"], r["vec_id"], r["score"], r["rank"])
    assert sorted(map(key, found.collect())) == sorted(map(key, I.dense(vectors, queries, 12).collect()))
    assert "bucket" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_index_search_after_a_pandas_udf_ran(spark):
    """Its tasks take no module along, whose UDF holds a lock of the session once it has run."""
    assert spark.range(1).select(text.nfkc(F.lit("\ufb01"))).first()[0] == "fi"
    run, _ = lsh.best_in_buckets(np.ones((2, 4)), 4, tables=2, bits=3, seed=1, probes=2, k=2)
    assert b"char_grams" not in cloudpickle.dumps(run)


def test_crowded_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PAIRS", 64, raising=False)
    a = spark.range(200).select("id", (F.col("id") % 3).cast("double").alias("s"))
    b = spark.range(90).select(F.col("id").alias("other"), F.lit(1.0).alias("f"), F.lit(1.5).alias("t"))
    met = intervals.interval_join(a, b, ("s", "s"), ("f", "t"))
    assert met.distinct().count() == met.count() == 90 * 67
    assert met.groupBy(F.spark_partition_id()).count().count() > 8  # one bucket has all pairs


def test_many_pairs_repeat_few_rows(spark, monkeypatch):
    """Cells grow with all pairs, so rows are not repeated for each small cell of a bucket."""
    monkeypatch.setattr(intervals, "PAIRS", 16)
    a = spark.range(4000).select("id", (F.col("id") % 50).cast("double").alias("s"))
    b = spark.range(4000).select(F.col("id").alias("other"), (F.col("id") % 50).cast("double").alias("f"))
    dealt = []
    former = type(a).repartition
    monkeypatch.setattr(type(a), "repartition", lambda df, *more: (dealt.append(df), former(df, *more))[1])
    assert intervals.interval_join(a, b, ("s", "s"), ("f", "f")).count() == 50 * 80 * 80
    assert len(dealt) == 2 and max(x.count() for x in dealt) <= 4 * 4000
