"""What the search operators once left out."""

from pyspark.sql import functions as F

from docmill.operators import index


def test_dense_takes_any_number_of_queries(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i % 20)]) for i in range(2500)], "query_id long, q array<double>")
    got = index.dense(vectors, queries, 3).collect()
    assert len(got) == 7500 and {r["query_id"] for r in got} == set(range(2500))
    assert all(r["vec_id"] == r["query_id"] % 20 for r in got if r["rank"] == 1 and r["query_id"] % 20 < 4)


def test_exact_search_finds_parts_of_long_ids(spark):
    whole = "1AbCdEfGhIjKlMnOpQrStUvWxYz_0123456789"
    docs = spark.createDataFrame([(1, f"see {whole} there"), (2, "nothing of the kind, Mr Smith")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, whole[3:28]), (2, whole[3:20]), (3, f"x{whole}y")], "query_id int, text string")
    got = {(r["query_id"], r["doc_id"]) for r in index.exact_search(index.entity_index(docs), queries, 10).collect()}
    assert got == {(1, 1), (3, 1)}


def test_dense_forms_products_in_blocks(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3) - 1.0]) for i in range(5000)] + [(-1, None), (-2, [0.0, 0.0, 0.0]), (-3, [1.0, None, 1.0]), (-4, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows) if i % 100 == 0 or r[0] < 0], "query_id long, q array<float>")
    found = index.dense(vectors, queries, 4)
    pairs = vectors.crossJoin(queries).select("query_id", "vec_id", index.cosine(F.col("embedding"), F.col("q")).alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.top(pairs, 4, "vec_id", 5).select(found.columns).collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[: plan.index("Join")]  # packed blocks are joined, not single rows


def test_dense_puts_nan_first(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = index.dense(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>"), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1] and got[0]["score"] != got[0]["score"] and got[1]["score"] == 1.0
