"""Steps whose time had grown too fast: what they do in one pass is still the whole job."""

import hashlib

from pyspark.sql import functions as F

from docmill.plans import operations


def test_page_files_keep_pages_of_one_id_apart(spark, tmp_path):
    html = ["<p>a</p>\n", "", "<p>b</p>\r\n\n", None, "é"]
    rows = [(7, html[0]), (7, html[0]), (7, html[1]), (-3, html[2]), (8, html[3]), (9, html[4])]
    spark.createDataFrame(rows, "page_id long, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, operations.page_files(spark, str(tmp_path)).collect()))
    assert got == sorted((k, hashlib.sha256(t.encode()).hexdigest(), len(t), None) for k, t in rows if t is not None)


def test_files_that_are_written_stay_in_their_folder(spark, tmp_path):
    from docmill.sources import extractors as X

    X.register_source(spark)
    rows = spark.createDataFrame([("a/b.txt", "one"), ("c.txt", "two")], "path string, content string")
    for _ in range(2):  # a second run replaces
        rows.write.format("docmill_files").mode("append").save(f"{tmp_path}/out")
    found = spark.read.format("docmill_files").load(f"{tmp_path}/out")
    assert sorted((r["path"].rpartition("out/")[2], r["text"]) for r in found.collect()) == [("a/b.txt", "one"), ("c.txt", "two")]
    try:
        rows.withColumn("path", F.lit("../x.txt")).write.format("docmill_files").mode("append").save(f"{tmp_path}/out")
    except Exception as e:
        assert "leaves its folder" in str(e)
    assert not (tmp_path / "x.txt").exists()


def test_mentions_are_found_a_batch_at_once(spark):
    from docmill.functions import tabled

    rows = spark.createDataFrame([(1, "Rs. 1,200 in 2024 or 5 lakh", [1.5]), (2, None, None), (3, "none", [])], "id int, said string, more array<double>")
    found = tabled.mentions(rows, "said")
    assert "ArrowEvalPythonUDTF" in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["id"], r["more"], r["n"], r["start"], r["end"], r["raw"], r["number"]["value"], r["number"]["unit"]) for r in found.orderBy("n").collect()]
    assert got == [(1, [1.5], 0, 0, 9, "Rs. 1,200", 1200.0, None), (1, [1.5], 1, 21, 27, "5 lakh", 500000.0, "lakh")]


def test_exact_search_over_texts_finds_what_the_whole_index_gives(spark):
    import random

    from docmill.operators import index

    r = random.Random(5)
    bits = ("Npr Smith", "Rs Usd Apache", "Rs Und Der", "NPR 1,2.5", "NPR,", "npr500", "rs.5", "Rs.  7", "2024-01-05", "1999", "$1,0", "ABC", "É", "555-123-4567", "5551234567", "5 Lakh", "usd 5 million", "a@b", ",", "\n")
    texts = [(k, "".join(r.choice(bits) + r.choice((" ", "")) for _ in range(6))) for k in range(3000)] + [(-1, None), (-2, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = "smith apache der abc npr500 npr rs 5 7 10 2024-01-05 1999 555-123-4567 5551234567 lakh million É usd"
    for words in (words, "smith", "5", "zzz", "", words + " " + "a" * 28):
        asked = spark.createDataFrame([(1, words), (2, "abc")], "query_id int, text string")
        over, whole = index.exact_over(docs, asked, 5000), index.exact_search(index.entity_index(docs), asked, 5000)
        assert sorted(map(tuple, over.collect())) == sorted(map(tuple, whole.collect()))
    tokens = index.entity_index(docs, terms=["abc"]).select("token").distinct().collect()
    assert {t["token"] for t in tokens} >= {"ABC", "abc"} and not any("@" in t["token"] for t in tokens)


def test_a_frequent_words_postings_lie_in_several_files(spark, tmp_path):
    from docmill.operators.store import Index

    name = "spark.sql.adaptive.enabled"
    former = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id = 0 THEN null WHEN id = 1 THEN '' ELSE concat('word word w', id % 3) END AS text")
        index = Index(spark, f"{tmp_path}/index")
        index.add(rows)
        for _ in range(2):
            postings = index.table("postings")
            files = postings.withColumn("file", F.input_file_name()).filter("term = 'word'")
            assert files.select("file").distinct().count() > 1 and files.count() == 3998
            assert postings.groupBy().agg(F.sum("tf")).collect()[0][0] == 3 * 3998 and postings.filter("dl <> 3").count() == 0
            lengths = {r["dl"]: r["count"] for r in index.table("lengths").groupBy("dl").count().collect()}
            assert lengths.pop(3) == 3998 and lengths.pop(0) == 1 and list(lengths.values()) == [1]
            index.compact()
    finally:
        spark.conf.set(name, former)
