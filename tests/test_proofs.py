"""Operators that no query reaches: retries, re-extraction, file names, OCR rates, sub-plans, stored indexes, the ladder's rungs, period bounds."""

import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import documents as D
from docmill.operators import extraction as X
from docmill.operators import ingest as G
from docmill.operators import planner as P
from docmill.operators import retrieve as R
from docmill.operators.store import Index


def test_retried():
    def failing(errors):
        left = list(errors)

        def call():
            if left:
                raise left.pop(0)
            return "done"

        return call

    waits = []
    assert G.retried(failing([OSError("connection reset"), OSError("503 unavailable")]), sleep=waits.append) == "done"
    assert len(waits) == 2 and 0.5 <= waits[0] <= 0.625 and 1.0 <= waits[1] <= 1.25
    with pytest.raises(OSError, match="denied"):  # stays: not tried again
        G.retried(failing([OSError("access denied"), OSError("timeout")]), sleep=waits.append)
    with pytest.raises(OSError, match="timeout"):
        G.retried(failing([OSError("timeout")] * 3), sleep=waits.append)
    assert len(waits) == 4
    cause = OSError("outer")
    cause.__cause__ = OSError("timeout")
    assert G.retried(failing([cause]), sleep=waits.append) == "done"
    waits.clear()
    assert G.retried(failing([OSError("timeout")] * 9), tries=10, first=1.0, most=4.0, sleep=waits.append) == "done"
    assert max(waits) <= 5.0 and all(4.0 <= w for w in waits[2:])


def test_safe_name():
    assert G.safe_name("a b.txt") == "a b.txt" and G.safe_name("..hidden") == "..hidden"
    for bad in ("", "../x", "a/../b", "/etc/passwd", "~root", "..", "a\\..\\b", "x\0"):
        with pytest.raises(ValueError, match="leaves its folder"):
            G.safe_name(bad)


def test_reextract(spark):
    files = spark.createDataFrame([("/a/1.txt", "text/plain"), ("/b/1.pdf", "application/pdf"), ("/a/2.txt", "text/plain"), ("/a/3.txt", "text/plain")], "path string, kind string")
    got = G.reextract(files, spark.createDataFrame([("1",), ("3",), ("1",), ("9",)], "id string"))
    assert sorted((r["id"], r["path"]) for r in got.collect()) == [("1", "/a/1.txt"), ("3", "/a/3.txt")]


def test_ocr_quality(spark):
    rows = [(1, "total 100 and 2,5", "total 100 and 2,5"), (2, "tota1 l00", "total 100"), (3, "no reference 1.2.3", None), (4, None, "all lost"), (5, "", "")]
    got = {r["doc_id"]: r for r in X.ocr_quality(spark.createDataFrame(rows, "doc_id int, text string, reference string")).collect()}
    assert (got[1]["cer"], got[1]["wer"], got[1]["numeric"], got[1]["words"]) == (0.0, 0.0, 1.0, 4)
    assert 0 < got[2]["cer"] < 0.5 and got[2]["wer"] == 1.0
    assert got[3]["cer"] is None and got[3]["chars"] == 18
    assert (got[4]["cer"], got[4]["wer"], got[4]["chars"]) == (1.0, 1.0, 0) and got[5]["cer"] is None


def test_sub_plans(spark):
    asked = spark.createDataFrame([(1, "compare the fees and who is the president"), (2, "budget")], "query_id int, text string")
    got = sorted((r["query_id"], r["part"], r["text"], r["intent"], list(r["strategies"])) for r in P.sub_plans(P.plans(asked)).collect())
    assert got == [(1, 0, "compare the fees", "comparison", list(P.STRATEGIES["comparison"])), (1, 1, "who is the president", "exact_lookup", list(P.STRATEGIES["exact_lookup"]))]


def test_supported_kinds():
    assert len(G.SUPPORTED_KINDS) == 13 and set(G.SUPPORTED_KINDS) <= set(G.EXTENSIONS)


def test_stored_index(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "9f8e7d6c5b4a39281706f5e4d3c2")], "query_id int, text string")
    meant = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>")
    hits = lambda df: sorted((r["query_id"], r["doc_id"]) for r in df.collect())
    assert hits(index.bm25(asked, 5)) == hits(index.exact(asked, 5)) == hits(index.dense(meant, 5)) == []  # nothing stored yet
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma 9f8e7d6c5b4a39281706f5e4d3c2"), (3, "beta")], "doc_id long, text string")
    index.add(docs, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>"))
    assert hits(index.bm25(asked, 5)) == [(1, 1), (1, 3), (2, 2)]
    assert (2, 2) in hits(index.exact(asked, 5)) and hits(index.dense(meant, 1)) == [(1, 1)]
    index.add(spark.createDataFrame([(1, "delta")], "doc_id long, text string"))  # replaces, its vector too
    index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    want = hits(index.bm25(asked, 5))
    assert want == [(2, 2)] and hits(index.dense(meant, 5)) == [(1, 2)]
    index.compact()
    assert hits(index.bm25(asked, 5)) == want and len(index.numbers()) == 1
    index.add(docs.filter("doc_id = 3"))
    assert hits(index.bm25(asked, 5)) == [(1, 3), (2, 2)]
    index.clear()
    assert index.numbers() == []


def test_compaction_that_breaks_off(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(k, "alpha") for k in range(4)], "doc_id long, text string")
    index.add(docs.filter("doc_id < 2"))
    index.add(docs.filter("doc_id >= 2"))
    with monkeypatch.context() as m:
        m.setattr("docmill.operators.store.remove", lambda spark, path: None)  # the old segments are still there
        index.compact()
    assert len(index.numbers()) == 3 and index.table("lengths").count() == 4 and index.table("postings").count() == 4


@pytest.mark.parametrize(("hits", "rung"), [(3, 0), (40, 1), (-1, 2), (-2, 3), (-3, 4), (-4, 5)])
def test_every_rung_of_the_ladder(spark, hits, rung):
    """A search that suffices only for the form of the query that a rung asks."""
    texts = {2: '"mtg sponsor!"', 3: "meeting sponsor", 4: "meeting sponsor!"}
    seen = []

    def search(queries, k):
        seen.append((k, sorted(r["text"] for r in queries.collect())))
        score = F.when(F.col("text") == texts.get(rung, "mtg sponsor!"), 0.9).otherwise(0.1)
        many = 20 if rung > 0 else 3
        enough = k if rung == 1 and k >= 50 else 3 if rung != 1 else 1
        rows = queries.withColumn("doc_id", F.explode(F.sequence(F.lit(1), F.lit(min(many, enough))))).withColumn("rank", F.col("doc_id").cast("int"))
        plain = F.lit(0.1) if rung == 5 or rung == 1 and k < 50 else score
        return rows.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), plain.alias("score"), "rank")

    got = R.ladder(spark.createDataFrame([(1, "mtg sponsor!")], "query_id int, text string"), search).collect()
    assert {r["rung"] for r in got} == {rung} and got
    assert len(seen) == rung + 1


def test_canonical_by_time(spark):
    rows = [(1, "Same text", 30), (2, "same  TEXT", 10), (3, "same text", 30), (4, "other", 5), (5, "same text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, modified int")
    assert {r["canonical"] for r in D.exact_clusters(docs, "modified").collect()} == {3}
    assert {r["canonical"] for r in D.exact_clusters(docs).collect()} == {5}
    assert {r["doc_id"]: r["canonical"] for r in D.aliases(docs, "modified").collect()} == dict.fromkeys((1, 2, 3, 5), 3)


def test_claims(spark):
    text = "Ncell gave NPR 500,000; CG gave 300000 [2:7]. Label: Word. The of. • A sentence with five words. Ncell gave NPR 500,000. " + "x" * 120 + " one 1. " + "x" * 120 + " two 2."
    got = [r["claim"] for r in X.claims(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).orderBy("n").collect()]
    assert got[:2] == ["Ncell gave NPR 500,000", "CG gave 300000 ."] or got[0] == "Ncell gave NPR 500,000"
    assert sum("x" * 120 in c for c in got) == 2  # equal for over 100 characters, and still two
    short = X.claims(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], prefix=100)
    assert sum("x" * 120 in r["claim"] for r in short.collect()) == 1
    parts = "; ".join(f"part number {k}" for k in range(6)) + "."
    assert X.claims(spark.createDataFrame([(1, parts)], "id int, text string"), ["id"]).count() == 1


def test_greedy_long_chain(spark):
    from docmill.operators import answers as A

    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(12)]
    rnd.shuffle(edges)
    assert sorted(map(tuple, A.greedy_matches(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())) == sorted(edges)[::2]


def test_located_chunks(spark):
    rows = [(1, 0, "heading", 1, "Fees of 2024", 1), (1, 1, "paragraph", 0, "a" * 700, 1), (1, 2, "paragraph", 0, "b" * 700, 2), (1, 3, "paragraph", 0, "same", 3), (1, 4, "table", 0, "x | y", 3), (1, 5, "paragraph", 0, "same", None)]
    got = sorted(D.located_chunks(spark.createDataFrame(rows, "doc_id long, n int, kind string, level int, block string, page int")).collect(), key=lambda r: r["n"])
    assert [(r["kind"], r["page_first"], r["page_last"]) for r in got] == [("heading", 1, 1), ("text", 1, 2), ("text", 3, 3), ("table", 3, 3), ("text", None, None)]
    assert len({r["chunk_id"] for r in got}) == 5 and got[2]["parent"] == got[1]["chunk_id"] and got[2]["text"] == "b" * 100 + "\n\nsame"
    assert [r["parent"] for r in got if r["n"] != 2] == [None] * 4
    twice = D.chunks(spark.createDataFrame([(1, "p" * 400 + "\n" + "p" * 400 + "\n" + "p" * 400)], "doc_id long, text string"))
    assert twice.count() == twice.select("chunk_id").distinct().count() > 1


def test_stored_tables(spark, tmp_path):
    from docmill.operators import structured as S

    df = spark.createDataFrame([("Ncell", 5), ("CG", 3)], "sponsor string, amount int")
    when = [f"2024-01-0{k} 00:00:00" for k in (1, 2)]
    stamp = lambda s: spark.sql(f"SELECT timestamp'{s}' AS t").first()["t"]
    one = S.stored_table(spark, "sponsors", df, str(tmp_path), stamp(when[0]), {"filename": "a.csv", "page": "3"}, "d1")
    registry = S.upsert(S.upsert(one.limit(0), one), S.stored_table(spark, "fees", df.limit(1), str(tmp_path), stamp(when[1]), {}))
    assert [(r["table_id"], r["rows"], r["doc_id"]) for r in S.list_tables(registry).collect()] == [("fees", 1, None), ("sponsors", 2, "d1")]
    assert spark.read.parquet(f"{tmp_path}/sponsors").count() == 2 and S.provenance_of(spark, f"{tmp_path}/sponsors") == {"filename": "a.csv", "page": "3"}
    assert S.provenance_of(spark, f"{tmp_path}/fees") == {} == S.provenance_of(spark, f"{tmp_path}/none")
    again = S.stored_table(spark, "fees", df, str(tmp_path), stamp(when[1]), {"filename": "b.csv"})
    assert S.upsert(registry, again).filter("table_id = 'fees'").first()["rows"] == 2
    assert [r["table_id"] for r in S.find_tables(registry, "spons").orderBy("table_id").collect()] == ["fees", "sponsors"]


def test_exports_are_read_back(spark, tmp_path):
    from docmill.sources import files

    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "d\te")], "id long, text string")
    for kind in ("json", "csv", "tsv", "parquet", "markdown"):
        files.export(df, str(tmp_path / kind), kind)
    rows = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect())) == rows
    assert sorted((r["id"], r["text"]) for r in spark.read.schema("id long, text string").json(str(tmp_path / "json")).collect()) == rows
    read = lambda sep, kind: sorted(map(tuple, spark.read.csv(str(tmp_path / kind), header=True, sep=sep, schema="id long, text string", escape="\\").collect()))
    assert read(",", "csv") == rows and read("\t", "tsv") == rows
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert sorted(lines) == ['| 1 | a "b", c |', "| 2 |  |", "| 3 | d\te |"]
    for bad in (("../out", "csv"), ("out", "xlsx")):
        with pytest.raises(ValueError):
            files.export(df, *bad)
