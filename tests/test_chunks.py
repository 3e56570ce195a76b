"""Chunks against plain versions, and metrics and sorts whose order SQL does not show."""

from pyspark.sql import functions as F
from docmill.operators import documents as D
from docmill.plans import catalogue
from docmill.session import table

SF = "/root/testdata/sf0.001"


def windows(paras, most):
    """Runs of paragraphs; each run starts with the one before's last paragraph and takes the next in any case."""
    out, start = [], 0
    while paras:
        end = start + (2 if out else 1)
        while end < len(paras) and sum(map(len, paras[start : end + 1])) <= most:
            end += 1
        out.append("\n\n".join(paras[start:end]))
        if end >= len(paras):
            break
        start = end - 1
    return out


def test_chunk_baseline(spark):
    want = []
    for r in table(spark, SF, "documents").select("doc_id", "text").collect():
        paras = [p.strip() for p in (r["text"] or "").split("\n")]
        want += [(r["doc_id"], n, text) for n, text in enumerate(windows([p for p in paras if p], 500))]
    got = catalogue.queries()["chunk_baseline"](spark, SF).select("doc_id", "n", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_chunks_of_long_and_empty_texts(spark):
    rows = [(1, "a" * 700 + "\n" + "b" * 700 + "\nc"), (2, ""), (3, None), (4, " \n \n"), (5, "x"), (5, "x")]
    got = sorted(map(tuple, D.chunks(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n", "text").collect()))
    assert got == [(1, 0, "a" * 700), (1, 1, "a" * 700 + "\n\n" + "b" * 700), (1, 2, "b" * 700 + "\n\nc"), (5, 0, "x"), (5, 0, "x")]


def test_structural_chunks(spark):
    long = "".join(f"{i:04d}" for i in range(325))
    blocks = [(1, 0, "heading", 1, "Intro"), (1, 1, "paragraph", 0, "alpha"), (1, 2, "paragraph", 0, "beta"), (1, 3, "heading", 2, "Details"), (1, 4, "paragraph", 0, "gamma"), (1, 5, "table", 0, long), (2, 0, "paragraph", 0, " ")]
    got = D.structural_chunks(spark.createDataFrame(blocks, "doc_id long, n int, kind string, level int, block string")).collect()
    assert [tuple(r)[2:] for r in sorted(got, key=lambda r: (r["doc_id"], r["n"]))] == [
        ("heading", "Intro", "Intro"),
        ("text", "Intro", "alpha\n\nbeta"),
        ("heading", "Intro > Details", "Details"),
        ("text", "Intro > Details", "gamma"),
        ("table", "Intro > Details", long[:600]),
        ("table", "Intro > Details", long[500:600] + "\n\n" + long[600:1200]),
        ("table", "Intro > Details", long[1100:1200] + "\n\n" + long[1200:]),
    ]


def test_near_duplicate_greedy(spark):
    pairs = sorted((r["a"], r["b"]) for r in catalogue.queries()["near_duplicate_pairs"](spark, SF).collect())
    used, want = set(), []
    for a, b in pairs:
        if a not in used and b not in used:
            want.append((a, b))
            used |= {a, b}
    assert sorted(map(tuple, catalogue.queries()["near_duplicate_greedy"](spark, SF).collect())) == want


def test_orders_of_sorted_queries(spark):
    rows = [(r["v"], r["k"]) for r in catalogue.queries()["sort_nulls"](spark, SF).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])) and rows[-1][0] is None
    balances = [r["c_acctbal"] for r in catalogue.queries()["nl_sort"](spark, SF).collect()]
    assert balances in (sorted(balances), sorted(balances, reverse=True))


def test_documents_need_no_group_or_frame_each(spark):
    from docmill.operators import documents

    docs = spark.createDataFrame([(1, "HEAD\nbody"), (2, None)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = documents.structural_chunks(documents.blocks(docs, "\n").withColumn("level", F.lit(1)))
    assert "InPandas" not in plan(found) + plan(documents.chunks(docs)) and found.count() == 1
    assert [tuple(r)[:3] for r in documents.chunks(docs).collect()] == [(1, 0, "HEAD\n\nbody")]
