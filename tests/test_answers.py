"""Operators on questions, answers, provenance and samples that SQL cannot express, against small cases."""

import random

from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import answers as A
from docmill.operators import documents as D


def test_intents(spark):
    asked = spark.createDataFrame([(1, "Who was President of Kathmandu University and when"), (2, ""), (3, None)], "query_id int, text string")
    got = {r["query_id"]: r for r in A.intents(asked).collect()}
    assert got[1]["entity"] == "President" and got[1]["parts"] == ["Who was President of Kathmandu University", "when"]
    assert got[2]["intent"] == "semantic" and got[3]["intent"] == "semantic"


def test_year_check(spark):
    asked = spark.createDataFrame([(1, "budget 2024"), (2, "budget 2023"), (3, "budget"), (4, "budget 2022")], "query_id int, text string")
    items = spark.createDataFrame([(1, "in 2024 we"), (2, "no 2023 records"), (4, None)], "query_id int, text string")
    assert {r["query_id"]: r["found"] for r in A.year_check(asked, items).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_numbers_in(spark):
    texts = ["Sponsors contributed Rs. 50,000 in 2024.", "1,000 and 75000; 5 lakh", "none", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", V.numbers_in(F.col("text")).alias("m"))
    got = {r["id"]: [(texts[r["id"]][m["start"] : m["end"]] == m["raw"], m["number"]["value"]) for m in r["m"] or []] for r in df.collect()}
    assert got == {0: [(True, 50000.0)], 1: [(True, 1000.0), (True, 75000.0), (True, 500000.0)], 2: [], 3: [], 4: []}


def test_char_grams(spark):
    texts = ["abcdefab", "ABC", "a\nb\nc\nd", "x\U0001f600yz\U0001f601w", "", "aaaaaaa"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.char_grams(F.col("t"), 4).alias("g")).collect()
    for r in got:
        low = r["t"].lower()
        assert sorted(r["g"]) == sorted({low[i : i + 4] for i in range(len(low) - 3)} if len(low) >= 4 else {low})


def test_near_pairs_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcde ") for _ in range(60)) for _ in range(8)]
    rows = [(i, "".join(c if rnd.random() > 0.03 else "z" for c in rnd.choice(base))) for i in range(60)] + [(90, ""), (91, None), (92, base[0]), (93, base[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = {}
    for i, t in rows:
        if t is not None:
            one.setdefault(t, i)
    sets = {i: {t[k : k + 4] for k in range(len(t) - 3)} or {t} for t, i in one.items()}
    want = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.6}
    assert want
    for block, at_once in ((1024, 1 << 20), (3, 16)):
        monkeypatch.setattr(D, "LIST_BLOCK", block)
        monkeypatch.setattr(D, "PAIRS_AT_ONCE", at_once)
        assert {(r["a"], r["b"]) for r in D.near_pairs(docs).collect()} == want


def test_near_pairs_measures_few(spark, monkeypatch):
    """Texts of one alphabet share their grams, rare ones too; only pairs that are near are measured."""
    rnd, measured = random.Random(4), []
    texts = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(300, 500))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (500, texts[3][:-20]), (501, texts[3] + texts[4][:30])], "doc_id long, text string")
    former = D.measured
    monkeypatch.setattr(D, "measured", lambda pairs, *more: (measured.append(pairs.count()), former(pairs, *more))[1])
    assert {(r["a"], r["b"]) for r in D.near_pairs(docs).collect()} == {(3, 500), (3, 501), (500, 501)}
    assert measured[0] < 10


def test_greedy_matches_of_a_group_takes_few_rounds(spark, monkeypatch):
    edges = [(a, b) for a in range(60) for b in range(a + 1, 60)] + [(100 + i, 101 + i) for i in range(20)]
    pairs, rounds = spark.createDataFrame(edges, "a long, b long").repartition(5), []
    former = A.written
    monkeypatch.setattr(A, "written", lambda df, name: (rounds.append(name), former(df, name))[1])
    want = [(i, i + 1) for i in range(0, 60, 2)] + [(100 + i, 101 + i) for i in range(0, 20, 2)]
    for last in (1 << 20, 1600):  # at once, and after rounds
        monkeypatch.setattr(A, "LAST_EDGES", last, raising=False)
        rounds.clear()
        assert sorted(map(tuple, A.greedy_matches(pairs).collect())) == want
        assert len(rounds) < 20


def test_greedy_matches(spark):
    rnd = random.Random(2)
    edges = sorted({tuple(sorted(rnd.sample(range(30), 2))) for _ in range(60)})
    used, want = set(), []
    for a, b in edges:
        if a not in used and b not in used:
            want.append((a, b))
            used |= {a, b}
    assert sorted(map(tuple, A.greedy_matches(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert A.greedy_matches(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(8)]
    assert sorted(map(tuple, A.greedy_matches(spark.createDataFrame(chain, "a long, b long")).collect())) == chain[::2]


def test_repair_provenance(spark):
    known = spark.createDataFrame([("d1", "one.txt", 3), ("f2", "two.txt", 5)], "key string, filename string, page int")
    cand = spark.createDataFrame([("d1", None, None), ("d9", "f2", None), ("d8", None, "own.txt")], "doc_id string, file_id string, filename string")
    got = {r["doc_id"]: (r["filename"], r["page"]) for r in A.repair_provenance(cand, known, ["doc_id", "file_id"], ["filename", "page"]).collect()}
    assert got == {"d1": ("one.txt", 3), "d9": ("two.txt", 5), "d8": ("own.txt", None)}


def test_cache(spark):
    entries = spark.createDataFrame([("a", 3), ("b", 9), ("c", 3)], "key string, accessed int")
    assert [r["key"] for r in A.cache_evict(entries, 2).collect()] == ["b", "a"]


def test_stratified_sample(spark):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(50)], "doc_id int, kind string")
    got = A.stratified_sample(rows, "kind", "doc_id", 10)
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"x": 10, "y": 10}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, A.stratified_sample(rows, "kind", "doc_id", 10).collect()))


def test_quality_trims_spaces_only(spark):
    df = spark.createDataFrame([(1, "0 nine 0\n  1 one 1  \n \n")], "doc_id long, text string")
    r = D.quality(df).first()
    assert (r["chars"], r["blocks"]) == (len("0 nine 0") + len("1 one 1"), 2)
