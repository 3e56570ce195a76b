"""The LSH forest against brute force, and its edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import forest
from docmill.llm import queries as registered

DOCS = "doc_id long, text string, lang string, h int, key string, tok double"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + size]) for k in range(max(len(words) - size + 1, 1))) if words else frozenset()


def brute(rows, size, num, den=100):
    """doc_id, set size, component and whether it is kept of each row, by comparing all pairs of different sets."""
    sets = [shingles(r[1], size) for r in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    up = {s: s for s in distinct}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if len(b) * num > len(a) * den:
                break
            both = len(a & b)
            if den * both >= num * (len(a) + len(b) - both):
                up[find(a)] = find(b)
    low = {}
    for r, s in zip(rows, sets, strict=True):
        if s and r[0] is not None:
            low[find(s)] = min(low.get(find(s), r[0]), r[0])
    out = []
    for r, s in zip(rows, sets, strict=True):
        own = low.get(find(s)) if s else r[0]
        out.append((r[0], len(s), own, r[0] == own))
    return sorted(out, key=str)


def corpus(seed, n=160):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice([2, 3, 4, 6, 12, 40, 90]))] for _ in range(n)]
    texts = [" ".join(w) for w in base]
    for k in range(n):
        w = list(base[rnd.randrange(n)])
        for _ in range(rnd.choice([0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        texts.append(" ".join(w).upper() if k % 5 == 0 else "  \n".join(w))
    hot = [f"h{rnd.randrange(10**6)}" for _ in range(120)]
    for k in range(n):  # a third of the rows are near copies of one text, in a chain that drifts
        hot = list(hot)
        hot[rnd.randrange(len(hot))] = f"y{k}"
        texts.append(" ".join(hot))
    return texts


@pytest.mark.parametrize(("region", "part"), [(24, 4096), (3, 20)])
def test_forest(spark, monkeypatch, region, part):
    monkeypatch.setattr(forest, "PART", part)  # several parts of a region that is too large
    rows = [(i, t) for i, t in enumerate(corpus(3))]
    rows += [(None, "no id at all here"), (None, rows[5][1]), (7, "same id other text"), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "two words"), (906, "two  WORDS"), (907, "lang " * 150_000), (908, "lang " * 149_000)]
    rows += [rows[8]] * 30
    df = spark.createDataFrame([(*r, "en", 1, "k", 0.5) for r in rows], DOCS).repartition(7)
    got = forest.near_duplicates(df, size=3, num=85, region=region).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 85)
    assert [f.name for f in forest.near_duplicates(df.limit(0)).schema] == ["doc_id", "n_shingles", "component_id", "kept"]


def test_other_thresholds_and_empty(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(corpus(9, 60))]
    df = spark.createDataFrame([(*r, "en", 1, "k", 0.5) for r in rows], DOCS)
    assert sorted((tuple(r) for r in forest.near_duplicates(df).collect()), key=str) == brute(rows, 5, 80)
    df.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert registered.queries()["op13_minhash_dedup"](spark, str(tmp_path)).count() == 0


def test_crowded_regions(spark):
    """Regions have depths of their own: lists at the first depth of few members, the rest at the full depth."""
    rnd = np.random.default_rng(1)
    rows = []
    for key in range(400):  # of tree 0, all share the first value, then fewer and fewer; 60 share all
        own = [7, key % 2, key, key] if key >= 60 else [7, 0, -1, -1]
        rows.append((*[int(x) for x in own], key, 50, 0))
    rows += [(*[int(x) for x in rnd.integers(0, 1 << 60, 4)], key, 50, 0) for key in range(400, 500)]
    posts = spark.createDataFrame(rows, "t0 long, t1 long, t2 long, t3 long, key long, n int, bits long").repartition(5)
    listed, large = forest.regions(posts, 4, 24)
    assert sorted(r["key"] for r in listed.collect()) == list(range(60, 500))
    assert {(r["tok"], r["c"]) for r in large.collect()} == {(-1, 60)} and large.count() == 60
    assert listed.groupBy("tok").count().agg(F.max("count")).first()[0] <= 24


def test_signatures():
    """Two sets share a prefix of d values in a tree about as often as their similarity to the power d."""
    rng = np.random.default_rng(5)
    both = rng.integers(0, 1 << 63, 170, dtype=np.uint64)
    a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, 15, dtype=np.uint64)])) for _ in range(2))
    same = (np.diff(forest.signatures(np.concatenate([a, b]), np.array([0, len(a)]), 400, (1, 2, 4)), axis=0)[0] == 0).mean(0)
    s = 170 / 200
    assert all(abs(x - s**d) < 0.08 for x, d in zip(same, (1, 2, 4), strict=True))
