"""Whitening and hard negatives against plain versions, with their edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import negatives, whitening
from docmill.llm import queries as registered

VECTORS = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(n, d, seed, near=0):
    """n rows; `near` of them are near copies of one vector."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 1) * (1 + k) for k in range(d)], rnd.randrange(4)) for i in range(n)]
    for i in range(0, near):
        rows[i * n // max(near, 1)] = (i * n // max(near, 1), [x + rnd.gauss(0, 0.01) for x in rows[n // 2][1]], 1)
    return rows


def odd(d):
    """Rows that take no part, repeated rows, a null id."""
    return [(9001, None, 1), (9002, [1.0] * (d - 1) + [None], 1), (9003, [NAN] + [1.0] * (d - 1), 1), (9004, [1.0] * (d - 1) + [-INF], 1), (9005, [], 1), (9006, [1.0] * (d + 1), 1), (9100, [2.5] * d, None), (None, [0.5] * d, 2)]


def plain_whitening(rows, d, scale=256):
    x = {i: None for i in range(len(rows))}
    for i, (_, v, _) in enumerate(rows):
        if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v):
            x[i] = [math.floor(scale * c) for c in v]
    fit = sorted({tuple(v) for v in x.values() if v is not None})
    n, sums = len(fit), [sum(v[k] for v in fit) for k in range(d)]
    c = np.array([[n * v[k] - sums[k] for k in range(d)] for v in fit], float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        if x[i] is not None:
            y = [n * a - s for a, s in zip(x[i], sums, strict=True)]
            out.append((vec_id, n, sum(a * a for a in y), np.array(y, float) / n @ axes / np.sqrt(values), values / np.trace(c.T @ c / n)))
    return out


@pytest.mark.parametrize("big", [1.0, 1e9])
def test_whitening(spark, tmp_path, big):
    d = 6
    rows = [(i, v and [c if c is None else c * big for c in v], k) for i, v, k in vectors(150, d, 5) + odd(d)]
    rows += [rows[3]] * 40 + [(7, rows[9][1], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("mine")).withColumn("whitened", F.lit(1)).withColumn("n", F.lit(None).cast("int")).repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in registered.queries()["op11_whitening"](spark, str(tmp_path)).collect():
        got.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["identity_error"] <= 1e-9
    want = plain_whitening(rows, d)
    fits = lambda t: t if t < 1 << 63 else None
    assert sum(len(v) for v in got.values()) == 4 * len(want)
    signs = {}
    for vec_id, n, deviation, w, explained in want:
        own = sorted(got[vec_id, fits(deviation)], key=lambda r: r["component"])[: 4 * 41]
        for r in own:
            k = r["component"] - 1
            assert r["n"] == n and abs(r["explained"] / explained[k] - 1) < 1e-9
            if len(own) == 4 and abs(w[k]) > 1e-3:
                assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-6
                signs.setdefault(k, set()).add(np.sign(r["whitened"]) == np.sign(w[k]))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_whitening_without_variance(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return registered.queries()["op11_whitening"](spark, f"{tmp_path}/{name}").collect()

    assert run([], "none") == [] and run([(1, None, 0), (2, [], 0)], "unusable") == []
    one = run([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], "one")
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(1, 1, 0, None, 0.0, None)] * 2 + [(2, 1, 0, None, 0.0, None)] * 2
    line = run([(k, [float(k), 2.0 * k, 0.0], 0) for k in range(5)], "line")  # all variance in one component
    first = sorted((r["vec_id"], r["whitened"]) for r in line if r["component"] == 1)
    assert len(line) == 15 and abs(abs(first[0][1]) - math.sqrt(2)) < 1e-9 and all(r["whitened"] is None and r["explained"] == 0 for r in line if r["component"] > 1)
    huge = run([(1, [1e300, -1e300], 0), (2, [1.0, 2.0], 0), (3, [-5.0, 1.0], 0)], "huge")
    assert len(huge) == 6 and {r["deviation"] for r in huge} == {None}


def plain_negatives(rows, positives=5, negatives=5, low=80, high=100):
    d = 5
    used = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * c) for c in v]) for i, v, k in rows if i is not None and k is not None and v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, label, v) in enumerate(used):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, other, w) in enumerate(used) if b != a)
        for s, j, _ in [t for t in scored if t[2]][:positives]:
            fit = [(t, m) for t, m, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fit, 1)]
    return out


def test_hard_negatives(spark, tmp_path, monkeypatch):
    d = 5
    rows = [(i, v, k) for i, v, k in vectors(900, d, 8, near=300)] + odd(d)
    rows += [(400, [1.0] * d, 1)] * 3 + [(401 + k, [1.0] * d, 2) for k in range(12)] + [(500, [0.0] * d, 1), (600, [-3.0] * d, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("rid", F.lit("x")).withColumn("far", F.lit(1)).repartition(6)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = sorted(plain_negatives(rows))
    assert len(want) > 100
    assert sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)  # several blocks of anchors, and results that do not fit at once
    monkeypatch.setattr(negatives, "HELD", 10)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    assert sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, str(tmp_path)).collect()) == want
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_scores(spark):
    """Products beyond what doubles hold exactly, and vectors too long to have a score."""
    big = 2.0**21
    rows = [(0, [big, big + 1], 1), (1, [big, big], 1), (2, [big - 1, big], 2), (3, [big - 2, big], 2), (4, [1e200, 1.0], 1)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0).collect()
    x = {i: [int(256 * c) for c in v] for i, v, _ in rows[:4]}
    dot = lambda i, j: sum(a * b for a, b in zip(x[i], x[j], strict=True))
    assert sorted(tuple(r) for r in got) == [(0, 1, k - 1, k, dot(0, 1), dot(0, k)) for k in (2, 3)]


def test_pivots_skip_blocks(spark):
    """Brackets hold all scores, and exclude rows where there are groups."""
    rng = np.random.default_rng(2)
    x = np.round(100 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 600)] + 0.02 * rng.normal(size=(600, 8)))).astype(np.int64)
    most = float((x**2).sum(1).max()) + 1
    points = negatives.augmented(x, most)
    pivots = negatives.farthest(points, 12)
    far = negatives.apart(points, pivots)
    near = negatives.apart(np.hstack([x[:50].astype(float), np.zeros((50, 1))]), pivots)
    low, high = negatives.brackets(near, far, far, (x[:50] ** 2).sum(1).astype(float), most)
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, 1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.6
    assert len(negatives.farthest(np.ones((5, 3)), 4)) == 1
