"""Quantiles by ranks against Spark's own aggregate."""

import random

from pyspark.sql import functions as F

from docmill.plans.relational import exact_quantiles


def test_exact_quantiles(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.choice([None, float(rnd.randrange(50)), rnd.random()])) for g in ("a", "b", None) for _ in range(700)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = exact_quantiles(df, "g", "v", {"p0": 0.0, "p25": 0.25, "p90": 0.9})
    want = df.groupBy("g").agg(*[F.percentile("v", q) for q in (0.0, 0.25, 0.9)])
    plain = lambda rows: sorted((str(r[0]), *[None if x is None else round(x, 9) for x in r[1:]]) for r in rows)
    assert plain(got.collect()) == plain(want.collect())
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()  # which holds a group's values in one task
