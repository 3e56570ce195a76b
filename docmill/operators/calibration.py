"""Whether scores mean what they say: reliability bins, their errors, and an isotonic fit that mends them.

Rows have a score between 0 and 1 and a label 0 or 1; rows without either, or with a score that is not a number, take no part.

The fit pools adjacent violators. Pooling is exact however the rows are grouped, as long as they stay in the order of
their scores: a part's blocks can stand for its rows. So rows are added up by score, each range of scores is pooled in
its own task, and the blocks that are left, of neighbouring ranges together, are pooled again until one task has all
of them. A block carries its sum and weight only, and at each step a task reads its rows one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "low double, high double, total double, weight double"
#: Parts of the first step, and how many go together in each later one.
PARTS, FAN = 64, 16


def usable(rows: DataFrame) -> DataFrame:
    scored = rows.select(F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label"))
    return scored.filter("score is not null and label is not null and not isnan(score) and not isnan(label)")


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean_score, mean_label, gap of each of `bins` equal ranges of scores that has rows; a score of 1 is in the last."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    each = usable(rows).withColumn("bin", F.greatest(place, F.lit(0))).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("label").alias("l"))
    return each.select("bin", "n", F.round("s", 6).alias("mean_score"), F.round("l", 6).alias("mean_label"), F.round(F.abs(F.col("s") - F.col("l")), 6).alias("gap"))


def errors(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, ece (mean gap of the bins, by their rows), worst (largest gap), brier (mean squared error)."""
    found = usable(rows)
    place = F.greatest(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)), F.lit(0))
    each = found.groupBy(place.alias("bin")).agg(F.count("*").alias("c"), F.abs(F.avg("score") - F.avg("label")).alias("gap"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("square"))
    return each.agg(F.sum("c").alias("n"), F.round(F.sum(F.col("gap") * F.col("c")) / F.sum("c"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("worst"), F.round(F.sum("square") / F.sum("c"), 6).alias("brier"))


def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (low, high, total, weight) in the order of scores, pooled until their means rise."""
    stack: list[list[float]] = []
    for f in frames:
        for low, high, total, weight in f.itertuples(index=False):
            block = [low, high, total, weight]
            while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:  # the mean before is no smaller
                before = stack.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            stack.append(block)
    yield pd.DataFrame(stack, columns=["low", "high", "total", "weight"])


def isotonic(rows: DataFrame) -> DataFrame:
    """low, high, value, weight: the rising steps nearest to the labels; a step holds for the scores from low to high."""
    # the same function by value: workers need no copy of the library
    run = lambda frames: pool_of(frames)
    pool_of = pool
    sums = usable(rows).groupBy("score").agg(F.sum("label").alias("total"), F.count("*").cast("double").alias("weight"))
    blocks = sums.select(F.col("score").alias("low"), F.col("score").alias("high"), "total", "weight")
    parts = PARTS
    while True:
        blocks = blocks.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInPandas(run, BLOCKS)
        if parts == 1:
            break
        parts = max(1, parts // FAN)
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("value"), "weight")


def calibrated(rows: DataFrame, steps: DataFrame, score: Column | None = None) -> DataFrame:
    """rows with `calibrated`: the value of the step that their score is in, or, between two, of the one below; below all, of the first.

    The steps are few (they rise), and meet the rows by one sorted array.
    """
    ordered = F.sort_array(F.collect_list(F.struct("low", "value")))
    table = steps.agg(ordered.alias("_steps"))
    score = F.col("score") if score is None else score
    below = F.filter("_steps", lambda s: s["low"] <= score)
    value = F.when(F.size(below) > 0, F.element_at(below, -1)["value"]).otherwise(F.try_element_at("_steps", F.lit(1))["value"])
    return rows.crossJoin(F.broadcast(table)).withColumn("calibrated", F.when(score.isNotNull() & ~F.isnan(score), value)).drop("_steps")
