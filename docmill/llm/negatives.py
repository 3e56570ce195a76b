"""Hard-negative mining with a pivot table.

Vectors become whole numbers, floor(scale * x). A row's score is its inner product with the anchor. Each vector is
augmented by one entry, the root of M*M less its squared length, where M is the greatest length; anchors get a 0
there. Then the squared distance of an anchor and a row is its own squared length plus M*M less twice the score, so
larger scores are smaller distances. Pivots are rows picked farthest first from a sample of PIVOT_SAMPLE; the
distances of all rows to all pivots are stored beside the vectors. By the triangle inequality they bracket each
distance, hence each score: whole blocks of rows first, by the least and greatest distance of a block to each
pivot, then rows. Rows whose bracket meets what is still wanted are measured exactly.

Rows are sorted by label and nearest pivot, so that blocks are narrow, and dealt evenly, whatever the groups.
Each task holds one block of anchors, the best rows found so far for them, and one block of rows. Two rounds: the
positives, then, with their scores known, the negatives in the bands below them.

Edge cases: rows with a null id, label or vector, or with null or non-finite entries, take no part, nor do empty
vectors and those of another length than the most frequent one (the smaller on a tie). Nor do rows whose squared
length is beyond LENGTH, as a long would not hold their scores. Ties in score go to the smaller id. Repeated rows
each take part, as anchors and as others; an anchor is never its own positive. Anchors without positives, and
positives without negatives, give no rows. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import scope, scratch_dir, stage, table
from docmill.llm.whitening import LONG, commonest_length, matrix

SCALE, PIVOTS, PIVOT_SAMPLE = 256, 16, 4096
#: Anchors that are broadcast at once; rows of a block; found rows that a task holds before it keeps each anchor's best; rows of the least task.
ANCHOR_BLOCK, BLOCK_ROWS, HELD, ROWS_A_TASK = 2048, 256, 1 << 18, 1 << 20
#: Greatest squared length that takes part; up to EXACT, sums of products are exact in doubles.
LENGTH, EXACT = float(1 << 62), 1 << 53
FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
FOUND = "anchor long, wanted int, rid long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.filter(fine).select("vec_id", "label", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    return whole.withColumn("near", F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))).filter(F.col("near") <= LENGTH)


def farthest(points: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the points, each the farthest from those before it; the first is the farthest from their mean."""
    apart, chosen = ((points - points.mean(0)) ** 2).sum(1), []
    for _ in range(min(k, len(points))):
        if chosen and not apart.max() > 0:
            break
        best = int(apart.argmax())
        own = ((points - points[best]) ** 2).sum(1)
        apart = own if not chosen else np.minimum(apart, own)
        chosen.append(best)
    return points[chosen]


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """The vectors with the entry that makes all of length `most` (squared)."""
    x = x.astype(float)
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]])


def apart(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], 1)


def pivot_table(rows: DataFrame, pivots: np.ndarray, most: float, parts: int) -> DataFrame:
    """rid, vec_id, label, x and its distances to the pivots, dealt by label and nearest pivot."""
    d = pivots.shape[1] - 1
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            far = apart(augmented(matrix(batch.column("x"), d), most), shared.value)
            columns = [batch.column(c) for c in ("rid", "vec_id", "label", "x")]
            yield pa.RecordBatch.from_arrays([*columns, pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float64())), pa.array(far.argmin(1).astype(np.int32)), pa.array(far.min(1))], ["rid", "vec_id", "label", "x", "far", "cell", "ring"])

    placed = rows.select("rid", "vec_id", "label", "x").mapInArrow(run, "rid long, vec_id long, label long, x array<long>, far array<double>, cell int, ring double")
    # by the row as well, so that one label, or copies of one vector, go to several tasks
    return stage(placed.repartitionByRange(parts, "label", "cell", "ring", "rid").sortWithinPartitions("label", "cell", "ring", "rid"), "pivot-table")


class Best:
    """The best rows found so far: `keep` for each anchor and band, higher scores first, then smaller ids."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.held, self.size = keep, [], 0
        #: The score that a row must reach to count: the last one kept, once there are enough.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, rid: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        better = score >= self.floor[slot]
        if better.any():
            self.held.append([x[better] for x in (slot, rid, vec_id, score)])
            self.size += int(better.sum())
        if self.size > HELD:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """Drops what is not among the best, and raises the floors."""
        if not self.held:
            return [np.zeros(0, np.int64)] * 4
        slot, rid, vec_id, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((rid, vec_id, -score, slot))
        slot, rid, vec_id, score = (x[order] for x in (slot, rid, vec_id, score))
        begin = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - begin
        full = rank == self.keep - 1
        self.floor[slot[full]] = score[full]
        few = rank < self.keep
        self.held = [[x[few] for x in (slot, rid, vec_id, score)]]
        self.size = int(few.sum())
        return self.held[0]


def brackets(near: np.ndarray, far: np.ndarray, least: np.ndarray, size: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (distances to pivots `near`, squared length `size`) with rows at `least` to `far` of the pivots."""
    low, high = np.zeros((len(near), len(far))), np.full((len(near), len(far)), np.inf)
    for p in range(near.shape[1]):
        own = near[:, p, None]
        np.maximum(low, np.maximum(own - far[:, p], least[:, p] - own), out=low)
        np.minimum(high, own + far[:, p], out=high)
    slack = 1e-9 * (most + size)[:, None]  # of the roots and sums
    total = (most + size)[:, None]
    return (total - high * high) / 2 - slack, (total - low * low) / 2 + slack


def scan(index: DataFrame, anchors: tuple, same: bool, keep: int) -> DataFrame:
    """Each task's `keep` best rows for each anchor and band: of the anchor's label, or of the others.

    anchors: (rid, label, x, distances to pivots, bands, greatest squared length); bands: a row an anchor, of (lowest, highest) scores.
    """
    shared = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        rid, label, x, near, bands, most = shared.value
        d, count, kinds = x.shape[1], len(rid), bands.shape[1]
        size = (x.astype(float) ** 2).sum(1)
        exact = most <= EXACT
        asked = x.astype(float) if exact else x
        lows, highs = bands[:, :, 0], bands[:, :, 1]
        ceiling, best = highs.max(1), Best(count * kinds, keep)
        by_label = {int(k): (np.flatnonzero(label == k), np.flatnonzero(label != k)) for k in np.unique(label)}
        all_of, none_of = np.arange(count), np.zeros(0, np.int64)

        def block(own, ids, kind, v, far):
            seekers = by_label.get(kind, (none_of, all_of))[0 if same else 1]
            if not len(seekers):
                return
            goal = np.maximum(best.floor.reshape(count, kinds), lows)[seekers].min(1)  # what a row must reach in some band
            low, high = brackets(near[seekers], far.max(0)[None], far.min(0)[None], size[seekers], most)
            open_ = (high[:, 0] >= goal) & (low[:, 0] <= ceiling[seekers])
            seekers, goal = seekers[open_], goal[open_]
            if not len(seekers):
                return
            low, high = brackets(near[seekers], far, far, size[seekers], most)
            can = (high >= goal[:, None]) & (low <= ceiling[seekers][:, None]) & (own != rid[seekers][:, None])
            q, r = np.nonzero(can)
            if not len(q):
                return
            if 4 * len(q) > can.size:  # nearly all: one product of matrices
                score = (asked[seekers] @ v.T)[q, r].astype(np.int64)
            else:
                score = np.concatenate([(asked[seekers[q[k : k + 65536]]] * v[r[k : k + 65536]]).sum(1) for k in range(0, len(q), 65536)]).astype(np.int64)
            for band in range(kinds):
                fits = (score >= lows[seekers[q], band]) & (score <= highs[seekers[q], band])
                best.add(seekers[q[fits]] * kinds + band, own[r[fits]], ids[r[fits]], score[fits])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own, ids, kind = (part.column(c).to_numpy() for c in ("rid", "vec_id", "label"))
                v, far = matrix(part.column("x"), d), matrix(part.column("far"), near.shape[1])
                v = v.astype(float) if exact else v
                cuts = np.flatnonzero(np.diff(kind)) + 1
                edges = np.unique(np.concatenate([cuts, np.arange(0, len(own), BLOCK_ROWS), [len(own)]]))
                for lo, hi in zip(edges, edges[1:], strict=False):
                    block(own[lo:hi], ids[lo:hi], int(kind[lo]), v[lo:hi], far[lo:hi])
                best.settle()
        slot, *found = best.settle()
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(rid[slot // kinds]), pa.array((slot % kinds).astype(np.int32)), *map(pa.array, found)], ["anchor", "wanted", "rid", "vec_id", "score"])

    found = index.select("rid", "vec_id", "label", "x", "far").mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "wanted").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= keep)


def arrays(rows: list, d: int, pivots: np.ndarray) -> tuple:
    x = np.array([r["x"] for r in rows], np.int64).reshape(-1, d)
    plain = np.hstack([x.astype(float), np.zeros((len(x), 1))])
    return np.array([r["rid"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), x, apart(plain, pivots)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100), scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best `positives`, the best `negatives`.

    band: the shares, in hundredths of the positive's score, that a negative's score lies between, ends included.
    """
    spark, schema = vectors.sparkSession, ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in FIELDS)
    with scope():
        rows = stage(usable(vectors, scale).withColumn("rid", F.monotonically_increasing_id()), "rows")
        d = commonest_length(rows)
        if d is None:
            return spark.createDataFrame([], schema)
        rows = rows.filter(F.size("x") == d)
        total, near = rows.agg(F.count("*"), F.max("near")).first()
        most = near * (1 + 1e-12) + 1
        sample = rows.orderBy(F.xxhash64("x"), "rid").limit(PIVOT_SAMPLE).select("x").collect()
        pivots = farthest(augmented(np.array([r["x"] for r in sample], np.int64), most), PIVOTS)
        parts = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK))
        index = pivot_table(rows, pivots, most, parts)
        anchors = rows.filter(is_anchor).select("rid", "vec_id", "label", "x")
        blocks = -(-anchors.count() // ANCHOR_BLOCK)
        numbered = anchors.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks))) if blocks else anchors
        folder, some_found = f"{scratch_dir(spark)}/negatives-{uuid.uuid4().hex}", False
        for block in range(blocks):  # about ANCHOR_BLOCK anchors at once, whatever their number
            some = numbered.filter(F.col("block") == block).collect()
            if not some:
                continue
            rid, label, x, far = arrays(some, d, pivots)
            every = np.full((len(rid), 1, 2), [np.iinfo(np.int64).min, np.iinfo(np.int64).max])
            near_rows = scan(index, (rid, label, x, far, every, most), True, positives).collect()  # a few rows an anchor of the block
            by = {}
            for r in near_rows:
                by.setdefault(r["anchor"], {})[r["rank"]] = (r["vec_id"], r["score"])
            ids = {r["rid"]: r["vec_id"] for r in some}
            # a band from the least whole score of the lower share to the greatest of the upper one; none where there is no such positive
            bands = np.tile(np.array([[[1, 0]]], np.int64), (len(rid), positives, 1))
            for k, own in enumerate(rid.tolist()):
                for rank, (_, score) in by.get(own, {}).items():
                    low, high = -(-band[0] * score // 100), min(band[1] * score // 100, LONG)
                    if low <= high:
                        bands[k, rank - 1] = low, high
            told = [(ids[own], own, rank - 1, p, s) for own, found in by.items() for rank, (p, s) in found.items()]
            if not told:
                continue
            pairs = spark.createDataFrame(told, "anchor_id long, anchor long, wanted int, positive_id long, positive_score long")
            found = scan(index, (rid, label, x, far, bands, most), False, negatives)
            found = found.join(F.broadcast(pairs), ["anchor", "wanted"])  # positives of one block
            found = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).select(*FIELDS)
            found.write.parquet(f"{folder}/block={block}")  # one table in the end, so the plan does not grow with the blocks
            some_found = True
        return spark.read.schema(schema).parquet(folder).select(*FIELDS) if some_found else spark.createDataFrame([], schema)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; labels of those divisible by 7 go one up, modulo 10."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM used a JOIN used b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
