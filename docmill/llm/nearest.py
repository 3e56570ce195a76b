"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one entry from each of several full-dimensional codebooks. The codebooks are
trained on the driver on at most SAMPLE_ROWS vectors, by k-means on residuals, then each in turn on what the
others leave. Every vector is encoded by a beam search; its code, the squared norm of its decoded form and the
length of what the code leaves are stored, beside the vector. A query's inner products with all entries make a
lookup table, by which each task scores its codes. The exact distances of a task's best SHORTLIST bound what
can still count: a vector is no nearer than its decoded form less what its code leaves, so all that this
does not exclude are measured too. Of these a task returns the nearest, with all that tie with the last.

Queries go in blocks of a fixed number, each of which is broadcast and meets all codes. Equal vectors are
one entry that carries its smallest ids, so copies cost nothing and crowd nothing out.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; nor do those
of another length than the most frequent one (the smaller on a tie). Ties in distance go to the smaller
vec_id. A repeated row counts once; a vec_id with several vectors takes part with each, as query and as
neighbour. Null ids take no part. An empty table gives no
rows; with fewer candidates than asked for, all are returned. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import stage, table

SAMPLE_ROWS, BOOKS, ENTRIES, BEAM = 8192, 16, 256, 4
SHORTLIST, QUERY_BLOCK, ROWS_A_TASK = 400, 2048, 16_384


@dataclass
class Quantiser:
    books: np.ndarray  # (books, entries, dimension), float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and squared norms of the decoded vectors, by a beam of partial sums."""
        n, (levels, entries, d) = len(x), self.books.shape
        residual = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, levels), np.uint8)
        rows = np.arange(n)[:, None]
        for level, book in enumerate(self.books):
            width = residual.shape[1]
            # squared length of residual - entry, for all partial sums of the beam and all entries
            cost = (residual**2).sum(2)[:, :, None] - 2 * (residual.reshape(-1, d) @ book.T).reshape(n, width, entries) + (book**2).sum(1)
            cost = cost.reshape(n, -1)
            keep = min(beam, cost.shape[1]) if level < levels - 1 else 1
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.argsort(cost, axis=1)
            parent, entry = best // entries, best % entries
            residual = residual[rows, parent] - book[entry]
            codes = codes[rows, parent]
            codes[:, :, level] = entry
        return codes[:, 0], ((x - residual[:, 0]) ** 2).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres, np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def train(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 5, sweeps: int = 2, seed: int = 7) -> Quantiser:
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    entries = max(1, min(entries, len(x)))
    out, residual = [], x.copy()
    for _ in range(books):
        centres, own = k_means(residual, entries, rounds, rng)
        residual -= centres[own]
        out.append(centres)
    found = Quantiser(np.array(out, np.float32).reshape(books, entries, x.shape[1]))
    for _ in range(sweeps):
        codes, _ = found.encode(x)
        residual = x - sum(found.books[m][codes[:, m]] for m in range(books))
        for m in range(books):
            own = codes[:, m]
            residual += found.books[m][own]
            counts = np.bincount(own, minlength=entries)
            sums = np.zeros((entries, x.shape[1]), np.float32)
            np.add.at(sums, own, residual)
            found.books[m][counts > 0] = (sums / np.maximum(counts, 1)[:, None])[counts > 0]
            residual -= found.books[m][own]
    return found


# ---------------------------------------------------------------- tables


def usable(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v) of the vectors that take part; v in double precision."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["d"] if sizes else -1)).distinct()


def is_query(vec_id: Column) -> Column:
    return vec_id % 100 == 0


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """cid, v, ids: each distinct vector with its k + 1 smallest ids."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    grouped = rows.withColumn("r", rank).filter(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return stage(grouped.withColumn("cid", F.monotonically_increasing_id()), "entries")


def encoded(entries: DataFrame, quantiser: Quantiser, tasks: int) -> DataFrame:
    """cid, code, norm (squared, of the decoded form), err (length of what the code leaves) and v."""
    # the array alone: a broadcast is pickled by reference to its class, which workers may be unable to import
    shared = entries.sparkSession.sparkContext.broadcast(quantiser.books)

    def run(batches):
        books, coder = shared.value, Quantiser(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                v = part.column(1)
                x = np.asarray(v.flatten()).reshape(len(v), -1)
                codes, _ = coder.encode(x)
                near = sum(books[m][codes[:, m]].astype(float) for m in range(len(books)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near**2).sum(1)), pa.array(np.sqrt(((x - near) ** 2).sum(1))), v], ["cid", "code", "norm", "err", "v"])

    return stage(entries.select("cid", "v").repartition(tasks).mapInArrow(run, "cid long, code binary, norm double, err double, v array<double>"), "codes")


def shortlists(codes: DataFrame, queries: list, quantiser: Quantiser, most: int, wanted: int) -> DataFrame:
    """(qid, cid, near): each task's `wanted` nearest, and ties, for each query of one block; near is the squared distance."""
    qid = np.array([q["cid"] for q in queries], np.int64)
    asked = np.array([q["v"] for q in queries], float)
    tables = np.einsum("qd,mkd->qmk", asked.astype(np.float32), quantiser.books, optimize=True)
    # what single precision can add to a score, as a share of the lengths that meet in it
    reach = float(np.sqrt((quantiser.books.astype(float) ** 2).sum(2)).max(1).sum())
    shared = codes.sparkSession.sparkContext.broadcast((qid, asked, tables, reach))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS_A_TASK:
                yield from best(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from best(pa.Table.from_batches(held))

    def best(part):
        qid, asked, tables, reach = shared.value
        cids, norm, err = (part.column(c).to_numpy() for c in ("cid", "norm", "err"))
        x = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(cids), -1)
        code = np.ascontiguousarray(np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(cids), -1).T)
        lengths = (x**2).sum(1)
        keep, want = min(max(most, wanted), len(cids)), min(wanted, len(cids))
        for q, v in enumerate(asked):
            size = float(v @ v)
            dots = np.zeros(len(cids), np.float32)
            for m in range(len(code)):
                dots += tables[q, m][code[m]]
            decoded = norm - 2.0 * dots
            first = np.argpartition(decoded, keep - 1)[:keep] if keep < len(cids) else np.arange(keep)
            bound = np.partition(((x[first] - v) ** 2).sum(1), want - 1)[want - 1]
            slack = 1e-5 * (size**0.5 * reach + size)
            low = np.sqrt(np.maximum(decoded + size - slack, 0)) - err
            can = np.flatnonzero(low <= bound**0.5 * (1 + 1e-9))
            # products first, as differences of all rows take longer; what is left by rounding is measured by differences
            rough = lengths[can] - 2 * (x @ v if 4 * len(can) > len(cids) else x[can] @ v)[can if 4 * len(can) > len(cids) else slice(None)] + size
            can = can[rough <= bound + 1e-9 * (bound + size + lengths[can])]
            near = ((x[can] - v) ** 2).sum(1)
            last = np.partition(near, want - 1)[want - 1]
            take = near <= last * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(take.sum(), qid[q])), pa.array(cids[can[take]]), pa.array(near[take])], ["qid", "cid", "near"])

    return codes.mapInArrow(run, "qid long, cid long, near double")


def nearest(vectors: DataFrame, k: int = 10, shortlist: int = SHORTLIST, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (vec_id divisible by 100)."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors), "rows")
    entries = entries_of(rows, k)
    count = entries.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.select("v").orderBy(F.xxhash64("v"), "cid").limit(sample_rows).collect()
    quantiser = train(np.array([r["v"] for r in sample], np.float32))
    codes = encoded(entries, quantiser, max(1, -(-count // ROWS_A_TASK)))

    asked = stage(rows.filter(is_query(F.col("vec_id"))).join(entries.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid"), "asked")
    queries = stage(entries.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v"), "queries")
    total = queries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts, wanted = -(-total // QUERY_BLOCK), 2 * k + 2
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(parts)))
    found = None
    for block in range(parts):  # about QUERY_BLOCK queries at once, whatever their number
        some = numbered.filter(F.col("block") == block).collect()
        if some:
            near = shortlists(codes, some, quantiser, shortlist, wanted)
            # rounded, as equal distances of different tasks can differ in the last digits
            near = near.withColumn("r", F.rank().over(Window.partitionBy("qid").orderBy(F.round("near", 9)))).filter(F.col("r") <= wanted).select("qid", "cid")
            near = stage(near, "near") if parts > 1 else near
            found = near if found is None else found.unionByName(near)

    exact = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = found.join(entries, "cid").join(queries.select(F.col("cid").alias("qid"), F.col("v").alias("q")), "qid").select("qid", "cid", "ids", exact.alias("score"))
    order = [F.col("score"), F.col("vec_id")]
    flat = scored.select("qid", "cid", "score", F.explode("ids").alias("vec_id"))
    flat = flat.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).filter(F.col("r") <= wanted)
    answers = flat.join(asked.withColumnRenamed("cid", "qid"), "qid").filter((F.col("vec_id") != F.col("query_id")) | (F.col("cid") != F.col("qid")))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
