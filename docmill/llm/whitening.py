"""Embedding whitening: principal components of centred integer vectors, scaled to unit variance.

Method. Each entry c becomes the whole number x = floor(scale * c). The fit list holds every distinct x
vector once; n is its length and S its sums by dimension. Its rows are centred exactly, as n*x - S in whole
numbers, and go as vectors to MLlib's RowMatrix on the JVM side: its Gramian divided by n (and n*n for the
factor n in each row) is the covariance. The eigenvectors are found on the driver, which holds a matrix of
dimension squared, whatever the number of rows; they are broadcast, and mapInPandas projects all rows.

Edge cases: rows whose vector is null, or holds null or non-finite entries, are dropped, and so are empty
vectors and those of another length than the most frequent one in the fit list (the smaller on a tie), since
components have one length. A null or repeated vec_id is kept, a row for a row. Entries beyond the range of a
long are held at its ends. A component without variance (equal vectors, one row, dependent dimensions) has
explained 0 and no whitened value (null); with fewer dimensions than components asked for there are as many as
dimensions. A deviation beyond a long is null. No row left: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import scope, stage, table

SCALE, COMPONENTS = 256, 4
#: The largest long.
LONG = (1 << 63) - 1
#: Share of the largest eigenvalue, by dimension, below which a variance is rounding.
ROUNDING = np.finfo(float).eps
WHITENED = "vec_id long, void boolean, deviation long, whitened array<double>"


@dataclass(frozen=True)
class Whitening:
    """What is learned: n and sums of the fit list, and its components by falling variance (columns of `axes`)."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray  # (dimension, components)
    variances: np.ndarray
    trace: float
    most: int  # largest absolute entry of the fit list
    identity_error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace if self.trace > 0 else np.zeros(len(self.variances))

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied by: NaN for a component without variance."""
        with np.errstate(divide="ignore"):
            return np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)

    @property
    def plain(self) -> tuple:
        """What workers need, without this class."""
        return self.n, self.sums, self.axes, self.scales


def whole(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that can be used, as whole numbers."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(column, lambda c: c.cast("double")).alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(fine).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def commonest_length(rows: DataFrame, column: str = "x") -> int | None:
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return sizes[0]["d"] if sizes else None


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of an Arrow list column of length d."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """n, the sums by dimension and the largest absolute entry, exact at any size: a task adds the halves of the entries apart."""

    def add(batches):
        n, high, low, most = 0, np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
            if len(x):
                most = max(most, int(x.max()), -int(x.min()))
        if n:
            held = min(most, LONG)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([n] * d), pa.array(high), pa.array(low), pa.array([held] * d)], ["i", "n", "high", "low", "most"])

    parts = fit.select("x").mapInArrow(add, "i long, n long, high long, low long, most long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low"), F.max("most").alias("most")).orderBy("i").collect()  # a row a dimension
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found], max(r["most"] for r in found)


def centred(n: int, sums: list[int], most: int) -> Column:
    """n*x - S of each entry: in longs where they hold it, else in decimals."""
    kind = "long" if 2 * n * most <= LONG and max(map(abs, sums)) <= LONG else "decimal(38,0)"
    s = F.array(*[F.lit(str(v)).cast(kind) for v in sums])
    return F.transform("x", lambda v, i: (v.cast(kind) * F.lit(str(n)).cast(kind) - F.get(s, i)).cast("double"))


def covariance(fit: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """Gramian of the centred rows, divided by n; the factor n that each centred row carries is taken out."""
    vectors = fit.select(array_to_vector(centred(n, sums, most)).alias("v"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix()
    return gram.toArray() / n / n / n


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors by falling eigenvalue; each one's largest entry is positive, so reruns agree in sign."""
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return np.where(values > len(v) * ROUNDING * max(values.max(initial=0), 0), values, 0.0), axes


def project(x: np.ndarray, model: tuple) -> tuple[list, np.ndarray]:
    """Of rows of whole numbers: deviations (None beyond a long), and whitened rows (NaN without variance)."""
    n, sums, axes, scales = model
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most + max(map(abs, sums)) <= LONG:
        y = x * np.int64(n) - np.array(sums, np.int64)
        near = (y.astype(float) ** 2).sum(1)
        with np.errstate(over="ignore"):
            deviation = (y * y).sum(1).astype(object)  # right wherever the whole sum is within a long
        deviation[near > LONG] = None
        for k in np.flatnonzero(np.abs(near / LONG - 1) < 1e-6):
            exact = sum(int(c) ** 2 for c in y[k])
            deviation[k] = exact if exact <= LONG else None
    else:
        y = x.astype(object) * n - np.array(sums, object)
        deviation = np.array([t if t <= LONG else None for t in (y * y).sum(1)], object)
    return deviation.tolist(), (y.astype(float) / n) @ axes * scales


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, over components with variance."""
    k = int((model.variances > 0).sum())
    if not k:
        return None
    d, plain = len(model.sums), model.plain

    def means(batches):
        n, total = 0, np.zeros(k)
        for batch in batches:
            w = project(matrix(batch.column(0), d), plain)[1][:, :k]
            n, total = n + len(w), total + w.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(total)], ["i", "part"])

    def added(run) -> np.ndarray:
        return np.array([r["s"] for r in fit.select("x").mapInArrow(run, "i long, part double").groupBy("i").agg(F.sum("part").alias("s")).orderBy("i").collect()])

    mean = added(means) / model.n

    def products(batches):
        n, total = 0, np.zeros((k, k))
        for batch in batches:
            w = project(matrix(batch.column(0), d), plain)[1][:, :k] - mean
            n, total = n + len(w), total + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["i", "part"])

    return float(np.abs(added(products).reshape(k, k) / model.n - np.eye(k)).max())


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening learned from all distinct x of rows (vec_id, x); None if there are none."""
    with scope():  # the fit list goes once it is read
        fit = stage(rows.select("x").distinct(), "fit")
        d = commonest_length(fit)
        if d is None:
            return None
        fit = fit.filter(F.size("x") == d)
        n, sums, most = sums_of(fit, d)
        v = covariance(fit, n, sums, most)
        values, axes = principal(v, components)
        model = Whitening(n, tuple(sums), axes, values, float(np.trace(v)), most)
        return Whitening(**vars(model) | {"identity_error": identity_error(fit, model)})


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened of each row (vec_id, x): an entry a component, null where it has no variance."""
    d = len(model.sums)
    shared = rows.sparkSession.sparkContext.broadcast(model.plain)  # dimension times components, at any number of rows

    def run(frames):
        for f in frames:
            if len(f):
                deviation, w = project(np.stack(f["x"].to_numpy()), shared.value)
                yield pd.DataFrame({"vec_id": f["vec_id"], "void": f["void"], "deviation": pd.array(deviation, "Int64"), "whitened": [[None if np.isnan(c) else c for c in row] for row in w.tolist()]})

    # null ids are carried by a flag, as pandas would turn the others into floats
    told = rows.filter(F.size("x") == d).select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("void"), "x")
    return told.mapInPandas(run, WHITENED).select(F.when(~F.col("void"), F.col("vec_id")).alias("vec_id"), "deviation", "whitened")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable row of embeddings and each of the first four components."""
    rows = whole(table(spark, sf_dir, "embeddings"))
    model = fit_whitening(rows)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    by = F.array(*[F.lit(float(x)) for x in model.explained])
    flat = whitened(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "w"))
    return flat.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.get(by, F.col("k")).alias("explained"), F.lit(model.identity_error).cast(T.DoubleType()).alias("identity_error"))
