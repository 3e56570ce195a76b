"""Document fingerprints from prefix polynomial hashes.

PrefixHash keeps, for two bases modulo 2**31 - 1, the prefix sums of code[i] * base**i. A span's hash is a
difference of two entries, brought to position 0 by an inverse power, so any two spans are compared in
constant time, and the longest common extension of two positions is found by binary search.

The fingerprint of a text is its whole hash, its length, and a sketch: all windows of WINDOW code points
are hashed that way and dealt to SLOTS slots, each of which keeps its least value. The likeness of two
fingerprints is the share of agreeing slots among those that either one fills.

Edge cases: a null text counts as empty; an empty text has an empty sketch, and two empty texts have
likeness 1; a text shorter than a window is one window. Equal texts have equal fingerprints. With a
repeated doc_id, rows are ordered by text within it; a null doc_id comes last in descending order. A
single row is its own next document. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import mixed, table

PRIME = (1 << 31) - 1
BASES = (1_000_003_579, 754_974_721)
WINDOW, SLOTS, CHUNK = 16, 128, 1 << 18
_powers: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod PRIME for x < 2**62."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod PRIME."""
    have = _powers.get(base, np.ones(1, np.int64))
    while len(have) < n:
        step = pow(base, len(have), PRIME)
        have = np.concatenate([have, _fold(have * step)])
    _powers[base] = have
    return have[:n]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class PrefixHash:
    """Prefix arrays of one text: span(i, j) answers for any span of it."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.prefix = [np.concatenate([[0], _fold(np.cumsum(_fold((codes + 1) * powers(b, self.n))))]) for b in BASES]

    def span(self, i, j):
        """The hash of [i, j), independent of where it stands; arrays are answered element by element."""
        out = np.zeros(np.broadcast(i, j).shape, np.int64)
        for b, p in zip(BASES, self.prefix, strict=True):
            inverse = powers(pow(b, -1, PRIME), self.n + 1)
            out = (out << 31) | _fold(((p[j] - p[i]) % PRIME) * inverse[i])
        return out

    def common(self, i: int, other: PrefixHash, j: int) -> int:
        """Longest common extension of position i here and position j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def sketch(codes: np.ndarray) -> tuple[int, np.ndarray]:
    """The whole text's hash and the least value of each slot (-1: none). Long texts go by overlapping chunks."""
    n = len(codes)
    slots = np.full(SLOTS, np.iinfo(np.int64).max)
    whole = [0, 0]
    width = min(WINDOW, n)
    for at in range(0, max(n - width + 1, 1) if n else 0, CHUNK):
        part = PrefixHash(codes[at : at + CHUNK + width - 1])
        own = min(CHUNK, n - at)
        last = at + CHUNK >= n - width + 1
        for k, b in enumerate(BASES):
            end = part.n if last else own
            whole[k] = (whole[k] + int(part.prefix[k][end]) * pow(b, at, PRIME)) % PRIME
        starts = np.arange(part.n - width + 1)
        v = mixed(part.span(starts, starts + width).astype(np.uint64))
        slot, value = (v >> np.uint64(57)).astype(np.int64), (v & np.uint64((1 << 57) - 1)).astype(np.int64)
        few = value < int(min(1.0, 16 * SLOTS / len(v)) * (1 << 57))  # the least of nearly every slot is among these
        np.minimum.at(slots, slot[few], value[few])
        if not few.all() and len(np.unique(slot[few])) < SLOTS:
            np.minimum.at(slots, slot, value)
    slots[slots == np.iinfo(np.int64).max] = -1
    return (whole[0] << 31) | whole[1], np.where(slots < 0, -1, slots >> 25)


def fingerprint(codes: np.ndarray) -> tuple[str, np.ndarray]:
    """As text: whole hash, length, and eight hex digits of each slot (dots where a slot is empty)."""
    whole, slots = sketch(codes)
    words = np.array([f"{x:08x}" if x >= 0 else "........" for x in slots.tolist()])
    return f"{whole:016x}-{len(codes):x}-{''.join(words)}", slots


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing slots among those that either sketch fills."""
    used = (a >= 0) | (b >= 0)
    return float((a == b)[used].mean()) if used.any() else 1.0


# ---------------------------------------------------------------- each document beside the next one

MOST_BUCKETS, BUCKET_ROWS = 4096, 4000


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, ord, ghost, doc_id, text), dealt by ranges of doc_id and sorted in descending order.

    Each bucket ends with a ghost: the first row of the next bucket that has any (after the last: of the
    first). So every row finds its next document within its bucket, and texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63))))
    count = docs.count()
    wanted = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS))
    cuts = docs.select(F.percentile_approx("ord", [k / wanted for k in range(1, wanted)], 50 * wanted).alias("c")).first()["c"] if wanted > 1 and count else []
    edges = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, ids.to_numpy(np.int64), "left"), dtype="int32")

    dealt = docs.withColumn("bucket", bucket_of("ord"))
    tops = sorted((r["bucket"], r["top"]) for r in docs.select("ord").withColumn("bucket", bucket_of("ord")).groupBy("bucket").agg(F.max("ord").alias("top")).collect())  # MOST_BUCKETS rows at most
    firsts = spark.createDataFrame([(top, tops[k - 1][0]) for k, (_, top) in enumerate(tops)], "ord long, bucket int")
    ghosts = docs.select("ord", "text").join(F.broadcast(firsts), "ord").groupBy("bucket", "ord").agg(F.min("text").alias("text"))
    rows = dealt.select("bucket", F.lit(0).alias("ghost"), "ord", "doc_id", "text").unionByName(ghosts.select("bucket", F.lit(1).alias("ghost"), "ord", F.lit(None).cast("long").alias("doc_id"), "text"))
    return rows.repartition(max(len(tops), 1), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("ord"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_next long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half comes from the next document.

    common_next: length of the common beginning with the next document.
    """

    def run(batches):
        held = None  # bucket, doc_id, text and sketch of the row that waits for its next one
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True)
            out = []
            for bucket, ghost, doc_id, text in rows:
                codes = codes_of(text)
                own = fingerprint(codes)
                if held is not None and held[0] == bucket:
                    _, before, was, old, (name, slots) = held
                    half = len(old) // 2
                    edited = was[: len(was) - half] + text[:half]
                    changed = np.concatenate([old[: len(old) - half], codes[:half]])
                    other, marks = fingerprint(changed)
                    same = len(old) and len(codes) and old[0] == codes[0]  # most pairs differ at once
                    out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), name, other, likeness(slots, marks), likeness(slots, own[1]), PrefixHash(old).common(0, PrefixHash(codes[: len(old)]), 0) if same else 0))
                held = None if ghost else (bucket, doc_id, text, codes, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return beside_next(docs).mapInArrow(run, SCHEMA)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
