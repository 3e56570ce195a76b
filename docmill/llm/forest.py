"""MinHash near-dedup by an LSH forest.

Each set of word shingles has TREES sequences of DEPTH MinHash values. A tree is the order of all sets by their
sequence; sets that share a longer prefix stand closer together. The tree is kept as nested groups of equal
prefixes, and each region has a depth of its own: the first of DEPTHS at which no more than REGION sets share the
prefix, found by counts of the groups that are still too large. The members of a region are each other's
neighbours of longest common prefix, and all pairs of them are candidates. Counts are added up before they are
shuffled, and only groups that are too large are joined back, so no group of any size meets in one task.

Regions still too large at the full depth are near copies of one text. They are not expanded: their members are dealt
to parts and linked with one member of each part first; those outside the region's largest component then meet a few
pivots, more pivots, and in the end all members, in blocks (ngram_join.linked). All links are confirmed on the whole
sets, so none is false.

What can be missed: a pair of similarity s shares a prefix of d values in no tree with probability (1 - s**d)**TREES.
At s = 0.85 that is 1e-18 at depth 2, 6e-11 at depth 4, and 4e-5 at the full depth of 8, where only pairs in crowded
regions go. Copies with equal sets form a class beforehand and are never missed.

Edge cases: a null text, or one without words, has an empty set, n_shingles 0, and is linked with nothing (its
component is its own doc_id, and it is kept). A text of fewer words than a shingle is one shingle. A repeated doc_id
keeps all its rows, and each has its own set; all rows whose doc_id names their component are kept. A null doc_id
never names a component unless all of its members are null; then they are kept. An empty table gives no rows. Texts
are hashed whole, a block at a time, whatever their length. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import setjoin as S
from docmill.llm.common import blocks, mixed, scope, shingle_hashes, stage, table, word_hashes
from docmill.llm.ngram_join import linked

TREES, DEPTHS, REGION = 32, (2, 4, 8), 24
#: Members of a part of a region that is too large at full depth; rows of a side that may be broadcast: 32 MB.
PART, BROADCAST_ROWS = 4096, 2_000_000
SETS = "doc_id long, h long, key long, n int, first boolean, sig binary, parity long, bits binary"


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd multipliers of the MinHash functions."""
    x = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (x[:count] >> np.uint64(32)).astype(np.uint32), (x[count:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(hashes: np.ndarray, starts: np.ndarray, trees: int, depths: tuple[int, ...]) -> np.ndarray:
    """Of non-empty sets (flat hashes, start of each): a 64-bit hash of each tree's prefix at each depth, (sets, trees, depths)."""
    depth = depths[-1]
    masks, factors = permutations(trees * depth)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    values = np.empty((trees * depth, len(starts)), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(trees * depth):
            values[k] = np.minimum.reduceat((low ^ masks[k]) * factors[k], starts)
        out = np.empty((len(starts), trees, len(depths)), np.int64)
        for tree in range(trees):
            acc = np.full(len(starts), tree + 1, np.uint64)
            for k in range(depth):
                acc = mixed(acc * np.uint64(3) + values[tree * depth + k])
                if k + 1 in depths:
                    out[:, tree, depths.index(k + 1)] = acc.view(np.int64)
    return out


def forest_sets(docs: DataFrame, size: int, trees: int, depths: tuple[int, ...]) -> DataFrame:
    """A row per document: hash and size of its set; of the first row of a set in its partition also its prefixes and bitmaps."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            ids, places, column = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi in blocks(column):
                h, at = shingle_hashes(*word_hashes(column.slice(lo, hi - lo)), size)
                key, n, first, own = [], [], [], []
                for k in range(hi - lo):
                    s = np.unique(h[at[k] : at[k + 1]])
                    key.append(S.set_key(S.unranked(s)))
                    n.append(len(s))
                    new = len(s) > 0 and key[-1] not in seen
                    first.append(new)
                    if new:
                        seen.add(key[-1])
                        own.append(s)
                sig, parity, bits = iter(()), iter(()), iter(())
                if own:
                    starts = np.cumsum([0, *map(len, own[:-1])])
                    sig = iter([x.tobytes() for x in signatures(np.concatenate(own), starts, trees, depths)])
                    tokens = [S.unranked(s) for s in own]
                    parity = iter([int(np.bitwise_xor.reduce(np.left_shift(np.int64(1), x % 63))) for x in tokens])  # of 63 bits, as signed ones are counted by their absolute value
                    bits = iter([S.bitmap(x) for x in tokens])
                of = lambda values: [next(values) if f else None for f in first]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), places.slice(lo, hi - lo), pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(first), pa.array(of(sig), pa.binary()), pa.array(of(parity), pa.int64()), pa.array(of(bits), pa.binary())], ["doc_id", "h", "key", "n", "first", "sig", "parity", "bits"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, SETS)


def classes_of(sets: DataFrame) -> DataFrame:
    """One row of each set: only those that are the first in several partitions are compared."""
    firsts = sets.filter("first")
    several = stage(firsts.groupBy("key").agg(F.count("*").alias("c"), F.min("row").alias("least")).filter("c > 1").select("key", "least"), "several")
    side = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    return firsts.join(side, "key", "left").filter("least is null or row = least")


def prefixes(one: DataFrame, levels: int) -> DataFrame:
    """A row (t0, t1, ..., key, n, bits) of each set and tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            toks = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.int64).reshape(batch.num_rows, -1, levels)
            trees = toks.shape[1]
            rest = [pa.array(np.repeat(batch.column(c).to_numpy(), trees)) for c in ("key", "n", "parity")]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(toks[:, :, k]).ravel()) for k in range(levels)), *rest], [*(f"t{k}" for k in range(levels)), "key", "n", "bits"])

    return one.select("sig", "key", "n", "parity").mapInArrow(run, ", ".join(f"t{k} long" for k in range(levels)) + ", key long, n int, bits long")


def regions(posts: DataFrame, levels: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Postings of all regions of up to `most` sets, each at its own depth, and members (tok, key, n, bits, c) of those too large at the full depth."""
    listed, rows = None, posts
    for k in range(levels):
        tok = F.col(f"t{k}")
        dense = stage(rows.groupBy(tok.alias("tok")).agg(F.count("*").alias("c")).filter(F.col("c") > most), "dense")
        many = dense.count()
        side = F.broadcast(dense) if many <= BROADCAST_ROWS else dense
        few = (rows.join(side, tok == F.col("tok"), "left_anti") if many else rows).select(tok.alias("tok"), "key", "n", F.lit(0).alias("pos"), "bits")
        listed = few if listed is None else listed.unionByName(few)
        if not many:
            return listed, None
        rows = stage(rows.join(side, tok == F.col("tok")).drop("tok" if k < levels - 1 else f"t{k}").drop(*([] if k == levels - 1 else ["c"])), "deeper")
    return listed, rows.select("tok", "key", "n", "bits", "c")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, trees: int = TREES, depths: tuple[int, ...] = DEPTHS, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    with scope() as made:  # of the tables made on the way, only the result stays
        found = made.keep(stage(_near_duplicates(docs, size, S.Threshold(num, den), trees, depths, region), "near-duplicates"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _near_duplicates(docs: DataFrame, size: int, t: S.Threshold, trees: int, depths: tuple[int, ...], region: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    sets = stage(forest_sets(docs, size, trees, depths).withColumn("row", F.monotonically_increasing_id()), "sets")
    one = classes_of(sets)
    listed, large = regions(prefixes(one, len(depths)), len(depths), region)
    if large is not None:
        salt = F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / PART))
        listed = listed.unionByName(large.select(F.xxhash64("tok", salt).alias("tok"), "key", "n", F.lit(0).alias("pos"), "bits"))
        hot = large.select("tok", "key", "n")
    else:
        hot = S.empty(docs.sparkSession, "tok long, key long, n int")
    return linked(docs, sets, one, S.candidates(listed, t, region), hot, None, size, t)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85)
