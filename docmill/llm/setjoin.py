"""Exact joins of token sets by Jaccard similarity, without cross joins and without unbounded groups.

A token is one non-negative long: seven bits of a frequency class above 56 bits of a hash. Sorted,
the tokens of a set stand from rare to frequent, so a prefix filter reads its rarest ones.

The frequency classes come from counts of all tokens of all rows in 2**24 hash buckets: a table of
fixed size (16 MB), so it may be broadcast at any input size. Any global order gives right results; a
bucket shared by several tokens only makes some of them look more frequent than they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import blocks, drop_stage, mixed, stage

#: Hash buckets of the counts, the chunks they are added up in, and the tables that a task adds up.
SKETCH_BITS, SKETCH_CHUNKS, FAN = 24, 64, 64
#: Bits of the parity bitmap that bounds the symmetric difference of two sets from below.
BITMAP_BITS = 1024


@dataclass(frozen=True)
class Threshold:
    """Two sets are similar when den * |intersection| >= num * |union|."""

    num: int
    den: int

    def least(self, n):
        """Smallest size of a partner of a set of n."""
        return -(-self.num * n // self.den)

    def most(self, n):
        """Largest size of a partner of a set of n."""
        return self.den * n // self.num

    def need(self, n, m):
        """Smallest overlap of similar sets of n and m."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n):
        """How many of its rarest tokens a set of n must look up."""
        return n - self.least(n) + 1


# ---------------------------------------------------------------- token frequencies


def frequency_classes(texts: DataFrame, hashes) -> np.ndarray:
    return frequencies(texts, hashes)[0]


def frequencies(texts: DataFrame, hashes) -> tuple[np.ndarray, int]:
    """Frequency class (0 to 127) of each hash bucket, from the counts over all rows of the one text column, and the sum of the counts.

    `hashes` maps an Arrow array of texts to (token hashes, row starts). A task sends the buckets it has counts for;
    these are added up by FAN tasks' tables and then by chunk, both streamed, so that no task holds more than one chunk.
    """
    width = (1 << SKETCH_BITS) // SKETCH_CHUNKS
    most = np.uint64(2**32 - 1)

    def packed(chunk: int, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        blob = zlib.compress(at.astype(np.uint32).tobytes() + np.minimum(counts[at], most).astype(np.uint32).tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "counts"])

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            column = batch.column(0)
            for lo, hi in blocks(column):
                where, times = np.unique((hashes(column.slice(lo, hi - lo))[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32), return_counts=True)
                total[where] += times.astype(np.uint32)
        for chunk, counts in enumerate(total.reshape(SKETCH_CHUNKS, -1)):
            if counts.any():
                yield packed(chunk, counts)

    def add(batches):
        now, total = None, None
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        yield packed(now, total)
                    now, total = chunk, np.zeros(width, np.uint64)
                at, counts = np.frombuffer(zlib.decompress(blob), np.uint32).reshape(2, -1)
                total[at] = np.minimum(total[at] + counts, most)
        if now is not None:
            yield packed(now, total)

    schema = "chunk int, counts binary"
    parts = texts.mapInArrow(count, schema).withColumn("lane", F.floor(F.spark_partition_id() / FAN))
    for lanes in (["chunk", "lane"], ["chunk"]):
        parts = parts.repartition(*lanes).sortWithinPartitions(*lanes).select("chunk", "counts").mapInArrow(add, schema)
    out, whole = np.zeros((SKETCH_CHUNKS, width), np.uint8), 0
    for row in parts.collect():  # a table of fixed size at any input size
        at, counts = np.frombuffer(zlib.decompress(row["counts"]), np.uint32).reshape(2, -1)
        out[row["chunk"]][at] = np.minimum(127, 4 * np.log2(1 + counts.astype(np.float64))).astype(np.uint8)
        whole += int(counts.sum(dtype=np.int64))
    return out.reshape(-1), whole


def ranked(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes as tokens that sort from rare to frequent."""
    return ((classes[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))).astype(np.int64)


def unranked(hashes: np.ndarray) -> np.ndarray:
    """Hashes as tokens in no order of frequency."""
    return (hashes >> np.uint64(8)).astype(np.int64)


def bitmap(tokens: np.ndarray) -> bytes:
    return np.packbits((np.bincount(tokens & (BITMAP_BITS - 1), minlength=BITMAP_BITS) & 1).astype(np.uint8)).tobytes()


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of the set; sets of equal hashes count as equal (expected false ones: 0.03 among 10**9 sets)."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed((tokens.astype(np.uint64) << np.uint64(8)) + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(tokens)))[()].astype(np.int64))


#: A posting: a set's token (or subset, or segment), the set, its size, the token's place in it, a parity bitmap of it.
POSTING = ("tok", "key", "n", "pos", "bits")
POSTINGS = "tok long, key long, n int, pos int, bits long"


# ---------------------------------------------------------------- small sets: subsets of fixed sizes


def subset_sizes(n: int, bound: int, t: Threshold) -> list[int]:
    """The overlaps that a set of n can need with any partner of at most `bound` tokens."""
    return sorted({t.need(n, m) for m in range(max(1, t.least(n)), min(bound, t.most(n)) + 1)})


def subsets(n: int, bound: int, t: Threshold) -> int:
    return sum(comb(n, c) for c in subset_sizes(n, bound, t))


def choose_bound(histogram: dict[int, tuple[int, int]], t: Threshold, most: int) -> int:
    """The largest size of sets whose subsets are enumerated, at the least cost.

    histogram: size -> (number of sets, cost of scanning the lists of their prefixes), for sizes up to `most`.
    """
    costs = {}
    for bound in range(most + 1):
        listed = sum(count * subsets(n, bound, t) for n, (count, _) in histogram.items() if 1 < n <= bound)
        scanned = sum(cost for n, (_, cost) in histogram.items() if n > 1 and t.most(n) > bound)
        costs[bound] = listed + scanned
    return min(costs, key=lambda b: (costs[b], b))


def subset_rows(bound: int, t: Threshold):
    """mapInArrow: (key, n, small, bits) -> a row (tok, key, n, pos, bits) of each subset of the sizes that the set can need."""
    plans: dict[int, list[tuple[int, np.ndarray]]] = {}

    def run(batches):
        for batch in batches:
            key, n, bits = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            lists = batch.column(2)
            values, at = np.asarray(lists.values), lists.offsets.to_numpy()
            for size in np.unique(n):
                size = int(size)
                if size not in plans:
                    plans[size] = [(c, np.array(list(combinations(range(size), c)))) for c in subset_sizes(size, bound, t)]
                rows = np.flatnonzero(n == size)
                tokens = mixed(values[at[rows][:, None] + np.arange(size)].astype(np.uint64))
                for c, index in plans[size]:
                    with np.errstate(over="ignore"):
                        keys = mixed(tokens[:, index].sum(axis=2, dtype=np.uint64) * np.uint64(2 * c + 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(key[rows], len(index))), pa.array(np.full(keys.size, size, np.int32)), pa.array(np.zeros(keys.size, np.int32)), pa.array(np.repeat(bits[rows], len(index)))], ["tok", "key", "n", "pos", "bits"])

    return run


# ---------------------------------------------------------------- inverted lists


def postings(sets: DataFrame, t: Threshold, small_most: int) -> tuple[DataFrame, int]:
    """A row (tok, key, n, pos) for each subset of a small set and each prefix token of a large one.

    sets: key, n, scan (cost of its prefix's lists), pre (array: its prefix), small (array: the whole
    set where n <= small_most). A pair belongs to the small scheme when both sizes are within the
    bound, else to the large one; a set that can have partners of both kinds is listed in both.
    """
    by_size = sets.filter(F.col("n").between(2, small_most)).groupBy("n").agg(F.count("*").alias("c"), F.sum("scan").alias("s"))
    bound = choose_bound({r["n"]: (r["c"], r["s"]) for r in by_size.collect()}, t, small_most)  # small_most rows at most
    large = sets.filter((F.col("n") > 1) & (F.expr(f"{t.den} * n div {t.num}") > bound)).select("key", "n", F.posexplode("pre").alias("pos", "tok")).select("tok", "key", "n", "pos", F.lit(0).cast("long").alias("bits"))
    if bound < 2:
        return large, bound
    small = sets.filter(F.col("n").between(2, bound)).select("key", "n", "small", F.lit(0).cast("long").alias("bits")).mapInArrow(subset_rows(bound, t), POSTINGS)
    return large.unionByName(small), bound


STAR, PAIR, HOT = 0, 1, 2
OUT = "kind int, tok long, a long, na int, b long, nb int"


def list_pairs(t: Threshold, long_list: int):
    """mapInArrow over postings sorted by (tok, n, key): candidate pairs of each inverted list.

    STAR pairs join each member with the first one of about its size; PAIR rows are the other pairs of
    lists of up to long_list members. Longer lists come out as HOT rows, one per member, beside their
    STAR pairs. Memory: one batch and long_list rows, however long a list is.
    """

    def passed(na, pa_, xa, nb, pb, xb):
        """Length, positional and bitmap filters; na <= nb."""
        need = -(-t.num * (na + nb) // (t.num + t.den))
        left = 1 + np.minimum(na - pa_ - 1, nb - pb - 1)
        return (na >= -(-t.num * nb // t.den)) & (left >= need) & (np.bitwise_count(xa ^ xb) <= na + nb - 2 * need)

    def rows(kind, tok, a, na, b, nb):
        m = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.broadcast_to(tok, m).astype(np.int64)), pa.array(a), pa.array(na), pa.array(b), pa.array(nb)], ["kind", "tok", "a", "na", "b", "nb"])

    def run(batches):
        held = None  # rows of the last list, which may go on
        pivot = None  # of the list that is being streamed as HOT: tok, key, n, pos, bits

        def hot(tok, key, n, pos, bits):
            """Streams rows of one long list."""
            nonlocal pivot
            yield rows(HOT, tok, key, n, key, n)
            at = 0
            while at < len(key):
                if pivot is None or pivot[0] != tok or n[at] > t.most(pivot[2]):
                    pivot = (tok, key[at], n[at], pos[at], bits[at])
                    at += 1
                    continue
                end = at + int(np.searchsorted(n[at:], t.most(pivot[2]), "right"))
                ok = passed(np.int32(pivot[2]), pivot[3], pivot[4], n[at:end], pos[at:end], bits[at:end]) & (key[at:end] != pivot[1])
                k = int(ok.sum())
                if k:
                    yield rows(STAR, tok, np.full(k, pivot[1]), np.full(k, pivot[2], np.int32), key[at:end][ok], n[at:end][ok])
                at = end

        def whole(tok, key, n, pos, bits):
            """Lists that are complete in these rows."""
            if not len(tok):
                return
            starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            sizes = np.diff(np.append(starts, len(tok)))
            for c in np.unique(sizes):
                if c < 2:
                    continue
                if c > long_list:
                    for s in starts[sizes == c]:
                        yield from hot(tok[s], *(x[s : s + c] for x in (key, n, pos, bits)))
                    continue
                i, j = np.triu_indices(c, 1)
                base = starts[sizes == c][:, None]
                x, y = (base + i).ravel(), (base + j).ravel()
                star = np.broadcast_to(i == 0, (len(base), len(i))).ravel()
                ok = passed(n[x], pos[x], bits[x], n[y], pos[y], bits[y])
                for kind, which in ((STAR, ok & star), (PAIR, ok & ~star)):
                    if which.any():
                        u, v = x[which], y[which]
                        yield rows(kind, tok[u], key[u], n[u], key[v], n[v])

        for batch in batches:
            cols = [np.asarray(batch.column(i)) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            tok, key = cols[:2]
            if not len(tok):
                continue
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])])
            cols = [x[new] for x in cols]
            tok = cols[0]
            last = int(np.searchsorted(tok, tok[-1]))
            if last:
                first = int(np.searchsorted(tok, tok[0], "right"))
                if pivot is not None and pivot[0] == tok[0]:
                    yield from hot(tok[0], *(x[1:first] for x in cols[1:]))
                    yield from whole(*(x[first:last] for x in cols))
                else:
                    yield from whole(*(x[:last] for x in cols))
            tail = [x[last:] for x in cols]
            if pivot is not None and pivot[0] == tail[0][0]:
                yield from hot(tail[0][0], *(x[1:] for x in tail[1:]))
                held = [x[-1:] for x in tail]  # so that repeated rows are seen
            elif len(tail[0]) > long_list:
                yield from hot(tail[0][0], *tail[1:])
                held = [x[-1:] for x in tail]
            else:
                held = tail
        if held is not None and not (pivot is not None and pivot[0] == held[0][0]):
            yield from whole(*held)

    return run


def candidates(listed: DataFrame, t: Threshold, long_list: int = 64) -> DataFrame:
    """Candidate pairs and long lists of the postings, staged: kind, tok, a, na, b, nb."""
    sorted_lists = listed.repartition("tok").sortWithinPartitions("tok", "n", "key")
    return stage(sorted_lists.mapInArrow(list_pairs(t, long_list), OUT), "pairs")


def bitmap_bound(t: Threshold):
    """mapInArrow: drops pairs whose bitmaps differ in more bits than similar sets can. Columns: ..., na, nb, bits_a, bits_b (last)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("na", "nb"))
            a, b = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            apart = np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)
            most = na + nb - 2 * -(-t.num * (na + nb) // (t.num + t.den))
            yield batch.filter(pa.array(apart <= most)).select(batch.schema.names[:-2])

    return run


def with_bits(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb, ...) with both bitmaps as the last columns."""
    both = pairs.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("key").alias("b"), F.col("bits").alias("bits_b")), "b")
    return both.select(*pairs.columns, "bits_a", "bits_b")


#: Keys of sets that may be broadcast: 16 MB.
BROADCAST_KEYS = 2_000_000


def verified(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets (key, toks) are similar. Only the sets of the pairs leave their tasks."""
    pairs = stage(pairs.select("a", "b"), "weighed")
    keys = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends")
    some = sets.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
    both = pairs.join(some.select(F.col("key").alias("a"), F.col("toks").alias("ta")), "a").join(some.select(F.col("key").alias("b"), F.col("toks").alias("tb")), "b")
    return both.filter(similar(t, F.col("ta"), F.col("tb"))).select("a", "b")


#: Rows that one side of a meeting holds at once, and the closest partners that a round with pivots keeps.
MEETING_ROWS, CLOSEST = 2048, 4


def meetings(members: DataFrame, t: Threshold, pivots: int | None) -> DataFrame:
    """Pairs (a, b, na, nb) within long lists that the bitmaps allow, of each open member with pivots or with all members.

    members: tok, key, n, bits, open. Pivots are the members of the least hashes, so lists that share members
    share pivots; with pivots, each open member keeps its CLOSEST allowed partners. Without, the pairs are
    all that the bitmaps allow. Members meet in blocks of about MEETING_ROWS rows, which no pair leaves unless
    it is allowed.
    """
    if pivots is not None:
        rank = F.row_number().over(Window.partitionBy("tok").orderBy(F.xxhash64("key", F.lit(pivots)), "key"))
        firsts = members.withColumn("r", rank).filter(F.col("r") <= pivots).drop("r")
    else:
        firsts = members
    seekers = members.filter("open")
    count = lambda df, name: df.groupBy("tok").agg(F.ceil(F.count("*") / MEETING_ROWS).alias(name))
    shape = count(firsts, "across").join(count(seekers, "down"), "tok")
    mine = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = firsts.join(shape, "tok").withColumn("i", mine("across", 1)).withColumn("j", all_of("down")).select("tok", "i", "j", "key", "n", "bits")
    right = seekers.join(shape, "tok").withColumn("j", mine("down", 2)).withColumn("i", all_of("across")).select(*[F.col(c).alias(f"{c}_") for c in ("tok", "i", "j", "key", "n", "bits")])

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(one) and len(two):
            bits = [np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (one["bits"], two["bits_"])]
            na, ka = one["n"].to_numpy(np.int64), one["key"].to_numpy(np.int64)
            for k, (n, key) in enumerate(zip(two["n_"].tolist(), two["key_"].tolist(), strict=True)):
                apart = np.bitwise_count(bits[0] ^ bits[1][k]).sum(axis=1).astype(np.int64)
                small, large = np.minimum(na, n), np.maximum(na, n)
                ok = (apart <= na + n - 2 * -(-t.num * (na + n) // (t.num + t.den))) & (small * t.den >= large * t.num) & (ka != key)
                at = np.flatnonzero(ok)
                if pivots is not None and len(at) > CLOSEST:
                    at = at[np.argsort(apart[at], kind="stable")[:CLOSEST]]
                if len(at):
                    a, b = np.minimum(ka[at], key), np.maximum(ka[at], key)
                    found.append(np.column_stack([a, b, np.where(ka[at] == a, na[at], n), np.where(ka[at] == a, n, na[at])]))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        return pd.DataFrame(out, columns=["a", "b", "na", "nb"]).astype({"na": "int32", "nb": "int32"})

    met = left.groupBy("tok", "i", "j").cogroup(right.groupBy("tok_", "i_", "j_")).applyInPandas(meet, "a long, b long, na int, nb int")
    return met.distinct()


def similar(t: Threshold, a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter * t.den >= (F.size(a) + F.size(b) - inter) * t.num


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Large-star and small-star steps, each one grouping by node and joining its minimum back; the edges
    are staged after each round, and the last ones dropped. It ends as every round but the last lowers
    some node's target. Fixed-size state per group, so a hub of any degree is no obstacle.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(low, "u")
        if large:
            out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u != v")  # at most a row per edge and node, so repeats can wait for the round's end

    now = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct(), "edges")
    while True:
        former, now = now, stage(star(star(now, True), False).distinct(), "edges")
        drop_stage(former)
        # the edges are stars, each node's one edge leading to its root, when no target is a source and no source has two
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1").limit(1).count():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, root) after the links (a, b) too: components of the links between roots alone, carried over to all nodes."""
    a, b = (comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    heads = components(between)
    moved = comp.join(heads.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(heads.join(comp.select("node"), "node", "left_anti").select("node", "root"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
