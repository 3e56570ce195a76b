"""N-gram Jaccard join of documents: a size-aware heavy-light join on sets of word shingles.

Method. Sets up to a size bound, chosen by cost from all sets' sizes and list lengths, are joined by
the subsets of fixed sizes that similar sets must share; larger sets scan inverted lists of their
rarest shingles. Candidates pass length, positional and bitmap bounds, all exact, and are then verified
on the whole sets. Documents of equal sets form a class beforehand, so copies are never paired.

For components, links inside one component need no check. So each list first links its members to one
of them, components are formed, and only pairs across components are checked after that. Lists longer
than LONG_LIST, which near copies of one text or very frequent shingles make, are not expanded: their
members meet a few pivots, then more, and only those outside the list's largest component then meet all
members, in blocks in which the bitmaps are compared and from which only allowed pairs emerge.

Edge cases: a null text, or one without words, has an empty set, n_shingles 0, and is linked with
nothing (its component is its own doc_id). A text of fewer words than a shingle is one shingle. A
repeated doc_id keeps all its rows, and each has its own set. A null doc_id is kept; it never names a
component unless all of its members are null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import setjoin as S
from docmill.llm.common import blocks, scope, shingle_hashes, stage, table, word_hashes

#: Sets up to this size are considered for the enumeration of subsets.
SMALL_MOST = 16
LONG_LIST = 48
#: Pivots of the rounds over long lists; None: all members.
ROUNDS = (32, 512, None)
SETS = "doc_id long, h long, key long, n int, first boolean, scan double, pre array<long>, small array<long>, bits binary"


def _hashes(size: int):
    return lambda column: shingle_hashes(*word_hashes(column), size)


def shingle_sets(docs: DataFrame, classes: np.ndarray, size: int, t: S.Threshold) -> DataFrame:
    """A row per document: the hash of its set, the set's size, its prefix, and the whole set if small.

    `first` marks the first row of its set in its partition; only those are listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)  # 16 MB at any input size
    hashes = _hashes(size)

    def run(batches):
        seen: set[int] = set()
        df = np.exp2(np.arange(128) / 4) - 1
        for batch in batches:
            ids, places, column = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi in blocks(column):
                h, at = hashes(column.slice(lo, hi - lo))
                tokens = S.ranked(h, shared.value)
                key, n, first, scan, pre, small, bits = [], [], [], [], [], [], []
                for k in range(hi - lo):
                    s = np.unique(tokens[at[k] : at[k + 1]])
                    m = len(s)
                    mine = S.set_key(s)
                    new = m > 1 and mine not in seen
                    key.append(mine)
                    n.append(m)
                    first.append(new)
                    if new:
                        seen.add(mine)
                        p = s[: t.prefix(m)]
                        pre.append(p)
                        scan.append(float(df[p >> 56].sum()))
                        small.append(s if m <= SMALL_MOST else None)
                        bits.append(S.bitmap(s))
                    else:
                        pre.append(None)
                        scan.append(0.0)
                        small.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), places.slice(lo, hi - lo), pa.array(key, pa.int64()), pa.array(n, pa.int32()), pa.array(first), pa.array(scan), pa.array(pre, pa.list_(pa.int64())), pa.array(small, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "h", "key", "n", "first", "scan", "pre", "small", "bits"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, SETS)


def full_sets(docs: DataFrame, chosen: DataFrame, classes: np.ndarray | None, size: int) -> DataFrame:
    """(key, toks): the whole sets of the chosen rows (doc_id and hash of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(classes) if classes is not None else None
    hashes = _hashes(size)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            new = []
            for k, key in enumerate(batch.column(0).to_pylist()):  # repeated rows
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            for lo, hi in blocks(batch.column(1)):
                h, at = hashes(batch.column(1).slice(lo, hi - lo))
                tokens = S.ranked(h, shared.value) if shared is not None else S.unranked(h)
                sets = [np.unique(tokens[at[k] : at[k + 1]]) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))], ["key", "toks"])

    # by the text's hash as well, so that rows of one doc_id, or of none, do not meet each other's texts
    texts = docs.join(chosen.select("key", "at.*").withColumnsRenamed({"doc_id": "d", "h": "dh"}), (F.col("h") == F.col("dh")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return texts.select("key", "text").mapInArrow(run, "key long, toks array<long>").dropDuplicates(["key"])


#: Rows of (doc_id, key) that may be broadcast: 32 MB.
BROADCAST_ROWS = 2_000_000


def ngram_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text)."""
    with scope() as made:  # of the tables made on the way, only the result stays
        return made.keep(stage(_components(docs, size, num, den), "components"))


def _components(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    t = S.Threshold(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    classes = S.frequency_classes(docs.select("text"), _hashes(size))
    sets = stage(shingle_sets(docs, classes, size, t), "sets")
    one = sets.filter("first")
    listed, _ = S.postings(one, t, SMALL_MOST)
    cand = S.candidates(listed, t, LONG_LIST)
    hot = cand.filter(F.col("kind") == S.HOT).select("tok", F.col("a").alias("key"), F.col("na").alias("n"))
    return linked(docs, sets, one, cand, hot, classes, size, t)


def linked(docs: DataFrame, sets: DataFrame, one: DataFrame, cand: DataFrame, hot: DataFrame, classes: np.ndarray | None, size: int, t: S.Threshold) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows of sets, from candidate pairs and the members of long lists (tok, key, n).

    one: a row or more of each class (key, doc_id, h, bits). classes: of frequency, by which the tokens of whole sets are ranked; None: not ranked.
    """
    # each pair once; exact bounds before any whole set is read
    bits = one.select("key", "bits").dropDuplicates(["key"])
    pairs = cand.filter(F.col("kind") != S.HOT).groupBy("a", "b").agg(F.min("kind").alias("kind"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = stage(S.with_bits(pairs.select("a", "b", "kind", "na", "nb"), bits).mapInArrow(S.bitmap_bound(t), "a long, b long, kind int, na int, nb int"), "bounded")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(hot.select("key")).distinct()
    chosen = one.join(wanted, "key").groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("at"))
    chosen = stage(chosen, "chosen")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    whole = stage(full_sets(docs, side, classes, size), "whole")

    comp = stage(S.components(stage(S.verified(pairs.filter(F.col("kind") == S.STAR), whole, t), "links")), "comp")

    def join(more: DataFrame) -> None:
        """Verifies pairs across components, and joins the components of those that are similar."""
        nonlocal comp
        found = stage(S.verified(across(more, comp), whole, t), "links")
        if found.limit(1).count():
            comp = stage(S.merged(comp, found), "comp")

    join(pairs.filter(F.col("kind") == S.PAIR))
    for pivots in ROUNDS:
        members = stage(open_members(hot, comp, bits), "members")
        longest = members.filter("open").groupBy("tok").count().agg(F.max("count").alias("c")).first()["c"]
        if longest is None:
            break
        if pivots is None or longest > pivots:
            join(S.meetings(members, t, pivots))

    keys = sets.groupBy("key", (F.col("n") == 0).alias("void")).agg(F.min("doc_id").alias("low")).filter("not void")
    rooted = keys.join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("key", "component_id")
    out = sets.select("doc_id", "key", "n").join(named, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose members are in different components so far."""
    a, b = (comp.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def open_members(hot: DataFrame, comp: DataFrame, bits: DataFrame) -> DataFrame:
    """Members of long lists that are in several components; open are those outside the list's largest one."""
    placed = hot.join(comp.withColumnRenamed("node", "key"), "key", "left").select("tok", "key", "n", F.coalesce("root", "key").alias("root"))
    largest = placed.groupBy("tok", "root").agg(F.count("*").alias("c")).groupBy("tok").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("several")).filter("several > 1")
    return placed.join(largest, "tok").join(bits, "key").select("tok", "key", "n", "bits", (F.col("root") != F.col("top.root")).alias("open"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))
