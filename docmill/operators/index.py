"""Lexical, entity and vector indexes as tables, and batched search over them.

Queries are a table too (query_id, text), so one pass over an index serves all of them. The tables of
terms that are broadcast hold a query batch's terms, whose number is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.scratch import written

BROADCAST_ROWS, LONG_TERM = 100_000, 20
#: Queries and vectors whose products are formed at once, blocks of queries that are broadcast, and candidates that a task gathers before it sorts out the best.
DENSE_BLOCK, DENSE_CHUNK, DENSE_BLOCKS, DENSE_HELD = 2048, 1024, 64, 1 << 18
#: Words of a query batch that are looked for within each text's row; more are joined.
FILTER_TERMS = 200
K1, B = 1.2, 0.75


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf."""
    return docs.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(T.tokens(F.col(text))).cast("long").alias("dl"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf, first: postings with their text's length; one row of each text is its first, and a text without words has a row without a term."""
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.posexplode_outer("w").alias("at", "term"))
    return words.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"), (F.coalesce(F.min("at"), F.lit(0)) == 0).alias("first"))


def term_df(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qn (how often the query has it)."""
    return queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def bm25_scores(tf: DataFrame, size: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """query_id, key, score of postings (key, dl, term, tf) of the asked terms; size: one row n, avgdl."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(small(df), "term").crossJoin(F.broadcast(size)).join(small(asked), "term")  # size: one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", key).agg(F.sum(part * F.col("qn")).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank: the k best documents of each query; a repeated query term counts again.

    One pass over the texts finds the queries' words and all lengths; only those are kept (store.Index holds the
    postings of all words for many batches).
    """
    asked = asked_terms(queries)
    terms = [r["term"] for r in asked.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
    words = docs.select(key, T.tokens(F.col("text")).alias("w")).withColumn("dl", F.size("w"))
    if len(terms) <= FILTER_TERMS:  # the other words never leave their row
        words = written(words.select(key, "dl", F.filter("w", lambda w: w.isin(terms)).alias("w")), "words")
        tf = words.select(key, "dl", F.explode("w").alias("term"))
    else:
        tf = words.select(key, "dl", F.explode("w").alias("term")).join(small(asked.select("term").distinct()), "term")
    tf = tf.groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))
    return top(bm25_scores(tf, words.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), asked, key), k, key)


def top(scored: DataFrame, k: int, key: str, digits: int = 6) -> DataFrame:
    """The k best of each query, by rounded score, then key; ranks from 1."""
    scored = scored.withColumn("score", F.round("score", digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def entity_index(docs: DataFrame, key: str = "doc_id", terms: list[str] | None = None) -> DataFrame:
    """token, form, key; of the tokens that can be terms only, if those are given."""
    return docs.select(key, F.explode(T.entity_tokens(F.col("text"), terms)).alias("token")).select("token", T.exact_form(F.col("token")).alias("form"), key)


ASKED_WORD = r"[\p{L}\p{N}_'-]+"


def is_long(term: Column) -> Column:
    """Whether a term also counts as a part of tokens."""
    return (F.length(term) >= LONG_TERM) & term.rlike("^[a-z0-9_-]+$")


def exact_over(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """exact_search() straight over texts (key, text). For few terms, none of them long, only what can equal a term is looked for."""
    asked = queries.select(F.explode(F.regexp_extract_all("text", F.lit(ASKED_WORD), F.lit(0))).alias("raw")).select(T.exact_form(F.col("raw")).alias("term"))
    few = asked.distinct().select("term", is_long(F.col("term")).alias("long")).limit(FILTER_TERMS + 1).collect()
    whole = len(few) > FILTER_TERMS or any(r["long"] for r in few)
    return exact_search(entity_index(docs, key, None if whole else [r["term"] for r in few]), queries, k, key)


def exact_search(index: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """Each term of a query adds 1 / number of terms for a token that it equals, for each whose form it is, and, from
    LONG_TERM characters on (an id), for each that it is a part of or that is a part of it."""
    terms = F.regexp_extract_all("text", F.lit(ASKED_WORD), F.lit(0))
    asked = queries.select("query_id", F.explode(terms).alias("raw"), (F.lit(1.0) / F.greatest(F.size(terms), F.lit(1))).alias("w")).select("query_id", "w", T.exact_form(F.col("raw")).alias("term"))
    asked = small(asked.groupBy("query_id", "term").agg(F.sum("w").alias("w")))
    # a token can be hit as it stands and by its form, which count each; one reading of the index serves both
    found = index.select(key, F.explode(F.array("token", "form")).alias("term")).join(asked, "term").select("query_id", key, "w")
    long_terms = asked.filter(is_long(F.col("term")))
    if long_terms.limit(1).count():
        partly = index.join(small(long_terms), F.contains("token", F.col("term")) | F.contains(F.col("term"), F.col("token")))
        found = found.unionByName(partly.select("query_id", key, "w"))
    return top(found.groupBy("query_id", key).agg(F.sum("w").alias("score")), k, key)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit_rows(lists: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows scaled to length one) of the vectors of a column, by length; null ones and those with null entries have length 0.

    A zero vector stays as it is; one with a non-finite entry becomes NaN.
    """
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = lists.flatten(), np.cumsum(counts) - counts
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        counts = np.where(gaps[starts + counts] > gaps[starts], 0, counts)
    found = []
    for d in np.unique(counts).tolist():
        places = np.flatnonzero(counts == d)
        rows = flat[starts[places, None] + np.arange(d)]
        norms = np.sqrt(np.square(rows).sum(1))
        rows = rows / np.where(norms > 0, norms, 1.0)[:, None]
        rows[~np.isfinite(norms)] = np.nan
        found.append((d, places, rows))
    return found


def packed(df: DataFrame, most: int) -> DataFrame:
    """ids, d, rows: up to `most` vectors (id, vector) of one length in a row, scaled to length one."""

    def run(batches):
        for batch in batches:
            for d, places, rows in unit_rows(batch.column(1)):
                for at in range(0, len(places), most):
                    ids = batch.column(0).take(pa.array(places[at : at + most]))
                    ends = pa.array([0, len(ids)], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.array([d], pa.int32()), pa.array([rows[at : at + most].tobytes()], pa.binary())], ["ids", "d", "rows"])

    return df.mapInArrow(run, f"ids array<{df.schema[0].dataType.simpleString()}>, d int, rows binary")


class Best:
    """The k best (score to five digits, then id) of each of n queries among the rows met so far; a row met twice counts once."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.held, self.size = [], 0

    def meet(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores: a line for each of the queries, an entry for each of the rows (of which none repeats)."""
        if len(ids) >= self.k and (new := self.least[queries] == -np.inf).any():
            at = len(ids) - self.k
            self.least[queries[new]] = np.partition(scores[new], at, axis=1)[:, at]
        q, r = np.nonzero(scores >= self.least[queries, None] - 1e-5)  # more than rounding can change
        rounded = np.copysign(np.floor(np.abs(scores[q, r]) * 1e5 + 0.5) / 1e5, scores[q, r]) + 0.0
        self.held.append((queries[q], rounded, ids[r], rows[r]))
        self.size += len(q)
        if self.size > DENSE_HELD + 2 * self.k * len(self.least):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """query, score, id, row of the best, each query's in order."""
        if not self.held:
            return tuple(np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        q, s, i, r = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((r, i, -s, q))
        q, s, i, r = q[order], s[order], i[order], r[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (i[1:] != i[:-1])
        q, s, i, r = q[new], s[new], i[new], r[new]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        last = place == self.k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
        kept = place < self.k
        self.held, self.size = [(q[kept], s[kept], i[kept], r[kept])], int(kept.sum())
        return self.held[0]


#: Stands for a null id; it comes first, as nulls do.
NO_ID = np.iinfo(np.int64).min


def plain_ids(ids: pa.Array) -> np.ndarray:
    return pc.fill_null(ids.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def arrow_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def best_of_blocks(k: int, kind: str):
    """mapInArrow over rows (ids, d, rows of vectors; ids, d, rows of queries): the k best of each query within the task."""

    def run(batches):
        met, done = {}, 0
        for batch in batches:
            for n in range(batch.num_rows):
                ids, asked = batch.column(0)[n].values, batch.column(3)[n].values
                d, e = batch.column(1)[n].as_py(), batch.column(4)[n].as_py()
                key = batch.column(6)[n].as_py()
                if key not in met:
                    met[key] = asked, Best(len(asked), k)
                best, ids = met[key][1], plain_ids(ids)
                products = d == e > 0
                if products:
                    x, q = (np.frombuffer(batch.column(c)[n].as_buffer(), np.float64).reshape(-1, d) for c in (2, 5))
                for at in range(0, len(ids), DENSE_CHUNK):
                    some = ids[at : at + DENSE_CHUNK]
                    scores = q @ x[at : at + DENSE_CHUNK].T if products else np.zeros((len(asked), len(some)))
                    scores[np.isnan(scores)] = np.inf  # NaN comes first, as in Spark's order
                    best.meet(np.arange(len(asked)), scores, some, done + np.arange(len(some)))
                    done += len(some)
        for asked, best in met.values():
            q, s, i, _ = best.settle()
            s = np.where(np.isinf(s), np.nan, s)
            for at in range(0, len(q), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q[part])), arrow_ids(i[part]), pa.array(s[part])], ["query_id", "vec_id", "score"])

    return run, f"query_id {kind}, vec_id long, score double"


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank by cosine similarity, of every vector with every query (query_id, q).

    Blocks of queries meet chunks of vectors, whose products are formed at once; a task keeps each query's best. Ids of
    vectors are whole numbers. A vector that is null, holds a null, is zero or of another length than the query scores 0.
    """
    asked = queries.select("query_id", "q")
    parts = max(1, -(-asked.count() // DENSE_BLOCK))
    blocks = written(packed(asked.repartition(parts), DENSE_BLOCK).withColumn("block", F.monotonically_increasing_id()), "queries")
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    chunks = packed(vectors.select("vec_id", "embedding"), 4 * DENSE_CHUNK).repartition(tasks)
    run, schema = best_of_blocks(k, queries.schema["query_id"].dataType.simpleString())
    met = chunks.crossJoin(small(blocks.select(F.col("ids").alias("asked"), F.col("d").alias("e"), F.col("rows").alias("q"), "block"), DENSE_BLOCKS)).mapInArrow(run, schema)
    return top(met, k, "vec_id", 5)
