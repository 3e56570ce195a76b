"""Routed retrieval: each query runs the lists that its plan names, within its bounds of time, and so do its parts.

A query of several parts ("... and ...") is planned as a whole and by each part; these legs are searched side by side,
in one search per list that serves all legs which ask for it, and a document counts by its best leg.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import index as I
from docmill.operators import planner as P
from docmill.operators.retrieve import RRF_K
from docmill.scratch import written

#: Words that bound the time that a query asks for, and what they ask of a year: fixed values.
BOUNDS = {"before": "<", "after": ">", "since": ">=", "until": "<=", "during": "="}
#: Words by which a query asks for rows of a table: fixed values.
HINT = r"\b(export|list|all|every|each|show\s+\w+\s+table|rows|columns)\b"
#: search(queries, depth) -> query_id, doc_id, rank
Search = Callable[[DataFrame, int], DataFrame]


def bounds(text: Column) -> dict[str, Column]:
    """The years that a query names, and those after each word of BOUNDS, as arrays of int."""
    low = F.lower(F.coalesce(text, F.lit("")))
    years = lambda pattern: F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), lambda y: y.cast("int"))
    return {"years": years(r"\b(20\d{2})\b")} | {word: years(rf"\b{word}\s+({r'20\d{2}' if word == 'during' else r'\d{4}'})") for word in BOUNDS}


def legs(queries: DataFrame) -> DataFrame:
    """leg (struct of query_id and part), text, intent, strategies, structured and bounds of each query (part 0) and each of its parts (from 1).

    A query that is nothing but compound has no leg of its own. Parts hold no joining word, so they have no parts.
    """
    whole = P.plans(queries).select("query_id", "parts")
    parts = whole.select("query_id", F.posexplode("parts").alias("k", "text")).select("query_id", (F.col("k") + 1).alias("part"), "text")
    own = queries.select("query_id", F.lit(0).alias("part"), "text")
    asked = own.unionByName(parts.join(own.select("query_id", F.col("text").alias("whole")), "query_id").filter(F.col("text") != F.trim("whole")).drop("whole"))
    asked = asked.select(F.struct("query_id", "part").alias("query_id"), "text")
    planned = P.plans(asked).select("query_id", "intent", "confidence", "strategies")
    told = asked.join(planned, "query_id").withColumns(bounds(F.col("text")))
    return told.withColumn("structured", F.lower(F.coalesce("text", F.lit(""))).rlike(HINT)).withColumnRenamed("query_id", "leg").filter(F.size("strategies") > 0)


def within(year: Column) -> Column:
    """Whether a document's year lies within a leg's bounds; a document without a year only where there are none."""
    test = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}
    # years after a word bound the range; those that stand alone name the years themselves
    bound = F.concat(*BOUNDS)
    alone = F.array_except("years", bound)
    checks = [(F.size(alone) == 0) | F.array_contains(alone, year)]
    holds = lambda op: lambda y: test[op](year, y)
    checks += [(F.size(word) == 0) | F.forall(word, holds(op)) for word, op in BOUNDS.items()]
    free = (F.size("years") == 0) & (F.size(bound) == 0)
    return free | F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def searches(docs: DataFrame, meta: DataFrame | None = None, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None) -> dict[str, Search]:
    """The lists that plans name, over docs (doc_id, text).

    meta (doc_id and fields; doc_type tells structured documents) gives the lists `metadata`, of documents one of
    whose fields is a word of the query, and `structured`; vectors (doc_id, embedding) and asked_vectors (query_id,
    q) give `dense`, which parts of a query share with it.
    """
    found: dict[str, Search] = {"bm25": lambda q, k: I.bm25(docs, q, k), "exact": lambda q, k: I.exact_over(docs, q, k)}
    if meta is not None:
        found["metadata"] = lambda q, k: metadata_search(meta, q, k)
        if "doc_type" in meta.columns:
            tables = docs.join(meta.filter("doc_type = 'structured'").select("doc_id"), "doc_id", "left_semi")
            found["structured"] = lambda q, k: I.bm25(tables, q, k)
    if vectors is not None and asked_vectors is not None:
        rows = vectors.select(F.col("doc_id").alias("vec_id"), "embedding")

        def dense(q: DataFrame, k: int) -> DataFrame:
            own = q.select("query_id", F.col("query_id.query_id").alias("whole")).join(asked_vectors.withColumnRenamed("query_id", "whole"), "whole")
            return I.dense(rows, own.select("query_id", "q"), k).withColumnRenamed("vec_id", "doc_id")

        found["dense"] = dense
    return found


def metadata_search(meta: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: documents by how many of their fields are a word of the query."""
    fields = [c for c in meta.columns if c != "doc_id"]
    words = I.small(queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+"))).alias("word")).filter("word <> ''"))
    values = meta.select("doc_id", F.explode(F.array_compact(F.array(*[F.lower(F.col(c).cast("string")) for c in fields]))).alias("word"))
    return I.top(values.join(words, "word").groupBy("query_id", "doc_id").agg(F.count("*").cast("double").alias("score")), k, "doc_id")


def routed(queries: DataFrame, lists: dict[str, Search], years: DataFrame | None = None, k: int = 20, depth: int = 100) -> DataFrame:
    """query_id, doc_id, score, rank, part: the best documents of each query by its plan; part is the leg that counted.

    lists: what serves the names in plans; names without a list are passed over. years (doc_id, year): by which
    bounds of time are checked; without it they are not. A leg's score is the reciprocal rank sum of its lists.
    """
    planned = written(legs(queries), "legs")
    hits = []
    for name, search in lists.items():
        asked = planned.filter(F.array_contains("strategies", name)).select(F.col("leg").alias("query_id"), "text")
        if asked.limit(1).count():
            hits.append(search(asked, depth).select(F.col("query_id").alias("leg"), "doc_id", "rank"))
    if not hits:
        none = F.lit(None)
        return planned.select("leg.query_id", none.cast("long").alias("doc_id"), none.cast("double").alias("score"), none.cast("int").alias("rank"), "leg.part").limit(0)
    fused = reduce(DataFrame.unionByName, hits).groupBy("leg", "doc_id").agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"))
    if years is not None:
        dated = fused.join(years.select("doc_id", "year"), "doc_id", "left")
        fused = dated.join(I.small(planned.select("leg", "years", *BOUNDS)), "leg").filter(within(F.col("year"))).select("leg", "doc_id", "score")
    fused = fused.withColumn("score", F.round("score", 6))
    best = fused.groupBy(F.col("leg.query_id").alias("query_id"), "doc_id").agg(F.max("score").alias("score"), F.min_by("leg.part", F.struct(-F.col("score"), "leg.part")).alias("part"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank", "part")
