"""Stored indexes that grow: postings, entity tokens and vectors as Parquet segments, with add, delete, clear and compact.

Each call writes a segment under the next number; nothing is rewritten. A delete writes the ids alone, and
counts for segments of smaller numbers, so an id can be added again (which replaces it). compact() writes what
lives as one segment, with a list of its ids, so that segments which are still there beside it do not count. Postings are sorted by term, so a search reads the row groups of its terms alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators import index as I
from docmill.scratch import folders, remove, rename, written

TABLES = ("postings", "lengths", "entities", "vectors")
#: By what the rows of a table are sorted; a frequent word's rows may lie in several files.
SORT = {"postings": ("term", "doc_id"), "entities": ("form", "doc_id")}
KEY_RANGE_ROWS = 2_000_000
#: Terms of a query batch that are pushed into the scan; more are joined.
PUSHED_TERMS = 1000


def ranged(rows: DataFrame, name: str) -> DataFrame:
    return rows.repartitionByRange(*SORT[name]).sortWithinPartitions(*SORT[name])


class Index:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        return [int(x.split("=")[1]) for x in folders(self.spark, self.path) if x.startswith("seq=")]

    def next(self) -> str:
        return f"{self.path}/seq={max(self.numbers(), default=0) + 1:06d}"

    def add(self, docs: DataFrame, vectors: DataFrame | None = None) -> None:
        """Adds documents (doc_id, text), and vectors (doc_id, embedding) if given; an id that is there is replaced."""
        self._write(self.next(), docs, vectors, replace=True)

    def _write(self, path: str, docs: DataFrame | None, vectors: DataFrame | None, replace: bool) -> None:
        if replace and self.numbers():  # the first segment replaces nothing
            ids = [d.select("doc_id") for d in (docs, vectors) if d is not None]
            for d in ids[1:]:
                ids[0] = ids[0].unionByName(d)
            ids[0].distinct().write.parquet(f"{path}/deleted")
        if docs is not None:
            # each text is parted into words once; range partitions read their rows twice, so those are stored before
            posted = written(I.counted(docs), "postings")
            ranged(posted.filter("term is not null").select("doc_id", "term", "tf", "dl"), "postings").write.parquet(f"{path}/postings")
            posted.filter("first").select("doc_id", "dl").write.parquet(f"{path}/lengths")
            ranged(written(I.entity_index(docs), "entities"), "entities").write.parquet(f"{path}/entities")
        if vectors is not None:
            vectors.select("doc_id", "embedding").write.parquet(f"{path}/vectors")

    def delete(self, ids: DataFrame) -> None:
        """Deletes documents by id (doc_id)."""
        ids.select("doc_id").distinct().write.parquet(f"{self.next()}/deleted")

    def clear(self) -> None:
        remove(self.spark, self.path)

    def table(self, name: str) -> DataFrame | None:
        """The rows of a table that live; None if no segment has the table."""
        have = [n for n in self.numbers() if name in folders(self.spark, f"{self.path}/seq={n:06d}")]
        if not have:
            return None
        read = lambda n, t: self.spark.read.parquet(f"{self.path}/seq={n:06d}/{t}").withColumn("seq", F.lit(n))
        rows = read(have[0], name)
        for n in have[1:]:
            rows = rows.unionByName(read(n, name))
        gone = [n for n in self.numbers() if n > have[0] and "deleted" in folders(self.spark, f"{self.path}/seq={n:06d}")]
        if gone:
            last = read(gone[0], "deleted")
            for n in gone[1:]:
                last = last.unionByName(read(n, "deleted"))
            last = last.groupBy("doc_id").agg(F.max("seq").alias("gone"))
            rows = rows.join(I.small(last), "doc_id", "left").filter(F.col("gone").isNull() | (F.col("seq") >= F.col("gone"))).drop("gone")
        return rows.drop("seq")

    def compact(self) -> None:
        """Rewrites what lives as one segment, which appears whole or not at all, and removes the others."""
        old, path = self.numbers(), self.next()
        early = f"{self.path}/making-{path.rpartition('=')[2]}"  # not a segment yet
        remove(self.spark, early)
        for name in TABLES:
            rows = self.table(name)
            if rows is not None:
                (ranged(written(rows, name), name) if name in SORT else rows).write.parquet(f"{early}/{name}")
        ids = [rows.select("doc_id") for rows in map(self.table, ("lengths", "vectors")) if rows is not None]
        if ids:
            # until the others are gone, they do not count beside it
            reduce(DataFrame.unionByName, ids).distinct().write.parquet(f"{early}/deleted")
            rename(self.spark, early, path)
        for n in old:
            remove(self.spark, f"{self.path}/seq={n:06d}")

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank, from the stored postings of the queries' terms."""
        asked = I.asked_terms(queries)
        posted, lengths = self.table("postings"), self.table("lengths")
        if posted is None or lengths is None:
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        terms = asked.select("term").distinct()
        few = terms.limit(PUSHED_TERMS + 1).collect()
        mine = posted.filter(F.col("term").isin([r["term"] for r in few])) if len(few) <= PUSHED_TERMS else posted.join(I.small(terms), "term")
        return I.top(I.bm25_scores(mine, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), asked, "doc_id"), k, "doc_id")

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank of the exact search over the stored tokens."""
        stored = self.table("entities")
        if stored is None:
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return I.exact_search(stored, queries, k)

    def dense(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score, rank by cosine similarity to the stored vectors; queries (query_id, q)."""
        stored = self.table("vectors")
        if stored is None:
            return queries.select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        return I.dense(stored.withColumnRenamed("doc_id", "vec_id"), queries, k).withColumnRenamed("vec_id", "doc_id")


# ---------------------------------------------------------------- caches of results and embeddings


def retrieval_key(query, corpus_version: int, index_version: int, top_k: int, rrf_k: int, filters: dict | None = None):
    """The key of a cached result: the query's hash, the versions, the depths and the filters' fingerprint."""
    return F.concat(F.lit("r"), F.substring(F.sha2(query.cast("binary"), 256), 1, 16), F.lit(f":c{corpus_version}:i{index_version}:k{top_k}:rk{rrf_k}:f"), fingerprint(filters))


def fingerprint(filters: dict | None):
    """Twelve hex digits of the filters in order of their names; empty without any."""
    if not filters:
        return F.lit("")
    plain = ";".join(f"{k}={filters[k]!r}" for k in sorted(filters, key=str))
    return F.substring(F.sha2(F.lit(plain).cast("binary"), 256), 1, 12)


CANDIDATE = "array<struct<rank: int, doc_id: bigint, score: double>>"


def serialised(candidates: DataFrame) -> DataFrame:
    """query_id, value: each query's ranked candidates as JSON."""
    return candidates.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"))))).alias("value"))


def deserialised(cached: DataFrame) -> DataFrame:
    """query_id, doc_id, score, rank of cached values; a value that cannot be read gives no rows, which is a miss."""
    return cached.select("query_id", F.explode(F.from_json("value", CANDIDATE)).alias("c")).filter(F.col("c.doc_id").isNotNull()).select("query_id", "c.doc_id", "c.score", "c.rank")


def store(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Cache entries (key, ...) with new ones, which replace those of their keys."""
    return entries.join(new.select("key"), "key", "left_anti").unionByName(new)


def invalidate(entries: DataFrame, corpus_version: int | None = None, index_version: int | None = None) -> DataFrame:
    """Entries without those of a corpus or index version."""
    for column, version in (("corpus_version", corpus_version), ("index_version", index_version)):
        if version is not None:
            entries = entries.filter(F.col(column) != version)
    return entries


def embedded(texts: DataFrame, cache: DataFrame, model: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(texts with the embedding that the cache has for their hash, model and version; the other texts, each once)."""
    keyed = texts.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    known = cache.filter((F.col("model") == model) & (F.col("version") == version)).select("text_hash", "embedding").dropDuplicates(["text_hash"])
    return keyed.join(known, "text_hash"), keyed.join(known, "text_hash", "left_anti").dropDuplicates(["text_hash"])
