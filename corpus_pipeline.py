"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame. Between stages the
rows are written as Parquet and read again. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import line_dedup, mixing, ngram_join, packing, quality
from docmill.llm.common import drop_stage, stage, table

#: Rows of (doc_id, hash, fate) that may be broadcast: 34 MB.
BROADCAST_ROWS = 2_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on labels, scores below its limit."""
    docs = docs.select(*COLUMNS)
    labels = table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels)).filter(F.col("score") >= quality.REJECT_BELOW).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line resembles; documents that lose all their text go."""
    done = line_dedup.dedup_lines(docs.select(*COLUMNS), least=line_dedup.ALL_LINES)
    kept = done.filter((F.col("n_gone") == 0) | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of the smallest doc_id. Five words, similarity 0.8."""
    docs = docs.select(*COLUMNS)
    found = ngram_join.ngram_components(docs, size=5, num=80, den=100)
    # documents without words are linked with nothing, and stay
    heads = found.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("head"), F.lit(True).alias("stays")).distinct()
    # the texts meet only the list of rows that go or that repeat; all others stay where they are
    h = F.xxhash64("text")
    rows = docs.groupBy(F.col("doc_id").alias("d"), h.alias("dh")).count()
    fate = rows.join(heads, F.col("d").eqNullSafe(F.col("head")), "left").select("d", "dh", F.coalesce("stays", F.lit(False)).alias("stays"), F.col("count").alias("copies"))
    fate = stage(fate.filter("not stays or copies > 1"), "fate")
    side = F.broadcast(fate) if fate.count() <= BROADCAST_ROWS else fate
    told = docs.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (h == F.col("dh")), "left")
    # a repeated doc_id can bring several rows of one group, or of several; one row of each text stays
    again = told.filter("stays and copies > 1").dropDuplicates(["doc_id", "text"])
    return told.filter("copies is null").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: not at all, once or twice."""
    return mixing.repeated(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents that are left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", best_fit_packing),
]

#: The classifier's trees cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, former = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        if former is not None:
            drop_stage(former)
        former = docs
    return docs
