"""The catalog's life: support rules, lookups, resumable batches, reconciliation, index contract, errors and statistics."""

from __future__ import annotations

import random
import re
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds that are documents by default, prefixes of kinds that are none, what editors' own kinds are exported as, and extensions: fixed values.
DOCUMENT_KINDS = (
    "application/pdf",
    "application/vnd.google-apps.document",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "text/plain",
    "text/markdown",
    "application/vnd.google-apps.spreadsheet",
    "text/csv",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)
#: Kinds that can be ingested as they are: fixed values.
SUPPORTED_KINDS = (
    "application/pdf",
    "text/plain",
    "text/markdown",
    "text/csv",
    "text/tab-separated-values",
    "application/rtf",
    "application/json",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "application/msword",
    "application/vnd.oasis.opendocument.text",
    "application/vnd.oasis.opendocument.spreadsheet",
)
EXCLUDED = ("image/", "video/", "audio/", "font/", "application/photoshop", "application/illustrator", "application/x-executable", "application/x-msdownload")
EXPORTS = {
    "application/vnd.google-apps.document": "text/plain",
    "application/vnd.google-apps.spreadsheet": "text/csv",
    "application/vnd.google-apps.presentation": "text/plain",
    "application/vnd.google-apps.drawing": "image/png",
    "application/vnd.google-apps.form": "application/json",
    "application/vnd.google-apps.script": "application/json",
}
EXTENSIONS = {
    "text/plain": ".txt",
    "text/markdown": ".md",
    "text/csv": ".csv",
    "text/tab-separated-values": ".tsv",
    "application/pdf": ".pdf",
    "application/rtf": ".rtf",
    "application/json": ".json",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel": ".xls",
    "application/msword": ".doc",
    "application/vnd.oasis.opendocument.text": ".odt",
    "application/vnd.oasis.opendocument.spreadsheet": ".ods",
    "image/png": ".png",
}
#: Parts of messages of errors that pass, and of those that stay: fixed values.
TRANSIENT = ("connection", "connect", "reset", "timeout", "timed out", "temporary", "try again", "retry", "rate limit", "quota", "502", "503", "429", "service unavailable", "unavailable", "socket", "ssl", "dns", "interrupt", "econnreset", "econnrefused")
PERMANENT = ("permission", "auth", "forbidden", "denied", "credentials", "not found", "404", "unsupported", "invalid", "does not exist", "not permitted", "unauthorized", "403")
#: What a document must have before it counts as indexed.
CONTRACT = ("has_normalized", "has_chunks", "has_embeddings", "has_dense", "has_bm25", "has_exact", "provenance_intact", "consistent")


def lookup(catalog: DataFrame, key, column: str = "id") -> DataFrame:
    """The row of one id."""
    return catalog.filter(F.col(column) == F.lit(key))


def supported(kind: Column, kinds=SUPPORTED_KINDS, excluded=EXCLUDED) -> Column:
    """Whether a kind can be read: one of `kinds` or of those that are exported, and without an excluded prefix."""
    out = reduce(lambda a, b: a | b, [F.startswith(kind, F.lit(p)) for p in excluded], F.lit(False))
    return F.coalesce(~out & (kind.isin(*kinds) | kind.isin(*EXPORTS)), F.lit(False))


def exported(kind: Column) -> Column:
    """The kind that a file is fetched as."""
    return F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in EXPORTS.items()], kind)


def extension(kind: Column) -> Column:
    """The extension that a file of a kind is kept under."""
    return F.coalesce(*[F.when(kind == a, F.lit(b)) for a, b in EXTENSIONS.items()], F.lit(".bin"))


def discover(catalog: DataFrame, kinds=DOCUMENT_KINDS) -> DataFrame:
    """Rows of the default kinds that are not trashed, latest first."""
    return catalog.filter((F.col("trashed") == 0) & F.col("mime_type").isin(*kinds)).orderBy(F.desc_nulls_last("modified"), "id")


def stats(catalog: DataFrame, done: DataFrame) -> DataFrame:
    """mime_type, files, done (how many of them are among the ids of `done`), most files first."""
    marked = catalog.join(done.select("id").distinct().withColumn("is_done", F.lit(1)), "id", "left")
    return marked.groupBy("mime_type").agg(F.count("*").alias("files"), F.count("is_done").alias("done")).orderBy(F.desc("files"), "mime_type")


def pending(catalog: DataFrame, processed: DataFrame, blocked: DataFrame, batch: int = 10) -> DataFrame:
    """Rows that are neither processed nor blocked, with the number of their batch, in order of id.

    Batches are numbered from the counts of sorted parts, so no task orders all rows.
    """
    left = catalog.join(processed.select("id"), "id", "left_anti").join(blocked.select("id"), "id", "left_anti")
    bounds = left.stat.approxQuantile("id", [k / 64 for k in range(1, 64)], 0.005) if left.limit(1).count() else []
    part = reduce(lambda c, b: c + (F.col("id") > F.lit(b)).cast("int"), sorted(set(bounds)), F.lit(0))
    parted = left.withColumn("part", part)
    before = parted.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 64 rows at most
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return parted.withColumn("place", place).join(F.broadcast(before.select("part", "before")), "part").withColumn("batch", F.floor((F.col("place") - 1 + F.col("before")) / batch)).drop("part", "place", "before")


def reconcile(catalog: DataFrame, kinds=SUPPORTED_KINDS, excluded=EXCLUDED) -> DataFrame:
    """ids, eligible, excluded, other: distinct ids in all, of supported kinds, of excluded prefixes, and the rest."""
    ok = supported(F.col("mime_type"), kinds, excluded)
    out = F.coalesce(reduce(lambda a, b: a | b, [F.startswith("mime_type", F.lit(p)) for p in excluded]), F.lit(False))
    one = catalog.groupBy("id").agg(F.max(ok).alias("ok"), F.max(out).alias("out"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    return one.agg(F.count("*").alias("ids"), count(F.col("ok"))("eligible"), count(~F.col("ok") & F.col("out"))("excluded"), count(~F.col("ok") & ~F.col("out"))("other"))


def can_index(states: DataFrame) -> DataFrame:
    """states (state, chunk_ids and the booleans of CONTRACT) with can_index: whether all hold."""
    return states.withColumn("can_index", F.coalesce(reduce(lambda a, b: a & b, map(F.col, CONTRACT), (F.col("state") == "indexed") & (F.size("chunk_ids") > 0)), F.lit(False)))


def error_class(message: Column) -> Column:
    """permanent, transient or unknown, by the message of an error and of its causes; permanent signs go first."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(has(PERMANENT), "permanent").when(has(TRANSIENT), "transient").otherwise("unknown")


def is_transient(error: BaseException | None) -> bool:
    """The same rule on the driver, over an error and the chain of its causes."""
    messages = []
    while error is not None:
        messages.append(str(error).lower())
        error = error.__cause__
    return not any(p in m for m in messages for p in PERMANENT) and any(p in m for m in messages for p in TRANSIENT)


def retried(call, tries: int = 3, first: float = 0.5, most: float = 8.0, sleep=time.sleep):
    """call(), tried again on transient errors after waits that double up to `most` seconds, with some jitter."""
    for k in range(tries):
        try:
            return call()
        except Exception as error:
            if k == tries - 1 or not is_transient(error):
                raise
            sleep(min(most, first * 2**k) * (1 + random.random() / 4))


def top_warnings(results: DataFrame, most: int = 8) -> DataFrame:
    """warning, n: the most frequent ones of the column warnings (arrays)."""
    return results.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning").limit(most)


def size_by_tier(measured: DataFrame, size: str = "chars") -> DataFrame:
    """tier, n, least, middle, most of a size."""
    return measured.groupBy("tier").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.median(size).alias("middle"), F.max(size).alias("most"))


def record_counts(records: DataFrame) -> DataFrame:
    """doc_id, pages, blocks, headings, tables, table_rows, warnings of extracted records.

    records: doc_id, pages array<struct<blocks array<struct<kind, text>>, tables array<struct<rows array>>>>, warnings array.
    """
    blocks = F.flatten(F.transform("pages", lambda p: p["blocks"]))
    tables = F.flatten(F.transform("pages", lambda p: p["tables"]))
    size = lambda c: F.coalesce(F.when(F.size(c) >= 0, F.size(c)), F.lit(0))
    return records.select("doc_id", size(F.col("pages")).alias("pages"), size(blocks).alias("blocks"), size(F.filter(blocks, lambda b: b["kind"] == "heading")).alias("headings"), size(tables).alias("tables"), F.coalesce(F.aggregate(tables, F.lit(0), lambda s, t: s + size(t["rows"])), F.lit(0)).alias("table_rows"), size(F.col("warnings")).alias("warnings"))


def reextract(files: DataFrame, ids: DataFrame) -> DataFrame:
    """The fetched files (path, kind, ...) of some ids, whose names are <id>.<extension>, one file an id: the first path."""
    named = files.withColumn("id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    first = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    return named.join(ids.select("id"), "id", "left_semi").withColumn("r", first).filter("r = 1").drop("r")


def safe_name(name: str) -> str:
    """A file name without folders; ValueError for one that leaves its folder or is none."""
    if not name or re.search(r"(^|[/\\])\.\.([/\\]|$)|^[/\\~]|\0", name):
        raise ValueError(f"name leaves its folder: {name!r}")
    return name
