"""Readers and writers of files, and the catalog of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.sources import extractors
from docmill.sources.extractors import KINDS


def catalog_scan(files: DataFrame, kinds: list[str] | None = None, without: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Rows that are not trashed, of given kinds, without some prefixes, latest first."""
    out = files.filter(F.col("trashed") == 0)
    if kinds:
        out = out.filter(F.col("mime_type").isin(kinds))
    for prefix in without:
        out = out.filter(~F.startswith("mime_type", F.lit(prefix)))
    out = out.orderBy(F.desc_nulls_last("modified"), "id")
    return out.limit(limit) if limit else out


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, size, sha256, content of all files below a folder that hold a byte at least (Spark lists no others)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(extension == e, F.lit(k)) for e, k in KINDS.items()], F.lit("unknown"))
    return files.select("path", kind.alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def extract(files: DataFrame) -> DataFrame:
    """path, kind, sha256, text, error of raw files; a file that cannot be read has an error."""
    found = extractors.texts(extractors.blocks(files))
    return files.select("path", "kind", "sha256").join(found, "path").select("path", "kind", "sha256", "text", "error")


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, title, text without scripts, styles, comments and tags."""
    bare = F.regexp_replace("html", r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"[ \t\r\n]+", " "))
    return pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), text.alias("text"))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, inferSchema=True)


def import_table(spark: SparkSession, path: str, table_path: str) -> DataFrame:
    """A CSV file as a typed Parquet table; blank and repeated headers get names of their own."""
    df = read_csv(spark, path)
    seen: dict[str, int] = {}
    names = []
    for name in (c.strip() or "col" for c in df.columns):
        seen[name] = seen.get(name, -1) + 1
        names.append(name if not seen[name] else f"{name}_{seen[name]}")
    df.toDF(*names).write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """Writes json, csv, tsv, parquet or markdown; ValueError for another kind or a path that leaves its folder."""
    if ".." in path.split("/"):
        raise ValueError(f"path leaves its folder: {path}")
    if kind == "markdown":
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
        df.select(cells.alias("value")).write.mode("overwrite").text(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    elif kind in ("csv", "tsv"):
        df.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        raise ValueError(f"unknown kind: {kind}")
