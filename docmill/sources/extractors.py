"""Extractors by kind, by registration, over files read by Spark or by a data source of their own.

An extractor maps the bytes of one file to blocks: (page, block, size, text, image). A kind without an extractor, or
one that raises, gives one row with an error and no text; the other files are not touched. Registered extractors are
sent to the workers by value.

Two ways to read: blocks() over raw_files(), which reads through Spark's own file systems; and the data source
`docmill_files`, which lists a folder that Python can read on driver and workers alike (a mounted share, or a file
system that pyarrow knows) and reads its files in parts of about PART_BYTES. Its options `kinds` and `least_bytes` are
answered from the listing, before any file is opened. It writes, too: rows (path, content) become one file each, by the
tasks themselves, so nothing is moved file by file on the driver. Filters are not pushed into it: in Spark 4.1 what one query
pushes into a Python source stays for the next query over the same DataFrame, which would then lack rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import sys
import uuid
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docmill.operators.extraction import heading_level
from docmill.sources import pdf

# by value, so that workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(pdf)

Block = tuple[int, int, float, str, bool]
Extractor = Callable[[bytes], list[Block]]

#: File kinds by extension: fixed values.
KINDS = {
    "txt": "text/plain",
    "md": "text/markdown",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "json": "application/json",
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "html": "text/html",
}
PART_BYTES = 32 << 20
SCHEMA = "path string, kind string, bytes long, sha256 string, page int, block int, size double, text string, image boolean, error string"


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def one_block(text: str) -> list[Block]:
    return [(1, 0, 0.0, text, False)]


def text_blocks(content: bytes) -> list[Block]:
    return one_block(decoded(content))


def docx_blocks(content: bytes) -> list[Block]:
    """Paragraphs of a document; breaks and tabs count, and entities are written out."""
    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8")
    found = []
    for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        marked = re.sub(r"<w:(?:br|cr)\b[^>]*>", "\n", re.sub(r"<w:tab\b[^>]*/>", "\t", p))
        found.append(unescape("".join(a or b for a, b in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>|([\n\t])", marked))))
    return [(1, k, 0.0, t, False) for k, t in enumerate(t for t in found if t.strip())]


def doc_blocks(content: bytes) -> list[Block]:
    """All runs of printable characters, one a line."""
    return one_block("\n".join(x.decode("latin-1") for x in re.findall(rb"[\x20-\x7e]{3,}", content)))


def pdf_blocks(content: bytes) -> list[Block]:
    return [(page, k, size, text, image) for page, k, _, size, text, image in pdf.read_pdf(content)]


_EXTRACTORS: dict[str, Extractor] = {}


def register(*kinds: str) -> Callable[[Extractor], Extractor]:
    """Makes a function the extractor of some kinds; of several the last counts."""

    def decorate(f: Extractor) -> Extractor:
        _EXTRACTORS.update(dict.fromkeys(kinds, f))
        return f

    return decorate


for _kind in ("txt", "md", "csv", "tsv", "json", "html"):
    register(KINDS[_kind])(text_blocks)
register(KINDS["docx"])(docx_blocks)
register(KINDS["doc"])(doc_blocks)
register(KINDS["pdf"])(pdf_blocks)


def registered() -> dict[str, Extractor]:
    return dict(_EXTRACTORS)


def kind_of(path: str) -> str:
    return KINDS.get(path.rsplit("/", 1)[-1].rpartition(".")[2].lower(), "unknown")


def extracted(kind: str, content: bytes, extractors: dict[str, Extractor]) -> tuple[list[Block], str | None]:
    """Blocks of one file, or one empty block and what went wrong."""
    run = extractors.get(kind)
    if run is None:
        return [(0, 0, 0.0, None, False)], f"no extractor for {kind}"
    try:
        return run(content) or [(1, 0, 0.0, "", False)], None
    except Exception as e:  # one bad file is a row with an error, not a failed job
        return [(0, 0, 0.0, None, False)], f"{type(e).__name__}: {e}"


def rows_of(path: str, kind: str, content: bytes, extractors: dict[str, Extractor]) -> list[tuple]:
    found, error = extracted(kind, content, extractors)
    digest = hashlib.sha256(content).hexdigest()
    return [(path, kind, len(content), digest, page, block, float(size), text, image, error) for page, block, size, text, image in found]


def blocks(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Blocks of raw files (path, kind, content)."""
    known = extractors or registered()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            for path, kind, content in zip(f["path"], f["kind"], f["content"], strict=True):
                yield pd.DataFrame(rows_of(path, kind, content, known), columns=names)

    return files.select("path", "kind", "content").mapInPandas(run, SCHEMA)


def marked(found: DataFrame) -> DataFrame:
    """Blocks with heading (level by font size, 0 for a paragraph)."""
    return found.withColumn("heading", heading_level(F.col("size")))


def pages(found: DataFrame, least: int = 20) -> DataFrame:
    """path, page, chars, scanned: pages that show an image and fewer than `least` characters of text are scans."""
    each = found.filter("error is null").groupBy("path", "page").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"), F.max("image").alias("image"))
    return each.select("path", "page", "chars", (F.col("image") & (F.col("chars") < least)).alias("scanned"))


def texts(found: DataFrame) -> DataFrame:
    """path, text, error of each file: its blocks, with blank lines between."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block", "text"))), lambda b: b["text"]), "\n\n")
    return found.groupBy("path").agg(F.first("error", ignorenulls=True).alias("error"), body.alias("body")).select("path", F.when(F.col("error").isNull(), F.col("body")).alias("text"), "error")


# ---------------------------------------------------------------- the data source


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class Part(InputPartition):
    """Files that one task reads: (path, kind, size)."""

    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class FilesReader(DataSourceReader):
    def __init__(self, path: str, extractors: dict[str, Extractor], part_bytes: int, kinds: set[str], least: int):
        self.path, self.extractors, self.part_bytes, self.kinds, self.least = path, extractors, part_bytes, kinds, least

    def partitions(self) -> list[InputPartition]:
        system, root = opened(self.path)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, kind_of(x.path), x.size) for x in listed if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        parts, held = [], 0
        for file in files:
            if (not self.kinds or file[1] in self.kinds) and file[2] >= self.least:
                if not parts or held + file[2] > self.part_bytes:
                    parts.append([])
                    held = 0
                parts[-1].append(file)
                held += file[2]
        return [Part(p) for p in parts] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path, kind, size in partition.files:
            if kind not in self.extractors:  # not opened: there is nothing to read it with
                yield path, kind, size, None, 0, 0, 0.0, None, False, f"no extractor for {kind}"
                continue
            with system.open_input_stream(path) as stream:
                yield from rows_of(path, kind, stream.read(), self.extractors)


class FilesWriter(DataSourceArrowWriter):
    """Writes rows (path within the folder, content) as one file each; a file that is there is replaced, whole or not at all."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        made = set()
        for batch in iterator:
            contents = batch.column("content")
            if pa.types.is_string(contents.type) or pa.types.is_large_string(contents.type):
                contents = contents.cast(pa.large_binary())
            for name, content in zip(batch.column("path").to_pylist(), contents, strict=True):
                if ".." in name.split("/"):
                    raise ValueError(f"path leaves its folder: {name}")
                folder, _, last = f"{root.rstrip('/')}/{name}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                early = f"{folder}/.{uuid.uuid4().hex}"  # the reader lists no such names
                with system.open_output_stream(early) as stream:
                    stream.write(content.as_buffer() or b"")
                system.move(early, f"{folder}/{last}")
        return WriterCommitMessage()


class FilesSource(DataSource):
    """spark.read.format("docmill_files").load(folder); options kinds (parted by commas), least_bytes, part_bytes.

    rows.write.format("docmill_files").mode("append").save(folder) writes rows (path, content) as files.
    """

    extractors: dict[str, Extractor] = {}

    @classmethod
    def name(cls) -> str:
        return "docmill_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> FilesReader:
        kinds = {k.strip() for k in self.options.get("kinds", "").split(",")} - {""}
        return FilesReader(self.options["path"], dict(self.extractors), int(self.options.get("part_bytes", PART_BYTES)), kinds, int(self.options.get("least_bytes", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FilesWriter:
        if overwrite or set(schema.names) != {"path", "content"}:
            raise ValueError("rows (path, content) are added by mode append")
        return FilesWriter(self.options["path"])


def register_source(spark: SparkSession, extractors: dict[str, Extractor] | None = None) -> None:
    """Makes the source known to a session, with the extractors registered so far or those given."""
    spark.dataSource.register(type("FilesSource", (FilesSource,), {"extractors": extractors or registered()}))
