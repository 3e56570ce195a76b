"""What extraction makes of pages and tables: blocks, tables found in lines, context, audits, OCR quality, dates, claims."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import values as V

# ---------------------------------------------------------------- tables


def csv_cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of a line; a quote mark opens and closes a part in which delimiters count for nothing, and is dropped."""
    # parts between quote marks are outside and inside by turns: delimiters outside become a mark of their own
    marked = F.transform(F.split(line, '"'), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(delimiter), F.lit("\x01"))).otherwise(part))
    return F.transform(F.split(F.array_join(marked, ""), "\x01"), lambda c: F.trim(c))


def csv_blocks(files: DataFrame, delimiter: str = ",", key: str = "doc_id") -> DataFrame:
    """key, n, kind, cells, block of the lines of a text column: the header, then rows of as many cells as it has.

    Short rows are filled up with empty cells, long ones cut off. An empty text has no rows.
    """
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    each = files.filter(F.col("text") != "").select(key, F.size(csv_cells(lines[0], delimiter)).alias("width"), F.posexplode(lines).alias("n", "line"))
    cells = csv_cells(F.col("line"), delimiter)
    fitted = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    return each.select(key, "n", F.when(F.col("n") == 0, "heading").otherwise("paragraph").alias("kind"), fitted.alias("cells")).withColumn("block", F.array_join("cells", " | "))


def table_lines(docs: DataFrame, least_rows: int = 3, least_columns: int = 3, key: str = "doc_id") -> DataFrame:
    """key, first (number of the first line), rows, columns, text of tables in texts: runs of lines that have several columns.

    Columns are parted by two or more spaces, a tab or a pipe.
    """
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    cells = F.filter(F.split(F.trim("line"), r"\s{2,}|\t|\|"), lambda c: F.trim(c) != "")
    rows = lines.withColumn("columns", F.size(cells)).filter(F.col("columns") >= least_columns)
    # in a run, the number of a line less its place among the lines with columns does not change
    run = F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n"))
    found = rows.withColumn("run", run).groupBy(key, "run").agg(F.min("n").alias("first"), F.count("*").alias("rows"), F.max("columns").alias("columns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return found.filter(F.col("rows") >= least_rows).drop("run")


def table_text(headers: Column, rows: Column) -> Column:
    """A table as text: headers, a rule, and rows (arrays of cells)."""
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    return F.array_join(F.concat(F.when(F.size(headers) > 0, F.array(F.array_join(headers, " | "), F.lit("-" * 40))).otherwise(F.array().cast("array<string>")), lines), "\n")


def context(path: Column, first: Column, last: Column, sheet: Column, name: Column) -> Column:
    """The lines that tell where a chunk stands: document, section, pages and sheet, as far as they are known."""
    pages = F.when(first == last, F.concat(F.lit("Page "), first.cast("string"))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), F.coalesce(last, first).cast("string")))
    section = F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > ")))
    return F.concat_ws("\n", F.concat(F.lit("Document: "), name), section, F.when(first.isNotNull(), pages), F.concat(F.lit("Sheet: "), sheet))


def heading_level(size: Column) -> Column:
    """1 to 3 by font size, 0 for a paragraph."""
    return F.when(size > 18, 1).when(size > 14, 2).when(size > 12, 3).otherwise(0)


# ---------------------------------------------------------------- audit


def audit(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, check, severity of the nine checks, in order, of extraction results.

    results: tier, text, pages and expected (numbers; expected may be null), blocks, headings, empty_pages, ocr, warnings (array).
    """
    length = F.char_length(F.coalesce("text", F.lit("")))
    far = F.col("expected").isNotNull() & (F.abs(F.col("pages") - F.col("expected")) > 0.1 * F.col("expected"))
    warn = lambda c: F.when(c, "warn").otherwise("pass")
    checks = {
        "extraction_success": F.when(F.col("tier") == "failed", "fail").otherwise(warn(F.col("tier") == "low")),
        "text_yield": F.when(length == 0, "fail").otherwise(warn(length < 100)),
        "page_count": F.when(F.col("pages") == 0, "fail").otherwise(warn(far)),
        "block_structure": warn(F.col("blocks") == 0),
        "heading_preservation": warn((length > 2000) & (F.col("headings") == 0)),
        "table_preservation": F.lit("pass"),
        "empty_pages": warn(F.col("empty_pages") > 0),
        "parser_warnings": warn(F.size("warnings") > 0),
        "ocr_used": F.when(F.col("ocr"), F.when(F.col("tier") == "high", "info").otherwise("warn")).otherwise("pass"),
    }
    every = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(name).alias("check"), c.alias("severity")) for k, (name, c) in enumerate(checks.items())])
    return results.select(key, F.explode(every).alias("x")).select(key, "x.n", "x.check", "x.severity")


def overall(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, status: the worst severity of its findings; info counts for nothing."""
    worst = F.max(F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    return findings.groupBy(key).agg(worst.alias("w")).select(key, F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warn").otherwise("pass").alias("status"))


# ---------------------------------------------------------------- OCR


def ocr_quality(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chars, words, cer, wer, numeric of texts and references: error rates are 1 less the matcher's ratio.

    Without a reference there are no rates. numeric: the share of numbers that parse. Matching has no SQL form, so
    rows go through pandas in batches.
    """

    def run(batches):
        for pdf in batches:
            rates = []
            for text, ref in zip(pdf["text"], pdf["reference"], strict=True):
                text = text or ""
                if not ref:
                    rates.append((None, None))
                    continue
                words = ref.split()
                wer = 1 - SequenceMatcher(None, words, text.split()).ratio() if words else float(bool(text.split()))
                rates.append((1 - SequenceMatcher(None, ref, text).ratio(), wer))
            yield pd.DataFrame({key: pdf[key], "text": pdf["text"], "cer": [c for c, _ in rates], "wer": [w for _, w in rates]})

    kind = dict(pairs.dtypes)[key]
    rated = pairs.select(key, "text", "reference").mapInPandas(run, f"{key} {kind}, text string, cer double, wer double")
    numbers = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b\d[\d,.]*\b"), F.lit(0))
    clean = F.filter(numbers, lambda x: F.regexp_replace(x, "[,.]", "").rlike("^[0-9]+$"))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return rated.select(key, F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), words.alias("words"), "cer", "wer", F.when(F.size(numbers) == 0, 1.0).otherwise(F.size(clean) / F.size(numbers)).alias("numeric"))


def clean_ocr(text: Column) -> Column:
    """Without byte order marks, with single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("﻿"), F.lit("")), r"\s+", " "))


# ---------------------------------------------------------------- dates

MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*"
#: Patterns of dates in texts: fixed values.
DATE_FORMS = (
    r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    rf"\b{MONTH}\s+\d{{1,2}}[a-z]*[,\s]+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+{MONTH}[,\s]+\d{{4}}\b",
)
SPAN = r"(\d{1,2}[/.]\d{1,2}[/.]\d{2,4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"
PERIOD = rf"(?is)(?:period|from|between)\s+{SPAN}.{{0,10}}(?:to|[-–]|until|and)\s+{SPAN}"


def dates(text: Column) -> Column:
    """The distinct dates of a text, in order of time."""
    raw = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in DATE_FORMS])
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, V.date), lambda d: d.isNotNull())))


def period(text: Column, keywords: list[str]) -> Column:
    """start and end of the first period that stands from 200 characters before to 500 after a keyword's first place; null without one."""
    text = F.coalesce(text, F.lit(""))

    def near(word: str) -> Column:
        at = F.instr(F.lower(text), word)
        region = F.substring(text, F.greatest(at - 200, F.lit(1)), F.least(at - 1, F.lit(200)) + 500)
        ends = [V.date(F.regexp_extract(region, PERIOD, k)) for k in (1, 2)]
        return F.when((at > 0) & ends[0].isNotNull() & ends[1].isNotNull(), F.struct(ends[0].alias("start"), ends[1].alias("end")))

    return F.coalesce(*map(near, keywords))


# ---------------------------------------------------------------- claims and synthesis

#: Words that make no claim by themselves: fixed values.
LINKS = ("and", "with", "which", "where", "of", "the", "a", "an", "to", "in", "for", "as", "on", "at", "from")


def claims(texts: DataFrame, key: list[str], facts: tuple[str, ...] = (), most_parts: int = 4, prefix: int | None = None) -> DataFrame:
    """key, n, claim of texts: sentences of 15 characters or more without bracketed marks, parted at semicolons.

    A sentence of more than `most_parts` parts stays whole. Labels, and parts of few words without a digit or one of
    the words `facts`, are no claims. Claims that are equal but for case count once; with a `prefix`, those that agree in so many characters.
    """
    marked = F.regexp_replace("text", r"([.!?])\s+", "$1\u0001")
    sentences = texts.select(*key, F.posexplode(F.split(marked, "\u0001")).alias("s", "raw")).withColumn("raw", F.trim("raw")).filter(F.char_length("raw") >= 15)
    clean = F.trim(F.regexp_replace("raw", r"\[[^\]]+\]", ""))
    parts = F.filter(F.transform(F.split(clean, ";"), lambda p: F.trim(p)), lambda p: p != "")
    each = sentences.select(*key, "s", F.posexplode(F.when(F.size(parts) > most_parts, F.array(clean)).otherwise(parts)).alias("p", "claim"))
    bare = each.withColumn("claim", F.regexp_replace(F.regexp_replace("claim", r"^•\s*", ""), r"^\s*[-–—]\s*", ""))
    words = F.filter(F.split("claim", r"\s+"), lambda w: w != "")
    told = reduce(lambda a, b: a | b, [F.contains(F.lower("claim"), F.lit(w)) for w in facts], F.col("claim").rlike(r"\d"))
    label = F.col("claim").rlike(r"^[A-Z][\w\s:]*$") & (F.char_length("claim") < 30)
    thin = (F.size(F.filter(words, lambda w: ~F.lower(w).isin(*LINKS))) < 3) & (F.size(words) < 6) & ~told
    kept = bare.filter(~label & ~thin)
    same = F.lower("claim") if prefix is None else F.substring(F.lower("claim"), 1, prefix)
    first = F.row_number().over(Window.partitionBy(*key, same).orderBy("s", "p"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("s", "p")) - 1
    return kept.withColumn("r", first).filter("r = 1").select(*key, number.alias("n"), "claim")


def synthesis(queries: DataFrame, evidence: DataFrame, entities: tuple[str, ...] = (), most: int = 4, snippet: int = 120, least: int = 30) -> DataFrame:
    """query_id, place, doc_id, relevance, snippet: the documents that an answer is made of, by relevance, then length.

    evidence: query_id, doc_id, text, known (whether its source is known), ranked (whether it is structured or of an
    institution). A document counts 3 for each of the query's words of over two characters in its longest text, 2
    for each entity in both, 1 if ranked, 0.5 if known.
    """
    longest = F.max_by(F.struct("text", "known", "ranked"), F.struct(F.char_length(F.coalesce("text", F.lit(""))), F.col("text")))
    docs = evidence.groupBy("query_id", "doc_id").agg(longest.alias("b")).select("query_id", "doc_id", "b.*")
    asked = queries.select("query_id", F.lower(F.coalesce("text", F.lit(""))).alias("q"))
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.size(F.filter(F.split("q", r"\s+"), lambda w: (F.char_length(w) > 2) & F.contains(low, w)))
    names = reduce(lambda a, b: a + b, [(F.contains("q", F.lit(e)) & F.contains(low, F.lit(e))).cast("int") for e in entities], F.lit(0))
    relevance = 3 * words + 2 * names + F.coalesce(F.col("ranked").cast("int"), F.lit(0)) + F.when(F.col("known"), 0.5).otherwise(0.0)
    scored = docs.join(asked, "query_id").withColumn("relevance", relevance)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), F.desc(F.char_length("text")), "doc_id"))
    best = scored.withColumn("place", place).filter((F.col("place") <= most) & (F.char_length(clean_ocr(F.col("text"))) > least))
    return best.select("query_id", "place", "doc_id", "relevance", F.trim(F.replace(F.substring("text", 1, snippet), F.lit("\n"), F.lit(" "))).alias("snippet"))
