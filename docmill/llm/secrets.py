"""Secret scan: three patterns, and windows of high Shannon entropy in candidate strings.

Candidates are maximal runs of base64-like characters. Within one, a window of WINDOW characters slides
over each character class (hex digits, base64 characters, capitals with digits, small letters with digits);
its entropy is kept up by adding the entering and removing the leaving character's count. Windows over the
class's limit merge into a span, but for those that lie within a pattern's span; so a candidate that only
touches one is scanned too. Runs that an allow-list entry matches add nothing. Spans of one case count if
they hold a letter and a digit.

Edge cases: a null or empty text has no spans, and its digest is that of the empty string. Offsets are
code points, ends exclusive. Repeated rows are each scanned; a null doc_id is kept; an empty table
gives no rows; extra columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from math import log2

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import blocks, table

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character that a window must exceed: hex digits, base64 characters, letters of one case and digits.
LIMITS = {"hex": 3.1, "base64": 3.9, "upper": 3.6, "lower": 3.6}
#: Candidates that are no secrets: UUIDs, runs of one case without digits, dates and numbers, paths of words, checksums named by an algorithm.
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z+/_=-]+",
    r"[0-9+/_=-]+",
    r"(?:[A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}",
    r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",
)


def window_spans(run: str, chars: frozenset, limit: float, width: int = WINDOW, known: tuple = ()) -> list[tuple[int, int]]:
    """Spans of `run` where windows of `width` characters, all of the class, have more than `limit` bits a character.

    Windows within one of the spans `known` (start, end; by start) are left out.
    """
    spans: list[list[int]] = []
    counts: dict[str, int] = {}
    at, reach = 0, 0  # spans known that begin by the window's start, and their furthest end
    start, load = 0, 0.0  # load: sum of count * log2(count) over the window
    term = [0.0, *(k * log2(k) for k in range(1, width + 2))]
    for end, c in enumerate(run):
        if c not in chars:
            counts, start, load = {}, end + 1, 0.0
            continue
        k = counts.get(c, 0)
        counts[c] = k + 1
        load += term[k + 1] - term[k]
        if end - start == width:
            old = run[start]
            k = counts[old]
            counts[old] = k - 1
            load += term[k - 1] - term[k]
            start += 1
        if end - start == width - 1 and log2(width) - load / width > limit:
            while at < len(known) and known[at][0] <= start:
                reach = max(reach, known[at][1])
                at += 1
            if end < reach:
                continue
            if spans and spans[-1][1] >= start:
                spans[-1][1] = end + 1
            else:
                spans.append([start, end + 1])
    return [(a, b) for a, b in spans]


def scanner(allowed: tuple[str, ...] = ALLOWED):
    """(text) -> spans (kind, start, end) by start, then kind."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    access, hexa = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
    run = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
    allow = re.compile("|".join(f"(?:{p})" for p in allowed))
    hex_chars = frozenset("0123456789abcdefABCDEF")
    digits = "0123456789"
    upper, lower = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + digits), frozenset("abcdefghijklmnopqrstuvwxyz" + digits)
    all_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")

    def scan(text: str) -> list[tuple[int, int, int]]:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in hexa.finditer(text)]
        base = sorted((a, b) for a, _, b in spans)
        after, touching = 0, []  # of each kind one base span at most covers a place, so few are carried from run to run
        for m in run.finditer(text):
            while after < len(base) and base[after][0] < m.end():
                touching.append(base[after])
                after += 1
            touching = [s for s in touching if s[1] > m.start()]
            if allow.fullmatch(m[0]):
                continue
            known = [(a - m.start(), b - m.start()) for a, b in touching]
            found = window_spans(m[0], hex_chars, LIMITS["hex"], known=known)
            if re.search("[0-9]", m[0]):
                up, low = re.search("[A-Z]", m[0]), re.search("[a-z]", m[0])
                if up and low:
                    found += window_spans(m[0], all_chars, LIMITS["base64"], known=known)
                for some, chars, kind in ((up, upper, "upper"), (low, lower, "lower")):
                    if some:
                        found += [(a, b) for a, b in window_spans(m[0], chars, LIMITS[kind], known=known) if re.search("[0-9]", m[0][a:b]) and re.search("[A-Za-z]", m[0][a:b])]
            end = -1
            for a, b in sorted(found):  # one span where those of two classes overlap
                if a <= end:
                    end = max(end, b)
                    spans[-1] = (spans[-1][0], 3, m.start() + end)
                else:
                    spans.append((m.start() + a, 3, m.start() + b))
                    end = b
        return sorted(spans)

    return scan


def scan_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, spans (array of kind, start, end) of each row of docs (doc_id, text)."""
    # a text that none of these touches has no span; the linear-time matcher of Arrow skips it
    hints = (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "AKIA", "[0-9a-f]{24}", "[A-Za-z0-9+/_=-]{%d}" % WINDOW)

    def run(batches):
        scan = scanner(allowed)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            ids, column = batch.column(0), pc.fill_null(batch.column(1), "")
            for lo, hi in blocks(column):
                part = column.slice(lo, hi - lo)
                hit = pa.array([False] * (hi - lo))
                for hint in hints:
                    hit = pc.or_(hit, pc.match_substring_regex(part, hint))
                out = [[] if not h else [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(s.as_py())] for h, s in zip(hit.to_pylist(), part, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("entropy"))
