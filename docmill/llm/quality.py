"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training runs on the driver, on at most SAMPLE_ROWS labelled rows (those of the smallest hashes of
doc_id, so reruns agree). The trees are flattened into arrays; scoring walks all rows of a block
through them together with numpy. Statistics are taken of whole texts.

Edge cases: a null or empty text has all statistics 0 and still gets a score. A label other than 0 or
1, or null, is not learned from; a doc_id is learned from once, with its least label if it has several. Without labels of both
kinds the score is the share of label 1 (0.5 without any), a constant. A null doc_id is kept, is not held out, and
is never learned from. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.common import blocks, mixed, table, word_hashes

SAMPLE_ROWS = 20_000
REJECT_BELOW = 0.3
FEATURES = (
    "log_bytes log_words log_lines word_length letters upper digits space marks stars dollars amps percents hashes bangs bars stops commas wide "
    "distinct_words repeats distinct_pairs top_word short_words repeated_lines line_words worst_line_marks worst_line_upper worst_line_bars worst_line_repeats"
).split()


# ---------------------------------------------------------------- statistics


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"*", b"$", b"&", b"%", b"#", b"!", b"|", b".?", b",;:"), 1):
        c[list(chars)] = k
    c[128:] = 15
    return c


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string()), pa.array([], pa.large_string())])
    rows = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[: rows + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: at[-1]] if texts.buffers()[2] is not None and at[-1] else np.zeros(0, np.uint8)
    size = np.diff(at).astype(float)
    row_of_byte = np.repeat(np.arange(rows), np.diff(at))
    classes = _byte_classes()[data]
    counts = np.bincount(row_of_byte * 16 + classes, minlength=rows * 16).reshape(rows, 16).astype(float)
    low, up, digit, space, line, star, dollar, amp, percent, hash_, bang, bar, stop, comma, wide = (counts[:, k] for k in range(1, 16))
    letters, marks = low + up + wide, star + dollar + amp + percent + hash_ + bang + bar

    words, starts = word_hashes(texts, lower=False)
    n = np.diff(starts)
    row = np.repeat(np.arange(rows), n)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])

    def distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each row, and the most frequent one's count."""
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, int)
        runs = np.diff(np.append(head, len(h)))
        top = np.zeros(rows)
        np.maximum.at(top, r[head], runs)
        return np.bincount(r[head], minlength=rows).astype(float), top

    with np.errstate(over="ignore"):
        kinds, top = distinct(words, row)
        pair = np.flatnonzero(row[1:] == row[:-1]) if len(words) else np.zeros(0, int)
        pairs, _ = distinct(mixed(words[pair] * np.uint64(3) + words[pair + 1]), row[pair])

    # lines, as runs between line ends; those of under 5 words tell little and count for no extreme
    is_end = np.zeros(len(data) + 1, bool)
    is_end[:-1] = data == 10
    begins = np.zeros(len(data), bool)
    begins[at[:-1][size > 0]] = True
    begins[1:] |= is_end[:-2]
    line_at = np.flatnonzero(begins)
    line_row = row_of_byte[line_at] if len(line_at) else np.zeros(0, int)
    line_of_byte = np.cumsum(begins) - 1
    per_line = np.bincount(line_of_byte * 16 + classes, minlength=len(line_at) * 16).reshape(-1, 16).astype(float) if len(line_at) else np.zeros((0, 16))
    white = (classes == 4) | (classes == 5)
    word_begin = np.flatnonzero(~white & np.concatenate([[True], white[:-1] | begins[1:]])) if len(data) else np.zeros(0, int)
    if len(word_begin) != len(words):  # cannot differ: both split at the same bytes
        raise AssertionError("word counts differ")
    line_of_word = line_of_byte[word_begin] if len(words) else np.zeros(0, int)
    line_words = np.bincount(line_of_word, minlength=len(line_at)).astype(float)
    line_again = np.bincount(line_of_word, weights=again, minlength=len(line_at))
    line_hash = np.zeros(len(line_at), np.uint64)
    place = np.arange(len(words)) - (np.concatenate([[0], np.cumsum(line_words)]).astype(int)[line_of_word] if len(words) else 0)
    with np.errstate(over="ignore"):
        np.add.at(line_hash, line_of_word, mixed(words + place.astype(np.uint64)))
    filled = line_words > 0
    line_kinds, _ = distinct(line_hash[filled], line_row[filled])
    lines = np.bincount(line_row[filled], minlength=rows).astype(float)

    def worst(values: np.ndarray) -> np.ndarray:
        out, long = np.zeros(rows), line_words >= 5
        np.maximum.at(out, line_row[long], values[long])
        return out

    line_letters = np.maximum(1, per_line[:, 1] + per_line[:, 2])
    one, some = np.maximum(size, 1), np.maximum(n, 1)
    length = np.diff(np.append(word_begin, len(data))) if len(words) else np.zeros(0)
    return np.column_stack([
        np.log1p(size), np.log1p(n), np.log1p(lines), (size - space - line) / some, letters / one, up / np.maximum(1, low + up), digit / one, (space + line) / one, marks / some,
        star / some, dollar / some, amp / some, percent / some, hash_ / some, bang / some, bar / some, stop / some, comma / some, wide / one,
        kinds / some, np.bincount(row, weights=again, minlength=rows) / some, pairs / np.maximum(1, n - 1), top / some, np.bincount(row, weights=length <= 4, minlength=rows) / some,
        1 - line_kinds / np.maximum(1, lines), n / np.maximum(1, lines),
        worst((per_line[:, 6:13].sum(axis=1)) / np.maximum(1, line_words)), worst(per_line[:, 2] / line_letters), worst(per_line[:, 12] / np.maximum(1, line_words)), worst(line_again / np.maximum(1, line_words)),
    ])


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """All trees in flat arrays: an inner node's children are left and left + 1; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 12, ridge: float = 2.0) -> Trees:
    """Boosted trees on logistic loss, split on histograms of binned statistics."""
    share = float(y.mean()) if len(y) else 0.5
    grown = {k: [] for k in ("feature", "cut", "left", "value")}
    if not len(y) or not 0 < share < 1:
        return Trees(float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)), *(np.zeros(0, int) for _ in range(2)), np.zeros(0), np.zeros(0, int), np.zeros(0), 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    base = float(np.log(share / (1 - share)))
    margin, roots, features = np.full(len(y), base), [], x.shape[1]
    offsets = np.arange(features) * bins

    def add() -> int:
        for k, v in (("feature", 0), ("cut", np.inf), ("left", len(grown["left"])), ("value", 0.0)):
            grown[k].append(v)
        return len(grown["left"]) - 1

    def grow(node: int, rows: np.ndarray, level: int) -> None:
        g, h = grad[rows], hess[rows]
        grown["value"][node] = -rate * g.sum() / (h.sum() + ridge)
        if level == depth or len(rows) < 2 * least:
            margin[rows] += grown["value"][node]
            return
        flat = (binned[rows] + offsets).ravel()
        sums = [np.bincount(flat, weights=np.repeat(w, features), minlength=features * bins).reshape(features, bins).cumsum(axis=1) for w in (g, h, np.ones(len(rows)))]
        gl, hl, cl = sums
        gt, ht = g.sum(), h.sum()
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        gain[(cl < least) | (len(rows) - cl < least)] = -np.inf
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if not gain[f, b] > 1e-6 or b >= len(edges[f]):
            margin[rows] += grown["value"][node]
            return
        one, other = add(), add()
        grown["feature"][node], grown["cut"][node], grown["left"][node] = int(f), float(edges[f][b]), one
        goes = binned[rows, f] > b
        grow(one, rows[~goes], level + 1)
        grow(other, rows[goes], level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(add())
        grow(roots[-1], np.arange(len(y)), 0)
    return Trees(base, np.array(roots), np.array(grown["feature"]), np.array(grown["cut"]), np.array(grown["left"]), np.array(grown["value"]), depth)


# ---------------------------------------------------------------- operator


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learns labels.quality from rows whose fold is not 0."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("text").cast("string")).alias("h")).join(F.broadcast(sample), "doc_id")  # sample_rows at most

    def run(batches):
        least: dict[int, int] = {}  # the least hash of a text that this task has sent of each doc_id of the sample
        for batch in batches:
            some = []
            for k, (doc_id, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if least.get(doc_id, 1 << 63) > h:
                    least[doc_id] = h
                    some.append(k)
            batch = batch.take(pa.array(some, pa.int64()))
            for lo, hi in blocks(batch.column(0)):
                x = statistics(batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (1, 2, 3)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "h", "x"])

    found = chosen.select("text", "doc_id", "quality", "h").mapInArrow(run, "doc_id long, quality int, h long, x array<double>")
    # of a repeated doc_id the text of the least hash, so there are sample_rows rows at most, and reruns agree
    rows = found.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return train(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with a column score; all columns of docs stay (a former score is replaced)."""
    kept = [c for c in docs.columns if c.lower() != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = next(i for i, c in enumerate(kept) if c.lower() == "text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            parts = [trees.score(statistics(text.slice(lo, hi - lo))) for lo, hi in blocks(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))
