"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of the greatest length, and pieces are dealt by a hash to shards of a bounded
expected number of documents, whatever their doc_ids and texts; within a shard, pieces go from long to short to the open bin with the least
room that still holds them. Where none does, the length that costs least for each token that it can
expect to hold is opened: a bin costs its length and OVERHEAD, and can expect its first piece and what is
left of pieces that fit beside it. In the end each bin is cut down to the least permitted length that
holds its contents.

Edge cases: a null or empty text has no tokens: it keeps one row with tokens 0 and no bin. Repeated
rows are packed each. Shards go by a row's place in the input too, so another partitioning of the same rows gives other bins.
A null doc_id is kept. A document longer than the greatest length spans several
bins. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import table
from docmill.llm.mixing import hash_of, words_in

LENGTHS, OVERHEAD, SHARD_ROWS = (512, 1024, 2048, 4096), 16, 20_000


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, and each bin's final length. sizes: descending, each from 1 to max(lengths)."""
    lengths = tuple(sorted(lengths))
    n = len(sizes)
    fitting = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])  # tokens in pieces from the k-th on
    ascending = -sizes
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, s in enumerate(sizes.tolist()):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            costs = []
            for c in lengths:
                if c >= s:
                    # pieces after this one that fit in what is left; all of them may come here
                    first = max(k + 1, int(np.searchsorted(ascending, -(c - s), "left")))
                    costs.append(((c + overhead) / (s + min(c - s, int(fitting[first]))), c))
            left, b = min(costs)[1], len(used)
            used.append(0)
        bins[k], offsets[k] = b, used[b]
        used[b] += s
        if left > s:
            insort(room, (left - s, b))
    held = np.array(used, np.int64)
    return bins, offsets, np.array(lengths, np.int64)[np.searchsorted(lengths, held)] if n else held


SCHEMA = "doc_id long, piece int, start long, tokens long, bin_id long, bin_length long, bin_offset long"


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each piece of each document of docs (doc_id, text): its place in the text, its bin and its place there."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_in(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    shards = -(-docs.count() // shard_rows) or 1
    longest = max(lengths)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-size // longest))
        row = np.repeat(np.arange(len(pdf)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * longest
        tokens = np.minimum(size[row] - start, longest)
        order = np.argsort(-tokens, kind="stable")
        order = order[tokens[order] > 0]
        bins, offsets, held = best_fit(tokens[order], lengths, overhead)
        out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").iloc[row].array, "piece": piece.astype(np.int32), "start": start, "tokens": tokens})
        for name, values in (("bin_id", (int(pdf["shard"].iloc[0]) << 32) + bins), ("bin_length", held[bins] if len(order) else bins), ("bin_offset", offsets)):
            column = pd.array([pd.NA] * len(row), "Int64")
            column[order] = values
            out[name] = column
        return out

    # repeated rows hash alike; salted by blocks of the input, none of their groups outgrows a shard and a block
    block = F.floor(F.monotonically_increasing_id() / shard_rows)
    return sized.withColumn("shard", F.pmod(F.xxhash64("h", block), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, SCHEMA)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
