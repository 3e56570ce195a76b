"""Shared pieces: scratch tables, word splitting and hashing of whole Arrow columns."""

from __future__ import annotations

import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a worker holds at once; longer single texts form a step alone.
BLOCK_BYTES = 1 << 20

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir; where that is unset, a local one if all run on this machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docmill-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/docmill-{sc.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    for s in scopes()[-1:]:
        s.made.append(path)  # no DataFrame: workers' functions can carry this module along
    return out


#: Most bytes of an Arrow batch within a scope; by default Spark sends up to 64 MB at once, which both sides hold twice.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


class scope:
    """Drops the tables staged within it on its end, but for those that are kept. What is staged within goes to workers in small batches."""

    def __enter__(self):
        self.made, self.kept = [], set()
        scopes().append(self)
        conf = SparkSession.active().conf
        self.former = conf.get(BATCH[0], None)
        conf.set(*BATCH)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df.scratch_path)
        return df

    def __exit__(self, *error):
        scopes().remove(self)
        conf = SparkSession.active().conf
        conf.set(BATCH[0], self.former) if self.former else conf.unset(BATCH[0])
        for path in self.made:
            if path not in self.kept:
                drop_path(SparkSession.active(), path)


def scopes() -> list[scope]:
    """The open scopes of this thread, kept on the session's Python side so that no worker carries them along."""
    held = SparkSession.active().__dict__.setdefault("docmill_scopes", {})
    return held.setdefault(threading.get_ident(), [])


def drop_stage(df: DataFrame) -> None:
    """Deletes a table that stage() wrote and that no later plan reads."""
    drop_path(df.sparkSession, df.scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(start, stop) ranges of rows that hold about `most` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from zip(cuts, cuts[1:], strict=False)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * M2
        h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def _table(lower: bool) -> bytes:
    """A byte table that maps white space to 0 (and 0, which is none, to a byte that UTF-8 never holds)."""
    out = bytearray(range(256))
    out[0] = 0xFF
    for c in (0x20, *range(0x09, 0x0E)):
        out[c] = 0
    if lower:
        for c in range(ord("A"), ord("Z") + 1):
            out[c] = c + 32
    return bytes(out)


_TABLES = {lower: _table(lower) for lower in (True, False)}
#: Bytes that are hashed at once, so that the arrays on the way stay in the cache; a longer word forms a piece alone.
PIECE_BYTES = 256 << 10


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd number, and of its inverse modulo 2**64."""
    made = []
    for base in (int(M1), pow(int(M1), -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        with np.errstate(over="ignore"):
            made.append(np.multiply.accumulate(x))
    return made


def pieces(b: np.ndarray, rows: np.ndarray):
    """(start, stop) ranges of bytes that no word crosses: cut where a row starts or at white space (0)."""
    lo = 0
    while lo < len(b):
        hi = min(lo + PIECE_BYTES, len(b))
        if hi < len(b):
            row = int(rows[np.searchsorted(rows, hi, "right") - 1])
            blank = np.flatnonzero(b[lo:hi] == 0)
            cut = max(row, lo + int(blank[-1]) + 1 if len(blank) else lo)
            if cut <= lo:  # a word longer than a piece
                later = np.flatnonzero(b[hi:] == 0)
                k = int(np.searchsorted(rows, lo, "right"))
                cut = min(hi + int(later[0]) + 1 if len(later) else len(b), int(rows[k]) if k < len(rows) else len(b))
            hi = cut
        yield lo, hi
        lo = hi


def word_places(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows: a 64-bit hash and the first byte of each, each row's first byte (one more at the end), and all bytes.

    The hash is polynomial over the word's bytes, from differences of prefix sums. Only A-Z are lower-cased. Null counts as empty.
    """
    whole = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string()), pa.array([], pa.large_string())])
    rows = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = whole.buffers()[2].slice(rows[0], rows[-1] - rows[0]).to_pybytes() if rows[-1] > rows[0] else b""
    rows = rows - rows[0]
    b = np.frombuffer(raw.translate(_TABLES[lower]), np.uint8)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    cuts = list(pieces(b, rows))
    ups, downs = powers(max((hi - lo for lo, hi in cuts), default=0))
    for lo, hi in cuts:
        part = b[lo:hi]
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        full = part != 0
        edge = np.empty(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(full[1:], full[:-1], out=edge[1:-1])
        edge[rows[np.searchsorted(rows, lo) : np.searchsorted(rows, hi, "right")] - lo] = True
        turns = np.flatnonzero(edge)
        begin, end = turns[:-1], turns[1:]
        word = full[begin]
        begin, end = begin[word], end[word]
        with np.errstate(over="ignore"):
            np.cumsum(part * ups[: hi - lo], out=sums[1:])
            hashes.append(mixed((sums[end] - sums[begin]) * downs[begin] + (end - begin).astype(np.uint64) * M2))
        begins.append(begin + lo)
    return np.concatenate(hashes), np.concatenate(begins), rows, np.frombuffer(raw, np.uint8)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, and each row's start in them (one more at the end)."""
    hashes, begins, rows, _ = word_places(texts, lower)
    return hashes, np.searchsorted(begins, rows)


def shingle_hashes(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words within a row (with repeats), and each row's start in them.

    A row of fewer words has one: its whole sequence. A row without words has none.
    """
    n = np.diff(starts)
    total = len(words)
    with np.errstate(over="ignore"):
        acc = mixed(words + M1)
        out = acc
        short = {}
        for k in range(1, size):
            short[k] = out
            nxt = np.zeros(total, np.uint64)
            nxt[: total - k] = words[k:]
            out = mixed(out * M1 + nxt + np.uint64(k))
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    first = np.repeat(starts[:-1], counts)
    where = first + (np.arange(at[-1]) - np.repeat(at[:-1], counts))
    hashes = out[where]
    for k in range(1, size):
        rows = np.flatnonzero(n == k)
        if len(rows):
            hashes[at[rows]] = mixed(short[k][starts[rows]] + np.uint64(k * int(M2) & (1 << 64) - 1))
    return hashes, at
