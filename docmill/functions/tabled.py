"""Table functions in Python, and their registration with a session's SQL.

number_mentions(text) gives a row for each number that a text holds, for LATERAL joins; mentions() does the same for
whole batches of a table's rows at once, as a call for each row costs more than its text. event_sessions(TABLE(...)
PARTITION BY user ORDER BY time, gap) gives a row for each session of the rows of a partition, which it reads one by
one with a fixed-size state, so a partition of any length is no obstacle.
"""

from __future__ import annotations

import sys

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from docmill.functions import values as V
from docmill.functions.text import nfkc

# by value, so that workers need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Written:
    """Written numbers of a text: n, start, end, raw of each, as values.number_spans() has them; nothing of a null."""

    pattern = "(?p)" + "|".join(f"(?:{p})" for p in V.NUMBERS)

    def __init__(self):
        self.written, self.year = regex.compile(self.pattern), regex.compile(r"(?:19|20)\d{2}")

    def of(self, text: str | None) -> list[tuple[int, int, int, str]]:
        found = (m for m in self.written.finditer(text or "") if not self.year.fullmatch(m[0]))
        return [(n, m.start(), m.end(), m[0]) for n, m in enumerate(found)]


@udtf(returnType="n int, start int, end int, raw string")
class NumberMentions:
    """A row for each written number of a text."""

    def __init__(self):
        self.numbers = Written()

    def eval(self, text: str):
        yield from self.numbers.of(text)


def mention_rows(schema: StructType, text: str):
    """The table function of rows of a schema: each row's columns beside n, start, end, raw of each number of its text."""

    class MentionRows:
        def __init__(self):
            self.numbers = Written()

        def eval(self, batch: pa.RecordBatch):
            found = [(at, *m) for at, t in enumerate(batch.column(text).to_pylist()) for m in self.numbers.of(t)]
            at, n, start, end, raw = zip(*found, strict=True) if found else ((),) * 5
            mine = batch.take(pa.array(at, pa.int32()))
            told = [pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(raw, pa.string())]
            yield pa.RecordBatch.from_arrays([*mine.columns, *told], [*mine.schema.names, "n", "start", "end", "raw"])

    return arrow_udtf(MentionRows, returnType=StructType(list(schema)).add("n", IntegerType()).add("start", IntegerType()).add("end", IntegerType()).add("raw", StringType()))


@udtf(returnType="user_id long, start timestamp_ntz, end timestamp_ntz, n long")
class EventSessions:
    """Sessions of rows (user_id, ts) in the order of ts: a row `gap` seconds or more after the last one begins another. Rows without a time are left out."""

    def __init__(self):
        self.user = self.start = self.last = None
        self.n = 0

    def eval(self, row, gap: int):
        if row["ts"] is None:
            return
        if self.n and (row["ts"] - self.last).total_seconds() >= gap:
            yield self.user, self.start, self.last, self.n
            self.n = 0
        if not self.n:
            self.user, self.start = row["user_id"], row["ts"]
        self.last = row["ts"]
        self.n += 1

    def terminate(self):
        if self.n:
            yield self.user, self.start, self.last, self.n


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions known to spark.sql; their names."""
    spark.udtf.register("number_mentions", NumberMentions)
    spark.udtf.register("event_sessions", EventSessions)
    spark.udf.register("nfkc", nfkc)
    return ["event_sessions", "nfkc", "number_mentions"]


def mentions(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with n, start, end, raw, number of each number of their text; rows without one go."""
    found = mention_rows(rows.schema, text)(rows.asTable())
    return found.withColumn("number", V.number(F.col("raw")))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """user_id, start, end, n of the sessions of events (user_id, ts)."""
    register_functions(events.sparkSession)
    rows = events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return events.sparkSession.sql(f"SELECT * FROM event_sessions(TABLE(SELECT * FROM {{rows}}) PARTITION BY user_id ORDER BY (ts), {int(gap_seconds)})", rows=rows)
