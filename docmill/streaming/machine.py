"""The state machine of documents: transitions checked one by one, as a batch or as a stream with state.

A log row asks to move a document to a state: key, at, seq, state, force (optional), error (optional). The first
row of a key is taken as it is; a later one only if its state may follow the current one, or if it is forced.
Taking `failed` counts an attempt, and the last error given stays. Rows of a key apply in the order of (at, seq);
on a stream within each batch, and batch after batch.

Both forms share step(). The batch form sorts the log and streams it through mapInPandas with one state in hand, so
a key of any length is no obstacle. The stream keeps the state in Spark's state store and sets an event-time timer
for each document that is not at an end: when no step follows its last one for `patience`, it is reported as stalled,
once for each time that it stops: as the watermark passes that time, or with the step that comes later.

Edge cases: a null key is a key of its own; a null or unknown state is refused, unless it is forced or the first; a
null force is false. An empty log gives no rows. Columns beyond the log's are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docmill.streaming.events import TRANSITIONS

STEPS = "key string, seq long, before string, state string, kind string, attempts long, error string"
STATE = "state string, attempts long, error string, timer long"
TAKEN, REFUSED, STALLED = "taken", "refused", "stalled"
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def step(now: tuple | None, state: str | None, force: bool, error: str | None, allowed: dict[str, list[str]]) -> tuple[tuple, bool]:
    """(state, attempts, last error) after one row, and whether it was taken; now: None before the first row."""
    if now is None:
        return (state, int(state == "failed"), error), True
    if not force and state not in allowed.get(now[0], ()):
        return now, False
    return (state, now[1] + (state == "failed"), now[2] if error is None else error), True


def prepared(log: DataFrame) -> DataFrame:
    """The log's columns as this module takes them."""
    given = lambda c, kind: (F.col(c) if c in log.columns else F.lit(None)).cast(kind)
    return log.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("state").cast("string").alias("state"), F.coalesce(given("force", "boolean"), F.lit(False)).alias("force"), given("error", "string").alias("error"))


def plain(value):
    return None if value is None or value != value else value


def rows_of(steps: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(steps, columns=["key", "seq", "before", "state", "kind", "attempts", "error"])
    return out.astype({"seq": "Int64", "attempts": "Int64"})


def transitions(log: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """A row for each row of a finished log: key, seq, before, state (asked for), kind, attempts and error afterwards."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = object(), None
        for f in frames:
            out = []
            for k, seq, state, force, error in zip(f["key"], f["seq"], f["state"], f["force"], f["error"], strict=True):
                k, state, error = plain(k), plain(state), plain(error)
                if k != key:
                    key, now = k, None
                before = now[0] if now else None
                now, taken = step(now, state, bool(force), error, allowed)
                out.append((k, seq, before, state, TAKEN if taken else REFUSED, now[1], now[2]))
            yield rows_of(out)

    return prepared(log).repartition("key").sortWithinPartitions("key", "at", "seq").select("key", "seq", "state", "force", "error").mapInPandas(run, STEPS)


class Machine(StatefulProcessor):
    """State of one document: a value (state, attempts, last error, its timer)."""

    def __init__(self, allowed: dict[str, list[str]], patience_ms: int):
        self.allowed, self.patience = allowed, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")  # a key's rows of one batch
        held = self.value.get() if self.value.exists() else None
        now, timer = (tuple(held[:3]), held[3]) if held else (None, None)
        out, deadline = [], timer
        held_attempts, held_error = (now[1], now[2]) if now else (0, None)
        for at, seq, state, force, error in zip(batch["at"], batch["seq"], batch["state"], batch["force"], batch["error"], strict=True):
            state, error = plain(state), plain(error)
            before = now[0] if now else None
            now, taken = step(now, state, bool(force), error, self.allowed)
            if taken and not pd.isna(at):
                moved = int(pd.Timestamp(at).value // 1_000_000)
                if deadline is not None and moved > deadline:  # it stopped, and goes on before its timer was due
                    out.append((plain(key[0]), None, before, before, STALLED, held_attempts, held_error))
                deadline = moved + self.patience if self.allowed.get(now[0]) else None
            held_attempts, held_error = now[1], now[2]
            out.append((plain(key[0]), seq, before, state, TAKEN if taken else REFUSED, now[1], now[2]))
        if deadline != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = deadline
            if timer is not None:
                timer = max(timer, timerValues.getCurrentWatermarkInMs() + 1)  # one that is due already comes with the next batch
                self.handle.registerTimer(timer)
        self.value.update((*now, timer))
        yield rows_of(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, attempts, error, _ = self.value.get()
        self.value.update((state, attempts, error, None))
        yield rows_of([(plain(key[0]), None, state, state, STALLED, attempts, error)])

    def close(self) -> None:
        pass


def transition_stream(log: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS, patience: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """transitions() of a stream, and a row of kind `stalled` for each document that makes no step for `patience`. Needs RocksDB as state store (ROCKS)."""
    rows = prepared(log).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Machine(allowed, int(pd.Timedelta(patience).total_seconds() * 1000)), STEPS, "append", "eventTime")


def current(steps: DataFrame, order: str = "seq") -> DataFrame:
    """key, state, attempts, error: where each document of the steps stands, by its last step taken."""
    return steps.filter(F.col("kind") == TAKEN).groupBy("key").agg(*[F.max_by(c, order).alias(c) for c in ("state", "attempts", "error")])


def review_queue(steps: DataFrame, most: int = 5, order: str = "seq") -> DataFrame:
    """key, state, attempts, reason: documents that a person has to see, since they ask for it, stall or fail `most` times or more."""
    stalled = steps.filter(F.col("kind") == STALLED).select(F.col("key").alias("stopped"), F.col("before").alias("there")).distinct()
    at = current(steps, order).join(stalled, F.col("key").eqNullSafe(F.col("stopped")) & (F.col("state") == F.col("there")), "left")
    reason = F.when(F.col("state") == "requires_review", "requires_review").when((F.col("state") == "failed") & (F.col("attempts") >= most), "dead_letter").when(F.col("there").isNotNull(), "stalled")
    return at.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("key", "state", "attempts", "reason")
