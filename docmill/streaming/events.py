"""Streams: windows, sessions, dedup within a watermark, document states and incremental sync.

Each function takes a batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Permitted transitions of a document's state: fixed values.
TRANSITIONS = {
    "discovered": ["downloading", "failed"],
    "downloading": ["downloaded", "failed", "requires_review"],
    "downloaded": ["extracted", "failed", "requires_review"],
    "extracted": ["normalized", "failed", "requires_review"],
    "normalized": ["classified", "failed"],
    "classified": ["deduplicated", "failed"],
    "deduplicated": ["chunked", "failed"],
    "chunked": ["embedded", "failed"],
    "embedded": ["indexed", "failed"],
    "indexed": [],
    "failed": ["discovered", "dead_letter"],
    "requires_review": ["discovered", "dead_letter"],
    "dead_letter": [],
}


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a timestamp that a watermark can follow."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: list[str]) -> DataFrame:
    """First event of each key; on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def with_purchases(views: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """Stream-stream join of views with the purchases of the same user that follow within a time."""
    a = views.select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    b = purchases.select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
    return a.join(b, F.expr(f"user_id = buyer AND bought >= seen AND bought <= seen + INTERVAL {within}")).select("view_id", "purchase_id")


def with_purchases_or_none(views: DataFrame, purchases: DataFrame, within: str = "1 hour") -> DataFrame:
    """As with_purchases(), and views without a purchase, with null. On streams these come out once the watermark of both sides has passed them."""
    a = views.select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    b = purchases.select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
    return a.join(b, F.expr(f"user_id = buyer AND bought >= seen AND bought <= seen + INTERVAL {within}"), "left").select("view_id", "purchase_id")


def with_dimension(events: DataFrame, dimension: DataFrame, on: str, key: str, how: str = "left") -> DataFrame:
    """Events of a stream with the row of a table that their column `on` names by its `key`; the table is read again for each batch.

    A key that several rows of the table have counts once, with its least row, so events are never multiplied.
    """
    fields = [c for c in dimension.columns if c != key]
    one = dimension.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*fields)).alias("_row"))
    return events.join(one, F.col(on) == F.col("_key"), how).select(*[events[c] for c in events.columns], *[F.col(f"_row.{c}").alias(c) for c in fields])


def latest_state(log: DataFrame) -> DataFrame:
    """Current state of each key of a log (key, at, seq, state), and its number of failures."""
    return log.groupBy("key").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.sum(F.when(F.col("state") == "failed", 1).otherwise(0)).cast("long").alias("attempts"))


def bad_transitions(log: DataFrame, allowed: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """Steps of the log that are not permitted."""
    w = Window.partitionBy("key").orderBy("at", "seq")
    steps = log.withColumn("before", F.lag("state").over(w)).filter(F.col("before").isNotNull())
    legal = F.coalesce(*[F.when(F.col("before") == s, F.col("state").isin(to) if to else F.lit(False)) for s, to in allowed.items()], F.lit(False))
    return steps.filter(~legal).select("key", "seq", "before", "state")


def dead_letters(log: DataFrame, most: int = 5) -> DataFrame:
    return latest_state(log).filter(F.col("attempts") >= most)


def changed(catalog: DataFrame, since, known: DataFrame | None = None) -> DataFrame:
    """Rows (id, modified, size) modified after `since` that differ from their checkpoint."""
    rows = catalog.filter(F.col("modified") > F.lit(since))
    if known is None:
        return rows
    k = known.select(F.col("id").alias("k"), F.col("modified").alias("km"), F.col("size").alias("ks"))
    return rows.join(k, F.col("id") == F.col("k"), "left").filter(F.col("k").isNull() | ~F.col("modified").eqNullSafe(F.col("km")) | ~F.col("size").eqNullSafe(F.col("ks"))).drop("k", "km", "ks")


def sync(stream: DataFrame, process, checkpoint: str):
    """Runs process(batch, id) on each new batch; a batch that raises is not committed, and is tried again."""
    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
