"""Queries of the state machine, of syncs and of stream joins, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import tabled
from docmill.operators import calibration as K
from docmill.operators.cache import QueryCache
from docmill.plans import corpus
from docmill.plans.corpus import catalog
from docmill.scratch import new_path
from docmill.session import table
from docmill.sources import extractors as X
from docmill.streaming import events as E
from docmill.streaming import machine as M
from docmill.streaming.sync import Sync

STATE = "CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'downloading' WHEN 'signup' THEN 'downloaded' WHEN 'purchase' THEN 'extracted' ELSE 'failed' END"
LEGAL = ", ".join(f"'{a}>{b}'" for a, to in E.TRANSITIONS.items() for b in to)


def forced_log(rows: DataFrame) -> DataFrame:
    """Events as a log of states; every seventh one is forced, and failures carry an error."""
    return log_of(rows).withColumns({"force": F.col("seq") % 7 == 0, "error": F.when(F.col("state") == "failed", F.concat(F.lit("error "), F.col("seq")))})


def log_of(rows: DataFrame) -> DataFrame:
    state = F.expr(STATE)
    return rows.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state"))


MACHINE = f"""WITH RECURSIVE asked AS (
  SELECT user_id AS key, event_id AS seq, {STATE} AS state, event_id % 7 = 0 AS force,
         CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
), walk AS (
  SELECT key, n, seq, NULL::VARCHAR AS before, state, state AS now, true AS taken, (state = 'failed')::BIGINT AS attempts, error
  FROM asked WHERE n = 1
  UNION ALL
  SELECT a.key, a.n, a.seq, w.now, a.state, CASE WHEN ok THEN a.state ELSE w.now END, ok,
         w.attempts + (ok AND a.state = 'failed')::BIGINT, CASE WHEN ok THEN coalesce(a.error, w.error) ELSE w.error END
  FROM walk w JOIN (SELECT * FROM asked) a ON a.key = w.key AND a.n = w.n + 1,
       LATERAL (SELECT a.force OR w.now || '>' || a.state IN ({LEGAL}) AS ok) t
)"""
STEPS = "key, seq, before, state, CASE WHEN taken THEN 'taken' ELSE 'refused' END AS kind, attempts, error"
CURRENT = "SELECT key, arg_max(state, n) AS state, arg_max(attempts, n) AS attempts, arg_max(error, n) AS error FROM walk WHERE taken GROUP BY key"


def keyed(steps: DataFrame) -> DataFrame:
    return steps.withColumn("key", F.col("key").cast("long"))


def state_machine(spark: SparkSession, d: str) -> DataFrame:
    return keyed(M.transitions(forced_log(table(spark, d, "events"))))


def current_states(spark: SparkSession, d: str) -> DataFrame:
    steps = M.transitions(forced_log(table(spark, d, "events")))
    place = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.struct("ts", "event_id").alias("place"))
    return keyed(M.current(steps.join(place, "seq"), "place"))


def streamed_machine(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream with state, run to its end."""
    name, path = "spark.sql.streaming.stateStore.providerClass", new_path(spark, "machine")
    former = spark.conf.get(name, None)
    spark.conf.set(name, M.ROCKS[name])
    try:
        rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque*")
        query = M.transition_stream(forced_log(rows), late="60 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, former) if former else spark.conf.unset(name)
    return keyed(spark.read.schema(M.STEPS).parquet(f"{path}/out").filter(F.col("kind") != M.STALLED))


def review(spark: SparkSession, d: str) -> DataFrame:
    steps = M.transitions(forced_log(table(spark, d, "events")))
    place = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.struct("ts", "event_id").alias("place"))
    return keyed(M.review_queue(steps.join(place, "seq"), 2, "place"))


def synced(spark: SparkSession, d: str) -> DataFrame:
    """What a second run finds after a first one in which every fifth file failed, and the state after it."""
    files = catalog(spark, d)
    sync = Sync(spark, f"{new_path(spark, 'sync')}-{uuid.uuid4().hex}")
    sync.run(files, lambda rows: rows.select("id", (F.col("id").cast("long") % 5 != 0).alias("ok")), since="1997-01-01", now="1998-01-01 00:00:00")
    # nothing was advanced, as files failed; half of the files have another size since
    later = files.withColumn("size", F.when(F.col("id") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")))
    sync.run(later, lambda rows: rows.select("id", F.lit(True).alias("ok")), catalog_since="1997-06-01", now="1999-01-01 00:00:00")
    return sync.checkpoints().select(F.col("id").cast("long").alias("id"), "size", F.lit(sync.watermark()).alias("watermark"))


SYNCED = """SELECT id, CASE WHEN modified > TIMESTAMP '1997-06-01' AND id % 2 = 0 THEN size + 1 ELSE size END AS size, '1999-01-01 00:00:00' AS watermark
FROM (SELECT o_orderkey AS id, o_orderdate AS modified, o_custkey AS size FROM orders WHERE o_orderstatus <> 'P')
WHERE modified > TIMESTAMP '1997-01-01' AND (id % 5 <> 0 OR modified > TIMESTAMP '1997-06-01')"""


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as one file each, and read back by the data source with an extractor of its own."""
    path = new_path(spark, "pages")
    # rows are numbered as they are read, so that a task that runs again gives its files the same names
    rows = table(spark, d, "pages").filter("html is not null").withColumn("row", F.monotonically_increasing_id())
    name = F.concat((F.col("row") % 1000).cast("string"), F.lit("/page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.col("row").cast("string"), F.lit(".txt"))
    X.register_source(spark, {"text/plain": lambda content: X.one_block(X.decoded(content))})
    rows.select(name.alias("path"), F.col("html").alias("content")).repartition("path").write.format("docmill_files").mode("append").save(path)
    found = X.texts(spark.read.format("docmill_files").load(path))
    page = F.regexp_extract("path", r"page_id=(-?\d*)-", 1).try_cast("long")
    return found.select(page.alias("page_id"), F.sha2("text", 256).alias("sha256"), F.char_length("text").cast("long").alias("chars"), "error")


def mentioned(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of texts by the table function over batches of rows."""
    text = F.concat(F.lit("Paid Rs. "), F.format_number("l_extendedprice", 2), F.lit(" in 2024 for "), F.col("l_quantity").cast("int").cast("string"), F.lit(" lakh"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return tabled.mentions(rows).select("l_orderkey", "l_linenumber", "n", F.round("number.value", 2).alias("value"), "number.unit")


def tabled_sessions(spark: SparkSession, d: str) -> DataFrame:
    return tabled.sessions(table(spark, d, "events"), 7200).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    """A score of each labelled document by its length, beside its label."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("score"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


SCORED = "s AS (SELECT least(n_chars / 4000.0, 1.0)::DOUBLE AS score, quality::DOUBLE AS label FROM labels JOIN documents USING (doc_id))"
BINS = f"WITH {SCORED}, b AS (SELECT greatest(least(floor(score * 10), 9), 0)::INTEGER AS bin, count(*) AS n, avg(score) AS s, avg(label) AS l, sum((score - label) ** 2) AS q FROM s WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY 1)"


def mended(spark: SparkSession, d: str) -> DataFrame:
    """Whether the isotonic fit rises, keeps the sum of the labels, and brings the mean squared error down."""
    rows = scored_labels(spark, d)
    steps = K.isotonic(rows)
    before, after = K.errors(rows), K.errors(K.calibrated(rows, steps).select(F.col("calibrated").alias("score"), "label"))
    kept = steps.agg(F.round(F.sum(F.col("value") * F.col("weight")), 4).alias("labels"), F.sum("weight").cast("long").alias("rows"))
    better = before.select(F.col("brier").alias("b")).crossJoin(after.select(F.col("brier").alias("a"), F.col("ece").alias("e"))).select((F.col("a") <= F.col("b")).alias("better"), (F.col("e") <= 0.0001).alias("calibrated"))
    return kept.crossJoin(better)  # one row each


def cached_turns(spark: SparkSession, d: str) -> DataFrame:
    """How often lookups of all turns of conversations hit a cache that holds the turns of every second conversation, for some of them too old."""
    said = table(spark, d, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", "conv_id")
    at = lambda s: F.lit(f"2024-01-01 {s}:00").cast("timestamp")
    cache = QueryCache(spark, new_path(spark, "cache"), ttl=3600.0)
    known = said.filter("conv_id % 2 = 0").select("text", F.concat(F.lit("answer to "), F.col("text")).alias("value"), "conv_id")
    cache.put(known.filter("conv_id % 3 = 0"), 1, at("00:00"))
    cache.put(known.filter("conv_id % 3 <> 0"), 1, at("00:40"))
    found, _ = cache.lookup(said.select("query_id", "text"), 1, at("01:10"))
    return found.select("query_id", "value", "state")


CACHED = """WITH t AS (SELECT conv_id * 1000 + turn AS query_id, text, conv_id FROM conversations WHERE text IS NOT NULL),
k AS (SELECT text, bool_or(conv_id % 3 <> 0) AS late FROM t WHERE conv_id % 2 = 0 GROUP BY text)
SELECT query_id, CASE WHEN late THEN 'answer to ' || text END AS value, CASE WHEN late IS NULL THEN 'miss' WHEN late THEN 'hit' ELSE 'expired' END AS state FROM t LEFT JOIN k USING (text)"""


def of_type(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").filter(F.col("event_type") == kind)


CATALOGUE = {
    "state_machine": (state_machine, f"{MACHINE} SELECT {STEPS} FROM walk"),
    "state_machine_stream": (streamed_machine, f"{MACHINE} SELECT {STEPS} FROM walk"),
    "state_machine_current": (current_states, f"{MACHINE} {CURRENT}"),
    "state_review_queue": (review, f"{MACHINE} SELECT key, state, attempts, 'dead_letter' AS reason FROM ({CURRENT}) WHERE state = 'failed' AND attempts >= 2"),
    "sync_checkpoints": (synced, SYNCED),
    "source_page_files": (page_files, "SELECT page_id, sha256(html) AS sha256, length(html) AS chars, NULL::VARCHAR AS error FROM pages WHERE html IS NOT NULL"),
    "udtf_number_mentions": (mentioned, corpus.CATALOGUE["number_mentions"][1]),
    "udtf_sessions": (tabled_sessions, corpus.CATALOGUE["window_session"][1]),
    "calibration_bins": (lambda s, d: K.reliability(scored_labels(s, d)), f"{BINS} SELECT bin, n, round(s, 6) AS mean_score, round(l, 6) AS mean_label, round(abs(s - l), 6) AS gap FROM b"),
    "calibration_errors": (lambda s, d: K.errors(scored_labels(s, d)), f"{BINS} SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(s - l) * n) / sum(n), 6) AS ece, round(max(abs(s - l)), 6) AS worst, round(sum(q) / sum(n), 6) AS brier FROM b"),
    "calibration_isotonic": (mended, f"WITH {SCORED} SELECT round(sum(label), 4) AS labels, count(*) AS rows, true AS better, true AS calibrated FROM s WHERE score IS NOT NULL"),
    "cache_turns": (cached_turns, CACHED),
    "stream_outer_join": (lambda s, d: E.with_purchases_or_none(of_type(s, d, "view"), of_type(s, d, "purchase"), "6 hours"), "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'view') v LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR"),
    "stream_static_join": (lambda s, d: E.with_dimension(table(s, d, "events").select("event_id", "user_id"), table(s, d, "customer").select("c_custkey", "c_mktsegment"), "user_id", "c_custkey"), "SELECT event_id, user_id, c_mktsegment FROM events LEFT JOIN customer ON user_id = c_custkey"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CATALOGUE.items() if text}
