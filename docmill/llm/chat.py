"""Chat formatting for several parties: the dialogue from each participant's perspective.

For every participant (distinct role) of a conversation, the participant's turns are rendered as the
assistant's and all others as a user's who is named; the mask marks the assistant's texts with their end
marks. Only DataFrame functions are used. A dialogue of more than PART_TURNS turns is
rendered in parts of as many, by the turns' places in it, so no row grows with the length of a conversation. The mask is in code points of
the part's text, ends exclusive.

Edge cases: turns are ordered by turn (null first), role, text; repeated rows are repeated turns. A null text is
an empty turn. A null role is a user named UNNAMED and has no perspective of its own; a conversation
without any role gives no rows. A null conv_id is a conversation of its own. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import table

PART_TURNS, UNNAMED, END = 256, "unknown", "<|end|>"


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, participant, part, n_turns, n_trained, text, mask of turns (conv_id, turn, role, text)."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # turns are numbered within ranges of turn numbers, and ranges by their counts, so a long conversation is spread over
    # tasks; the keys are never null, so that joins and windows share one dealing of the rows
    key = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), F.col("conv_id").isNull().alias("void"), F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 62))).alias("range")]
    ranged = rows.select("*", *key)
    before = Window.partitionBy("key", "void").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("key", "void", "range").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    within = Window.partitionBy("key", "void", "range").orderBy("turn", "role", "text")
    numbered = ranged.join(ranges, ["key", "void", "range"]).withColumn("k", F.row_number().over(within) - 1 + F.col("before")).withColumn("part", F.floor(F.col("k") / part_turns))
    parts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    speakers = rows.filter(F.col("role").isNotNull()).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))

    own = lambda t: F.coalesce(t["role"] == F.col("participant"), F.lit(False))
    head = lambda t: F.when(own(t), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.coalesce(t["role"], F.lit(UNNAMED)), F.lit("|>\n")))
    body = lambda t: F.concat(t["text"], F.lit(END))
    pieces = F.transform("turns", lambda t: F.struct(own(t).alias("own"), F.char_length(head(t)).alias("head"), F.char_length(body(t)).alias("body"), F.concat(head(t), body(t), F.lit("\n")).alias("s")))
    shaped = both.select("conv_id", "participant", "part", pieces.alias("p"))
    start = lambda i: F.aggregate(F.slice("p", 1, i), F.lit(0), lambda s, x: s + x["head"] + x["body"] + 1)
    spans = F.transform("p", lambda x, i: F.when(x["own"], F.concat_ws(":", (start(i) + x["head"]).cast("string"), (start(i) + x["head"] + x["body"]).cast("string"))))
    return shaped.select(
        "conv_id",
        "participant",
        F.col("part").cast("long").alias("part"),
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"),
        F.array_join(F.filter(spans, lambda x: x.isNotNull()), ",").alias("mask"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP8_SQL = f"""
WITH r AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS k FROM r),
s AS (SELECT DISTINCT conv_id, role AS participant FROM r WHERE role IS NOT NULL),
b AS (SELECT n.conv_id, s.participant, CAST(floor(n.k / {PART_TURNS}.0) AS BIGINT) AS part, n.k, coalesce(n.role = s.participant, false) AS own,
  CASE WHEN n.role = s.participant THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || coalesce(n.role, '{UNNAMED}') || '|>' || chr(10) END AS head, n.text || '{END}' AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS lo FROM b)
SELECT conv_id, participant, part, count(*) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_trained, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(CAST(lo AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(lo + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, participant, part
"""
