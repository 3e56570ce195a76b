"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source, which gives each source's target; then by source and hash bucket. The bucket
in which a source's target is reached is refined by the next bits of the hash, twice; all other rows are
settled by one comparison with the threshold so found. No documents are sorted, and the tables that meet the
rows hold one row per source. Rows that hash to the threshold itself, as equal rows do, are counted out.

A target may ask for more than a source has: its whole rounds are taken from all of its documents, the
rest by the threshold, so a document is taken up to `cap` times.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows that agree
in doc_id and text hash alike; as many of them are taken as come nearest to the target; a source of size 0 has target 0. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import scope, stage, table

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 12, 3
#: Rows of the table of sources that may be broadcast.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """36 bits that depend on the document alone."""
    digest = F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def numbered(sums: DataFrame) -> DataFrame:
    """The sources with their number in order of code points, null last, from 0: places in sorted parts and the parts' counts."""
    parts = stage(sums.orderBy(F.asc_nulls_last("source")).withColumn("m", F.monotonically_increasing_id()), "parts")
    part = F.shiftright("m", 33)
    counts = parts.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each part of the sort
    starts = parts.sparkSession.createDataFrame([(r["part"], sum(x["count"] for x in counts[:k])) for k, r in enumerate(counts)], "part long, start long")
    return parts.join(F.broadcast(starts), part == F.col("part")).withColumn("number", F.col("start") + F.col("m") - F.shiftleft(F.col("part"), 33)).select(*sums.columns, "number")


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target: shares of the budget by weight, none above cap times its source; one row per source.

    Sources that the level of the others would overfill are set to their most, and the level rises by what they
    leave, until none is above; each round is one sum over the sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = numbered(sums).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    one = stage(one.withColumn("most", F.col("source_size") * F.lit(float(cap))).drop("number"), "sources")
    budget = (one.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * float(share)
    level, open_ = -1.0, None
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        now = one.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("spent"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if now["open"] == open_ or not now["open"]:
            break
        open_, level = now["open"], max(level, (budget - now["spent"]) / now["open"])
    return one.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, source, text), its hash and its source."""
    with scope() as made:
        off, on, _ = settled(docs, weights, share, cap)
        return made.keep(stage(off.unionByName(on), "mixed"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay.

    The texts meet one row per source alone, and the rows at the thresholds. Rows that agree in doc_id, text and source are told
    apart only by their number: what one of them has more than the others is taken from any of them.
    """
    with scope() as made:
        _, on, state = settled(docs, weights, share, cap)
        times = on.filter("size > 0").select("doc_id", "h", "source", F.expr("taken div size").alias("times"))
        each = times.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.col("source").alias("s")).agg(F.min("times").alias("least"), (F.sum("times") - F.count("*") * F.min("times")).alias("extra"))
        each = made.keep(stage(each.filter("least > 0 or extra > 0"), "edges"))
        state = made.keep(state)
        few = state.count() <= BROADCAST_SOURCES and each.count() <= BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if few else df
    one = F.lit(1).cast("long")
    hashed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.col("source").cast("string").alias("of"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    whole = hashed.filter(words_in(F.col("row.text")) > 0).join(side(state.select("s", "rounds", "edge")), F.col("of").eqNullSafe(F.col("s")))
    whole = whole.filter("h <> edge").withColumn("times", F.col("rounds") + (F.col("h") < F.col("edge")).cast("long")).filter("times > 0")
    whole = whole.select("row", F.explode(F.sequence(one, "times")).alias("again"))
    at = hashed.join(side(each), F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")) & F.col("of").eqNullSafe(F.col("s")))
    always = at.filter("least > 0").select("row", F.explode(F.sequence(one, "least")).alias("again"))
    more = at.filter("extra > 0").dropDuplicates(["d", "dh", "s"])
    # in blocks, as one row can have as many copies as a hot document
    more = more.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(extra - 1) div 1024")))).repartition("h", "block")
    more = more.select("row", F.explode(F.sequence(one, F.least(F.lit(1024).cast("long"), F.col("extra") - 1024 * F.col("block")))).alias("again"))
    return whole.unionByName(always).unionByName(more).select("row.*")


def settled(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows off the thresholds and those at them, as of mix(); and s, source_size, target, rounds, rest, edge of each source (staged)."""
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), "sized")
    goals = stage(targets(sized, weights, share, cap), "goals")
    small = goals.count() <= BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if small else df
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("rounds", whole).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")).withColumn("edge", F.lit(0).cast("long"))

    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        # rows of the boundary bucket so far; at the first level all rows are in it
        open_ = side(state.select(F.col("source").alias("s"), "edge"))
        inside = sized.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("edge", shift + LEVEL_BITS)))
        bins = inside.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("size").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("source").orderBy("bin"))  # 2**LEVEL_BITS bins a source
        reached = bins.withColumn("upto", upto).join(side(state.select(F.col("source").alias("s"), "rest")), F.col("source").eqNullSafe(F.col("s")))
        stays = F.col("upto") <= F.col("rest")
        found = reached.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.min(F.when(~stays, F.col("bin"))), F.max("bin") + 1).alias("bin"), F.coalesce(F.sum(F.when(stays, F.col("here"))), F.lit(0)).alias("spent"))
        state = state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "rounds", (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("rest"), F.coalesce(F.shiftleft("bin", shift), F.col("edge")).alias("edge"))
        state = stage(state, "state")

    state = stage(state.withColumnRenamed("source", "s"), "state")
    placed = sized.join(side(state), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    off = placed.filter("h <> edge").withColumn("more", (F.col("h") < F.col("edge")).cast("long"))
    # at the boundary stand the rows of one hash: one document, or many equal rows, of which as many go as come nearest;
    # they are counted by the part of the table that they lie in, so no part's rows need meet another's
    at = stage(placed.filter("h = edge").withColumn("part", F.spark_partition_id()), "boundary")
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = at.filter("size > 0").groupBy("source", "size", "part").agg(F.count("*").alias("c"), F.first("rest").alias("rest"))
    room = F.col("rest") - F.coalesce(F.sum(F.col("c") * F.col("size")).over(before), F.lit(0))
    quota = groups.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), F.greatest(F.lit(0), F.least("c", F.floor(room / F.col("size") + 0.5))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id"))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))
    on = at.withColumn("rank", rank).join(quota, same, "left").withColumn("more", F.coalesce((F.col("rank") <= F.col("quota")).cast("long"), F.lit(0).cast("long")))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("rounds") + F.col("more"))).alias("taken"), "h", "source"]
    return off.select(*columns), on.select(*columns), state


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("h", "source")
