"""Intents of queries, verification of answers and claims, answers with citations, and the result cache.

All operators take tables: queries (query_id, text), evidence items (query_id, doc_id, text, score, authority),
claims (query_id, n, claim), cache entries. One pass serves all queries of a batch.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import written

#: Patterns of each intent, in order of precedence: fixed values.
INTENTS = {
    "exact_lookup": [r"\b(who is|what is the|find the|show me the)\s+\w+", r"\b(name|id|identifier|code)\s+of\s+"],
    "entity_lookup": [r"\b(who|which)\s+(was|is|were)\s+", r"\b(sponsor|organizer|president|member)\s+"],
    "numeric": [r"\b(how much|total|sum|amount|count|average)\b", r"\b(\d{1,3}(?:,\d{3})*|\d+)\b"],
    "date": [r"\b(when|date|year|month|day)\b", r"\b(20\d{2})\b"],
    "comparison": [r"\b(compare|versus|vs\.?|difference|similar|different)\b"],
    "aggregation": [r"\b(total|sum|average|count|min|max|group by|by year)\b"],
    "temporal": [r"\b(before|after|since|until|during|in\s+\d{4})\b", r"\b(historical|current|latest|latest|as of)\b"],
    "structured_data": [r"\b(list|show|export|all\s+\w+\s+and|every\s+\w+)\b", r"\b(table|rows|columns|spreadsheet|csv|excel)\b"],
    "metadata": [r"\b(meta|metadata|file|document|type|folder|path)\b"],
    "navigation": [r"\b(open|go to|show|navigate|path)\b"],
}
SQL_LIKE = r"\b(select|where|group by|order by|sum|count|average)\b"
#: Words that start a question and name nothing: fixed values.
NO_ENTITY = ("The", "A", "An", "What", "Who", "When", "Where", "How", "Why")


def intents(queries: DataFrame) -> DataFrame:
    """query_id, intent, confidence, parts, entity, years of each query.

    An intent scores a point for each of its patterns; words of SQL add two to structured_data, and "and" or a
    comma one to compound. The first largest score wins; without any the intent is semantic.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    points = lambda c, k: F.when(c, F.lit(k)).otherwise(F.lit(0))
    scores = {name: reduce(lambda a, b: a + b, [points(low.rlike(p), 1) for p in patterns]) for name, patterns in INTENTS.items()}
    scores["structured_data"] = scores["structured_data"] + points(low.rlike(SQL_LIKE), 2)
    scores["compound"] = points(low.rlike(r"\band\b|,"), 1)
    # an array, so that each pattern is matched once a query
    scored = queries.withColumn("_scores", F.array(*scores.values()))
    best = F.array_max("_scores")
    names_of = F.array(*[F.lit(name) for name in scores])
    first = F.when(best > 0, F.element_at(names_of, F.array_position("_scores", best).cast("int"))).otherwise(F.lit("semantic"))
    parts = F.filter(F.transform(F.split("text", r"\b(?:and|,)\b"), lambda p: F.trim(p)), lambda p: F.char_length(p) > 3)
    names = F.filter(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"), F.lit(1)), lambda n: ~n.isin(*NO_ENTITY))
    years = F.transform(F.regexp_extract_all("text", F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return scored.select(
        "query_id",
        first.alias("intent"),
        F.round(F.least(F.greatest(best, F.lit(1)) / 3.0, F.lit(1.0)), 6).alias("confidence"),
        F.when(F.element_at("_scores", -1) > 0, parts).otherwise(F.array().cast("array<string>")).alias("parts"),
        F.try_element_at(names, F.lit(1)).alias("entity"),
        years.alias("years"),
    )


def year_check(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, year (the latest that the query names, or null), found: some item of its evidence names it without denial."""
    asked = queries.select("query_id", F.array_max(F.regexp_extract_all("text", F.lit(r"(20[0-9]{2})"), F.lit(1))).alias("year"))
    low = F.lower(F.coalesce("text", F.lit("")))
    denied = reduce(lambda a, b: a | b, [F.contains(low, F.concat(F.lit(f"{w} "), F.col("year"))) for w in ("no", "not", "missing", "absent")])
    seen = evidence.join(asked, "query_id").filter(F.contains(low, F.col("year")) & ~denied).select("query_id").distinct().withColumn("has", F.lit(True))
    return asked.join(seen, "query_id", "left").select("query_id", "year", (F.col("year").isNull() | F.col("has").isNotNull()).alias("found"))


def verify(answers: DataFrame, evidence: DataFrame, sets: DataFrame, high: float = 0.8, medium: float = 0.4, sure: float = 1.0, strong: float = 0.5) -> DataFrame:
    """query_id, completeness, faithful, level of answers (query_id, answer) by their evidence.

    Completeness is 1.5 times the share of the answer's distinct words of over three characters that some item
    contains, 1 at most; a score above `sure` lifts it to 0.9. sets: query_id, sufficient, conflict.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("answer"), r"\s+"), lambda w: F.char_length(w) > 3))
    asked = answers.select("query_id", words.alias("words"))
    # word by word, so no query's texts are gathered in one row
    each = asked.select("query_id", F.explode("words").alias("w")).join(evidence.select("query_id", F.lower("text").alias("low")), "query_id").filter(F.contains("low", F.col("w")))
    held = each.groupBy("query_id").agg(F.countDistinct("w").alias("held"))
    top = evidence.groupBy("query_id").agg(F.max("score").alias("top"))
    joined = asked.join(held, "query_id", "left").join(top, "query_id", "left").join(sets, "query_id", "left")
    share = F.least(1.5 * F.coalesce("held", F.lit(0)) / F.greatest(F.size("words"), F.lit(1)), F.lit(1.0))
    none = F.col("top").isNull() | ~F.coalesce("sufficient", F.lit(False))
    complete = F.when(none, 0.0).when(F.col("top") > sure, F.greatest(share, F.lit(0.9))).otherwise(share)
    done = joined.withColumn("completeness", F.round(complete, 6)).withColumn("faithful", ~none & ~F.coalesce("conflict", F.lit(False)) & (F.col("completeness") >= medium))
    level = F.when(none, "ABSTAIN").when(~F.col("faithful"), F.when(F.col("completeness") < 0.2, "ABSTAIN").otherwise("LOW")).when((F.col("completeness") >= high) & (F.col("top") >= strong), "HIGH").otherwise("MEDIUM")
    return done.select("query_id", "completeness", "faithful", level.alias("level"))


def bare(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def topics(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.char_length(w) > 3))


def verify_claims(claims: DataFrame, evidence: DataFrame, sets: DataFrame, least: float = 0.3, high: float = 0.7) -> DataFrame:
    """query_id, n, status, doc_id, confidence of claims (query_id, n, claim) by the items of their query.

    An item supports a claim when one contains the other (letters and digits only), when it contains the claim's
    first 20, or when they share over 40 % of the claim's topic words. The best score times authority decides.
    """
    mine = claims.select("query_id", "n", bare(F.col("claim")).alias("c"), topics(F.col("claim")).alias("ct"))
    items = evidence.select("query_id", "doc_id", (F.col("score") * F.col("authority")).alias("weight"), bare(F.col("text")).alias("t"), topics(F.col("text")).alias("tt"))
    inside = F.contains("t", F.col("c")) | F.contains("c", F.col("t")) | ((F.char_length("c") > 3) & F.contains("t", F.substring("c", 1, 20)))
    shared = F.size(F.array_intersect("ct", "tt")) / F.greatest(F.size("ct"), F.lit(1)) > 0.4
    best = mine.join(items, "query_id").filter((inside | shared) & (F.col("weight") > 0)).groupBy("query_id", "n").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("b"))
    joined = mine.select("query_id", "n").join(best, ["query_id", "n"], "left").join(sets, "query_id", "left")
    good = F.coalesce(F.col("b.weight") >= least, F.lit(False))
    status = F.when(good, "VERIFIED").when(F.col("conflict"), "CONFLICT").when(~F.coalesce("sufficient", F.lit(False)), "INSUFFICIENT_EVIDENCE").otherwise("UNSUPPORTED")
    return joined.select("query_id", "n", status.alias("status"), F.when(good, -F.col("b.minus")).alias("doc_id"), F.when(good & (F.col("b.weight") > high), "HIGH").when(good, "MEDIUM").otherwise("LOW").alias("confidence"))


def build_answers(verified: DataFrame, evidence: DataFrame, most: int = 5, snippet: int = 120) -> DataFrame:
    """query_id, kind, answer, sources: the best items' beginnings with numbered citations, or an abstention.

    verified: query_id, level. Only the `most` best items of a query are gathered.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    best = evidence.withColumn("r", rank).filter(F.col("r") <= most)
    piece = F.concat(F.trim(F.substring("text", 1, snippet)), F.lit(" ["), F.col("r").cast("string"), F.lit(":"), F.col("doc_id").cast("string"), F.lit("]"))
    gathered = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id", piece.alias("s")))).alias("items"))
    joined = verified.join(gathered, "query_id", "left")
    abstains = (F.col("level") == "ABSTAIN") | F.col("items").isNull()
    return joined.select(
        "query_id",
        F.when(abstains, "ABSTENTION").otherwise("FACTUAL").alias("kind"),
        F.when(~abstains, F.array_join(F.transform("items", lambda i: i["s"]), "\n")).alias("answer"),
        F.when(abstains, F.array().cast("array<long>")).otherwise(F.transform("items", lambda i: i["doc_id"].cast("long"))).alias("sources"),
    )


# ---------------------------------------------------------------- cache


def cache_key(query: Column) -> Column:
    return F.substring(F.sha2(query.cast("binary"), 256), 1, 16)


def cache_lookup(queries: DataFrame, entries: DataFrame, corpus_version: int, index_version: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits: query_id, value; misses: the other queries) by entries (key, corpus_version, index_version, created, ttl, value).

    An entry of another version, or past its time to live in seconds (null: for ever), is a miss.
    """
    fresh = entries.filter((F.col("corpus_version") == corpus_version) & (F.col("index_version") == index_version) & (F.col("ttl").isNull() | (F.col("created").cast("double") + F.col("ttl") > now.cast("double"))))
    latest = fresh.groupBy("key").agg(F.max_by("value", F.struct("created", "value")).alias("value"))
    keyed = queries.withColumn("key", cache_key(F.col("text")))
    return keyed.join(latest, "key").select("query_id", "value"), keyed.join(latest, "key", "left_anti").drop("key")


def cache_evict(entries: DataFrame, most: int) -> DataFrame:
    """The `most` entries that were asked for most often (entries have a column accessed), by key on ties."""
    return entries.orderBy(F.desc("accessed"), "key").limit(most)


# ---------------------------------------------------------------- samples, provenance, artifacts


def stratified_sample(rows: DataFrame, stratum: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    """`budget` rows of each stratum, those of the least hashes (MD5) of key and seed."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(drawn, key))
    return rows.withColumn("r", rank).filter(F.col("r") <= budget).drop("r")


def repair_provenance(candidates: DataFrame, provenance: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fills missing fields of candidates from provenance (key, fields), by the first of `keys` that it knows."""
    out = candidates
    for k in keys:
        known = provenance.select(F.col("key").alias(f"k_{k}"), F.struct(*fields).alias(f"p_{k}"))
        out = out.join(known, F.col(k).cast("string") == F.col(f"k_{k}"), "left")
    found = F.coalesce(*[F.col(f"p_{k}") for k in keys])
    filled = {f: F.coalesce(F.col(f), found[f]) if f in candidates.columns else found[f] for f in fields}
    return out.select(*[c for c in candidates.columns if c not in fields], *[c.alias(f) for f, c in filled.items()])


def extraction_gate(docs: DataFrame, least: int = 10, most_space: float = 0.9) -> DataFrame:
    """doc_id, passed, issues: texts of too few characters, or almost all white space, must not be indexed."""
    text = F.coalesce("text", F.lit(""))
    tiny = F.char_length(F.regexp_replace(text, r"^\s+|\s+$", "")) < least
    blank = F.regexp_count(text, F.lit(r"\s")) / F.greatest(F.char_length(text), F.lit(1)) > most_space
    issues = F.array_compact(F.array(F.when(tiny, "empty_or_tiny_extraction"), F.when(blank, "abnormal_whitespace_yield")))
    return docs.select("doc_id", (F.size(issues) == 0).alias("passed"), F.array_join(issues, ",").alias("issues"))


def orphans(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two artifacts has, and which one."""
    a, b = one.select(key).distinct(), other.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("first")).unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("second")))


#: Edges that are left, up to which one task takes the rest of a greedy matching in order (16 MB).
LAST_EDGES = 1 << 20


def in_order(batches):
    """mapInArrow over edges (a, b) in order: those that greedy matching takes."""
    used = set()
    for batch in batches:
        won = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a not in used and b not in used:
                used.update((a, b))
                won.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in won], batch.schema.field(k).type) for k in (0, 1)], ["a", "b"])


def greedy_matches(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that greedy matching in order of (a, b) takes: each round takes those that come first at both ends.

    The first edge that is left always wins, so rounds end; a chain of edges in order, or a group of near copies, settles
    one a round. So once LAST_EDGES or fewer are left, one task takes the rest in order.
    Each round's edges are written to the shared scratch folder, so plans stay short and a lost executor costs one round.
    """
    left, taken, rounds = written(pairs.select("a", "b"), "left"), None, 0
    while True:
        if left.limit(LAST_EDGES + 1).count() <= LAST_EDGES:
            rest = left.coalesce(1).sortWithinPartitions("a", "b").mapInArrow(in_order, left.schema)
            return rest if taken is None else taken.unionByName(rest)
        ends = left.select(F.col("a").alias("v"), F.struct("a", "b").alias("e")).unionByName(left.select(F.col("b").alias("v"), F.struct("a", "b").alias("e")))
        first = ends.groupBy("v").agg(F.min("e").alias("e"))
        won = first.groupBy("e").agg(F.count("*").alias("c")).filter("c = 2").select("e.a", "e.b")
        won = written(won, "won")
        if won.isEmpty():
            break
        taken, rounds = won if taken is None else taken.unionByName(won), rounds + 1
        if rounds % 50 == 0:
            taken = written(taken, "taken")
        used = won.select(F.explode(F.array("a", "b")).alias("v"))
        left = written(left.join(used, F.col("a") == F.col("v"), "left_anti").join(used, F.col("b") == F.col("v"), "left_anti"), "left")
    return taken if taken is not None else left
