"""Fusion, filters, rerank and the evidence gate over ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import index as I
from docmill.operators import planner as P
from docmill.scratch import written

RRF_K = 60


def fuse(lists: list[DataFrame], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, key, rank): one union and one aggregate."""
    every = reduce(DataFrame.unionByName, [x.select("query_id", key, "rank") for x in lists])
    return every.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def merge_best(lists: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Union of lists that keeps a candidate's best score."""
    return reduce(DataFrame.unionByName, [x.select("query_id", key, "score") for x in lists]).groupBy("query_id", key).agg(F.max("score").alias("score"))


def metadata_filter(candidates: DataFrame, meta: DataFrame, key: str = "doc_id", **equal) -> DataFrame:
    """Candidates whose metadata equal the given values; missing metadata fail."""
    joined = candidates.join(meta, key, "left")
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), equal.items(), joined)


def contains_all(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a & b, [F.contains(low, F.lit(w.lower())) for w in words])


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])


def phrase_search(docs: DataFrame, words: list[str], k: int) -> DataFrame:
    """Documents with all words, shortest first; score 1 / (1 + 0.1 * position)."""
    found = docs.filter(contains_all(F.col("text"), words)).select("doc_id", F.char_length("text").cast("long").alias("n"))
    best = found.orderBy("n", "doc_id").limit(k)
    place = F.row_number().over(Window.orderBy("n", "doc_id"))  # over k rows
    return best.select("doc_id", "n", F.round(1 / (1 + 0.1 * (place - 1)), 6).alias("score"))


def rerank(candidates: DataFrame, rules: list[tuple[Column, float]]) -> DataFrame:
    """Adds the deltas of the rules that hold."""
    boost = reduce(lambda a, b: a + b, [F.when(rule, F.lit(delta)).otherwise(F.lit(0.0)) for rule, delta in rules])
    return candidates.withColumn("score", F.round(F.col("score") + boost, 6))


def reranked(candidates: DataFrame, rules: list[tuple[Column, float]]) -> DataFrame:
    """rerank() and the new order: by the new score, then the old one; ranks from 1."""
    after = rerank(candidates.withColumn("before", F.col("score")), rules)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("before"), "doc_id"))
    return after.withColumn("rank", rank).drop("before")


def page_filter(candidates: DataFrame, first: int, last: int) -> DataFrame:
    """Candidates one of whose pages page_start and page_end lies within a range."""
    return candidates.filter(F.col("page_start").between(first, last) | F.col("page_end").between(first, last))


def with_provenance(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, text, locator, chunk_id) that have more than five characters or can be traced to a source."""
    return candidates.filter((F.char_length("text") > 5) | F.col("doc_id").isNotNull() | F.col("locator").isNotNull() | F.col("chunk_id").isNotNull())


def gate(candidates: DataFrame, anchors: list[str], fallback: int = 5) -> DataFrame:
    """Candidates with an anchor word; a query that none passes keeps its first ones."""
    w = Window.partitionBy("query_id")
    marked = candidates.withColumn("ok", contains_any(F.col("text"), anchors)).withColumn("any_ok", F.max("ok").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "doc_id")))
    return marked.filter(F.col("ok") | (~F.col("any_ok") & (F.col("place") <= fallback))).drop("ok", "any_ok", "place")


#: Words by which a query's subject raises or lowers a candidate: fixed values.
SPONSOR = ("sponsor", "partner", "sponsorship")
SPONSOR_TEXT = ("sponsor", "partner", "platinum", "gold", "title", "associate")
PRICED = ("price", "fee", "cost", "registration", "participant", "participant list")
PRICE_ASKED = ("price", "fee", "registration")
PEOPLE = ("president", "committee", "team", "organizer", "members", "who is")
PEOPLE_TEXT = ("committee", "president", "team", "design chief", "coordinator", "co-ordinator", "leader")
LISTS = ("list", "table", "all sponsors", "all presidents", "all events", "list all")
LIST_TEXT = ("table", "csv", "spreadsheet", "excel", "xlsx", "rows")
FORMATS = ("csv", "excel", "table", "xlsx")
WHO = ("who", "president", "sponsor", "company", "team", "organizer")
ROSTERS = ("sponsor", "team", "committee", "roster", "contact", "president")
FEE_TEXT = ("price", "fee", "benefit", "privileges", "privilege", "starting sponsorship", "investment", "negotiable", "registration fee", "participant fee")
COMPANY_TEXT = ("company", "corporation", "group", "bank", "limited", "industrial", "engineering", "consulting", "consultancy", "p.c.", "ltd", "pvt")


def query_boost(asked: Column, text: Column, named: tuple[str, ...] = ()) -> Column:
    """What a candidate's score gains by its query's subject; reads the columns doc_id, doc_type, category, format, authority_status.

    named: entities of the corpus that count when query and text have them.
    """
    q, low = F.lower(F.coalesce(asked, F.lit(""))), F.lower(F.coalesce(text, F.lit("")))
    asks, says = (lambda words: P.any_of(q, words)), (lambda words: P.any_of(low, words))
    is_ = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    structured = is_("doc_type", "structured")
    rules = [
        (asks(SPONSOR) & (says(SPONSOR_TEXT) | structured) & says(PRICED) & ~asks(PRICE_ASKED), -0.15),
        (asks(SPONSOR) & (says(SPONSOR_TEXT) | structured) & (~says(PRICED) | asks(PRICE_ASKED)), 0.12),
        (asks(["theme"]) & (says(["theme"]) | is_("category", "theme") | structured), 0.10),
        (asks(PEOPLE) & (says(PEOPLE_TEXT) | is_("authority_status", "institutional")), 0.11),
        (asks(LISTS) & (structured | is_("format", *FORMATS)), 0.15),
        (asks(LISTS) & says(LIST_TEXT), 0.08),
        *((asks([n]) & says([n]), 0.25) for n in named),
        *((asks([n]) & (structured | is_("category", n.replace(" ", "_"))), 0.15) for n in named),
        (asks(WHO) & (structured | is_("format", *FORMATS) | is_("category", *ROSTERS)), 0.20),
        (asks(WHO) & says(FEE_TEXT) & ~says(COMPANY_TEXT), -0.25),
        (F.col("doc_id").isNotNull() & is_("authority_status", "institutional"), 0.02),
    ]
    return reduce(lambda a, b: a + b, [F.when(rule, F.lit(delta)).otherwise(F.lit(0.0)) for rule, delta in rules])


def hybrid(docs: DataFrame, queries: DataFrame, depth: int = 1000, k: int = 100, vectors: DataFrame | None = None, asked_vectors: DataFrame | None = None, meta: DataFrame | None = None, filters: dict | None = None, named: tuple[str, ...] | None = None, anchors: tuple[str, ...] | None = None, aliases: dict | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: BM25, exact and (with vectors) dense lists of `depth`, fused, then filtered, reranked and gated.

    meta (doc_id, doc_type, category, format, authority_status, ...) and filters: equal values that candidates must
    have. named: rerank by the query's subject, with these entities. anchors, aliases: keep what supports the
    query's gate plan, or its first five.
    """
    lists = [I.bm25(docs, queries, depth), I.exact_over(docs, queries, depth)]
    if vectors is not None and asked_vectors is not None:
        lists.append(I.dense(vectors.select(F.col("doc_id").alias("vec_id"), "embedding"), asked_vectors, depth).withColumnRenamed("vec_id", "doc_id"))
    return refined(fuse(lists), docs, queries, k, meta, filters, named, anchors, aliases)


def refined(fused: DataFrame, docs: DataFrame, queries: DataFrame, k: int, meta: DataFrame | None = None, filters: dict | None = None, named: tuple[str, ...] | None = None, anchors: tuple[str, ...] | None = None, aliases: dict | None = None) -> DataFrame:
    """The later steps of hybrid() on fused candidates (query_id, doc_id, score)."""
    if filters:
        fused = metadata_filter(fused, meta, **filters).select("query_id", "doc_id", "score")
    if named is not None or anchors is not None or aliases:
        fused = fused.join(docs.select("doc_id", "text"), "doc_id")
    if named is not None:
        fields = ("doc_type", "category", "format", "authority_status")
        known = fused.join(meta.select("doc_id", *fields), "doc_id", "left") if meta is not None else fused.withColumns({f: F.lit(None).cast("string") for f in fields})
        scored = known.join(I.small(queries.select("query_id", F.col("text").alias("asked"))), "query_id")
        fused = scored.withColumns({"before": F.col("score"), "score": F.col("score") + query_boost(F.col("asked"), F.col("text"), named)}).drop("asked", *fields)
    if anchors is not None or aliases:
        fused = P.gated(fused, P.gate_plans(queries, aliases), anchors or (), aliases)
    order = [F.desc("score"), *([F.desc("before")] if named is not None else []), "doc_id"]
    scored = fused.withColumn("score", F.round("score", 6))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


#: Depths of the ladder's rungs.
RUNGS = ("initial", "expanded", "phrase", "broadened", "reformulated", "documents")


def ladder(queries: DataFrame, search, k: int = 20, depths: tuple[int, ...] = (20, 50, 50, 50, 50, 50), enough: int = 3, top: float = 0.8, low: float = 0.3, abbreviations: dict[str, str] = P.ABBREVIATIONS, synonyms: dict[str, str] = P.SYNONYMS) -> DataFrame:
    """query_id, doc_id, score, rank, rung: the hits of the first rung that suffices, else of the last.

    search(queries, k) -> query_id, doc_id, score, rank serves a whole table of queries. A rung suffices with `enough`
    hits, if the best scores `top` or as many score `low`. The rungs: search; more depth; the quoted query; the query with
    abbreviations written out, without marks and in lower case, if that differs; its expansions, the first list that
    has a document counts; the best of each document. Each rung searches only for queries that are still open.
    """
    open_, done = queries.select("query_id", "text"), None
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), abbreviations.items(), F.col("text")), r"[^\p{L}\p{N}_\s]", " ")), r"\s+", " "))
    for rung, (name, depth) in enumerate(zip(RUNGS, depths, strict=True)):
        if name in ("initial", "expanded", "documents"):
            hits = search(open_, depth if name != "documents" else 3 * depth)
        elif name == "phrase":
            hits = search(open_.withColumn("text", F.concat(F.lit('"'), F.col("text"), F.lit('"'))), depth)
        elif name == "broadened":
            hits = search(open_.withColumn("bare", bare).filter((F.col("bare") != "") & (F.col("bare") != F.lower("text"))).select("query_id", F.col("bare").alias("text")), depth)
        else:
            each = P.expansions(open_, abbreviations, synonyms)
            counts = each.groupBy("query_id").agg(F.max("n").alias("most"))
            variants = each.filter("n > 0").join(counts, "query_id").select(F.struct("query_id", "n", "most").alias("query_id"), "text")
            found = search(variants, depth).select("query_id.*", "doc_id", "score", "rank").filter(F.col("rank") <= F.floor(F.lit(depth) / (F.col("most") + 1)))
            first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("n", "rank"))
            hits = found.withColumn("r", first).filter("r = 1").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n", "rank")))
        if name == "documents":
            hits = hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
        hits = written(hits.select("query_id", "doc_id", "score", "rank"), "rung")
        if name != RUNGS[-1]:
            sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max_by("score", -F.col("rank")).alias("best"), F.sum((F.col("score") >= low).cast("int")).alias("fair"))
            settled = written(sums.filter((F.col("n") >= enough) & ((F.col("best") >= top) | (F.col("fair") >= enough))).select("query_id"), "settled")
            mine = hits.join(settled, "query_id", "left_semi")
            open_ = open_.join(settled, "query_id", "left_anti")
        else:
            mine = hits
        mine = mine.filter(F.col("rank") <= k).withColumn("rung", F.lit(rung))
        done = mine if done is None else done.unionByName(mine)
        if not open_.limit(1).count():
            break
    return done


def recall_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, reciprocal rank and NDCG at k; ranked: query_id, doc_id, rank; relevant: query_id, doc_id."""
    want = relevant.groupBy("query_id").agg(F.count("*").alias("want"))
    hit = ranked.filter(F.col("rank") <= k).join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("want"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return want.join(hit, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("want"), 6).alias("recall"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))
