"""Queries understood: their parts, protected normal form, expansions, retrieval plans and gate plans.

All operators take a table of queries and give one row per query (or per expansion); word lists that name a
corpus's own entities are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import answers as A

#: What a query's normal form keeps as it stands: addresses, links, dates, amounts, grouped numbers, ids, Devanagari numerals: fixed values.
PROTECTED = (
    r"[\w.-]+@[\w.-]+\.\w+",
    r"https?://\S+",
    r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"(?i:NPR|Rs\.?|\$|USD)\s*[\d,]+(?:\.\d+)?",
    r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b",
    r"[A-Za-z0-9_-]{28}",
    r"[०-९]+",
)
#: Patterns of dates and amounts in queries, and general synonyms: fixed values.
DATES = (r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b")
AMOUNT = r"(?i:NPR|Rs\.?|\$)\s*[\d,]+"
NAMES = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
ABBREVIATIONS = {"mtg": "meeting", "conf": "conference", "comp": "competition"}
SYNONYMS = {"sponsor": "partner", "event": "festival", "total": "sum"}
#: Lists that each intent searches, in order: fixed values.
STRATEGIES = {
    "exact_lookup": ("exact", "bm25"),
    "entity_lookup": ("exact", "bm25"),
    "numeric": ("exact", "bm25", "structured"),
    "date": ("exact", "bm25", "metadata"),
    "structured_data": ("structured", "bm25", "exact"),
    "aggregation": ("structured", "bm25", "exact"),
    "comparison": ("structured", "bm25", "exact", "dense"),
    "temporal": ("exact", "metadata", "bm25"),
    "metadata": ("metadata", "bm25", "exact"),
    "navigation": ("metadata", "bm25"),
    "compound": (),
}
OTHERWISE = ("bm25", "exact", "dense")
#: Words by which the gate tells what kind of answer a query wants, in order of precedence: fixed values.
WANTS = {
    "who": ("who is", "who was", "who were", "president", "sponsor", "organizer", "team", "members"),
    "what": ("what is", "what was", "define", "explain", "description"),
    "when": ("when", "date", "held", "year", "2025", "2023", "2024"),
    "list": ("list", "20", "100", "all", "names", "items", "table"),
    "how_much": ("how much", "cost", "price", "fee", "investment", "rs", "amount"),
}
YEARS = ("2025", "2023", "2024", "2026", "2022", "2012")
#: Words of companies and of fees, which a question for a sponsor tells apart: fixed values.
COMPANY = ("company", "corporation", "ltd", "pvt", "group", "bank", "tech", "engineering", "limited", "industrial")
FEES = ("price", "fee", "cost", "investment", "rs ", "starting sponsorship", "benefit", "privilege", "privileges")


def any_of(text: Column, words) -> Column:
    """Whether the text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def analyse(queries: DataFrame, text: str = "text") -> DataFrame:
    """queries with terms (words of two characters or more), entities (runs of capitalised words), dates and amounts."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return queries.withColumns({"terms": T.tokens(F.trim(text)), "entities": found(NAMES), "dates": F.concat(*map(found, DATES)), "amounts": found(AMOUNT)})


def protected_lower(text: Column, protected=PROTECTED) -> Column:
    """Lower case with single spaces, but for the parts that a protected pattern matches, which stay as they are."""
    pattern = F.lit("|".join(protected))
    text = F.trim(text)
    kept, rest = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, "|".join(protected), -1)
    pieces = F.transform(rest, lambda x, i: F.concat(F.lower(F.regexp_replace(x, r"\s+", " ")), F.coalesce(F.get(kept, i), F.lit(""))))
    return F.array_join(pieces, "")


def expansions(queries: DataFrame, abbreviations: dict[str, str] = ABBREVIATIONS, synonyms: dict[str, str] = SYNONYMS, key: str = "query_id") -> DataFrame:
    """key, n, text: the query itself, with its abbreviations written out if it has any, and with each synonym it has a word for."""
    written = reduce(lambda c, kv: F.regexp_replace(c, rf"(?i)\b{kv[0]}\b", kv[1]), abbreviations.items(), F.col("text"))
    swapped = [F.when(F.contains(F.lower("text"), F.lit(a)), F.replace("text", F.lit(a), F.lit(b))) for a, b in synonyms.items()]
    every = F.array_compact(F.array("text", F.when(written != F.col("text"), written), *swapped))
    return queries.select(key, F.posexplode(every).alias("n", "text"))


def plans(queries: DataFrame) -> DataFrame:
    """query_id, intent, confidence, strategies (in order), years, before, after, parts of each query.

    A compound query has no strategies of its own; sub_plans() plans its parts.
    """
    understood = A.intents(queries)
    chosen = reduce(lambda c, kv: c.when(F.col("intent") == kv[0], F.array(*map(F.lit, kv[1])).cast("array<string>")), STRATEGIES.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    edge = lambda word: F.nullif(F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), rf"\b{word}\s+(\d{{4}})", 1), F.lit(""))
    bounds = queries.select("query_id", edge("before").alias("before"), edge("after").alias("after"))
    return understood.withColumn("strategies", chosen.otherwise(F.array(*map(F.lit, OTHERWISE)))).join(bounds, "query_id").select("query_id", "intent", "confidence", "strategies", "years", "before", "after", "parts")


def sub_plans(planned: DataFrame) -> DataFrame:
    """query_id, part, text, intent, strategies of the parts of compound queries."""
    parts = planned.select("query_id", F.posexplode("parts").alias("part", "text"))
    keyed = parts.withColumn("whole", F.col("query_id")).withColumn("query_id", F.struct("whole", "part"))
    return plans(keyed).join(keyed.select("query_id", "text"), "query_id").select(F.col("query_id.whole").alias("query_id"), F.col("query_id.part").alias("part"), "text", "intent", "strategies")


def wants(text: Column) -> Column:
    """The kind of answer that a query (in lower case) asks for."""
    return F.coalesce(*[F.when(any_of(text, words), F.lit(name)) for name, words in WANTS.items()], F.lit("general"))


def gate_plans(queries: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """query_id, wants, names (of the entities one of whose aliases the query has), years, sponsors (whether it asks who a sponsor is)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    names = F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(name)) for name, words in (aliases or {}).items()])).cast("array<string>")
    years = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(y)), F.lit(y)) for y in YEARS]))
    kind = wants(low)
    return queries.select("query_id", kind.alias("wants"), names.alias("names"), years.alias("years"), ((kind == "who") & F.contains(low, F.lit("sponsor"))).alias("sponsors"))


def gated(candidates: DataFrame, gate: DataFrame, anchors, aliases: dict[str, tuple[str, ...]] | None = None, fallback: int = 5) -> DataFrame:
    """Candidates (query_id, doc_id, text, score) that support their query's gate plan; a query that none does keeps its first ones.

    A text on fees without a company does not say who a sponsor is. A query that names entities wants one of
    their aliases, any other one of the anchors (no anchors: any text will do).
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    fees = any_of(low, FEES) & ~any_of(low, COMPANY)
    named = reduce(lambda a, b: a | b, [F.array_contains("names", name) & any_of(low, words) for name, words in (aliases or {}).items()], F.lit(False))
    ok = ~(F.col("sponsors") & fees) & F.when(F.size("names") > 0, named).otherwise(any_of(low, anchors) if anchors else F.lit(True))
    w = Window.partitionBy("query_id")
    marked = candidates.join(gate.select("query_id", "names", "sponsors"), "query_id").withColumn("ok", ok)
    marked = marked.withColumns({"some": F.max("ok").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))})
    return marked.filter(F.col("ok") | (~F.col("some") & (F.col("place") <= fallback))).drop("names", "sponsors", "ok", "some", "place")


def relevant(candidates: DataFrame, queries: DataFrame, anchors, roles, floor: float = 0.02, fallback: int = 10) -> DataFrame:
    """Candidates (query_id, doc_id, text, score) on their query's subject; a query without any keeps a third of them, or `fallback`.

    A query for a role wants a text with a role and an anchor, or with a role and a score above the floor; any
    other query wants an anchor.
    """
    asked = queries.select("query_id", any_of(F.lower(F.coalesce("text", F.lit(""))), roles).alias("role"))
    low = F.lower(F.coalesce("text", F.lit("")))
    anchor, role = any_of(low, anchors), any_of(low, roles)
    w = Window.partitionBy("query_id")
    marked = candidates.join(asked, "query_id").withColumn("ok", F.when(F.col("role"), role & (anchor | (F.col("score") > floor))).otherwise(anchor))
    marked = marked.withColumns({"some": F.max("ok").over(w), "all": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))})
    spare = F.greatest(F.lit(fallback), F.floor(F.col("all") / 3))
    return marked.filter(F.col("ok") | (~F.col("some") & (F.col("place") <= spare))).drop("role", "ok", "some", "all", "place")
