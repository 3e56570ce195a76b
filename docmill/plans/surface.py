"""Queries of planning, ingestion, extraction, stored indexes, caches and table computation, with their SQL.

Turns of the conversations stand for questions, orders for a catalog of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import answers as A
from docmill.operators import documents as D
from docmill.operators import extraction as X
from docmill.operators import index as I
from docmill.operators import ingest as G
from docmill.operators import planner as P
from docmill.operators import retrieve as R
from docmill.operators import store as K
from docmill.operators import structured as S
from docmill.plans.corpus import BM25, FOLD, QUALITY, TURNS, Q, asked, bm25_lists, docs, intent_sql, turns
from docmill.scratch import new_path, written
from docmill.session import table


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


WORD = quoted(T.WORD)
PROTECTED = quoted("|".join(P.PROTECTED))
ABBREVIATIONS, SYNONYMS = P.ABBREVIATIONS | {"the": "THE"}, P.SYNONYMS | {"and": "plus", "de": "of"}
#: Names that questions and texts of the test corpus may share, and words on its subject.
ALIASES = {"licence": ("license", "licensed"), "german": ("nicht", "und ")}
ANCHORS, ROLES = ("license", "the "), ("version", "apache")


def contains_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


def joined(*names: str):
    return [F.array_join(n, "|").alias(n) for n in names]


def expansions_sql() -> str:
    whole = reduce(lambda c, kv: rf"regexp_replace({c}, '\b{kv[0]}\b', '{kv[1]}', 'gi')", ABBREVIATIONS.items(), "text")
    swaps = ", ".join(f"CASE WHEN contains(lower(text), '{a}') THEN replace(text, '{a}', '{b}') END" for a, b in SYNONYMS.items())
    return f"SELECT query_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS n, unnest(l) AS text FROM (SELECT query_id, list_filter([text, CASE WHEN {whole} <> text THEN {whole} END, {swaps}], lambda x: x IS NOT NULL) AS l FROM {TURNS})"


def strategies_sql() -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in P.STRATEGIES.items())
    return f"SELECT p.query_id, intent, confidence, CASE intent {cases} ELSE '{','.join(P.OTHERWISE)}' END AS strategies, array_to_string(regexp_extract_all(text, '\\b(20\\d{{2}})\\b', 1), ',') AS years, nullif(regexp_extract(lower(text), '\\bbefore\\s+(\\d{{4}})', 1), '') AS before, nullif(regexp_extract(lower(text), '\\bafter\\s+(\\d{{4}})', 1), '') AS after FROM ({intent_sql(TURNS)}) p JOIN {TURNS} ON p.query_id = t.query_id"


def gate_plan_sql(source: str, alias: str) -> str:
    kinds = " ".join(f"WHEN {contains_sql('low', ws)} THEN '{k}'" for k, ws in P.WANTS.items())
    names = ", ".join(f"CASE WHEN {contains_sql('low', ws)} THEN '{k}' END" for k, ws in ALIASES.items())
    years = ", ".join(f"CASE WHEN contains(low, '{y}') THEN '{y}' END" for y in P.YEARS)
    return f"SELECT query_id, wants, names, years, wants = 'who' AND contains(low, 'sponsor') AS sponsors FROM (SELECT query_id, low, CASE {kinds} ELSE 'general' END AS wants, list_filter([{names}], lambda x: x IS NOT NULL) AS names, list_filter([{years}], lambda x: x IS NOT NULL) AS years FROM (SELECT query_id, lower({alias}.text) AS low FROM {source}))"


GATED = f"""WITH {BM25}, g AS ({gate_plan_sql(Q, 'q')}), c AS (SELECT b.query_id, b.doc_id, score, lower(text) AS low, names, sponsors FROM b JOIN documents USING (doc_id) JOIN g USING (query_id) WHERE rank <= 200),
m AS (SELECT *, NOT (sponsors AND {contains_sql('low', P.FEES)} AND NOT {contains_sql('low', P.COMPANY)}) AND CASE WHEN len(names) > 0 THEN {' OR '.join(f"(list_contains(names, '{k}') AND {contains_sql('low', ws)})" for k, ws in ALIASES.items())} ELSE {contains_sql('low', ANCHORS)} END AS ok FROM c),
w AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS has, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM m)
SELECT query_id, doc_id, score FROM w WHERE ok OR (NOT has AND place <= 5)"""
RELEVANT = f"""WITH {BM25}, a AS (SELECT query_id, {contains_sql('lower(text)', ROLES)} AS role FROM {Q}), c AS (SELECT b.query_id, b.doc_id, score, {contains_sql('lower(text)', ANCHORS)} AS anchor, {contains_sql('lower(text)', ROLES)} AS has_role, role FROM b JOIN documents USING (doc_id) JOIN a USING (query_id) WHERE rank <= 200),
m AS (SELECT *, CASE WHEN role THEN has_role AND (anchor OR score > 0.02) ELSE anchor END AS ok FROM c),
w AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS has, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM m)
SELECT query_id, doc_id, score FROM w WHERE ok OR (NOT has AND place <= greatest(10, n // 3))"""


def candidates(spark, d, k=200):
    return bm25_lists(spark, d, k).join(docs(spark, d).select("doc_id", "text", "lang"), "doc_id")


def boosted(spark, d):
    """Boosts after the cut at depth 50, and the new order."""
    low = F.lower("text")
    rules = [*((F.contains(low, F.lit(w)), 0.02) for w in ("2023", "2024")), (R.contains_any(F.col("text"), ["license", "version"]), 0.015), (F.contains(low, F.lit("lorem")), -0.03)]
    return R.reranked(candidates(spark, d, 50), rules).select("query_id", "doc_id", "score", "rank")


BOOSTED = f"""WITH {BM25}, z AS (SELECT query_id, doc_id, score AS before, round(score + CASE WHEN contains(low, '2023') THEN 0.02 ELSE 0 END + CASE WHEN contains(low, '2024') THEN 0.02 ELSE 0 END + CASE WHEN contains(low, 'license') OR contains(low, 'version') THEN 0.015 ELSE 0 END + CASE WHEN contains(low, 'lorem') THEN -0.03 ELSE 0 END, 6) AS score FROM (SELECT b.*, lower(text) AS low FROM b JOIN documents USING (doc_id) WHERE rank <= 50))
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before DESC, doc_id) AS INTEGER) AS rank FROM z"""

# ---------------------------------------------------------------- catalog

#: Kinds of the files, by their id; the SQL says for each of them what is to come out, so it does not lean on the library's lists.
TOLD = {
    "application/pdf": (True, "application/pdf", ".pdf"),
    "text/plain": (True, "text/plain", ".txt"),
    "text/markdown": (True, "text/markdown", ".md"),
    "text/csv": (True, "text/csv", ".csv"),
    "text/tab-separated-values": (True, "text/tab-separated-values", ".tsv"),
    "application/rtf": (True, "application/rtf", ".rtf"),
    "application/json": (True, "application/json", ".json"),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": (True, "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": (True, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xlsx"),
    "application/vnd.ms-excel": (True, "application/vnd.ms-excel", ".xls"),
    "application/msword": (True, "application/msword", ".doc"),
    "application/vnd.oasis.opendocument.text": (True, "application/vnd.oasis.opendocument.text", ".odt"),
    "application/vnd.oasis.opendocument.spreadsheet": (True, "application/vnd.oasis.opendocument.spreadsheet", ".ods"),
    "application/vnd.google-apps.document": (True, "text/plain", ".bin"),
    "application/vnd.google-apps.drawing": (True, "image/png", ".bin"),
    "image/png": (False, "image/png", ".png"),
    "video/mp4": (False, "video/mp4", ".bin"),
    "application/zip": (False, "application/zip", ".bin"),
}
KIND = f"CASE o_orderkey % {len(TOLD)} " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(TOLD)) + " END"
FILES = f"(SELECT o_orderkey AS id, o_orderdate AS modified, o_custkey AS size, {KIND} AS mime_type, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS trashed FROM orders) f"
DOCUMENT_KINDS = ", ".join(f"'{k}'" for k in G.DOCUMENT_KINDS)
OUT = "(" + " OR ".join(f"starts_with(mime_type, '{p}')" for p in G.EXCLUDED) + ")"
SUPPORTED = "mime_type IN (" + ", ".join(f"'{k}'" for k, (ok, _, _) in TOLD.items() if ok) + ")"
told = lambda k: "CASE mime_type " + " ".join(f"WHEN '{kind}' THEN '{v[k]}'" for kind, v in TOLD.items()) + " END"
MESSAGES = "CASE event_type WHEN 'view' THEN 'Connection reset by peer' WHEN 'click' THEN 'HTTP 404: timeout' WHEN 'signup' THEN 'Access DENIED' WHEN 'purchase' THEN '503 Service Unavailable' ELSE 'strange' END"


def files(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS id", "o_orderdate AS modified", "o_custkey AS size", f"{KIND} AS mime_type", "CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS trashed")


def states(spark, d):
    """Documents as states of indexing: what they lack goes by doc_id."""
    flags = [(F.col("doc_id") % k != k - 1).alias(n) for k, n in zip((2, 3, 5, 7, 11, 13, 17, 19), G.CONTRACT, strict=True)]
    return G.can_index(docs(spark, d).select("doc_id", F.when(F.col("lang") == "en", "indexed").otherwise("chunked").alias("state"), F.sequence(F.lit(1), (F.col("doc_id") % 4).cast("int") + 1).alias("chunk_ids"), *flags)).select("doc_id", "can_index")


def records(spark, d):
    """Lines of documents as pages of one block each; short lines are headings, and every page of a text with a digit has a table."""
    block = lambda line: F.struct(F.when(F.char_length(line) < 60, "heading").otherwise("paragraph").alias("kind"), line.alias("text"))
    page = lambda line: F.struct(F.array(block(line)).alias("blocks"), F.when(line.rlike("[0-9]"), F.array(F.struct(F.sequence(F.lit(1), F.lit(3)).alias("rows")))).otherwise(F.array().cast("array<struct<rows:array<int>>>")).alias("tables"))
    return G.record_counts(docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.transform(F.split("text", "\n"), page).alias("pages"), F.array("lang").alias("warnings")))


# ---------------------------------------------------------------- extraction


def marked_lines(spark, d):
    """Documents whose commas part columns."""
    return docs(spark, d).select("doc_id", F.regexp_replace("text", r", | the | und | de ", " | ").alias("text"))


CELLS = "list_transform(string_split(array_to_string(list_transform(string_split({line}, '\"'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, ',', chr(1)) ELSE x END), ''), chr(1)), lambda c: trim(c, ' '))"
CSV = "(SELECT c_custkey AS doc_id, 'key,name,\"note, long\"' || chr(10) || c_custkey || ',' || c_name || ',\"' || c_mktsegment || ', ' || c_nationkey || '\"' || chr(10) || 'short' || chr(10) || '1,2,3,4' AS text FROM customer)"


def csv_files(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "concat('key,name,\"note, long\"\\n', c_custkey, ',', c_name, ',\"', c_mktsegment, ', ', c_nationkey, '\"\\nshort\\n1,2,3,4') AS text")


def audited(spark, d):
    """The nine checks; what the corpus lacks goes by doc_id."""
    measured = D.quality(docs(spark, d), "\n", keep=("text",))
    more = {"pages": F.col("doc_id") % 5, "expected": F.when(F.col("doc_id") % 3 == 0, F.lit(4)), "headings": F.col("doc_id") % 2, "empty_pages": (F.col("doc_id") % 7 == 0).cast("int"), "ocr": F.col("doc_id") % 4 == 0, "warnings": F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))}
    return measured.withColumns(more)


AUDIT = f"""WITH {QUALITY}, r AS (SELECT t.doc_id, t.tier, t.length, t.blocks, t.doc_id % 5 AS pages, CASE WHEN t.doc_id % 3 = 0 THEN 4 END AS expected, t.doc_id % 2 AS headings, t.doc_id % 7 = 0 AS empty, t.doc_id % 4 = 0 AS ocr, t.doc_id % 6 = 0 AS warned FROM t),
x AS (SELECT doc_id, unnest([{{'n': 0, 'check': 'extraction_success', 'severity': CASE tier WHEN 'failed' THEN 'fail' WHEN 'low' THEN 'warn' ELSE 'pass' END}}, {{'n': 1, 'check': 'text_yield', 'severity': CASE WHEN length = 0 THEN 'fail' WHEN length < 100 THEN 'warn' ELSE 'pass' END}},
{{'n': 2, 'check': 'page_count', 'severity': CASE WHEN pages = 0 THEN 'fail' WHEN abs(pages - expected) > 0.1 * expected THEN 'warn' ELSE 'pass' END}}, {{'n': 3, 'check': 'block_structure', 'severity': CASE WHEN blocks = 0 THEN 'warn' ELSE 'pass' END}},
{{'n': 4, 'check': 'heading_preservation', 'severity': CASE WHEN length > 2000 AND headings = 0 THEN 'warn' ELSE 'pass' END}}, {{'n': 5, 'check': 'table_preservation', 'severity': 'pass'}}, {{'n': 6, 'check': 'empty_pages', 'severity': CASE WHEN empty THEN 'warn' ELSE 'pass' END}},
{{'n': 7, 'check': 'parser_warnings', 'severity': CASE WHEN warned THEN 'warn' ELSE 'pass' END}}, {{'n': 8, 'check': 'ocr_used', 'severity': CASE WHEN ocr THEN CASE WHEN tier = 'high' THEN 'info' ELSE 'warn' END ELSE 'pass' END}}]) AS c FROM r)"""


def dated(spark, d):
    raw = F.concat(F.lit("Signed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", seen 2024-13-45 and "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("; due "), F.date_format(F.date_add("o_orderdate", 9), "MMMM d, yyyy"), F.lit(". Event period from "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" to "), F.date_format(F.date_add("o_orderdate", 3), "yyyy-MM-dd"), F.lit("."))
    each = table(spark, d, "orders").select("o_orderkey", raw.alias("text"))
    return each.select("o_orderkey", F.array_join(F.transform(X.dates(F.col("text")), lambda x: x.cast("string")), ",").alias("dates"), X.period(F.col("text"), ["no such word", "event"]).alias("p")).select("o_orderkey", "dates", F.col("p.start").alias("start"), F.col("p.end").alias("end"))


def contexts(spark, d):
    n = table(spark, d, "nation")
    path = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("World"), "n_name"))
    first = F.when(F.col("n_nationkey") % 4 > 0, F.col("n_nationkey"))
    prefix = X.context(path, first, first + F.col("n_nationkey") % 2, F.when(F.col("n_nationkey") % 3 == 0, "S1"), F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")))
    rows = F.array(F.array("n_name", F.col("n_nationkey").cast("string")), F.array(F.lit("x"), F.lit("")))
    return n.select("n_nationkey", prefix.alias("prefix"), X.table_text(F.when(F.col("n_regionkey") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("name"), F.lit("key"))), rows).alias("body"))


CONTEXTS = """SELECT n_nationkey, concat_ws(chr(10), 'Document: ' || CASE WHEN n_nationkey % 5 > 0 THEN n_name END, CASE WHEN n_regionkey <> 0 THEN 'Section: World > ' || n_name END,
CASE WHEN n_nationkey % 4 > 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'Page ' || n_nationkey ELSE 'Pages ' || n_nationkey || '-' || (n_nationkey + 1) END END, CASE WHEN n_nationkey % 3 = 0 THEN 'Sheet: S1' END) AS prefix,
CASE WHEN n_regionkey = 1 THEN '' ELSE 'name | key' || chr(10) || repeat('-', 40) || chr(10) END || n_name || ' | ' || n_nationkey || chr(10) || 'x | ' AS body FROM nation"""


def synthesised(spark, d):
    items = candidates(spark, d, 30).select("query_id", "doc_id", "text", (F.col("doc_id") % 2 == 0).alias("known"), (F.col("lang") == "en").alias("ranked"))
    return X.synthesis(asked(spark), items, ("license", "und"), snippet=40)


SYNTHESIS = f"""WITH {BM25}, i AS (SELECT b.query_id, b.doc_id, d.text, lower(d.text) AS low, d.lang, lower(q0.text) AS q FROM b JOIN documents d USING (doc_id) JOIN (SELECT query_id, text FROM {Q}) q0 USING (query_id) WHERE rank <= 30),
v AS (SELECT *, 3 * len(list_filter(string_split(q, ' '), lambda w: length(w) > 2 AND contains(low, w))) + 2 * (CASE WHEN contains(q, 'license') AND contains(low, 'license') THEN 1 ELSE 0 END + CASE WHEN contains(q, 'und') AND contains(low, 'und') THEN 1 ELSE 0 END) + CASE WHEN lang = 'en' THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS relevance FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, length(text) DESC, doc_id) AS place FROM v)
SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, CAST(relevance AS DOUBLE) AS relevance, trim(replace(substring(text, 1, 40), chr(10), ' '), ' ') AS snippet FROM p WHERE place <= 4 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) > 30"""

# ---------------------------------------------------------------- stored indexes and caches


def indexed(spark, d, vectors: bool = False):
    """An index that documents were added to twice, replaced in and deleted from."""
    index = K.Index(spark, new_path(spark, "index"))
    if vectors:
        rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        index._write(index.next(), None, rows.filter("doc_id % 2 = 0"), True)
        index._write(index.next(), None, rows.filter("doc_id % 2 = 1"), True)
        index.delete(rows.filter("doc_id % 5 = 1"))
        return index
    rows = docs(spark, d).select("doc_id", "text")
    index.add(rows.filter("doc_id % 3 <> 1"))
    index.add(rows.filter("doc_id % 3 = 1"))
    index.delete(rows.filter("doc_id % 7 = 3"))
    index.add(rows.filter("doc_id % 14 = 3").withColumn("text", F.lit("licensed under another license")))
    return index


STORED = f"(SELECT doc_id, CASE WHEN doc_id % 14 = 3 THEN 'licensed under another license' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 14 = 3)"
STORED_BM25 = f"WITH {BM25.replace('FROM documents', f'FROM {STORED}')} SELECT * FROM b WHERE rank <= 10"


def compacted(spark, d):
    index = indexed(spark, d)
    index.compact()
    return index.bm25(asked(spark), 10).select("query_id", "doc_id", "score", "rank")


def cached_results(spark, d):
    """Results stored, read back for their key, and invalidated for another version."""
    lists = bm25_lists(spark, d, 10)
    key = K.retrieval_key(F.col("text"), 3, 1, 10, R.RRF_K, {"lang": "en"})
    entries = K.serialised(lists).join(asked(spark), "query_id").select(key.alias("key"), (F.col("query_id") % 2 + 3).alias("corpus_version"), F.lit(1).alias("index_version"), F.when(F.col("query_id") == 3, "broken").otherwise(F.col("value")).alias("value"))
    live = K.invalidate(K.store(entries.filter("value = 'broken'"), entries), corpus_version=4)
    return K.deserialised(asked(spark).withColumn("key", key).join(live, "key").select("query_id", "value"))


def reused(spark, d):
    """Texts whose embeddings a cache of the first half of them has."""
    rows = docs(spark, d).select("doc_id", "text").filter("text IS NOT NULL")
    cache = rows.filter("doc_id % 2 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), F.lit("m").alias("model"), F.when(F.col("doc_id") % 4 == 0, "1").otherwise("2").alias("version"), F.array(F.lit(1.0)).alias("embedding"))
    known, missing = K.embedded(rows, cache, "m", "1")
    return known.agg(F.count("*").alias("known"), F.countDistinct("text_hash").alias("texts")).crossJoin(missing.agg(F.count("*").alias("missing")))


REUSED = "WITH d AS (SELECT text, doc_id FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT text FROM d WHERE doc_id % 4 = 0) SELECT (SELECT count(*) FROM d WHERE text IN (SELECT text FROM k)) AS known, (SELECT count(*) FROM k) AS texts, (SELECT count(DISTINCT text) FROM d WHERE text NOT IN (SELECT text FROM k)) AS missing"


def described(spark, d):
    """A registry of two tables: one found by a column's name, and its columns."""
    rows = None
    for name in ("orders", "nation"):
        one = S.registered(spark, name, table(spark, d, name), f"{d}/{name}.parquet", None)
        rows = one if rows is None else S.upsert(rows, one)
    return S.describe(S.find_tables(rows, "totalprice"), "orders").filter("numeric").select("name")


def over_one_table(spark, d):
    """A query over one table, and what is wrong with two others, as rows."""
    t = table(spark, d, "nation")
    rows, _ = S.query_table(spark, t, "only_table", "SELECT n_regionkey, count(*) AS n FROM only_table GROUP BY n_regionkey")
    wrong = [S.query_table(spark, t, "only_table", q)[1] is not None for q in ("SELECT no_such FROM only_table", "SELEC 1")]
    return rows.withColumn("errors", F.lit(sum(wrong)))


CATALOGUE: dict[str, tuple] = {
    # ------------------------------------------------------------ questions
    "query_analysis": (lambda s, d: P.analyse(turns(s, d)).select("query_id", *joined("terms", "entities", "dates", "amounts")), f"SELECT query_id, array_to_string(list_filter(regexp_extract_all(lower(trim(text, ' ')), '{WORD}'), lambda w: length(w) > 1), '|') AS terms, array_to_string(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ɏͰ-῿]', '_', 'g'), '{P.NAMES}'), '|') AS entities, array_to_string(list_concat(regexp_extract_all(text, '{P.DATES[0]}'), regexp_extract_all(text, '{P.DATES[1]}')), '|') AS dates, array_to_string(regexp_extract_all(text, '{P.AMOUNT}'), '|') AS amounts FROM {TURNS}"),
    "query_normalised": (lambda s, d: turns(s, d).select("query_id", P.protected_lower(F.col("text")).alias("text")), f"SELECT query_id, array_to_string(list_transform(l, lambda x, i: lower(regexp_replace(x, '\\s+', ' ', 'g')) || coalesce(k[i], '')), '') AS text FROM (SELECT query_id, regexp_split_to_array(trim(text, ' '), '{PROTECTED}') AS l, regexp_extract_all(trim(text, ' '), '{PROTECTED}') AS k FROM {TURNS})"),
    "query_expansions": (lambda s, d: P.expansions(turns(s, d), ABBREVIATIONS, SYNONYMS), expansions_sql()),
    "query_plans": (lambda s, d: P.plans(turns(s, d)).select("query_id", "intent", "confidence", F.array_join("strategies", ",").alias("strategies"), F.array_join("years", ",").alias("years"), "before", "after"), strategies_sql()),
    "gate_plans": (lambda s, d: P.gate_plans(turns(s, d), ALIASES).select("query_id", "wants", *joined("names", "years"), "sponsors"), f"SELECT query_id, wants, array_to_string(names, '|') AS names, array_to_string(years, '|') AS years, sponsors FROM ({gate_plan_sql(TURNS, 't')})"),
    "planned_gate": (lambda s, d: P.gated(candidates(s, d), P.gate_plans(asked(s), ALIASES), ANCHORS, ALIASES).select("query_id", "doc_id", "score"), GATED),
    "relevance_filter": (lambda s, d: P.relevant(candidates(s, d), asked(s), ANCHORS, ROLES).select("query_id", "doc_id", "score"), RELEVANT),
    "boosted_order": (boosted, BOOSTED),
    "page_filter": (lambda s, d: R.page_filter(bm25_lists(s, d, 200).withColumns({"page_start": F.col("doc_id") % 30, "page_end": F.col("doc_id") % 30 + F.col("doc_id") % 4}), 10, 14).select("query_id", "doc_id"), f"WITH {BM25} SELECT query_id, doc_id FROM b WHERE rank <= 200 AND (doc_id % 30 BETWEEN 10 AND 14 OR doc_id % 30 + doc_id % 4 BETWEEN 10 AND 14)"),
    "provenance_filter": (lambda s, d: R.with_provenance(docs(s, d).select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 == 0, "x").alias("locator"), F.lit(None).cast("string").alias("chunk_id"))).agg(F.count("*").alias("n")), "SELECT count(*) FILTER (WHERE (doc_id % 2 = 0 AND length(text) > 5) OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS n FROM documents"),
    "merged_best": (lambda s, d: R.merge_best([bm25_lists(s, d, 50), bm25_lists(s, d, 80).withColumn("score", F.col("score") - F.lit(0.5) + F.col("doc_id") % 2)]).withColumn("score", F.round("score", 6)), f"WITH {BM25} SELECT query_id, doc_id, round(max(score), 6) AS score FROM (SELECT query_id, doc_id, score FROM b WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, score - 0.5 + doc_id % 2 FROM b WHERE rank <= 80) GROUP BY ALL"),
    # ------------------------------------------------------------ catalog
    "catalog_lookup": (lambda s, d: G.lookup(files(s, d), 7), f"SELECT * FROM {FILES} WHERE id = 7"),
    "catalog_discover": (lambda s, d: G.discover(files(s, d)), f"SELECT * FROM {FILES} WHERE trashed = 0 AND mime_type IN ({DOCUMENT_KINDS})"),
    "catalog_support": (lambda s, d: files(s, d).select("id", G.supported(F.col("mime_type")).alias("supported"), G.exported(F.col("mime_type")).alias("fetched_as"), G.extension(F.col("mime_type")).alias("extension")), f"SELECT id, {SUPPORTED} AS supported, {told(1)} AS fetched_as, {told(2)} AS extension FROM {FILES}"),
    "catalog_progress": (lambda s, d: G.stats(files(s, d), files(s, d).filter("id % 3 = 0")), f"SELECT mime_type, count(*) AS files, count(*) FILTER (WHERE id % 3 = 0) AS done FROM {FILES} GROUP BY 1"),
    "pending_batches": (lambda s, d: G.pending(files(s, d), files(s, d).filter("id % 3 = 0"), files(s, d).filter("id % 8 = 1")).select("id", "batch"), f"SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 10 AS BIGINT) AS batch FROM {FILES} WHERE id % 3 <> 0 AND id % 8 <> 1"),
    "reconciliation": (lambda s, d: G.reconcile(files(s, d).unionByName(files(s, d).filter("id % 2 = 0"))), f"SELECT count(*) AS ids, CAST(count(*) FILTER (WHERE {SUPPORTED}) AS BIGINT) AS eligible, CAST(count(*) FILTER (WHERE NOT {SUPPORTED} AND {OUT}) AS BIGINT) AS excluded, CAST(count(*) FILTER (WHERE NOT {SUPPORTED} AND NOT {OUT}) AS BIGINT) AS other FROM {FILES}"),
    "index_contract": (states, "SELECT doc_id, coalesce(lang = 'en', false) AND " + " AND ".join(f"doc_id % {k} <> {k - 1}" for k in (2, 3, 5, 7, 11, 13, 17, 19)) + " AS can_index FROM documents"),
    "error_classes": (lambda s, d: table(s, d, "events").select("event_id", G.error_class(F.expr(MESSAGES)).alias("class")), "SELECT event_id, CASE event_type WHEN 'view' THEN 'transient' WHEN 'click' THEN 'permanent' WHEN 'signup' THEN 'permanent' WHEN 'purchase' THEN 'transient' ELSE 'unknown' END AS class FROM events"),
    "top_warnings": (lambda s, d: G.top_warnings(docs(s, d).select(F.array_distinct(F.array(F.col("lang"), F.substring("text", 1, 1))).alias("warnings")).filter("lang IS NOT NULL AND text <> ''")), "SELECT warning, count(*) AS n FROM (SELECT unnest(list_distinct([lang, substring(text, 1, 1)])) AS warning FROM documents WHERE lang IS NOT NULL AND text <> '') GROUP BY 1 ORDER BY n DESC, warning LIMIT 8"),
    "size_by_tier": (lambda s, d: G.size_by_tier(D.quality(docs(s, d))), f"WITH {QUALITY} SELECT tier, count(*) AS n, min(chars) AS least, median(chars) AS middle, max(chars) AS most FROM t GROUP BY tier"),
    "record_counts": (records, "SELECT doc_id, CAST(len(l) AS INTEGER) AS pages, CAST(len(l) AS INTEGER) AS blocks, CAST(len(list_filter(l, lambda x: length(x) < 60)) AS INTEGER) AS headings, CAST(len(list_filter(l, lambda x: regexp_matches(x, '[0-9]'))) AS INTEGER) AS tables, CAST(3 * len(list_filter(l, lambda x: regexp_matches(x, '[0-9]'))) AS INTEGER) AS table_rows, 1 AS warnings FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"),
    # ------------------------------------------------------------ extraction
    "csv_blocks": (lambda s, d: X.csv_blocks(csv_files(s, d)).select("doc_id", "n", "kind", "block"), f"SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN n = 0 THEN 'heading' ELSE 'paragraph' END AS kind, array_to_string(list_transform(range(w), lambda i: coalesce(c[i + 1], '')), ' | ') AS block FROM (SELECT doc_id, n, {CELLS.format(line='line')} AS c, len({CELLS.format(line='first')}) AS w FROM (SELECT doc_id, string_split(text, chr(10))[1] AS first, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM {CSV}))"),
    "table_detection": (lambda s, d: X.table_lines(marked_lines(s, d), 2, 3).select("doc_id", "first", "rows", "columns", "text"), r"WITH m AS (SELECT doc_id, regexp_replace(text, ', | the | und | de ', ' | ', 'g') AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM m), c AS (SELECT *, len(list_filter(regexp_split_to_array(trim(line, ' '), '\s{2,}|\t|\|'), lambda x: trim(x, ' ') <> '')) AS columns FROM l), r AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM c WHERE columns >= 3) SELECT doc_id, CAST(min(n) AS INTEGER) AS first, count(*) AS rows, CAST(max(columns) AS INTEGER) AS columns, string_agg(line, chr(10) ORDER BY n) AS text FROM r GROUP BY doc_id, run HAVING count(*) >= 2"),
    "context_prefix": (contexts, CONTEXTS),
    "audit_checks": (lambda s, d: X.audit(audited(s, d)).select("doc_id", "n", "check", "severity"), AUDIT + " SELECT doc_id, c.n AS n, c.check AS check, c.severity AS severity FROM x"),
    "audit_overall": (lambda s, d: X.overall(X.audit(audited(s, d))), AUDIT + " SELECT doc_id, CASE WHEN bool_or(c.severity = 'fail') THEN 'fail' WHEN bool_or(c.severity = 'warn') THEN 'warn' ELSE 'pass' END AS status FROM x GROUP BY doc_id"),
    "text_dates": (dated, "SELECT o_orderkey, CAST(o_orderdate AS DATE) || ',' || (CAST(o_orderdate AS DATE) + 3) || ',' || (CAST(o_orderdate AS DATE) + 9) AS dates, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 3 AS end FROM orders"),
    "clean_text": (lambda s, d: docs(s, d).select("doc_id", X.clean_ocr(F.col("text")).alias("text")), r"SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(65279), ''), '\s+', ' ', 'g'), ' ') AS text FROM documents"),
    "answer_documents": (synthesised, SYNTHESIS),
    "duplicate_members": (lambda s, d: D.cluster_members(docs(s, d)).select("cluster", F.array_join("members", ",").alias("members")), f"SELECT substring(sha256(string_agg(doc_id, ',' ORDER BY doc_id)), 1, 12) AS cluster, string_agg(doc_id, ',' ORDER BY doc_id) AS members FROM documents GROUP BY {FOLD} HAVING count(*) > 1"),
    # ------------------------------------------------------------ stored indexes and caches
    "index_bm25": (lambda s, d: indexed(s, d).bm25(asked(s), 10).select("query_id", "doc_id", "score", "rank"), STORED_BM25),
    "index_compacted": (compacted, STORED_BM25),
    "index_dense": (lambda s, d: indexed(s, d, True).dense(table(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10).select("query_id", "doc_id", "score", "rank"), "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id % 5 <> 1)) WHERE rank <= 10"),
    "cached_results": (cached_results, f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM b WHERE rank <= 10 AND query_id % 2 = 0"),
    "embedding_reuse": (reused, REUSED),
    # ------------------------------------------------------------ tables
    "table_registry": (described, "SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')"),
    "table_sql": (over_one_table, "SELECT n_regionkey, count(*) AS n, 2 AS errors FROM nation GROUP BY n_regionkey"),
    "nl_compare": (lambda s, d: S.answer(table(s, d, "orders"), "compare 1-URGENT and 2-HIGH by o_orderpriority in o_totalprice").select("o_orderpriority", "rows", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean")), "SELECT o_orderpriority, count(*) AS rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1"),
    "nl_filter_units": (lambda s, d: S.answer(table(s, d, "orders"), "orders with o_totalprice at least 2.5 lakh"), "SELECT * FROM orders WHERE o_totalprice >= 250000"),
    "nl_places": (lambda s, d: S.answer(table(s, d, "nation").withColumn("total", F.col("n_nationkey") * 7 % 25), "highest total first").withColumn("place", F.monotonically_increasing_id()).select("n_nationkey", F.row_number().over(Window.orderBy("place")).alias("place")), "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey * 7 % 25 DESC) AS INTEGER) AS place FROM nation"),
    "plain_values": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.size(V.dates_in(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or "), F.date_format("o_orderdate", "yyyy/MM/dd")))).cast("long").alias("n")), "SELECT o_orderkey, 2 AS n FROM orders"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CATALOGUE.items() if text}
