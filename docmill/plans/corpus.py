"""Queries over documents, vectors, pages, conversations, events and tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import answers as A
from docmill.operators import documents as D
from docmill.operators import extraction as X
from docmill.operators import index as I
from docmill.operators import retrieve as R
from docmill.operators import structured as S
from docmill.session import table
from docmill.sources import files
from docmill.streaming import events as E

QUESTIONS = [(1, "the that and"), (2, "licensed license version"), (3, "ciónmente de la"), (4, "Apache License"), (5, "nicht und der")]
WORD = T.WORD.replace("'", "''")
TOK = f"list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda w: length(w) > 1)"
Q = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in QUESTIONS) + ") q(query_id, text)"


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def docs(spark, d):
    return table(spark, d, "documents")


def catalog(spark, d):
    """Orders seen as a catalog of files."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("modified"), F.col("o_custkey").alias("size"), F.col("o_orderpriority").alias("mime_type"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("trashed"))


def log(spark, d):
    """Events seen as a log of states."""
    state = F.create_map(*[F.lit(x) for kv in {"view": "discovered", "click": "downloading", "signup": "downloaded", "purchase": "extracted", "error": "failed"}.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state"))


def bm25_lists(spark, d, k):
    return I.bm25(docs(spark, d), asked(spark), k)


def parsed_numbers(spark, d):
    raw = F.concat(F.lit("Rs. "), F.format_number("l_extendedprice", 2), F.when(F.col("l_linenumber") == 1, " lakh").otherwise(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.number(raw).alias("v")).select("l_orderkey", "l_linenumber", F.round("v.value", 2).alias("value"), "v.unit", "v.currency")


def parsed_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", *[V.date(F.date_format("o_orderdate", f)).alias(n) for n, f in (("iso", "yyyy-MM-dd"), ("us", "MM/dd/yyyy"), ("long_form", "d MMMM yyyy"), ("month_first", "MMMM d, yyyy"))])


def similarity_queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def metrics(spark, d):
    """All documents labelled good count as relevant to each question."""
    good = table(spark, d, "labels").filter("quality = 1").select("doc_id").distinct()
    relevant = good.withColumn("query_id", F.explode(F.array(*[F.lit(k) for k, _ in QUESTIONS]))).select("query_id", "doc_id")
    return R.recall_at(bm25_lists(spark, d, 100), relevant, 100)


def hybrid_meta(spark, d):
    """Metadata of documents; the kinds go by doc_id."""
    kind = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    return docs(spark, d).select("doc_id", kind(3, "structured", "text", "note").alias("doc_type"), kind(2, "theme", "other").alias("category"), kind(5, "csv", "pdf", "doc", "md", "txt").alias("format"), kind(2, "institutional", "draft").alias("authority_status"), "lang")


def hybrid_refined(spark, d):
    fused = R.fuse([bm25_lists(spark, d, 300)])
    return R.refined(fused, docs(spark, d), asked(spark), 30, hybrid_meta(spark, d), {"lang": "en"}, ("license", "und"), ("the ",), {"apache": ("apache",)})


ASKED = [(1, "what is the total amount and the count by year"), (2, "who was president in 2024"), (3, "list all rows of the table"), (4, "compare the festival with the workshop"), (5, "the river"), (6, "open the folder before 2021, then show the file")]
ASKED_SQL = "(VALUES " + ", ".join(f"({k}, '{t}')" for k, t in ASKED) + ") q(query_id, text)"


def found(spark, d, k=20):
    """Evidence: the best documents of each question."""
    return bm25_lists(spark, d, k).join(docs(spark, d).select("doc_id", "text", F.when(F.col("lang") == "de", "draft").otherwise("confirmed").alias("status")), "doc_id").withColumn("authority", D.authority_score(F.col("status")))


def verified(spark, d):
    items = found(spark, d)
    return A.verify(asked(spark).withColumnRenamed("text", "answer"), items, D.evidence(items))


def claim_support(spark, d):
    """Claims of a conversation's first turns by its other turns."""
    turns = table(spark, d, "conversations")
    claims = X.claims(turns.filter("turn = 0").select("conv_id", "text"), ["conv_id"]).withColumnRenamed("conv_id", "query_id")
    items = turns.filter("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), "text", (1.0 / F.col("turn")).alias("score"), F.lit(1.0).alias("authority"))
    sets = items.groupBy("query_id").agg((F.count("*") > 0).alias("sufficient"), F.lit(False).alias("conflict"))
    return A.verify_claims(claims, items, sets)


def turns(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


def cached(spark, d):
    """Lookups of all turns in a cache that holds an answer to each, of two versions, and for every third conversation past its time."""
    said = table(spark, d, "conversations").filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", "conv_id")
    ttl = F.when(F.col("conv_id") % 3 == 0, 60.0).when(F.col("conv_id") % 3 == 1, 3600.0)
    entries = said.select(A.cache_key(F.col("text")).alias("key"), (F.col("conv_id") % 2 + 1).alias("corpus_version"), F.lit(1).alias("index_version"), F.lit("2024-01-01").cast("timestamp").alias("created"), ttl.alias("ttl"), F.concat(F.lit("answer "), F.col("query_id").cast("string")).alias("value"))
    hits, misses = A.cache_lookup(said, entries, 2, 1, F.lit("2024-01-01 00:30:00").cast("timestamp"))
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.select("query_id", F.lit(None).cast("string").alias("value"), F.lit(False).alias("hit")))


def number_mentions(spark, d):
    text = F.concat(F.lit("Paid Rs. "), F.format_number("l_extendedprice", 2), F.lit(" in 2024 for "), F.col("l_quantity").cast("int").cast("string"), F.lit(" lakh"))
    each = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(V.numbers_in(text)).alias("n", "m"))
    return each.select("l_orderkey", "l_linenumber", "n", F.round("m.number.value", 2).alias("value"), F.col("m.number.unit").alias("unit"))


def size_quality(spark, d):
    rank = F.when(F.col("tier") == "high", 3).when(F.col("tier") == "medium", 2).when(F.col("tier") == "low", 1).otherwise(0)
    return D.quality(docs(spark, d)).agg(F.round(F.corr(F.log(F.col("chars") + 1.0), rank.cast("double")), 6).alias("r"), F.round(F.avg((rank >= 2).cast("double")), 6).alias("clean"))


def intent_sql(source: str | None = None) -> str:
    scores = {n: " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END" for p in ps) for n, ps in A.INTENTS.items()}
    scores["structured_data"] += f" + CASE WHEN regexp_matches(lower(text), '{A.SQL_LIKE}') THEN 2 ELSE 0 END"
    scores["compound"] = r"CASE WHEN regexp_matches(lower(text), '\band\b|,') THEN 1 ELSE 0 END"
    best = "greatest(" + ", ".join(f"s_{n}" for n in scores) + ")"
    cases = " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in scores)
    return f"SELECT query_id, CASE WHEN {best} = 0 THEN 'semantic' {cases} END AS intent, CAST(round(least(greatest({best}, 1) / 3.0, 1.0), 6) AS DOUBLE) AS confidence FROM (SELECT query_id, " + ", ".join(f"{v} AS s_{n}" for n, v in scores.items()) + f" FROM {source or ASKED_SQL})"


TURNS = "(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations) t"
LINKS = ", ".join(f"'{w}'" for w in X.LINKS)
#: Claims of the turns of conversations: sentences, their parts, what is no claim left out, equal ones once.
CLAIM_PARTS = rf"""sentences AS (SELECT conv_id, turn, unnest(range(len(a))) AS s, trim(unnest(a), ' ') AS raw FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM conversations)),
cleaned AS (SELECT conv_id, turn, s, trim(regexp_replace(raw, '\[[^\]]+\]', '', 'g'), ' ') AS clean FROM sentences WHERE length(raw) >= 15),
parted AS (SELECT conv_id, turn, s, clean, list_filter(list_transform(string_split(clean, ';'), lambda p: trim(p, ' ')), lambda p: p <> '') AS parts FROM cleaned),
each_part AS (SELECT conv_id, turn, s, unnest(range(len(l))) AS p, unnest(l) AS claim FROM (SELECT *, CASE WHEN len(parts) > 4 THEN [clean] ELSE parts END AS l FROM parted)),
bare AS (SELECT conv_id, turn, s, p, regexp_replace(regexp_replace(claim, '^•\s*', ''), '^\s*[-–—]\s*', '') AS claim FROM each_part),
weighed AS (SELECT *, list_filter(regexp_split_to_array(claim, '\s+'), lambda w: w <> '') AS words FROM bare),
kept AS (SELECT * FROM weighed WHERE NOT (regexp_matches(claim, '^[A-Z][\w\s:]*$') AND length(claim) < 30) AND NOT (len(list_filter(words, lambda w: lower(w) NOT IN ({LINKS}))) < 3 AND len(words) < 6 AND NOT regexp_matches(claim, '\d'))),
firsts AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(claim) ORDER BY s, p) = 1),
claims AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY s, p) - 1 AS INTEGER) AS n, claim FROM firsts)"""
BM25 = f"""t AS (SELECT doc_id, {TOK} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT query_id, unnest({TOK}) AS term FROM {Q}), qn AS (SELECT query_id, term, count(*) AS qn FROM q GROUP BY ALL),
r AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qn), 6) AS score FROM f JOIN df USING (term) JOIN qn USING (term), s GROUP BY query_id, doc_id),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)"""


def form_sql(c: str) -> str:
    """exact_form() of a column."""
    out = f"replace(lower({c}), ',', '')"
    for prefix in ("npr ", "rs ", "rs. ", "$", "usd "):
        out = f"(CASE WHEN starts_with({out}, '{prefix}') THEN substring({out}, {len(prefix) + 1}) ELSE {out} END)"
    return f"trim({out}, ' ')"


#: Words end at letters of all scripts; DuckDB's word edge knows ASCII alone, so other letters and digits stand as underscores there.
WORD_EDGE, BOUNDED = r"\b", r"regexp_replace(text, '[^\x00-\x7F\PL]|[^\x00-\x7F\PN]', '_', 'g')"
ENTITIES = "et AS (SELECT doc_id, list_concat(" + ", ".join(f"regexp_extract_all({BOUNDED if WORD_EDGE in p else 'text'}, '{p}')" for p in T.EXACT) + f", regexp_extract_all(text, '{T.UNIT}', 1)) AS l FROM documents), ei AS (SELECT doc_id, token, {form_sql('token')} AS form FROM (SELECT doc_id, unnest(list_distinct(list_concat(l, list_transform(l, lambda x: lower(x))))) AS token FROM et))"
ASKED_TERMS = f"aq AS (SELECT query_id, {form_sql('raw')} AS term, sum(w) AS w FROM (SELECT query_id, unnest(l) AS raw, 1.0 / greatest(len(l), 1) AS w FROM (SELECT query_id, regexp_extract_all(text, '{WORD}') AS l FROM {Q})) GROUP BY 1, 2)"
EXACT = f"{ENTITIES}, {ASKED_TERMS}, es AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM (SELECT query_id, doc_id, w FROM ei JOIN aq ON token = term UNION ALL SELECT query_id, doc_id, w FROM ei JOIN aq ON form = term) GROUP BY ALL), ex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM es)"
LADDER = f"""WITH {BM25}, n AS (SELECT query_id, count(*) FILTER (WHERE rank <= 20) AS n, max(score) AS best, count(*) FILTER (WHERE rank <= 20 AND score >= 0.3) AS fair, count(*) AS m, count(*) FILTER (WHERE score >= 0.3) AS fairs FROM b GROUP BY query_id)
SELECT query_id, doc_id, CASE WHEN n >= 3 AND (best >= 0.8 OR fair >= 3) THEN 0 ELSE 5 END AS rung, rank, score FROM b JOIN n USING (query_id) WHERE rank <= 20"""
FOLD = "lower(trim(regexp_replace(translate(text, '’‘“”–— ', '''''\"\"-- '), '[\\s ]+', ' ', 'g')))"
STATE = "CASE event_type WHEN 'view' THEN 'discovered' WHEN 'click' THEN 'downloading' WHEN 'signup' THEN 'downloaded' WHEN 'purchase' THEN 'extracted' WHEN 'error' THEN 'failed' END"
CATALOG = "(SELECT o_orderkey AS id, o_orderdate AS modified, o_custkey AS size, o_orderpriority AS mime_type, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS trashed FROM orders)"
PARAGRAPHS = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda b: trim(b, ' ')), lambda b: b <> '')"
QUALITY = f"m AS (SELECT doc_id, coalesce(text, '') AS text, {PARAGRAPHS} AS p FROM documents), c AS (SELECT doc_id, length(text) AS length, CAST(coalesce(list_sum(list_transform(p, lambda b: length(b))), 0) AS INTEGER) AS chars, CAST(len(p) AS INTEGER) AS blocks FROM m), t AS (SELECT *, CASE WHEN chars < 10 OR blocks = 0 THEN 'failed' WHEN chars > 500 AND blocks > 10 THEN CASE WHEN chars > 1000 THEN 'high' ELSE 'medium' END WHEN chars > 100 AND blocks > 3 THEN 'medium' ELSE 'low' END AS tier FROM c)"
NEAR = """o AS (SELECT min(doc_id) AS doc_id, lower(text) AS text FROM documents GROUP BY lower(text)),
g AS (SELECT doc_id, unnest(CASE WHEN length(text) < 4 THEN [text] ELSE list_distinct(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4))) END) AS gram FROM o),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y USING (gram) WHERE x.doc_id < y.doc_id GROUP BY ALL)"""


VERIFY = f"""WITH {BM25}, i AS (SELECT query_id, doc_id, score, lower(documents.text) AS low, lang FROM b JOIN documents USING (doc_id) WHERE rank <= 20),
w AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(string_split(lower(text), ' ')) AS w FROM {Q}) WHERE length(w) > 3),
h AS (SELECT query_id, count(DISTINCT w) AS held FROM w JOIN i USING (query_id) WHERE contains(low, w) GROUP BY query_id), c AS (SELECT query_id, count(*) AS words FROM w GROUP BY query_id),
m AS (SELECT query_id, max(score) AS top, bool_or(score >= 0.005) AS sufficient, bool_or(lang = 'de' AND score >= 0.005) AND bool_or(lang <> 'de' AND score >= 0.005) AS conflict FROM i GROUP BY query_id),
z AS (SELECT query_id, top IS NULL OR NOT coalesce(sufficient, false) AS none, top, coalesce(conflict, false) AS conflict, least(1.5 * coalesce(held, 0) / greatest(coalesce(words, 0), 1), 1.0) AS share FROM {Q} LEFT JOIN h USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN m USING (query_id)),
y AS (SELECT *, CAST(round(CASE WHEN none THEN 0.0 WHEN top > 1 THEN greatest(share, 0.9) ELSE share END, 6) AS DOUBLE) AS completeness FROM z)
SELECT query_id, completeness, NOT none AND NOT conflict AND completeness >= 0.4 AS faithful,
CASE WHEN none THEN 'ABSTAIN' WHEN conflict OR completeness < 0.4 THEN CASE WHEN completeness < 0.2 THEN 'ABSTAIN' ELSE 'LOW' END WHEN completeness >= 0.8 AND top >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM y"""
CLAIMS = f"WITH {CLAIM_PARTS}, k AS (SELECT conv_id, n, claim FROM claims WHERE turn = 0), " + r"""p AS (SELECT conv_id, n, regexp_replace(lower(claim), '[^a-z0-9]', '', 'g') AS c, list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z]{3,}'), lambda w: length(w) > 3)) AS ct FROM k),
i AS (SELECT conv_id, turn, 1.0 / turn AS weight, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: length(w) > 3)) AS tt FROM conversations WHERE turn > 0),
m AS (SELECT conv_id, n, min(turn) AS turn FROM p JOIN i USING (conv_id) WHERE contains(t, c) OR contains(c, t) OR (length(c) > 3 AND contains(t, substring(c, 1, 20))) OR len(list_intersect(ct, tt)) / greatest(len(ct), 1) > 0.4 GROUP BY conv_id, n)
SELECT p.conv_id AS query_id, p.n, CASE WHEN 1.0 / turn >= 0.3 THEN 'VERIFIED' WHEN p.conv_id NOT IN (SELECT conv_id FROM i) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'UNSUPPORTED' END AS status, CASE WHEN 1.0 / turn >= 0.3 THEN turn END AS doc_id, CASE WHEN 1.0 / turn > 0.7 THEN 'HIGH' WHEN 1.0 / turn >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p LEFT JOIN m USING (conv_id, n)"""


def words_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def boost_sql() -> str:
    """query_boost() over columns q, low, doc_type, category, format, authority_status, for the names license and und."""
    asks, says = (lambda w: words_sql("q", w)), (lambda w: words_sql("low", w))
    structured, table_like = "doc_type = 'structured'", "format IN ('csv', 'excel', 'table', 'xlsx')"
    rules = [
        (f"{asks(R.SPONSOR)} AND ({says(R.SPONSOR_TEXT)} OR {structured}) AND {says(R.PRICED)} AND NOT {asks(R.PRICE_ASKED)}", -0.15),
        (f"{asks(R.SPONSOR)} AND ({says(R.SPONSOR_TEXT)} OR {structured}) AND (NOT {says(R.PRICED)} OR {asks(R.PRICE_ASKED)})", 0.12),
        (f"contains(q, 'theme') AND (contains(low, 'theme') OR category = 'theme' OR {structured})", 0.10),
        (f"{asks(R.PEOPLE)} AND ({says(R.PEOPLE_TEXT)} OR authority_status = 'institutional')", 0.11),
        (f"{asks(R.LISTS)} AND ({structured} OR {table_like})", 0.15),
        (f"{asks(R.LISTS)} AND {says(R.LIST_TEXT)}", 0.08),
        *((f"contains(q, '{n}') AND contains(low, '{n}')", 0.25) for n in ("license", "und")),
        *((f"contains(q, '{n}') AND ({structured} OR category = '{n}')", 0.15) for n in ("license", "und")),
        (f"{asks(R.WHO)} AND ({structured} OR {table_like} OR category IN ('sponsor', 'team', 'committee', 'roster', 'contact', 'president'))", 0.20),
        (f"{asks(R.WHO)} AND {says(R.FEE_TEXT)} AND NOT {says(R.COMPANY_TEXT)}", -0.25),
        ("authority_status = 'institutional'", 0.02),
    ]
    return " + ".join(f"CASE WHEN {rule} THEN {delta} ELSE 0 END" for rule, delta in rules)


HYBRID_REFINED = f"""WITH {BM25}, u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS before, lower(documents.text) AS low, lower(o.text) AS q, ['structured', 'text', 'note'][doc_id % 3 + 1] AS doc_type, ['theme', 'other'][doc_id % 2 + 1] AS category, ['csv', 'pdf', 'doc', 'md', 'txt'][doc_id % 5 + 1] AS format, ['institutional', 'draft'][doc_id % 2 + 1] AS authority_status
FROM b JOIN documents USING (doc_id) JOIN (SELECT query_id, text FROM {Q}) o USING (query_id) WHERE rank <= 300 AND lang = 'en'),
v AS (SELECT *, before + {boost_sql()} AS score, CASE WHEN contains(q, 'apache') THEN contains(low, 'apache') ELSE contains(low, 'the ') END AS ok FROM u),
w AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS has, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM v),
z AS (SELECT query_id, doc_id, round(score, 6) AS score, before FROM w WHERE ok OR (NOT has AND place <= 5))
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before DESC, doc_id) AS INTEGER) AS rank FROM z) WHERE rank <= 30"""


def domain_sql(patterns: dict[str, list[str]], prefix: str) -> str:
    return ", ".join("(" + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '(?i){p}'))" for p in ps) + f") AS {prefix}{n}" for n, ps in patterns.items())


def first_sql(names, prefix: str) -> str:
    best = "greatest(" + ", ".join(f"{prefix}{n}" for n in names) + ")"
    return "CASE WHEN " + best + " = 0 THEN 'unknown' " + " ".join(f"WHEN {prefix}{n} = {best} THEN '{n}'" for n in names) + " END"


#: Domains whose words occur in the test corpus, beside the defaults.
CORPUS_DOMAINS = {"licence": ["license", "licensed", "version"], "mail": ["[a-z0-9._]+@[a-z]"], "english": ["the", "that"], "german": ["und", "der"]}

CATALOGUE: dict[str, tuple] = {
    "bm25_topk": (lambda s, d: bm25_lists(s, d, 10).select("query_id", "doc_id", "score", "rank"), f"WITH {BM25} SELECT * FROM b WHERE rank <= 10"),
    "tf_postings": (lambda s, d: I.postings(docs(s, d)), f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL"),
    "term_df": (lambda s, d: I.term_df(I.postings(docs(s, d))), f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY term"),
    "doc_lengths": (lambda s, d: I.lengths(docs(s, d)), f"SELECT doc_id, len({TOK}) AS dl FROM documents"),
    "exact_entity_index": (lambda s, d: I.entity_index(docs(s, d)), f"WITH {ENTITIES} SELECT token, form, doc_id FROM ei"),
    "exact_search": (lambda s, d: I.exact_over(docs(s, d), asked(s), 10).select("query_id", "doc_id", "score", "rank"), f"WITH {EXACT} SELECT * FROM ex WHERE rank <= 10"),
    "dense_topk": (lambda s, d: I.dense(table(s, d, "embeddings"), similarity_queries(s, d), 10).select("query_id", "vec_id", "score", "rank"), "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"),
    "rrf_fusion": (
        lambda s, d: I.top(R.fuse([bm25_lists(s, d, 100), R.phrase_search(docs(s, d), ["the"], 50).select(F.lit(1).alias("query_id"), "doc_id", F.row_number().over(Window.orderBy("n", "doc_id")).alias("rank"))]), 20, "doc_id").select("query_id", "doc_id", "score", "rank"),
        f"WITH {BM25}, l AS (SELECT query_id, doc_id, rank FROM b WHERE rank <= 100 UNION ALL SELECT 1, doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS rank FROM documents WHERE contains(lower(text), 'the')) WHERE rank <= 50), z AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM z) WHERE rank <= 20",
    ),
    "hybrid_topk": (lambda s, d: R.hybrid(docs(s, d), asked(s), 1000, 20), f"WITH {BM25}, {EXACT}, l AS (SELECT query_id, doc_id, rank FROM b WHERE rank <= 1000 UNION ALL SELECT query_id, doc_id, rank FROM ex WHERE rank <= 1000), u AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM l GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM u) WHERE rank <= 20"),
    "hybrid_refined": (hybrid_refined, HYBRID_REFINED),
    "metadata_filter": (lambda s, d: R.metadata_filter(bm25_lists(s, d, 100), table(s, d, "labels").dropDuplicates(["doc_id"]), quality=1).select("query_id", "doc_id", "score"), f"WITH {BM25} SELECT query_id, doc_id, score FROM b JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id) WHERE rank <= 100"),
    "rerank_rules": (lambda s, d: R.rerank(bm25_lists(s, d, 50).join(docs(s, d).select("doc_id", "text", "lang"), "doc_id"), [(F.contains(F.lower("text"), F.lit("license")), 0.12), (F.col("lang") == "en", 0.02)]).select("query_id", "doc_id", "score"), f"WITH {BM25} SELECT query_id, doc_id, round(score + CASE WHEN contains(lower(text), 'license') THEN 0.12 ELSE 0.0 END + CASE WHEN lang = 'en' THEN 0.02 ELSE 0.0 END, 6) AS score FROM b JOIN documents USING (doc_id) WHERE rank <= 50"),
    "evidence_gate": (lambda s, d: R.gate(bm25_lists(s, d, 50).join(docs(s, d).select("doc_id", "text"), "doc_id"), ["license"]).select("query_id", "doc_id"), f"WITH {BM25}, m AS (SELECT b.*, contains(lower(text), 'license') AS ok FROM b JOIN documents USING (doc_id) WHERE rank <= 50), y AS (SELECT *, max(ok) OVER (PARTITION BY query_id) AS any_ok FROM m) SELECT query_id, doc_id FROM y WHERE ok OR (NOT any_ok AND rank <= 5)"),
    "phrase_search": (lambda s, d: R.phrase_search(docs(s, d), ["licensed", "version"], 25), "SELECT doc_id, n, round(1 / (1 + 0.1 * (row_number() OVER (ORDER BY n, doc_id) - 1)), 6) AS score FROM (SELECT doc_id, length(text) AS n FROM documents WHERE contains(lower(text), 'licensed') AND contains(lower(text), 'version') ORDER BY n, doc_id LIMIT 25)"),
    "recall_ladder": (lambda s, d: R.ladder(asked(s), lambda q, k: I.bm25(docs(s, d), q, k)).select("query_id", "doc_id", "rung", "rank", "score"), LADDER),
    "ir_metrics": (metrics, f"WITH {BM25}, v AS (SELECT query_id, doc_id FROM {Q}, (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)), w AS (SELECT query_id, count(*) AS want FROM v GROUP BY ALL), h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM b JOIN v USING (query_id, doc_id) WHERE rank <= 100 GROUP BY ALL) SELECT query_id, round(coalesce(hits, 0) / want, 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS rr, round(coalesce(dcg, 0.0) / (SELECT sum(1 / log2(i + 1.0)) FROM range(1, least(want, 100) + 1) r(i)), 6) AS ndcg FROM w LEFT JOIN h USING (query_id)"),
    # ------------------------------------------------------------ text and values
    "normalize_text": (lambda s, d: docs(s, d).select("doc_id", T.normalize(F.col("text")).alias("text")), f"SELECT doc_id, {FOLD} AS text FROM documents"),
    "mixed_script": (lambda s, d: docs(s, d).select("doc_id", T.mixed_script(F.col("text")).alias("mixed")), "SELECT doc_id, regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]') AS mixed FROM documents"),
    "parse_numbers": (parsed_numbers, "SELECT l_orderkey, l_linenumber, round(round(l_extendedprice, 2) * CASE WHEN l_linenumber = 1 THEN 100000.0 ELSE 1.0 END, 2) AS value, CASE WHEN l_linenumber = 1 THEN 'lakh' END AS unit, 'NPR' AS currency FROM lineitem"),
    "parse_dates": (parsed_dates, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS long_form, CAST(o_orderdate AS DATE) AS month_first FROM orders"),
    "content_ids": (lambda s, d: docs(s, d).select("doc_id", T.short_hash(F.col("text"), "ch_").alias("chunk_id")), "SELECT doc_id, 'ch_' || substring(sha256(text), 1, 16) AS chunk_id FROM documents"),
    # ------------------------------------------------------------ documents
    "classify_domain": (lambda s, d: D.classify(docs(s, d), CORPUS_DOMAINS), f"SELECT doc_id, {first_sql(CORPUS_DOMAINS, 'd_')} AS domain, {first_sql(D.AUTHORITY, 'a_')} AS authority, CAST(CASE WHEN total > 0 THEN least(1.0, round(0.4 + 0.1 * total, 6)) ELSE 0.2 END AS DOUBLE) AS confidence FROM (SELECT *, {' + '.join('d_' + n for n in CORPUS_DOMAINS)} AS total FROM (SELECT doc_id, {domain_sql(CORPUS_DOMAINS, 'd_')}, {domain_sql(D.AUTHORITY, 'a_')} FROM documents))"),
    "block_split": (lambda s, d: D.blocks(docs(s, d), "\n"), "SELECT * FROM (SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN (starts_with(block, '#') AND NOT starts_with(block, '```')) OR (length(block) < 80 AND upper(block) = block AND lower(block) <> block) THEN 'heading' ELSE 'paragraph' END AS kind, block FROM (SELECT doc_id, unnest(range(len(a))) AS n, trim(unnest(a), ' ') AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE block <> '')"),
    "extraction_quality": (lambda s, d: D.quality(docs(s, d)), f"WITH {QUALITY} SELECT doc_id, chars, blocks, tier FROM t"),
    "audit_findings": (lambda s, d: D.audit(docs(s, d)), f"WITH {QUALITY}, e AS (SELECT doc_id, CASE tier WHEN 'failed' THEN 'fail' WHEN 'low' THEN 'warn' ELSE 'pass' END AS x, CASE WHEN length = 0 THEN 'fail' WHEN length < 100 THEN 'warn' ELSE 'pass' END AS y, CASE WHEN blocks = 0 THEN 'warn' ELSE 'pass' END AS z FROM t) SELECT doc_id, 'extraction:' || x || ',text_yield:' || y || ',block_structure:' || z AS findings, CASE WHEN 'fail' IN (x, y, z) THEN 'fail' WHEN 'warn' IN (x, y, z) THEN 'warn' ELSE 'pass' END AS status FROM e"),
    "quality_crosstab": (lambda s, d: D.quality(docs(s, d), keep=("lang",)).groupBy("lang").pivot("tier", ["failed", "low", "medium", "high"]).count().na.fill(0), f"WITH {QUALITY} SELECT lang, count(*) FILTER (WHERE tier = 'failed') AS failed, count(*) FILTER (WHERE tier = 'low') AS low, count(*) FILTER (WHERE tier = 'medium') AS medium, count(*) FILTER (WHERE tier = 'high') AS high FROM t JOIN documents USING (doc_id) GROUP BY lang"),
    "chunk_baseline": (lambda s, d: D.chunks(docs(s, d)), None),
    "chunk_structural": (lambda s, d: D.structural_chunks(D.blocks(docs(s, d), "\n").withColumn("level", F.lit(1))), None),
    "exact_duplicates": (lambda s, d: D.exact_clusters(docs(s, d)), f"SELECT sha256({FOLD}) AS cluster, max(doc_id) AS canonical, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "canonical_aliases": (lambda s, d: D.aliases(docs(s, d)), f"SELECT doc_id, canonical FROM (SELECT doc_id, max(doc_id) OVER w AS canonical, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY {FOLD})) WHERE n > 1"),
    "near_duplicate_pairs": (lambda s, d: D.near_pairs(docs(s, d)), f"WITH {NEAR} SELECT a, b, round(i / (x.n + y.n - i), 6) AS similarity FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE round(i / (x.n + y.n - i), 6) >= 0.6"),
    "html_extract": (lambda s, d: files.html_text(table(s, d, "pages")), "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM pages"),
    "claims_split": (lambda s, d: X.claims(table(s, d, "conversations"), ["conv_id", "turn"]), f"WITH {CLAIM_PARTS} SELECT conv_id, turn, n, claim FROM claims"),
    "evidence_sets": (lambda s, d: D.evidence(bm25_lists(s, d, 50).join(docs(s, d).select("doc_id", F.when(F.col("lang") == "de", "draft").otherwise("confirmed").alias("status")), "doc_id")), f"WITH {BM25} SELECT query_id, count(*) AS items, count(*) >= 1 AS sufficient, bool_or(lang = 'de') AND bool_or(lang <> 'de') AS conflict FROM b JOIN documents USING (doc_id) WHERE rank <= 50 AND score >= 0.005 GROUP BY query_id"),
    "benchmark_phrases": (lambda s, d: docs(s, d).select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).join(table(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")), "line").filter(F.char_length("line") > 20).select("doc_id", "item_id").distinct(), "SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) USING (line) WHERE length(line) > 20"),
    # ------------------------------------------------------------ questions, answers, cache
    "query_intents": (lambda s, d: A.intents(turns(s, d)).select("query_id", "intent", "confidence"), intent_sql(TURNS)),
    "answer_verification": (verified, VERIFY),
    "answer_build": (lambda s, d: A.build_answers(verified(s, d), found(s, d)).select("query_id", "kind", "answer"), f"WITH {BM25}, i AS (SELECT query_id, string_agg(trim(substring(text, 1, 120), ' ') || ' [' || rank || ':' || doc_id || ']', chr(10) ORDER BY rank) AS answer FROM b JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id), v AS ({VERIFY}) SELECT query_id, CASE WHEN level = 'ABSTAIN' OR answer IS NULL THEN 'ABSTENTION' ELSE 'FACTUAL' END AS kind, CASE WHEN level <> 'ABSTAIN' THEN answer END AS answer FROM v LEFT JOIN i USING (query_id)"),
    "claim_support": (claim_support, CLAIMS),
    "cache_lookup": (cached, "WITH t AS (SELECT conv_id * 1000 + turn AS query_id, text, conv_id FROM conversations WHERE text IS NOT NULL), k AS (SELECT text, max('answer ' || query_id) FILTER (WHERE conv_id % 2 = 1 AND conv_id % 3 > 0) AS value FROM t GROUP BY text) SELECT query_id, value, value IS NOT NULL AS hit FROM t JOIN k USING (text)"),
    "number_mentions": (number_mentions, "SELECT l_orderkey, l_linenumber, CAST(n AS INTEGER) AS n, CASE WHEN n = 0 THEN round(l_extendedprice, 2) ELSE CAST(l_quantity AS INTEGER) * 100000.0 END AS value, CASE WHEN n = 1 THEN 'lakh' END AS unit FROM lineitem, range(2) r(n)"),
    "extraction_gate": (lambda s, d: A.extraction_gate(docs(s, d)), "SELECT doc_id, NOT tiny AND NOT blank AS passed, concat_ws(',', CASE WHEN tiny THEN 'empty_or_tiny_extraction' END, CASE WHEN blank THEN 'abnormal_whitespace_yield' END) AS issues FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) < 10 AS tiny, len(regexp_extract_all(coalesce(text, ''), '\\s')) / greatest(length(coalesce(text, '')), 1) > 0.9 AS blank FROM documents)"),
    "orphans": (lambda s, d: A.orphans(docs(s, d), table(s, d, "labels"), "doc_id"), "SELECT DISTINCT doc_id, 'first' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'second' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "stratified_sample": (lambda s, d: A.stratified_sample(docs(s, d), "lang", "doc_id", 20).select("doc_id", "lang"), "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS r FROM documents) WHERE r <= 20"),
    "near_duplicate_greedy": (lambda s, d: A.greedy_matches(D.near_pairs(docs(s, d))), None),
    "size_quality_corr": (size_quality, f"WITH {QUALITY}, r AS (SELECT ln(chars + 1.0) AS x, CASE tier WHEN 'high' THEN 3.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0.0 END AS y FROM t) SELECT round(corr(CAST(x AS DOUBLE), CAST(y AS DOUBLE)), 6) AS r, round(avg(CASE WHEN y >= 2 THEN 1.0 ELSE 0.0 END), 6) AS clean FROM r"),
    "state_counts": (lambda s, d: E.latest_state(log(s, d)).groupBy("state").agg(F.count("*").alias("n")), f"SELECT state, count(*) AS n FROM (SELECT arg_max({STATE}, (ts, event_id)) AS state FROM events GROUP BY user_id) GROUP BY state"),
    # ------------------------------------------------------------ structured computation
    **{f"agg_by_group_{f.lower()}": ((lambda f: lambda s, d: S.aggregate(table(s, d, "orders"), "o_orderpriority", "o_custkey", f).withColumn(f.lower(), F.round(F.col(f.lower()).cast("double"), 6)))(f), f"SELECT o_orderpriority, round(CAST({f}(o_custkey) AS DOUBLE), 6) AS {f.lower()} FROM orders GROUP BY 1") for f in S.FUNCTIONS},
    "total_of": (lambda s, d: S.total_of(table(s, d, "orders"), "o_totalprice").select(F.round("total", 2).alias("total")), "SELECT round(sum(o_totalprice), 2) AS total FROM orders"),
    "filter_condition": (lambda s, d: S.filter_rows(table(s, d, "orders"), "o_totalprice > 200000 AND o_orderstatus = 'O'"), "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'"),
    "nl_sort": (lambda s, d: S.answer(table(s, d, "customer"), "sort customers by c_acctbal"), "SELECT * FROM customer"),
    "nl_total": (lambda s, d: S.answer(table(s, d, "orders"), "what is the total amount of o_totalprice").select(F.round("total", 2).alias("total")), "SELECT round(sum(o_totalprice), 2) AS total FROM orders"),
    "nl_group": (lambda s, d: S.answer(table(s, d, "orders"), "o_totalprice by o_orderpriority").withColumn("total", F.round("total", 2)), "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "nl_filter": (lambda s, d: S.answer(table(s, d, "orders"), "orders with o_totalprice above 250,000"), "SELECT * FROM orders WHERE o_totalprice > 250000"),
    # ------------------------------------------------------------ catalog, states, streams
    "catalog_scan": (lambda s, d: files.catalog_scan(catalog(s, d), ["1-URGENT", "2-HIGH"], ("5",)), f"SELECT * FROM {CATALOG} WHERE trashed = 0 AND mime_type IN ('1-URGENT', '2-HIGH')"),
    "catalog_stats": (lambda s, d: catalog(s, d).groupBy("mime_type").agg(F.count("*").alias("n")).orderBy(F.desc("n")), f"SELECT mime_type, count(*) AS n FROM {CATALOG} GROUP BY 1"),
    "changed_documents": (lambda s, d: E.changed(catalog(s, d), "1997-01-01", catalog(s, d).filter(F.col("id") % 2 == 0)), f"SELECT * FROM {CATALOG} WHERE modified > TIMESTAMP '1997-01-01' AND id % 2 <> 0"),
    "state_latest": (lambda s, d: E.latest_state(log(s, d)), f"SELECT user_id AS key, arg_max({STATE}, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY user_id"),
    "state_bad_transitions": (lambda s, d: E.bad_transitions(log(s, d)), f"SELECT * FROM (SELECT user_id AS key, event_id AS seq, lag({STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, {STATE} AS state FROM events) WHERE before IS NOT NULL AND (before || '>' || state) NOT IN ({', '.join(repr(f'{a}>{b}') for a, to in E.TRANSITIONS.items() for b in to)})"),
    "state_dead_letters": (lambda s, d: E.dead_letters(log(s, d), 3), f"SELECT * FROM (SELECT user_id AS key, arg_max({STATE}, (ts, event_id)) AS state, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events GROUP BY user_id) WHERE attempts >= 3"),
    "window_tumbling": (lambda s, d: E.tumbling(E.timed(table(s, d, "events"))).withColumn("start", F.date_format("start", "yyyy-MM-dd")), "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "window_sliding": (lambda s, d: E.sliding(E.timed(table(s, d, "events"))).withColumn("start", F.date_format("start", "yyyy-MM-dd")), "SELECT strftime(CAST(ts AS DATE) - k * INTERVAL 1 DAY, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY 1, 2"),
    "window_session": (lambda s, d: E.sessions(E.timed(table(s, d, "events"))).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    "stream_dedup": (lambda s, d: E.once(table(s, d, "events").select("user_id", "event_type"), ["user_id", "event_type"]), "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_join": (lambda s, d: E.with_purchases(table(s, d, "events").filter("event_type = 'view'"), table(s, d, "events").filter("event_type = 'purchase'"), "6 hours"), "SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR"),
}


def queries() -> dict:
    return {name: query for name, (query, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in CATALOGUE.items() if text}
