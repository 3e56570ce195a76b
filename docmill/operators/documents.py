"""Classification, quality, audit, blocks, chunks, duplicates, claims and evidence of documents."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators.index import small
from docmill.scratch import written

#: Patterns by domain and by authority, in order of precedence: fixed values.
DOMAINS = {
    "sponsorship": ["sponsor", "sponsorship", "sponsors", "contribution", "partnership", "patron", "tier", "gold sponsor", "silver sponsor"],
    "budget_finance": [r"\bbudget\b", r"\bexpense\b", r"\brevenue\b", "financial", r"\bcash\b", "expenditure", r"\bincome\b", "cost"],
    "event": [r"\bevent\b", r"\bfestival\b", "tech fest", r"\bworkshop\b", r"\bbootcamp\b", "hackathon", "seminar", "expo"],
    "meeting": [r"\bmeeting\b", r"\bminutes\b", r"\bagenda\b", "attendees"],
    "member_cv": [r"\bcurriculum vitae\b", r"\bresume\b", r"\bcv\b", "work experience", r"\bcertificate\b", "achievement"],
    "report": [r"\breport\b", "annual report", r"\bsummary\b", "highlights"],
    "proposal": [r"\bproposal\b", r"\binvitation\b", "letter of intent", r"\bquery\b", "call for"],
    "technical": ["technical", r"\bcode\b", "programming", r"\bsoftware\b", "engineering", r"\bapi\b", r"\bserver\b"],
    "design": [r"\bdesign\b", r"\bui\b", r"\bux\b", r"\bgraphic\b", "photoshop", r"\bposter\b", r"\bbanner\b"],
}
AUTHORITY = {
    "draft": [r"\bdraft\b", "working copy", r"v\d+\s*draft"],
    "proposal": [r"\bproposal\b", "proposed", "invitation to", "letter of intent"],
    "final": [r"\bfinal\b", "finalized", "final version", r"\breport\b", r"\bapproved\b"],
    "signed": [r"\bsigned\b", r"\bsignature\b", r"\baccepted\b", r"\bagreed\b", "memorandum of understanding", r"\bmou\b"],
    "confirmed": [r"\bconfirmed\b", "official", r"\bverified\b"],
    "superseded": [r"\bsuperseded\b", r"\bobsolete\b", "replaced by", r"\barchive\b"],
}


def literal_of(pattern: str) -> str:
    """The longest run of small letters and spaces that every match of a pattern holds, in any case; empty if none can be told."""
    if re.search(r"[|(\[]", pattern):
        return ""
    return max(re.findall(r"[a-z ]+(?![a-z *?{+])", re.sub(r"\\.", "\0", pattern)), key=len, default="")


def counts(text: Column, low: Column, patterns: dict[str, list[str]]) -> dict[str, Column]:
    """low: the text in lower case. A pattern runs over texts that hold its literal, which is looked for first, at far less cost."""

    def count(p: str) -> Column:
        found = F.regexp_count(text, F.lit(f"(?i){p}"))
        return F.when(F.contains(low, F.lit(literal_of(p))), found).otherwise(F.lit(0)) if literal_of(p) else found

    return {name: reduce(lambda a, b: a + b, [count(p) for p in ps]) for name, ps in patterns.items()}


def first_largest(scores: dict[str, Column]) -> Column:
    """Name of the largest positive score, the first one of equals."""
    best = F.greatest(*scores.values())
    return F.coalesce(*[F.when((best > 0) & (s == best), F.lit(name)) for name, s in scores.items()], F.lit("unknown"))


def classify(docs: DataFrame, domains: dict = DOMAINS, authority: dict = AUTHORITY) -> DataFrame:
    """doc_id, domain, authority, confidence."""
    text, low = F.col("_text"), F.col("_low")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_low", F.lower("_text"))
    scored = read.select("doc_id", *[c.alias(f"d_{n}") for n, c in counts(text, low, domains).items()], *[c.alias(f"a_{n}") for n, c in counts(text, low, authority).items()])
    d, a = {n: F.col(f"d_{n}") for n in domains}, {n: F.col(f"a_{n}") for n in authority}
    total = reduce(lambda x, y: x + y, d.values())
    return scored.select("doc_id", first_largest(d).alias("domain"), first_largest(a).alias("authority"), F.when(total > 0, F.least(F.lit(1.0), F.round(0.4 + 0.1 * total, 6))).otherwise(0.2).alias("confidence"))


def blocks(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """doc_id, n, kind, block: non-empty paragraphs; marked or short upper-case ones are headings."""
    each = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("n", "block")).withColumn("block", F.trim("block")).filter("block <> ''")
    head = (F.startswith("block", F.lit("#")) & ~F.startswith("block", F.lit("```"))) | ((F.char_length("block") < 80) & (F.upper("block") == F.col("block")) & (F.lower("block") != F.col("block")))
    return each.select("doc_id", "n", F.when(head, "heading").otherwise("paragraph").alias("kind"), "block")


def tier(chars: Column, n_blocks: Column, tables: Column) -> Column:
    """Extraction quality of a document."""
    return (
        F.when((chars < 10) | (n_blocks == 0), "failed")
        .when((chars > 500) & (n_blocks > 10), F.when((tables > 0) | (chars > 1000), "high").otherwise("medium"))
        .when((chars > 100) & (n_blocks > 3), "medium")
        .otherwise("low")
    )


def quality(docs: DataFrame, separator: str = "\n", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chars, blocks, tier, and the columns to keep."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), separator), lambda b: F.trim(b)), lambda b: b != "")
    chars = F.aggregate(paragraphs, F.lit(0), lambda s, b: s + F.char_length(b))
    return docs.select("doc_id", chars.alias("chars"), F.size(paragraphs).alias("blocks"), *keep).withColumn("tier", tier(F.col("chars"), F.col("blocks"), F.lit(0)))


def audit(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """doc_id, findings (check:status, in order) and the overall status."""
    measured = quality(docs.withColumn("length", F.char_length(F.coalesce("text", F.lit("")))), separator, ("length",))
    finding = lambda name, status: F.concat(F.lit(f"{name}:"), status)
    checks = F.array(
        finding("extraction", F.when(F.col("tier") == "failed", "fail").when(F.col("tier") == "low", "warn").otherwise("pass")),
        finding("text_yield", F.when(F.col("length") == 0, "fail").when(F.col("length") < 100, "warn").otherwise("pass")),
        finding("block_structure", F.when(F.col("blocks") == 0, "warn").otherwise("pass")),
    )
    with_checks = measured.withColumn("c", checks)
    has = lambda s: F.exists("c", lambda x: F.endswith(x, F.lit(s)))
    return with_checks.select("doc_id", F.array_join("c", ",").alias("findings"), F.when(has("fail"), "fail").when(has("warn"), "warn").otherwise("pass").alias("status"))


CHUNK = "doc_id long, n int, chunk_id string, kind string, heading string, text string"

#: Characters of chunks that a worker gathers before it passes them on.
CHUNK_CHARS = 1 << 20


def chunks(docs: DataFrame, separator: str = "\n", most: int = 500) -> DataFrame:
    """Paragraphs gathered into chunks of about `most` characters; each starts with the last one's last paragraph.

    A fold over one document at a time, so rows need no grouping.
    """

    def pieces(text):
        held, size = [], 0
        for para in (p.strip() for p in (text or "").split(separator)):
            if not para:
                continue
            if held and size + len(para) > most:
                yield "\n\n".join(held)
                held = held[-1:]
                size = len(held[0])
            held.append(para)
            size += len(para)
        if held:
            yield "\n\n".join(held)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "n", "text"])

    def run(batches):
        out, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # one text at a time: a batch is not held a second time
                doc_id = batch.column(0)[k].as_py()
                for n, piece in enumerate(pieces(batch.column(1)[k].as_py())):
                    out.append((doc_id, n, piece))
                    size += len(piece)
                    if size > CHUNK_CHARS:
                        yield made(out)
                        out, size = [], 0
        if out:
            yield made(out)

    cut = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, text string")
    return cut.withColumn("chunk_id", T.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("string"), "text"), "ch_"))


def structural_chunks(blocks_: DataFrame, target: int = 600, cap: int = 1200, overlap: int = 100) -> DataFrame:
    """Chunks of ordered blocks (doc_id, n, kind, level, block) with their heading path and overlap."""
    return located_chunks(blocks_, target, cap, overlap).select("doc_id", "n", "kind", "heading", "text")


def located_chunks(blocks_: DataFrame, target: int = 600, cap: int = 1200, overlap: int = 100) -> DataFrame:
    """structural_chunks() with first and last page (of blocks with a column page), chunk_id, and parent: the chunk whose end a chunk begins with.

    Tables of a page come after its blocks in the order n. Ids hold the chunk's number, so equal chunks differ.
    """

    def cut(blocks: list[dict]) -> list[tuple]:
        path, held, out = [], [], []

        def flush():
            if held:
                out.append(("text", " > ".join(path_of[0]), "\n\n".join(t for t, _ in held).strip(), held[0][1], held[-1][1]))
                held.clear()

        path_of = [path]
        for kind, level, block, page in ((b["kind"], b["level"], b["block"], b["page"]) for b in sorted(blocks, key=lambda b: (b["n"] is None, b["n"]))):
            if kind == "heading":
                if level <= 2:
                    flush()
                path = [*path[: int(level) - 1], block.strip()]
                path_of[0] = path
                if len(block.strip()) >= 5:
                    out.append(("heading", " > ".join(path), block.strip(), page, page))
            elif kind == "table":
                flush()
                step = target if len(block) > cap else max(len(block), 1)
                out += [("table", " > ".join(path), block[i : i + step], page, page) for i in range(0, len(block), step)]
            elif block.strip():
                held.append((block, page))
                if sum(len(t) for t, _ in held) + 2 * (len(held) - 1) > cap:
                    flush()
        flush()
        rows, before = [], None
        for n, (kind, heading, text, first, last) in enumerate(out):
            parent = None
            if before and kind == before[0] != "heading" and (tail := before[1][-overlap:].strip()) and tail not in text:
                text, parent = f"{tail}\n\n{text}", n - 1
            rows.append((n, kind, heading, text, first, last, parent))
            before = (kind, text)
        return rows

    schema = "doc_id long, n int, kind string, heading string, text string, page_first int, page_last int, from_n int"

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = [(doc["doc_id"], *row) for doc in batch.slice(at, 64).to_pylist() for row in cut(doc["blocks"])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # a document's blocks as one row: a group of its own for each would cost far more than the work on it
    paged = blocks_ if "page" in blocks_.columns else blocks_.withColumn("page", F.lit(None).cast("int"))
    whole = paged.groupBy("doc_id").agg(F.collect_list(F.struct("n", "kind", "level", "block", F.col("page").cast("int").alias("page"))).alias("blocks"))
    found = whole.mapInArrow(run, schema)
    name = lambda n: T.short_hash(F.concat_ws(":", F.col("doc_id").cast("string"), F.col(n).cast("string")), "ch_")
    return found.withColumns({"chunk_id": name("n"), "parent": F.when(F.col("from_n").isNotNull(), name("from_n"))}).drop("from_n")


def latest(modified: str | None) -> Column:
    """The doc_id that stands for a group: the one modified last, of equal times the largest; without times the largest."""
    return F.max("doc_id") if modified is None else F.max_by("doc_id", F.struct(F.col(modified), "doc_id"))


def exact_clusters(docs: DataFrame, modified: str | None = None) -> DataFrame:
    """cluster, canonical (the latest by a column of times, if one is named) and size of each group of equal normalised texts."""
    times = [modified] if modified else []
    hashed = docs.select("doc_id", *times, F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("cluster"))
    return hashed.groupBy("cluster").agg(latest(modified).alias("canonical"), F.count("*").alias("members")).filter("members > 1")


def cluster_members(docs: DataFrame) -> DataFrame:
    """cluster (twelve digits of the hash of the members' ids), members (sorted doc_ids) of each group of equal normalised texts.

    A list holds ids alone; exact_clusters() counts groups whose lists would be too long for one row.
    """
    hashed = docs.select("doc_id", F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("h"))
    listed = hashed.groupBy("h").agg(F.sort_array(F.collect_list("doc_id")).alias("members")).filter(F.size("members") > 1)
    return listed.select(F.substring(F.sha2(F.array_join("members", ",").cast("binary"), 256), 1, 12).alias("cluster"), "members")


def aliases(docs: DataFrame, modified: str | None = None) -> DataFrame:
    """doc_id -> canonical doc_id for the documents of exact clusters."""
    hashed = docs.select("doc_id", F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("cluster"))
    return hashed.join(exact_clusters(docs, modified), "cluster").select("doc_id", "canonical")


#: Documents, and bytes of their bitmaps, that a block holds at most; bits of a bitmap for each gram, and the least and most of all.
LIST_BLOCK, BLOCK_BYTES, BITS_A_GRAM, LEAST_BITS, MOST_BITS = 1024, 1 << 21, 4, 64, 1 << 20
#: Pairs that a task gathers before it passes them on.
PAIRS_AT_ONCE = 1 << 20
#: A block: its documents by size, the bits of a bitmap, and the bitmaps.
BLOCKS = "doc_ids array<long>, sizes array<long>, bits int, low long, high long, block binary"


def bits_of(n: int) -> int:
    """Bits of the bitmap of a set of n: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_GRAM * n - 1).bit_length()))


def gram_blocks(batches):
    """mapInArrow over rows (doc_id, n, g) by n: blocks of documents with the parities of how many of their grams fall to each bit."""

    def block(held, bits):
        ids, sizes, maps = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict({"doc_ids": [ids], "sizes": [sizes], "bits": [bits], "low": [min(sizes)], "high": [max(sizes)], "block": [b"".join(maps)]}, schema=pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("block", pa.binary())]))

    held, bits = [], 0
    for batch in batches:
        values, starts = batch.column(2).flatten().to_numpy().view(np.uint64), np.cumsum([0, *(len(x) for x in batch.column(2))])
        for k, (doc, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if held and (bits_of(n) != bits or len(held) >= LIST_BLOCK or len(held) * bits >= 8 * BLOCK_BYTES):
                yield block(held, bits)
                held = []
            bits = bits_of(n)
            cells = (values[starts[k] : starts[k + 1]] & np.uint64(bits - 1)).astype(np.int64)
            held.append((doc, n, np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1).tobytes()))
    if held:
        yield block(held, bits)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: a bit's parity is that of the bits that fall to it."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def met_pairs(limit: float):
    """mapInArrow over rows of two blocks each: pairs (a, b) whose sizes and bitmaps allow the limit.

    Sets differ in as many grams as their bitmaps do in bits, at least.
    """
    limit -= 1e-6  # similarities are rounded
    share = 1 - 2 * limit / (1 + limit)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, maps = [], [], []
                for c in (0, 6):
                    ids.append(batch.column(c)[k].values.to_numpy())
                    sizes.append(batch.column(c + 1)[k].values.to_numpy())
                    maps.append(np.frombuffer(batch.column(c + 5)[k].as_buffer(), np.uint64).reshape(len(ids[-1]), -1))
                words = min(x.shape[1] for x in maps)
                one, two = (folded(x, words) for x in maps)
                lo, hi = np.searchsorted(sizes[1], sizes[0] * limit - 1e-6), np.searchsorted(sizes[1], sizes[0] / limit + 1e-6, "right")
                found, size = [], 0
                for r in range(len(one)):
                    apart = np.bitwise_count(one[r] ^ two[lo[r] : hi[r]]).sum(axis=1, dtype=np.int32)
                    near = ids[1][lo[r] : hi[r]][apart <= share * (sizes[0][r] + sizes[1][lo[r] : hi[r]]) + 1e-6]
                    found.append((np.full(len(near), ids[0][r]), near))
                    size += len(near)
                    if size >= PAIRS_AT_ONCE or r == len(one) - 1:
                        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                        a, b = np.minimum(a, b), np.maximum(a, b)
                        yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], ["a", "b"])
                        found, size = [], 0

    return run


def near_pairs(docs: DataFrame, limit: float = 0.6, size: int = 4) -> DataFrame:
    """Pairs a < b whose sets of character grams have a Jaccard similarity of limit or more.

    Most texts share their rarest grams with most others, so lists of grams give nearly all pairs. Instead documents
    are packed by size into blocks of bitmaps, and blocks whose sizes are within the limit meet; only pairs that the
    bitmaps allow are measured on their grams. Exact copies are left to exact_clusters: one of each group takes part.
    """
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    one = docs.groupBy(F.lower("text").alias("text")).agg(F.min("doc_id").cast("long").alias("doc_id"))
    one = written(one.filter("text is not null and doc_id is not null").repartition(tasks), "texts")
    grams = lambda rows, *more: rows.select("doc_id", *more, F.transform(T.char_grams(F.col("text"), size), lambda g: F.xxhash64(g)).alias("g"))
    sets = grams(one.repartition(tasks)).select("doc_id", F.size("g").cast("long").alias("n"), "g")
    blocks = written(sets.repartitionByRange("n", "doc_id").sortWithinPartitions("n").mapInArrow(gram_blocks, BLOCKS).withColumn("at", F.monotonically_increasing_id()), "blocks")
    x, y = (blocks.withColumnsRenamed({c: f"{c}{k}" for c in blocks.columns}) for k in (1, 2))
    within = (F.col("at1") <= F.col("at2")) & (F.col("low2") * limit <= F.col("high1") + 1) & (F.col("low1") * limit <= F.col("high2") + 1)
    # a few blocks become many pairs, so the partitions must not be sized by the input's bytes
    both = x.repartition(tasks, "at1").join(small(y, 64), within).select(*[c for c in (*x.columns, *y.columns) if not c.startswith("at")])
    met = written(both.mapInArrow(met_pairs(limit), "a long, b long").distinct(), "met")
    return measured(met, one, grams).withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= limit)


def gram_sets(batches):
    """mapInArrow over rows (doc_id, g): blocks of sets; a set's end, and its grams in order."""

    def block(held):
        ids, sets = zip(*held, strict=True)
        return pa.RecordBatch.from_pydict({"doc_ids": [ids], "ends": [np.cumsum([len(x) for x in sets])], "grams": [np.concatenate(sets).tobytes()]}, schema=pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("grams", pa.binary())]))

    held, size = [], 0
    for batch in batches:
        for doc, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.append((doc, np.sort(grams.values.to_numpy())))
            size += 8 * len(held[-1][1])
            if size >= BLOCK_BYTES or len(held) >= LIST_BLOCK:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


def overlaps(batches):
    """mapInArrow over rows (ends, grams, ends, grams, pairs of places): a, b and their Jaccard similarity."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sets = [], []
            for c in (0, 3):
                ids.append(batch.column(c)[k].values.to_numpy())
                sets.append(np.split(np.frombuffer(batch.column(c + 2)[k].as_buffer(), np.int64), batch.column(c + 1)[k].values.to_numpy()[:-1]))
            one, two = (batch.column(6)[k].values.field(f).to_numpy() for f in range(2))
            found = np.empty(len(one))
            for r, (p, q) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                x, y = sets[0][p], sets[1][q]
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                found[r] = both / (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][one]), pa.array(ids[1][two]), pa.array(found)], ["a", "b", "similarity"])


def measured(pairs: DataFrame, texts: DataFrame, grams) -> DataFrame:
    """a, b, similarity of pairs (a, b) of texts (doc_id, text), on the sets that `grams` gives.

    Sets are packed into blocks, those with a partner in common beside each other, so that a set travels once with
    many of its pairs.
    """
    tasks = 4 * texts.sparkSession.sparkContext.defaultParallelism
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("a").alias("by")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("by")))).alias("e"))
    some = small(ends.groupBy("e.doc_id").agg(F.min("e.by").alias("by")))
    sets = grams(texts.join(some, "doc_id").repartition(tasks), "by").repartitionByRange("by", "doc_id").sortWithinPartitions("by", "doc_id").select("doc_id", "g")
    blocks = written(sets.mapInArrow(gram_sets, "doc_ids array<long>, ends array<long>, grams binary").withColumn("at", F.monotonically_increasing_id()), "sets")
    place = small(blocks.select("at", F.posexplode("doc_ids").alias("p", "doc_id")))
    for c, k in (("a", 1), ("b", 2)):
        pairs = pairs.join(place.withColumnsRenamed({"at": f"at{k}", "p": f"p{k}", "doc_id": c}), c)
    pairs = pairs.groupBy("at1", "at2").agg(F.collect_list(F.struct("p1", "p2")).alias("pairs")).repartition(tasks, "at1", "at2")
    x, y = (blocks.withColumnsRenamed({c: f"{c}{k}" for c in blocks.columns}) for k in (1, 2))
    both = pairs.join(x, "at1").join(y, "at2").select("doc_ids1", "ends1", "grams1", "doc_ids2", "ends2", "grams2", "pairs")
    return both.mapInArrow(overlaps, "a long, b long, similarity double")


def authority_score(status: Column) -> Column:
    return F.when(status == "draft", 0.6).when(status == "proposal", 0.7).when(status == "superseded", 0.2).otherwise(1.0)


def evidence(candidates: DataFrame, floor: float = 0.005) -> DataFrame:
    """query_id, items, sufficient, conflict of candidates (query_id, doc_id, score, status): best score of a document, above the floor."""
    kept = candidates.filter(F.col("score") >= floor).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min(authority_score(F.col("status"))).alias("authority"))
    flag = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
    return kept.groupBy("query_id").agg(F.count("*").alias("items"), (F.count("*") >= 1).alias("sufficient"), (flag(F.col("authority") == 0.6) & flag(F.col("authority") == 1.0)).alias("conflict"))
