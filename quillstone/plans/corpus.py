"""The corpus: identity, hierarchy, duplicates, structure of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import hashing, text
from quillstone.operators import chunking, parsing, running
from quillstone.plans.registry import query
from quillstone.session import table

_WORDS = "[\\p{L}\\p{N}]+"


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (
    "policy_documents", "policy_chunks", "gold_queries", "ranked_results", "evidence", "rag_answers", "documents", "events")))
def table_counts(spark, sf):
    names = ("policy_documents", "policy_chunks", "gold_queries", "ranked_results", "evidence", "rag_answers", "documents", "events")
    return reduce(DataFrame.unionByName, (table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in names))


@query("""SELECT source_id, count(*) AS chunks, count(DISTINCT version_id) AS versions, count(*) FILTER (upper(visibility) = 'SHARED') AS shared,
    count(*) FILTER (is_fragment) AS fragments, count(*) FILTER (embedding IS NULL) AS no_vector, max(length(content)) AS longest,
    coalesce(min(page_start), 0) AS first_page, coalesce(max(page_end), 0) AS last_page FROM policy_chunks GROUP BY ALL""")
def source_report(spark, sf):
    """One pass of conditional counts for each source."""
    return table(spark, sf, "policy_chunks").groupBy("source_id").agg(
        F.count("*").alias("chunks"), F.count_distinct("version_id").alias("versions"), F.count_if(F.upper("visibility") == "SHARED").alias("shared"),
        F.count_if("is_fragment").alias("fragments"), F.count_if(F.col("embedding").isNull()).alias("no_vector"), F.max(F.length("content")).alias("longest"),
        F.coalesce(F.min("page_start"), F.lit(0)).alias("first_page"), F.coalesce(F.max("page_end"), F.lit(0)).alias("last_page"))


@query("SELECT namespace, upper(visibility) AS visibility, is_synthetic, count(*) AS chunks, sum(length(content)) AS characters FROM policy_chunks GROUP BY ALL")
def namespace_counts(spark, sf):
    return table(spark, sf, "policy_chunks").groupBy("namespace", F.upper("visibility").alias("visibility"), "is_synthetic").agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))


@query("SELECT chunk_id FROM policy_chunks WHERE sha256(content) <> regexp_replace(content_hash, '^sha256:', '')")
def stale_hashes(spark, sf):
    rows = table(spark, sf, "policy_chunks")
    return rows.where(hashing.content_hash(F.col("content")) != F.regexp_replace("content_hash", "^sha256:", "")).select("chunk_id")


_PARTS = ("source_id", "version_id", "chapter", "section", "article", "clause", "point", "content_hash", "fragment_index")


@query("SELECT chunk_id, sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({p}::VARCHAR, chr(0))" for p in _PARTS) + ")) AS identity FROM policy_chunks")
def chunk_identities(spark, sf):
    """An id from the parts that make a chunk what it is; nulls count."""
    return table(spark, sf, "policy_chunks").select("chunk_id", hashing.identity(*_PARTS).alias("identity"))


@query("""SELECT source_id, count(*) AS chunks, sum(('0x' || substr(sha256(canonical_chunk_id || ':' || content_hash), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS digest
    FROM policy_chunks GROUP BY ALL""")
def corpus_digest(spark, sf):
    """A digest per source that does not depend on order and is summed on the map side: no list of ids is ever collected."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "canonical_chunk_id", "content_hash"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return table(spark, sf, "policy_chunks").groupBy("source_id").agg(F.count("*").alias("chunks"), F.sum(part).cast("string").alias("digest"))


@query()
def named_uuids(spark, sf):
    """Name-based UUIDs of chunks and the hash of their vectors, which other systems can recompute."""
    rows = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "embedding")
    return rows.select("canonical_chunk_id", hashing.uuid5("chunk")(F.col("canonical_chunk_id")).alias("uuid"), hashing.vector_hash(F.col("embedding")).alias("vector_hash"))


_TUPLE = ("source_id", "version_id", "chapter", "section", "article", "clause", "point")
_CLASS = ("CASE WHEN clause IS NULL AND point IS NOT NULL THEN 'DIRECT_ARTICLE_POINT' WHEN n > 1 THEN 'REPEATED_LABEL_GENUINE' ELSE 'NORMAL' END")


@query(f"WITH g AS (SELECT {', '.join(_TUPLE)}, count(*) AS n FROM policy_chunks GROUP BY ALL) SELECT {_CLASS} AS class, count(*) AS labels, sum(n) AS chunks, max(n) AS most FROM g GROUP BY ALL")
def label_classes(spark, sf):
    """Hierarchy labels: unique, repeated, or a point right below an article. Nulls group together."""
    g = table(spark, sf, "policy_chunks").groupBy(*_TUPLE).agg(F.count("*").alias("n"))
    kind = (F.when(F.col("clause").isNull() & F.col("point").isNotNull(), "DIRECT_ARTICLE_POINT").when(F.col("n") > 1, "REPEATED_LABEL_GENUINE").otherwise("NORMAL"))
    return g.groupBy(kind.alias("class")).agg(F.count("*").alias("labels"), F.sum("n").alias("chunks"), F.max("n").alias("most"))


@query(f"""SELECT chunk_id, row_number() OVER (PARTITION BY {', '.join(_TUPLE)} ORDER BY chunk_id) AS occurrence FROM policy_chunks""")
def label_occurrences(spark, sf):
    """Which occurrence of its label a chunk is, in the order of ids."""
    rows = table(spark, sf, "policy_chunks").select(*_TUPLE, "chunk_id", F.lit(1).alias("one"))
    placed = running.running_total(rows, list(_TUPLE), F.floor(F.col("chunk_id") / 10_000), ["chunk_id"], "one")
    return placed.select("chunk_id", (F.col("total_before") + 1).alias("occurrence"))


@query("""SELECT source_id, version_id, content_hash, count(*) AS copies, min(chunk_id) AS first_id, max(chunk_id) AS last_id
    FROM policy_chunks GROUP BY ALL HAVING count(*) > 1""")
def duplicate_contents(spark, sf):
    g = table(spark, sf, "policy_chunks").groupBy("source_id", "version_id", "content_hash")
    return g.agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id")).where("copies > 1")


_ISLANDS = """WITH c AS (SELECT *, CASE WHEN article IS DISTINCT FROM lag(article) OVER w OR chapter IS DISTINCT FROM lag(chapter) OVER w
        OR lag(chunk_id) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM policy_chunks
        WINDOW w AS (PARTITION BY source_id, version_id, section ORDER BY page_start, chunk_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id, version_id, section ORDER BY page_start, chunk_id ROWS UNBOUNDED PRECEDING) AS instance FROM c)
"""


def _page():
    """The page of a chunk; chunks without one come last."""
    return F.coalesce("page_start", F.lit(2147483647))


@query(_ISLANDS + """SELECT source_id, version_id, section, instance, count(*) AS provisions, sum(length(content)) + count(*) - 1 AS packed_length,
    CASE WHEN sum(length(content)) + count(*) - 1 <= 2400 THEN 'PACK' ELSE 'SPLIT' END AS action FROM i GROUP BY ALL""")
def article_instances(spark, sf):
    """Runs of provisions of one article in reading order, and whether each fits one chunk of 2,400 characters."""
    by = ["source_id", "version_id", "section"]
    rows = table(spark, sf, "policy_chunks").select(*by, "page_start", "chunk_id", "article", "chapter", F.length("content").alias("n"))
    found = running.islands_in_blocks(rows, by, _page(), "chunk_id", ["article", "chapter"], "instance")
    length = F.sum("n") + F.count("*") - 1
    return found.groupBy(*by, "instance").agg(F.count("*").alias("provisions"), length.alias("packed_length"), F.when(length <= 2400, "PACK").otherwise("SPLIT").alias("action"))


@query(_ISLANDS + """, a AS (SELECT source_id, version_id, section, instance, string_agg(content, chr(10) ORDER BY page_start NULLS LAST, chunk_id) AS whole FROM i GROUP BY ALL)
    SELECT source_id, version_id, section, instance, sha256(whole) AS whole_hash, length(whole) AS characters FROM a""")
def packed_articles(spark, sf):
    """Articles packed into chunks of at most 2,400 characters, then put together again: what comes out must be the article."""
    by = ["source_id", "version_id", "section"]
    rows = table(spark, sf, "policy_chunks").select(*by, "page_start", "chunk_id", "article", "chapter", "content")
    found = running.islands_in_blocks(rows, by, _page(), "chunk_id", ["article", "chapter"], "instance")
    ordered = F.sort_array(F.collect_list(F.struct(_page().alias("p"), "chunk_id", "content")))
    articles = found.groupBy(*by, "instance").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("whole"))
    named = articles.withColumn("article_key", F.to_json(F.struct(*by, "instance"), {"ignoreNullFields": "false"}))
    parts = chunking.fragments(named, "article_key", "whole", chunking.lossless)
    again = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "content"))), lambda x: x["content"]), "")
    whole = parts.groupBy("id").agg(again.alias("whole"))
    key = F.from_json("id", "source_id string, version_id string, section string, instance long")
    return whole.select(key.alias("k"), F.sha2("whole", 256).alias("whole_hash"), F.length("whole").alias("characters")).select("k.*", "whole_hash", "characters")


@query("""SELECT d.document_id, count(c.chunk_id) AS chunks, coalesce(sum(length(c.content)), 0) AS characters FROM policy_documents d
    LEFT JOIN policy_chunks c USING (document_id) WHERE d.effective_from <= DATE '2025-06-30' AND (d.effective_to IS NULL OR d.effective_to > DATE '2025-06-30') GROUP BY ALL""")
def active_documents(spark, sf):
    """Documents in force on a stated day with the size of their text."""
    day = F.lit("2025-06-30").cast("date")
    active = table(spark, sf, "policy_documents").where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day))).select("document_id")
    sizes = table(spark, sf, "policy_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"))
    return active.join(sizes, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("characters", F.lit(0)).alias("characters"))


@query("""SELECT d.issuer, lower(d.document_type) AS document_type, d.is_synthetic, count(*) AS chunks, count(DISTINCT d.document_id) AS documents
    FROM policy_chunks c JOIN policy_documents d USING (document_id) GROUP BY ALL""")
def chunks_by_issuer(spark, sf):
    documents = table(spark, sf, "policy_documents").select("document_id", "issuer", F.lower("document_type").alias("document_type"), "is_synthetic")
    return table(spark, sf, "policy_chunks").select("document_id").join(documents, "document_id").groupBy("issuer", "document_type", "is_synthetic").agg(
        F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))


@query("""WITH a AS (SELECT DISTINCT document_source_id AS source_id, unnest([specialist_scope]) AS scope FROM evidence WHERE document_source_id IS NOT NULL),
    n AS (SELECT source_id, count(*) AS chunks FROM policy_chunks GROUP BY ALL)
    SELECT scope, count(*) AS sources, sum(chunks) AS rows_needed FROM a JOIN n USING (source_id) WHERE scope IN ('credit', 'risk_management', 'legal_compliance') GROUP BY ALL""")
def scope_fan_out(spark, sf):
    """Rows that a store with one row per (chunk, scope) needs; scopes that it doesn't support are dropped."""
    opened = table(spark, sf, "evidence").where("document_source_id IS NOT NULL").select(F.col("document_source_id").alias("source_id"), F.col("specialist_scope").alias("scope")).distinct()
    n = table(spark, sf, "policy_chunks").groupBy("source_id").agg(F.count("*").alias("chunks"))
    return opened.where(F.col("scope").isin("credit", "risk_management", "legal_compliance")).join(n, "source_id").groupBy("scope").agg(
        F.count("*").alias("sources"), F.sum("chunks").alias("rows_needed"))


# texts


@query(f"""SELECT doc_id, len(regexp_extract_all(lower(text), '{_WORDS}')) AS words, len(list_distinct(regexp_extract_all(lower(text), '{_WORDS}'))) AS distinct_words,
    ceil(length(text) / 4.0)::BIGINT AS approximate_tokens FROM documents WHERE text IS NOT NULL""")
def word_counts(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").where(t.isNotNull()).select(
        "doc_id", F.size(text.tokens(t)).alias("words"), F.size(text.distinct_tokens(t)).alias("distinct_words"), text.approximate_tokens(t).alias("approximate_tokens"))


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS composed, nfc_normalize(text) <> text AS decomposed FROM documents WHERE text IS NOT NULL")
def composed_texts(spark, sf):
    """Hash of each text in composed letters, and whether it was stored otherwise."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", text.nfc(F.col("text")).alias("c"))
    return rows.select("doc_id", F.sha2("c", 256).alias("composed"), (F.col("c") != F.col("text")).alias("decomposed"))


@query("""WITH t AS (SELECT evaluation_id, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+') AS t FROM gold_queries),
    d AS (SELECT evaluation_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms FROM t)
    SELECT evaluation_id, terms, array_to_string(terms, ' | ') AS or_query FROM d""")
def or_queries(spark, sf):
    return table(spark, sf, "gold_queries").select("evaluation_id", text.distinct_tokens(F.col("query")).alias("terms"), text.or_query(F.col("query")).alias("or_query"))


@query("""SELECT trace_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 79), '[ \\t\\n\\f\\r]+[^ \\t\\n\\f\\r]*$', '') || '…' END AS excerpt
    FROM (SELECT trace_id, question AS t FROM rag_answers)""")
def question_excerpts(spark, sf):
    """At most 80 characters of each question, cut at a word."""
    return table(spark, sf, "rag_answers").select("trace_id", text.excerpt(F.col("question"), 80).alias("excerpt"))


@query("""SELECT c.chunk_id, concat_ws('-', trim(regexp_replace(strip_accents(replace(lower(d.title), 'đ', 'd')), '[^a-z0-9]+', '-', 'g'), '-'), c.chunk_id) AS name
    FROM policy_chunks c JOIN policy_documents d USING (document_id)""")
def title_slugs(spark, sf):
    """Names for files and addresses from titles, joined to all chunks of the document."""
    titles = table(spark, sf, "policy_documents").select("document_id", text.slug(F.col("title")).alias("slug"))
    return table(spark, sf, "policy_chunks").select("chunk_id", "document_id").join(titles, "document_id").select("chunk_id", F.concat_ws("-", "slug", "chunk_id").alias("name"))


_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS text,
        generate_subscripts(string_split(regexp_replace(regexp_replace(text, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
    lined AS (SELECT * FROM l WHERE length(trim(text, ' ')) > 0),
    own AS (SELECT doc_id AS id, line, text, nullif(lower(regexp_extract(text, '(?i)^(chương|mục|điều|khoản|phụ lục|chapter|section|article|annex|annexe|§)\\s*(\\d+)', 1)), '') AS level,
        try_cast(nullif(regexp_extract(text, '(?i)^(chương|mục|điều|khoản|phụ lục|chapter|section|article|annex|annexe|§)\\s*(\\d+)', 2), '') AS INT) AS number FROM lined)
"""


def _lined(spark, sf):
    return parsing.lines(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query(_LINES + """, headed AS (SELECT id, line, level IS NOT NULL AS is_heading, last_value(level IGNORE NULLS) OVER w AS level, last_value(number IGNORE NULLS) OVER w AS number
        FROM own WINDOW w AS (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING))
    SELECT level, number, count(*) AS lines, count(*) FILTER (is_heading) AS headings, count(DISTINCT id) AS documents FROM headed GROUP BY ALL""")
def heading_lines(spark, sf):
    """Headings carried forward over the lines below them, counted."""
    return parsing.headed(_lined(spark, sf)).groupBy("level", "number").agg(
        F.count("*").alias("lines"), F.count_if("is_heading").alias("headings"), F.count_distinct("id").alias("documents"))


@query(_LINES + """, marked AS (SELECT *, sum(CASE WHEN level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM own)
    SELECT id, section, min(line) AS first_line, count(*) AS lines, length(string_agg(text, chr(10) ORDER BY line)) AS characters,
        sha256(string_agg(text, chr(10) ORDER BY line)) AS content_hash FROM marked GROUP BY id, section""")
def text_sections(spark, sf):
    """The lines from one heading to the next as one section."""
    return parsing.sections(_lined(spark, sf))


@query(_LINES + """, h AS (SELECT id, level, line, number, max(number) OVER (PARTITION BY id, level ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own WHERE level IS NOT NULL)
    SELECT id, level, line, number FROM h WHERE number < before""")
def falling_headings(spark, sf):
    """Headings numbered below an earlier one of their level: body text that looks like a heading."""
    h = parsing.headed(_lined(spark, sf)).where("is_heading")
    before = F.max("number").over(Window.partitionBy("id", "level").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return h.withColumn("before", before).where("number < before").select("id", "level", "line", "number")


@query(_LINES + """, f AS (SELECT id, CASE WHEN text LIKE '%\t%' THEN 'tab' WHEN text LIKE '% | %' THEN 'bar' WHEN regexp_matches(text, '^\\d+;') THEN 'semicolon' ELSE 'prose' END AS form, text FROM own)
    SELECT form, count(*) AS lines, count(DISTINCT id) AS documents, sum(length(text)) AS characters FROM f GROUP BY ALL""")
def line_forms(spark, sf):
    """Table rows and prose among the lines."""
    t = F.col("text")
    form = F.when(t.contains("\t"), "tab").when(t.contains(" | "), "bar").when(t.rlike(r"^\d+;"), "semicolon").otherwise("prose")
    return _lined(spark, sf).groupBy(form.alias("form")).agg(F.count("*").alias("lines"), F.count_distinct("id").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query("SELECT doc_id AS id, sha256(text) AS whole, true AS fits FROM documents WHERE length(text) > 0")
def lossless_fragments(spark, sf):
    """Texts split at 2,400 characters and put together again: the hash must be that of the text."""
    f = chunking.fragments(table(spark, sf, "documents"), "doc_id", "text", chunking.lossless)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("index", "content"))), lambda x: x["content"]), "")
    return f.groupBy("id").agg(F.sha2(whole, 256).alias("whole"), (F.max(F.length("content")) <= 2400).alias("fits"))


@query()
def overlapping_fragments(spark, sf):
    """Windows of 1,200 characters that overlap by 150."""
    f = chunking.fragments(table(spark, sf, "documents"), "doc_id", "text", chunking.overlapping)
    return f.select("id", "index", "start", F.length("content").alias("characters"), F.sha2("content", 256).alias("content_hash"))


@query("""WITH sized AS (SELECT doc_id, source, created_at, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY created_at, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM documents WHERE n_chars > 0 AND created_at IS NOT NULL)
    SELECT doc_id, source, n_chars, least(n_chars, 60000 - before)::BIGINT AS taken FROM sized WHERE before < 60000""")
def budgeted_documents(spark, sf):
    """The oldest documents of each source until 60,000 characters are used; of the last one what still fits."""
    rows = table(spark, sf, "documents").where("n_chars > 0 AND created_at IS NOT NULL").select("doc_id", "source", "created_at", "n_chars")
    kept = running.within_budget(rows, ["source"], F.to_date("created_at"), ["created_at", "doc_id"], "n_chars", 60_000)
    return kept.select("doc_id", "source", "n_chars", "taken")


@query("""WITH cited AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?i)(?:phụ lục|annex)\\s+([A-Z]{2}-\\d{5})', 1))) AS code FROM documents),
    declared AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?i)(?:hồ sơ|file|档案|dossier)\\s*([A-Z]{2}-\\d{5})', 1)) AS code FROM documents)
    SELECT doc_id AS id, code AS mention FROM cited WHERE code NOT IN (SELECT code FROM declared)""")
def unresolved_mentions(spark, sf):
    """Annexes cited in a text that no text declares as a file."""
    documents = table(spark, sf, "documents")
    cited = parsing.mentions(documents, "doc_id", "text", r"(?iu)(?:phụ lục|annex)\s+([A-Z]{2}-\d{5})")
    declared = parsing.mentions(documents, "doc_id", "text", r"(?iu)(?:hồ sơ|file|档案|dossier)\s*([A-Z]{2}-\d{5})")
    return cited.join(declared.select("mention").distinct(), "mention", "left_anti").select("id", "mention")


@query("""SELECT source, coalesce(lower(lang), 'unknown') AS lang, count(*) AS documents, sum(n_chars) AS characters, round(avg(n_chars), 6) AS mean_length,
    count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (regexp_full_match(text, '[ \\t\\r\\n]*')) AS blank FROM documents GROUP BY ALL""")
def document_sizes(spark, sf):
    return table(spark, sf, "documents").groupBy("source", F.coalesce(F.lower("lang"), F.lit("unknown")).alias("lang")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.round(F.avg("n_chars"), 6).alias("mean_length"),
        F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(F.col("text").rlike(r"^[ \t\r\n]*$")).alias("blank"))


@query("""SELECT doc_id, round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::DOUBLE, 6) AS upper_share
    FROM documents WHERE length(regexp_replace(text, '[^\\p{L}]', '', 'g')) > 0 AND length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) > 0.7 * length(regexp_replace(text, '[^\\p{L}]', '', 'g'))""")
def capital_texts(spark, sf):
    """Texts of which more than seven tenths of the letters are capitals."""
    share = text.upper_share(F.col("text"))
    return table(spark, sf, "documents").where(share > 0.7).select("doc_id", F.round(share, 6).alias("upper_share"))


@query("""SELECT sha256(text) AS content, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def exact_copies(spark, sf):
    g = table(spark, sf, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content"))
    return g.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("sources")).where("copies > 1")
