"""Records in detail: normalized values, nested rows, numbers and dates in texts, coverage and sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text, vectors
from quillstone.functions.hashing import joined_hash
from quillstone.operators.evaluation import top_of_each
from quillstone.plans.registry import query
from quillstone.session import table

SCOPES = ("credit", "risk_management", "legal_compliance", "customer_relationship", "collateral_appraisal")
_SLUG = "lower(regexp_replace(regexp_replace(trim(specialist_scope), '([a-z])([A-Z])', '\\1_\\2', 'g'), '[ -]+', '_', 'g'))"


@query(f"""SELECT evaluation_id, {_SLUG} AS scope, {_SLUG} IN ('{"', '".join(SCOPES)}') AS known FROM gold_queries""")
def normalized_scopes(spark, sf):
    """Scopes as slugs, from slugs, titles and camel case; others are marked unknown."""
    slug = F.lower(F.regexp_replace(F.regexp_replace(F.trim("specialist_scope"), "([a-z])([A-Z])", "$1_$2"), "[ -]+", "_"))
    return table(spark, sf, "gold_queries").select("evaluation_id", slug.alias("scope"), slug.isin(*SCOPES).alias("known"))


@query("SELECT evidence_id, round(greatest(0, least(1, vector_similarity)), 6) AS similarity FROM evidence WHERE vector_similarity IS NOT NULL AND isfinite(vector_similarity)")
def clamped_similarity(spark, sf):
    s = F.col("vector_similarity")
    rows = table(spark, sf, "evidence").where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))
    return rows.select("evidence_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6).alias("similarity"))


@query("""SELECT d.document_id, count(c.chunk_id) AS chunks FROM policy_documents d LEFT JOIN policy_chunks c USING (document_id)
    WHERE contains(lower(d.title), 'tài sản') OR contains(lower(d.source_id), 'tài sản') OR contains(lower(d.title), 'the ') GROUP BY ALL""")
def title_search(spark, sf):
    """Documents whose title or source holds a phrase in any case, with their number of chunks."""
    title, source = F.lower("title"), F.lower("source_id")
    found = table(spark, sf, "policy_documents").where(title.contains("tài sản") | source.contains("tài sản") | title.contains("the ")).select("document_id")
    n = table(spark, sf, "policy_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return found.join(n, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""WITH p AS (SELECT e.evidence_id, trim(regexp_replace(e.content, '[\\s\\x{A0}]+', ' ', 'g')) AS served, trim(regexp_replace(c.content, '[\\s\\x{A0}]+', ' ', 'g')) AS stored
        FROM evidence e JOIN policy_chunks c USING (canonical_chunk_id) WHERE e.content IS NOT NULL)
    SELECT CASE WHEN served = stored THEN 'equal' WHEN contains(lower(stored), lower(served)) THEN 'part' ELSE 'other' END AS relation, count(*) AS served_rows FROM p GROUP BY ALL""")
def verbatim_evidence(spark, sf):
    """Whether what was served is the stored passage, a part of it, or something else, apart from white space and case."""
    flat = lambda c: F.trim(F.regexp_replace(c, "[\\s\\u00a0]+", " "))
    served = table(spark, sf, "evidence").where("content IS NOT NULL").select("canonical_chunk_id", flat("content").alias("served"))
    stored = table(spark, sf, "policy_chunks").select("canonical_chunk_id", flat("content").alias("stored"))
    both = served.join(stored, "canonical_chunk_id")
    relation = F.when(F.col("served") == F.col("stored"), "equal").when(F.lower("stored").contains(F.lower("served")), "part").otherwise("other")
    return both.groupBy(relation.alias("relation")).agg(F.count("*").alias("served_rows"))


@query("""SELECT evaluation_id, list(canonical_chunk_id ORDER BY pos) AS ids, list(coalesce(title, '') ORDER BY pos) AS titles, list(heading ORDER BY pos) AS headings FROM (
    SELECT g.evaluation_id, g.pos, c.canonical_chunk_id, d.title, array_to_string(c.heading_path, ' > ') AS heading FROM (
        SELECT evaluation_id, unnest(expected_canonical_chunk_ids) AS canonical_chunk_id, generate_subscripts(expected_canonical_chunk_ids, 1) AS pos FROM gold_queries) g
    JOIN policy_chunks c USING (canonical_chunk_id) LEFT JOIN policy_documents d USING (document_id)) GROUP BY ALL""")
def gold_records(spark, sf):
    """Each query with its expected passages, their titles and headings in the order of the query."""
    gold = table(spark, sf, "gold_queries").select("evaluation_id", F.posexplode("expected_canonical_chunk_ids").alias("at", "canonical_chunk_id"))
    chunks = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "document_id", F.array_join("heading_path", " > ").alias("heading"))
    titles = table(spark, sf, "policy_documents").select("document_id", "title")
    rows = gold.join(chunks, "canonical_chunk_id").join(titles, "document_id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("at", "canonical_chunk_id", F.coalesce("title", F.lit("")).alias("title"), "heading")))
    return rows.groupBy("evaluation_id").agg(ordered.alias("x")).select(
        "evaluation_id", F.col("x.canonical_chunk_id").alias("ids"), F.col("x.title").alias("titles"), F.col("x.heading").alias("headings"))


@query("""WITH last_of AS (SELECT evaluation_id, run, arg_max(abstention_detected, (generated_at, trace_id)) FILTER (abstention_detected IS NOT NULL) AS flag FROM rag_answers GROUP BY ALL),
    wide AS (SELECT evaluation_id, max(flag::INT) FILTER (run = 1) AS a, max(flag::INT) FILTER (run = 2) AS b, max(flag::INT) FILTER (run = 3) AS c FROM last_of GROUP BY ALL)
    SELECT evaluation_id, coalesce(c, b, a) AS abstained, a IS DISTINCT FROM coalesce(c, b, a) AS overridden FROM wide""")
def merged_flags(spark, sf):
    """Flags of three runs merged: a later run overrides an earlier one where it says something."""
    said = table(spark, sf, "rag_answers").where("abstention_detected IS NOT NULL")
    newest = said.groupBy("evaluation_id", "run").agg(F.max_by("abstention_detected", F.struct("generated_at", "trace_id")).cast("int").alias("flag"))
    every = table(spark, sf, "rag_answers").select("evaluation_id").distinct()
    wide = every.join(newest.groupBy("evaluation_id").pivot("run", [1, 2, 3]).agg(F.max("flag")), "evaluation_id", "left")
    merged = F.coalesce("3", "2", "1")
    return wide.select("evaluation_id", merged.alias("abstained"), (~F.col("1").eqNullSafe(merged)).alias("overridden"))


@query("""WITH claimed AS (SELECT content_hash AS k, count(*) AS n, min(chunk_id) AS a, max(chunk_id) AS b, list_sort(list(chunk_id)) AS ids FROM policy_chunks GROUP BY ALL HAVING count(*) > 1),
    real AS (SELECT sha256(content) AS k, count(*) AS n, min(chunk_id) AS a, max(chunk_id) AS b, list_sort(list(chunk_id)) AS ids FROM policy_chunks GROUP BY ALL HAVING count(*) > 1)
    SELECT coalesce(c.k, r.k) AS content_hash, CASE WHEN c.k IS NULL THEN 'missed' WHEN r.k IS NULL THEN 'claimed' ELSE 'other members' END AS problem
    FROM claimed c FULL JOIN real r ON c.k = r.k WHERE c.k IS NULL OR r.k IS NULL OR c.n <> r.n OR c.a <> r.a OR c.b <> r.b OR c.ids <> r.ids""")
def copy_group_mismatches(spark, sf):
    """Groups of copies by the stored hash against those by the content itself; members are compared by their number, ends and sum of hashes."""
    rows = table(spark, sf, "policy_chunks")

    def groups(key, s):
        g = rows.groupBy(key.alias("content_hash")).agg(F.count("*").alias(f"n{s}"), F.min("chunk_id").alias(f"a{s}"), F.max("chunk_id").alias(f"b{s}"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).alias(f"m{s}"))
        return g.where(F.col(f"n{s}") > 1)

    both = groups(F.col("content_hash"), 1).join(groups(F.sha2("content", 256), 2), "content_hash", "full")
    problem = (F.when(F.col("n1").isNull(), "missed").when(F.col("n2").isNull(), "claimed")
               .when((F.col("n1") != F.col("n2")) | (F.col("a1") != F.col("a2")) | (F.col("b1") != F.col("b2")) | (F.col("m1") != F.col("m2")), "other members"))
    return both.select("content_hash", problem.alias("problem")).where("problem IS NOT NULL")


@query("""SELECT source_id, version_id, article, clause, point, count(*) AS fragments, count(DISTINCT fragment_index) AS distinct_indexes, min(fragment_index) AS least, max(fragment_index) AS most FROM policy_chunks
    WHERE is_fragment GROUP BY ALL HAVING NOT (min(fragment_index) = 0 AND max(fragment_index) = count(*) - 1 AND count(DISTINCT fragment_index) = count(*))""")
def broken_fragment_runs(spark, sf):
    """Fragments of a provision that are not numbered 0..n-1."""
    g = table(spark, sf, "policy_chunks").where("is_fragment").groupBy("source_id", "version_id", "article", "clause", "point").agg(
        F.count("*").alias("fragments"), F.count_distinct("fragment_index").alias("distinct_indexes"), F.min("fragment_index").alias("least"), F.max("fragment_index").alias("most"))
    return g.where("NOT (least = 0 AND most = fragments - 1 AND distinct_indexes = fragments)")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def last_events(spark, sf):
    """The last three events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("n")).where("n <= 3").drop("n")


@query("""WITH l AS (SELECT specialist_scope, canonical_chunk_id, arg_max(vector_similarity, (served_at, evidence_id)) AS similarity FROM evidence
        WHERE vector_similarity IS NOT NULL AND served_at IS NOT NULL GROUP BY ALL)
    SELECT specialist_scope, canonical_chunk_id, round(similarity, 6) AS similarity FROM l
    QUALIFY row_number() OVER (PARTITION BY specialist_scope ORDER BY similarity DESC, canonical_chunk_id) <= 8""")
def best_passages(spark, sf):
    """The eight best passages of each scope; of a passage served again the last similarity counts."""
    rows = table(spark, sf, "evidence").where("vector_similarity IS NOT NULL AND served_at IS NOT NULL")
    last = rows.groupBy("specialist_scope", "canonical_chunk_id").agg(F.max_by("vector_similarity", F.struct("served_at", "evidence_id")).alias("similarity"))
    w = Window.partitionBy("specialist_scope").orderBy(F.desc("similarity"), "canonical_chunk_id")
    return last.withColumn("n", F.row_number().over(w)).where("n <= 8").select("specialist_scope", "canonical_chunk_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH served AS (SELECT evaluation_id, list(DISTINCT rank) FILTER (rank IS NOT NULL) AS ranks FROM evidence GROUP BY ALL),
    cited AS (SELECT trace_id, evaluation_id, list_distinct(list_transform(regexp_extract_all(answer, '\\[E(\\d+)\\]', 1), lambda x: x::INT)) AS ids FROM rag_answers)
    SELECT trace_id, list_sort(list_filter(ids, lambda x: NOT list_contains(coalesce(ranks, []), x))) AS unserved FROM cited LEFT JOIN served USING (evaluation_id)
    WHERE len(list_filter(ids, lambda x: NOT list_contains(coalesce(ranks, []), x))) > 0""")
def unserved_citations(spark, sf):
    """Citations of passages that the query never was given."""
    served = table(spark, sf, "evidence").groupBy("evaluation_id").agg(F.collect_set("rank").alias("ranks"))
    cited = table(spark, sf, "rag_answers").select("trace_id", "evaluation_id", text.citations(F.col("answer")).alias("ids"))
    missing = F.sort_array(F.array_except("ids", F.coalesce("ranks", F.array().cast("array<int>"))))
    return cited.join(served, "evaluation_id", "left").select("trace_id", missing.alias("unserved")).where(F.size("unserved") > 0)


_NUMBER = "\\d+(?:[.,]\\d+)+%?"


@query(f"""WITH said AS (SELECT trace_id, evaluation_id, unnest(list_distinct(regexp_extract_all(answer, '{_NUMBER}'))) AS number FROM rag_answers),
    known AS (SELECT DISTINCT evaluation_id, unnest(regexp_extract_all(content, '{_NUMBER}')) AS number FROM evidence)
    SELECT s.trace_id, count(*) AS numbers, count(k.number) AS supported FROM said s LEFT JOIN known k ON k.evaluation_id = s.evaluation_id AND k.number = s.number GROUP BY ALL""")
def supported_numbers(spark, sf):
    """How many of an answer's figures stand in the passages that its query was given."""
    pattern = F.lit(_NUMBER)
    said = table(spark, sf, "rag_answers").select("trace_id", "evaluation_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", pattern, 0))).alias("number"))
    known = table(spark, sf, "evidence").select("evaluation_id", F.explode(F.array_distinct(F.regexp_extract_all("content", pattern, 0))).alias("number")).distinct().withColumn("ok", F.lit(1))
    return said.join(known, ["evaluation_id", "number"], "left").groupBy("trace_id").agg(F.count("*").alias("numbers"), F.count("ok").alias("supported"))


_PHRASES = ("tài sản", "không được tự ý", "chênh lệch", "may not", "ne peut", "不得")


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, source, count(*) AS documents FROM documents WHERE contains(lower(text), '{p}') GROUP BY ALL" for p in _PHRASES))
def phrase_scan(spark, sf):
    """Stated phrases and the documents of each source that hold them, in one pass."""
    t = F.lower("text")
    hits = F.array_compact(F.array(*(F.when(t.contains(p), F.lit(p)) for p in _PHRASES)))
    return table(spark, sf, "documents").select("source", F.explode(hits).alias("phrase")).groupBy("phrase", "source").agg(F.count("*").alias("documents"))


@query("""SELECT evaluation_id, sha256(string_agg('[E' || rank || '] ' || coalesce(document_title, '') || ': ' || coalesce(content, ''), chr(10) ORDER BY rank, evidence_id)) AS prompt_hash,
    count(*) AS passages FROM evidence WHERE rank IS NOT NULL GROUP BY ALL""")
def evidence_prompts(spark, sf):
    """The passages of a query as one numbered text, by its hash."""
    line = F.concat(F.lit("[E"), F.col("rank"), F.lit("] "), F.coalesce("document_title", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = table(spark, sf, "evidence").where("rank IS NOT NULL").select("evaluation_id", "rank", "evidence_id", line.alias("line"))
    return joined_hash(rows, "evaluation_id", ["rank", "evidence_id"], "line").select("evaluation_id", F.col("hash").alias("prompt_hash"), F.col("n").alias("passages"))


@query("""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\d{2}/\\d{2}/\\d{4})', 1)) AS said FROM documents)
    SELECT year(try_strptime(said, '%d/%m/%Y')) AS year, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM d GROUP BY ALL""")
def mentioned_years(spark, sf):
    """Dates in texts by year; what looks like a date and is none has no year."""
    said = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\d{2}/\d{2}/\d{4})"), 1)).alias("said"))
    year = F.year(F.try_to_timestamp("said", F.lit("dd/MM/yyyy")))
    return said.groupBy(year.alias("year")).agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))


@query("""WITH p AS (SELECT source, try_cast(replace(unnest(regexp_extract_all(text, '(\\d+,\\d+)%', 1)), ',', '.') AS DECIMAL(9, 4)) AS value FROM documents)
    SELECT source, count(value) AS n, min(value)::DOUBLE AS least, max(value)::DOUBLE AS most, round(avg(value::DOUBLE), 6) AS mean FROM p GROUP BY ALL""")
def percentages(spark, sf):
    """Percentages with a decimal comma in texts, as decimals."""
    said = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"(\d+,\d+)%"), 1)).alias("said"))
    value = said.select("source", F.replace("said", F.lit(","), F.lit(".")).try_cast("decimal(9,4)").alias("value"))
    return value.groupBy("source").agg(F.count("value").alias("n"), F.min("value").cast("double").alias("least"), F.max("value").cast("double").alias("most"),
                                       F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"))


@query("""WITH n AS (SELECT DISTINCT source_id, version_id, regexp_extract(article, '(\\d+)', 1)::INT AS n FROM policy_chunks WHERE regexp_matches(article, '\\d')),
    r AS (SELECT source_id, version_id, unnest(range(min(n), max(n) + 1)) AS n FROM n GROUP BY source_id, version_id)
    SELECT source_id, version_id, count(*) AS missing FROM r ANTI JOIN n USING (source_id, version_id, n) GROUP BY ALL""")
def missing_articles(spark, sf):
    """Article numbers that a version skips between its first and its last."""
    have = table(spark, sf, "policy_chunks").where(F.col("article").rlike(r"\d")).select("source_id", "version_id", F.regexp_extract("article", r"(\d+)", 1).cast("int").alias("n")).distinct()
    span = have.groupBy("source_id", "version_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).select("source_id", "version_id", F.explode(F.sequence("a", "b")).alias("n"))
    return span.join(have, ["source_id", "version_id", "n"], "left_anti").groupBy("source_id", "version_id").agg(F.count("*").alias("missing"))


@query("""WITH v AS (SELECT source_id, regexp_extract(version_id, 'v(\\d+)$', 1)::INT AS n FROM policy_documents),
    g AS (SELECT source_id, n, lag(n) OVER (PARTITION BY source_id ORDER BY n) AS before FROM v)
    SELECT g.source_id, g.n AS version, g.before, (SELECT count(*) FROM policy_chunks c WHERE c.source_id = g.source_id) AS chunks FROM g WHERE g.n <> coalesce(g.before, 0) + 1""")
def version_gaps(spark, sf):
    """Versions that do not follow their predecessor by one: a write that expected another state."""
    v = table(spark, sf, "policy_documents").select("source_id", F.regexp_extract("version_id", r"v(\d+)$", 1).cast("int").alias("version"))
    gap = v.withColumn("before", F.lag("version").over(Window.partitionBy("source_id").orderBy("version"))).where(F.col("version") != F.coalesce("before", F.lit(0)) + 1)
    n = table(spark, sf, "policy_chunks").groupBy("source_id").agg(F.count("*").alias("chunks"))
    return gap.join(n, "source_id", "left").select("source_id", "version", "before", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents),
    h AS (SELECT doc_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 64 AS bucket, CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM t),
    b AS (SELECT doc_id, bucket, sum(sign) AS weight FROM h GROUP BY ALL)
    SELECT doc_id, count(*) FILTER (weight <> 0) AS buckets, round(sqrt(sum(weight * weight)), 6) AS norm, arg_min(bucket, (-abs(weight), bucket)) AS strongest FROM b GROUP BY ALL""")
def hashed_embeddings(spark, sf):
    """Token-hash vectors of 64 buckets: how many are filled, their length, the strongest bucket."""
    listed = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    filled = vectors.token_hashes(listed, "doc_id", "tokens", 64)
    by_strength = F.array_min(F.transform("vector", lambda w, i: F.struct((-F.abs(w)).alias("w"), i.cast("long").alias("i"))))
    return filled.select(F.col("id").alias("doc_id"), F.size(F.filter("vector", lambda w: w != 0)).cast("long").alias("buckets"), F.round(vectors.norm(F.col("vector")), 6).alias("norm"),
                         by_strength["i"].alias("strongest"))


@query("""SELECT doc_id, source, created_at FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40""")
def document_page(spark, sf):
    """The third page of 20 documents, newest first: a page by definition."""
    return table(spark, sf, "documents").select("doc_id", "source", "created_at").orderBy(F.desc_nulls_last("created_at"), "doc_id").offset(40).limit(20)


@query("""PIVOT (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING round(sum(o_totalprice), 2) GROUP BY o_orderpriority""")
def order_pivot(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))


@query("""WITH m AS (SELECT retrieval_source, canonical_chunk_id, max(retrieved_at) AS seen, count(*) AS times FROM ranked_results WHERE canonical_chunk_id IS NOT NULL GROUP BY ALL)
    SELECT retrieval_source, canonical_chunk_id, seen, times FROM m QUALIFY row_number() OVER (PARTITION BY canonical_chunk_id ORDER BY times DESC, retrieval_source) = 1""")
def main_source(spark, sf):
    """The source that returns each passage most often."""
    m = table(spark, sf, "ranked_results").where("canonical_chunk_id IS NOT NULL").groupBy("retrieval_source", "canonical_chunk_id").agg(F.max("retrieved_at").alias("seen"), F.count("*").alias("times"))
    return top_of_each(m, ["canonical_chunk_id"], [F.desc("times"), F.asc("retrieval_source")])


@query("""SELECT 'documents' AS name, count(DISTINCT source) AS a, count(DISTINCT doc_type) AS b, count(DISTINCT (source, doc_type)) AS c FROM documents
    UNION ALL SELECT 'results', count(DISTINCT evaluation_id), count(DISTINCT canonical_chunk_id), count(DISTINCT (evaluation_id, canonical_chunk_id)) FROM ranked_results WHERE canonical_chunk_id IS NOT NULL""")
def distinct_counts(spark, sf):
    def one(d, name, a, b):
        both = F.struct(a, b)
        return d.agg(F.lit(name).alias("name"), F.count_distinct(F.col(a)).alias("a"), F.count_distinct(F.col(b)).alias("b"), F.count_distinct(both).alias("c"))

    results = table(spark, sf, "ranked_results").where("canonical_chunk_id IS NOT NULL")
    return reduce(DataFrame.unionByName, (one(table(spark, sf, "documents"), "documents", "source", "doc_type"), one(results, "results", "evaluation_id", "canonical_chunk_id")))
