"""Rules that rows must keep, as tables of the rows that break them; changes between states; graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import changes, graph
from quillstone.plans.common import copied_stretch
from quillstone.plans.registry import query
from quillstone.session import table


@query("SELECT chunk_id FROM policy_chunks c WHERE NOT EXISTS (SELECT 1 FROM policy_documents d WHERE d.document_id = c.document_id)")
def orphan_chunks(spark, sf):
    documents = table(spark, sf, "policy_documents").select("document_id")
    return table(spark, sf, "policy_chunks").join(documents, "document_id", "left_anti").select("chunk_id")


@query("SELECT document_id FROM policy_documents d WHERE NOT EXISTS (SELECT 1 FROM policy_chunks c WHERE c.document_id = d.document_id)")
def documents_without_chunks(spark, sf):
    used = table(spark, sf, "policy_chunks").select("document_id")
    return table(spark, sf, "policy_documents").join(used, "document_id", "left_anti").select("document_id")


@query("SELECT result_id FROM ranked_results r WHERE canonical_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM policy_chunks c WHERE c.canonical_chunk_id = r.canonical_chunk_id)")
def results_without_chunk(spark, sf):
    known = table(spark, sf, "policy_chunks").select("canonical_chunk_id")
    return table(spark, sf, "ranked_results").where("canonical_chunk_id IS NOT NULL").join(known, "canonical_chunk_id", "left_anti").select("result_id")


@query("SELECT chunk_id, page_start, page_end FROM policy_chunks WHERE page_start > page_end")
def reversed_pages(spark, sf):
    return table(spark, sf, "policy_chunks").where("page_start > page_end").select("chunk_id", "page_start", "page_end")


@query("SELECT document_id, 'reversed' AS problem FROM policy_documents WHERE effective_to <= effective_from UNION ALL SELECT document_id, 'undated' FROM policy_documents WHERE effective_from IS NULL")
def document_intervals(spark, sf):
    rows = table(spark, sf, "policy_documents")
    problem = F.when(F.col("effective_to") <= F.col("effective_from"), "reversed").when(F.col("effective_from").isNull(), "undated")
    return rows.select("document_id", problem.alias("problem")).where("problem IS NOT NULL")


@query("""WITH v AS (SELECT source_id, version_id, effective_from, effective_to,
        max(coalesce(effective_to, DATE '9999-12-31')) OVER (PARTITION BY source_id ORDER BY effective_from, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until
        FROM policy_documents WHERE effective_from IS NOT NULL AND (effective_to IS NULL OR effective_to > effective_from))
    SELECT v.source_id, v.version_id, count(c.chunk_id) AS chunks FROM v LEFT JOIN policy_chunks c USING (source_id, version_id) WHERE v.effective_from < v.until GROUP BY ALL""")
def overlapping_versions(spark, sf):
    """Versions that begin while an earlier one of their source is in force, and the chunks that this concerns."""
    far = F.lit("9999-12-31").cast("date")
    w = Window.partitionBy("source_id").orderBy("effective_from", "version_id").rowsBetween(Window.unboundedPreceding, -1)
    valid = table(spark, sf, "policy_documents").where("effective_from IS NOT NULL AND (effective_to IS NULL OR effective_to > effective_from)")
    late = valid.withColumn("until", F.max(F.coalesce("effective_to", far)).over(w)).where("effective_from < until").select("source_id", "version_id")
    n = table(spark, sf, "policy_chunks").groupBy("source_id", "version_id").agg(F.count("*").alias("chunks"))
    return late.join(n, ["source_id", "version_id"], "left").select("source_id", "version_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""WITH e AS (SELECT evaluation_id, count(*) AS items, count(rank) AS ranked, count(DISTINCT rank) AS distinct_ranks, min(rank) AS least, max(rank) AS most,
        count(DISTINCT canonical_chunk_id) AS chunks, count(*) FILTER (content IS NULL OR regexp_full_match(content, '[ \\t\\r\\n]*')) AS blank FROM evidence GROUP BY ALL)
    SELECT evaluation_id, items, ranked <> items AS unranked, distinct_ranks <> ranked AS repeated_rank, coalesce(least <> 1 OR most <> distinct_ranks, true) AS gap,
        chunks <> items AS repeated_chunk, blank > 0 AS blank, items > 20 AS too_many FROM e
    WHERE ranked <> items OR distinct_ranks <> ranked OR coalesce(least <> 1 OR most <> distinct_ranks, true) OR chunks <> items OR blank > 0 OR items > 20""")
def evidence_contract(spark, sf):
    """What is served for a query must have ranks 1..n, each once, different chunks, contents, and at most 20 rows."""
    e = table(spark, sf, "evidence").groupBy("evaluation_id").agg(
        F.count("*").alias("items"), F.count("rank").alias("ranked"), F.count_distinct("rank").alias("distinct_ranks"), F.min("rank").alias("least"), F.max("rank").alias("most"),
        F.count_distinct("canonical_chunk_id").alias("chunks"), F.count_if(F.col("content").isNull() | F.col("content").rlike(r"^[ \t\r\n]*$")).alias("n_blank"))
    flags = {"unranked": F.col("ranked") != F.col("items"), "repeated_rank": F.col("distinct_ranks") != F.col("ranked"),
             "gap": F.coalesce((F.col("least") != 1) | (F.col("most") != F.col("distinct_ranks")), F.lit(True)), "repeated_chunk": F.col("chunks") != F.col("items"),
             "blank": F.col("n_blank") > 0, "too_many": F.col("items") > 20}
    broken = e.withColumns(flags)
    return broken.where(" OR ".join(flags)).select("evaluation_id", "items", *flags)


@query("""SELECT e.evidence_id, list_filter([CASE WHEN c.source_id IS DISTINCT FROM e.document_source_id THEN 'source' END, CASE WHEN c.version_id IS DISTINCT FROM e.document_version_id THEN 'version' END,
        CASE WHEN upper(c.visibility) IS DISTINCT FROM upper(e.visibility) THEN 'visibility' END, CASE WHEN c.content IS DISTINCT FROM e.content THEN 'content' END], lambda x: x IS NOT NULL) AS changed
    FROM evidence e JOIN policy_chunks c USING (canonical_chunk_id) WHERE c.source_id IS DISTINCT FROM e.document_source_id OR c.version_id IS DISTINCT FROM e.document_version_id
        OR upper(c.visibility) IS DISTINCT FROM upper(e.visibility) OR c.content IS DISTINCT FROM e.content""")
def evidence_drift(spark, sf):
    """Served rows that differ from the chunk they name, with what differs."""
    served = table(spark, sf, "evidence").select("evidence_id", "canonical_chunk_id", "document_source_id", "document_version_id", F.upper("visibility").alias("v"), "content")
    stored = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "source_id", "version_id", F.upper("visibility").alias("w"), F.col("content").alias("stored"))
    pairs = {"source": ("source_id", "document_source_id"), "version": ("version_id", "document_version_id"), "visibility": ("w", "v"), "content": ("stored", "content")}
    changed = F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, (a, b) in pairs.items())))
    return served.join(stored, "canonical_chunk_id").select("evidence_id", changed.alias("changed")).where(F.size("changed") > 0)


@query("""SELECT e.evidence_id, e.specialist_scope FROM evidence e JOIN policy_chunks c USING (canonical_chunk_id) JOIN gold_queries g USING (evaluation_id)
    WHERE upper(c.visibility) = 'SCOPED' AND replace(lower(g.specialist_scope), ' ', '_') <> e.specialist_scope""")
def scope_leaks(spark, sf):
    """Scoped passages served to another scope than that of the question."""
    scoped = table(spark, sf, "policy_chunks").where(F.upper("visibility") == "SCOPED").select("canonical_chunk_id")
    asked = table(spark, sf, "gold_queries").select("evaluation_id", F.replace(F.lower("specialist_scope"), F.lit(" "), F.lit("_")).alias("asked"))
    served = table(spark, sf, "evidence").select("evidence_id", "evaluation_id", "canonical_chunk_id", "specialist_scope")
    return served.join(scoped, "canonical_chunk_id").join(asked, "evaluation_id").where("asked <> specialist_scope").select("evidence_id", "specialist_scope")


@query("""SELECT 'chunk without document' AS "check", chunk_id::VARCHAR AS key FROM policy_chunks c WHERE document_id NOT IN (SELECT document_id FROM policy_documents) OR document_id IS NULL
    UNION ALL SELECT 'stale hash', chunk_id::VARCHAR FROM policy_chunks WHERE sha256(content) <> regexp_replace(content_hash, '^sha256:', '')
    UNION ALL SELECT 'visibility spelling', chunk_id::VARCHAR FROM policy_chunks WHERE visibility NOT IN ('SHARED', 'SCOPED')
    UNION ALL SELECT 'reversed pages', chunk_id::VARCHAR FROM policy_chunks WHERE page_start > page_end
    UNION ALL SELECT 'document without size', document_id FROM policy_documents WHERE byte_size IS NULL
    UNION ALL SELECT 'answer without query', trace_id::VARCHAR FROM rag_answers WHERE evaluation_id NOT IN (SELECT evaluation_id FROM gold_queries)""")
def corpus_violations(spark, sf):
    """All rules of the corpus in one table."""
    chunks, documents = table(spark, sf, "policy_chunks"), table(spark, sf, "policy_documents")
    stale = F.sha2("content", 256) != F.regexp_replace("content_hash", "^sha256:", "")
    answers, gold = table(spark, sf, "rag_answers"), table(spark, sf, "gold_queries").select("evaluation_id")
    key = lambda d, c: d.select(F.col(c).alias("key"))
    return changes.violations({
        "chunk without document": key(chunks.join(documents.select("document_id"), "document_id", "left_anti"), "chunk_id"),
        "stale hash": key(chunks.where(stale), "chunk_id"),
        "visibility spelling": key(chunks.where(~F.col("visibility").isin("SHARED", "SCOPED")), "chunk_id"),
        "reversed pages": key(chunks.where("page_start > page_end"), "chunk_id"),
        "document without size": key(documents.where("byte_size IS NULL"), "document_id"),
        "answer without query": key(answers.where("evaluation_id IS NOT NULL").join(gold, "evaluation_id", "left_anti"), "trace_id"),
    }, "key")


@query("""SELECT evaluation_id, len(expected_canonical_chunk_ids) <> len(list_distinct(expected_canonical_chunk_ids)) AS repeated, len(expected_canonical_chunk_ids) = 0 AS empty,
    assessment_date IS NULL AS undated, tags IS NULL AS untagged, specialist_scope NOT IN ('credit', 'risk_management', 'legal_compliance', 'customer_relationship', 'collateral_appraisal') AS scope_spelling FROM gold_queries
    WHERE len(expected_canonical_chunk_ids) <> len(list_distinct(expected_canonical_chunk_ids)) OR len(expected_canonical_chunk_ids) = 0 OR assessment_date IS NULL OR tags IS NULL
        OR specialist_scope NOT IN ('credit', 'risk_management', 'legal_compliance', 'customer_relationship', 'collateral_appraisal')""")
def gold_violations(spark, sf):
    ids = F.col("expected_canonical_chunk_ids")
    flags = {"repeated": F.size(ids) != F.size(F.array_distinct(ids)), "empty": F.size(ids) == 0, "undated": F.col("assessment_date").isNull(), "untagged": F.col("tags").isNull(),
             "scope_spelling": ~F.col("specialist_scope").isin("credit", "risk_management", "legal_compliance", "customer_relationship", "collateral_appraisal")}
    return table(spark, sf, "gold_queries").withColumns(flags).where(" OR ".join(flags)).select("evaluation_id", *flags)


_DELIVERIES = """WITH d AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id, run ORDER BY ingested_at NULLS LAST, trace_id) AS first_of, row_number() OVER (PARTITION BY evaluation_id, run ORDER BY ingested_at DESC NULLS LAST, trace_id DESC) AS last_of FROM rag_answers)
"""
_COMPARED = ("answer", "source", "generator_model", "completion_tokens", "abstention_detected", "generation_error")


@query(_DELIVERIES + "SELECT a.evaluation_id, a.run, list_filter([" + ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in _COMPARED) + """], lambda x: x IS NOT NULL) AS changed
    FROM d a JOIN d b ON a.evaluation_id = b.evaluation_id AND a.run = b.run WHERE a.first_of = 1 AND b.last_of = 1 AND a.trace_id <> b.trace_id""")
def redelivered_answers(spark, sf):
    """First against last delivery of each answer that came again: which columns changed."""
    rows = table(spark, sf, "rag_answers").select("evaluation_id", "run", "trace_id", "ingested_at", *_COMPARED)
    by = Window.partitionBy("evaluation_id", "run")
    one = lambda *order: rows.withColumn("n", F.row_number().over(by.orderBy(*order))).where("n = 1").drop("n")
    first, last = one(F.asc_nulls_last("ingested_at"), "trace_id"), one(F.desc_nulls_last("ingested_at"), F.desc("trace_id"))
    again = first.select("evaluation_id", "run", "trace_id").join(last.select("evaluation_id", "run", F.col("trace_id").alias("last")), ["evaluation_id", "run"]).where("trace_id <> last")
    keys = again.select("evaluation_id", "run")
    found = changes.changed_columns(first.join(keys, ["evaluation_id", "run"], "left_semi"), last.join(keys, ["evaluation_id", "run"], "left_semi"), ["evaluation_id", "run"], list(_COMPARED))
    return found.select("evaluation_id", "run", "changed")


_RUN = "(SELECT retrieval_source, evaluation_id, canonical_chunk_id, max(score) AS score FROM ranked_results WHERE run = {} AND isfinite(score) AND canonical_chunk_id IS NOT NULL GROUP BY ALL)"


@query(f"""SELECT s.retrieval_source, CASE WHEN e.score IS NULL THEN 'NEW' WHEN e.score = s.score THEN 'SAME' ELSE 'CONFLICT' END AS state, count(*) AS items
    FROM {_RUN.format(2)} s LEFT JOIN {_RUN.format(1)} e USING (retrieval_source, evaluation_id, canonical_chunk_id) GROUP BY ALL""")
def upsert_states(spark, sf):
    """The second run staged against the first: what an insert that never overwrites would do."""
    rows = table(spark, sf, "ranked_results").where(F.col("canonical_chunk_id").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))))
    keys = ["retrieval_source", "evaluation_id", "canonical_chunk_id"]
    state = lambda r: rows.where(F.col("run") == r).groupBy(*keys).agg(F.max("score").alias("score"))
    return changes.upsert_plan(state(1), state(2), keys, ["score"]).groupBy("retrieval_source", "state").agg(F.count("*").alias("items"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY document_source_id, sha256(content) ORDER BY served_at NULLS LAST, evidence_id) AS n FROM evidence WHERE content IS NOT NULL)
    SELECT document_source_id, count(*) FILTER (n = 1) AS inserted, count(*) FILTER (n > 1) AS duplicates FROM t GROUP BY ALL""")
def ingest_duplicates(spark, sf):
    """Passages of each source that an ingest would store once, and the deliveries that it would count as duplicates."""
    g = table(spark, sf, "evidence").where("content IS NOT NULL").groupBy("document_source_id", F.sha2("content", 256).alias("h")).agg(F.count("*").alias("n"))
    return g.groupBy("document_source_id").agg(F.count("*").alias("inserted"), F.sum(F.col("n") - 1).alias("duplicates"))


@query("""(SELECT sha256(content) AS content_hash, 'a' AS side FROM policy_chunks WHERE is_synthetic EXCEPT ALL SELECT sha256(content), 'a' FROM evidence WHERE provenance = 'synthetic_policy')
    UNION ALL (SELECT sha256(content), 'b' FROM evidence WHERE provenance = 'synthetic_policy' EXCEPT ALL SELECT sha256(content), 'b' FROM policy_chunks WHERE is_synthetic)""")
def synthetic_difference(spark, sf):
    """Synthetic passages that are stored but never served, or served otherwise than stored; with multiplicity."""
    stored = table(spark, sf, "policy_chunks").where("is_synthetic").select(F.sha2("content", 256).alias("content_hash"))
    served = table(spark, sf, "evidence").where("provenance = 'synthetic_policy'").select(F.sha2("content", 256).alias("content_hash"))
    return changes.difference(stored, served)


@query("""SELECT sha256(content) AS content_hash FROM policy_chunks WHERE is_synthetic INTERSECT SELECT sha256(content) FROM policy_chunks WHERE NOT is_synthetic""")
def synthetic_overlap(spark, sf):
    """Contents that are both real and synthetic."""
    rows = table(spark, sf, "policy_chunks").select("is_synthetic", F.sha2("content", 256).alias("content_hash"))
    return rows.where("is_synthetic").select("content_hash").intersect(rows.where("NOT is_synthetic").select("content_hash"))


@query("""WITH u AS (SELECT DISTINCT unnest(expected_canonical_chunk_ids) AS id FROM gold_queries), s AS (SELECT DISTINCT canonical_chunk_id AS id FROM ranked_results WHERE retrieval_source = 'vector')
    SELECT id FROM u EXCEPT SELECT id FROM s""")
def never_retrieved(spark, sf):
    """Expected passages that vector retrieval never returned."""
    wanted = table(spark, sf, "gold_queries").select(F.explode("expected_canonical_chunk_ids").alias("id"))
    seen = table(spark, sf, "ranked_results").where("retrieval_source = 'vector'").select(F.col("canonical_chunk_id").alias("id"))
    return wanted.subtract(seen)


@query("""SELECT 'canonical' AS key_kind, canonical_chunk_id AS key, count(*) AS copies FROM policy_chunks WHERE canonical_chunk_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'document and content', document_id || ':' || content_hash, count(*) FROM policy_chunks WHERE document_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def broken_unique_keys(spark, sf):
    """Keys that must be unique where they aren't null."""
    rows = table(spark, sf, "policy_chunks")
    one = lambda d, kind, key: d.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select(F.lit(kind).alias("key_kind"), "key", "copies")
    return one(rows.where("canonical_chunk_id IS NOT NULL"), "canonical", F.col("canonical_chunk_id")).unionByName(
        one(rows.where("document_id IS NOT NULL"), "document and content", F.concat_ws(":", "document_id", "content_hash")))


@query("""SELECT g.evaluation_id, list_sort(list(DISTINCT flag)) AS leaks FROM (
    SELECT g.evaluation_id, unnest(list_filter([CASE WHEN contains(g.query, c.canonical_chunk_id) THEN 'id' END, CASE WHEN contains(lower(g.query), lower(c.content))
            OR (length(g.query) >= 80 AND len(list_filter(range(1, length(lower(g.query)) - 78), lambda i: contains(lower(c.content), substr(lower(g.query), i, 80)))) > 0) THEN 'excerpt' END,
        CASE WHEN contains(lower(g.query), lower(c.article)) THEN 'heading' END, CASE WHEN contains(lower(c.content), lower(rtrim(g.query, '?'))) THEN 'question' END], lambda x: x IS NOT NULL)) AS flag, g.evaluation_id AS e
    FROM (SELECT evaluation_id, query, unnest(expected_canonical_chunk_ids) AS canonical_chunk_id FROM gold_queries) g JOIN policy_chunks c USING (canonical_chunk_id)) g GROUP BY ALL""")
def leaking_questions(spark, sf):
    """Questions that give their answer away: the id, a stretch of 80 characters from anywhere in an expected passage (or all of a
    shorter one), its heading, or a passage that holds the question."""
    gold = table(spark, sf, "gold_queries").select("evaluation_id", "query", F.explode("expected_canonical_chunk_ids").alias("canonical_chunk_id"))
    chunks = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "content", "article")
    q = F.lower("query")
    flags = F.array_compact(F.array(
        F.when(F.col("query").contains(F.col("canonical_chunk_id")), "id"), F.when(copied_stretch(q, F.lower("content")), "excerpt"),
        F.when(q.contains(F.lower("article")), "heading"), F.when(F.lower("content").contains(F.lower(F.rtrim("query", F.lit("?")))), "question")))
    found = gold.join(chunks, "canonical_chunk_id").select("evaluation_id", F.explode(flags).alias("flag"))
    return found.groupBy("evaluation_id").agg(F.sort_array(F.collect_set("flag")).alias("leaks"))


# graphs

_TREE = """WITH RECURSIVE paths AS (SELECT DISTINCT source_id || '|' || version_id AS root, heading_path FROM policy_chunks WHERE len(heading_path) > 0),
    edges AS (SELECT DISTINCT root || '|' || array_to_string(heading_path[1:i], '|') AS node, CASE WHEN i = 1 THEN root ELSE root || '|' || array_to_string(heading_path[1:i - 1], '|') END AS parent
        FROM paths, unnest(range(1, len(heading_path) + 1)) t(i)),
    up AS (SELECT node, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT u.node, e.parent, u.depth + 1 FROM up u JOIN edges e ON e.node = u.ancestor)
"""


def _tree(spark, sf):
    """Edges from each heading to the one above it; the document's version is the root."""
    paths = table(spark, sf, "policy_chunks").where(F.size("heading_path") > 0).select(F.concat_ws("|", "source_id", "version_id").alias("root"), "heading_path").distinct()
    level = F.explode(F.sequence(F.lit(1), F.size("heading_path"))).alias("i")
    upto = lambda n: F.concat_ws("|", "root", F.array_join(F.slice("heading_path", F.lit(1), n), "|"))
    each = paths.select("root", "heading_path", level)
    return each.select(upto(F.col("i")).alias("node"), F.when(F.col("i") == 1, F.col("root")).otherwise(upto(F.col("i") - 1)).alias("parent")).distinct()


@query(_TREE + "SELECT node, ancestor, max(depth) AS depth FROM up GROUP BY ALL")
def heading_ancestors(spark, sf):
    """The transitive closure of the headings."""
    return graph.ancestors(_tree(spark, sf))


@query(_TREE + """SELECT layer, count(*) AS nodes FROM (SELECT n.node, coalesce(max(depth), 0) AS layer FROM (SELECT node FROM edges UNION SELECT parent FROM edges) n LEFT JOIN up u ON u.node = n.node GROUP BY ALL) GROUP BY ALL""")
def heading_layers(spark, sf):
    return graph.layers(_tree(spark, sf)).groupBy("layer").agg(F.count("*").alias("nodes"))


@query(_TREE + "SELECT node, count(DISTINCT parent) AS parents FROM edges GROUP BY ALL HAVING count(DISTINCT parent) > 1")
def headings_with_two_parents(spark, sf):
    return _tree(spark, sf).groupBy("node").agg(F.count_distinct("parent").alias("parents")).where("parents > 1")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT evaluation_id AS a, unnest(expected_canonical_chunk_ids) AS b FROM gold_queries),
    both_ways AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT x AS node, x AS seen FROM both_ways UNION SELECT r.node, w.y FROM reach r JOIN both_ways w ON w.x = r.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY ALL""")
def query_components(spark, sf):
    """Queries and expected passages that hang together."""
    edges = table(spark, sf, "gold_queries").select(F.col("evaluation_id").alias("a"), F.explode("expected_canonical_chunk_ids").alias("b"))
    return graph.components(edges)
