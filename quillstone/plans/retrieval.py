"""Search over the corpus: vectors, words, fusion. Queries are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import vectors as vec
from quillstone.operators import fulltext as ft
from quillstone.operators import retrieval as rt
from quillstone.operators import evaluation as ev
from quillstone.plans.common import ACCESS, DIM, RUNS, USABLE, access, runs, items_of_runs
from quillstone.plans.registry import query
from quillstone.session import table

_SEARCH = f"""
    WITH {USABLE},
    found AS (
        SELECT q.chunk_id AS query_id, c.chunk_id AS id, list_cosine_similarity(q.v, c.v) AS similarity
        FROM usable q JOIN usable c ON q.chunk_id <> c.chunk_id WHERE q.chunk_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rank FROM found)
"""


def _nearest(spark, sf, k):
    corpus = table(spark, sf, "policy_chunks").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    return vec.search(corpus.where("id % 100 = 0").withColumnRenamed("id", "query_id"), corpus, k, DIM)


@query(_SEARCH + "SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 10")
def vector_topk(spark, sf):
    """Exact cosine: the ten nearest of each query vector."""
    return _nearest(spark, sf, 10).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {USABLE}, {ACCESS},
    seen AS (SELECT * FROM usable u WHERE upper(visibility) = 'SHARED' OR EXISTS (SELECT 1 FROM access a WHERE a.source_id = u.source_id AND a.scope = 'credit')),
    found AS (SELECT q.chunk_id AS query_id, c.chunk_id AS id, list_cosine_similarity(q.v, c.v) AS similarity
              FROM usable q JOIN seen c ON q.chunk_id <> c.chunk_id WHERE q.chunk_id % 100 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rank FROM found)
    SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 5""")
def scoped_vector_topk(spark, sf):
    """Vector search of one scope: shared passages and the scoped ones that it may see; the filter comes before the limit."""
    chunks = table(spark, sf, "policy_chunks").select("chunk_id", "source_id", "visibility", "embedding")
    queries = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    seen = rt.visible(chunks, access(spark, sf), F.lit("credit"))
    found = vec.search(queries, seen.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector")), 5, DIM)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(_SEARCH + """, wide AS (SELECT * FROM ranked WHERE rank <= least(80, 4 * 5) AND similarity >= 0.5)
    SELECT query_id, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS rank
    FROM wide QUALIFY rank <= 5""")
def thresholded_topk(spark, sf):
    """Over-fetch four times, then the threshold, then the cut: the filter comes after the candidate limit."""
    wide = _nearest(spark, sf, 20).withColumn("s", F.round("similarity", 12)).drop("rank")
    return rt.over_fetch(wide, ["query_id"], "s", "id", 5, 0.5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {ACCESS}, scopes AS (SELECT DISTINCT scope FROM access)
    SELECT s.scope, count(*) AS visible, count(*) FILTER (upper(c.visibility) <> 'SHARED') AS scoped FROM scopes s JOIN policy_chunks c
    ON upper(c.visibility) = 'SHARED' OR EXISTS (SELECT 1 FROM access a WHERE a.source_id = c.source_id AND a.scope IS NOT DISTINCT FROM s.scope) GROUP BY ALL""")
def visible_per_scope(spark, sf):
    """How many passages each scope may see: counted by source before the join with the access rows."""
    chunks = table(spark, sf, "policy_chunks").groupBy("source_id").agg(
        F.count_if(F.upper("visibility") == "SHARED").alias("shared"), F.count_if(F.upper("visibility") != "SHARED").alias("scoped"))
    opened = access(spark, sf)
    own = opened.join(chunks, "source_id", "left").groupBy("scope").agg(F.coalesce(F.sum("scoped"), F.lit(0)).alias("scoped"))
    shared = chunks.agg(F.sum("shared")).scalar()
    return own.select("scope", (shared + F.col("scoped")).alias("visible"), "scoped")


@query("""SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 128 THEN 'dimension'
        WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite'
        WHEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) = 0 THEN 'zero' ELSE 'not unit' END AS defect
    FROM policy_chunks WHERE embedding IS NULL OR len(embedding) <> 128 OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
        OR abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) - 1) > 1e-4""")
def vector_defects(spark, sf):
    rows = table(spark, sf, "policy_chunks").select("chunk_id", vec.defect(F.col("embedding"), DIM).alias("defect"))
    return rows.where("defect IS NOT NULL")


@query(f"""WITH {USABLE}, n AS (SELECT source_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM usable)
    SELECT source_id, count(*) AS n, round(min(norm), 6) AS least, round(quantile_cont(norm, 0.5), 6) AS median, round(avg(norm), 6) AS mean,
        round(quantile_cont(norm, 0.95), 6) AS p95, round(max(norm), 6) AS most FROM n GROUP BY ALL""")
def norm_statistics(spark, sf):
    chunks = table(spark, sf, "policy_chunks").select("source_id", "embedding", vec.defect(F.col("embedding"), DIM).alias("defect"))
    n = chunks.where("defect IS NULL OR defect = 'not unit'").select("source_id", vec.norm(F.col("embedding")).alias("norm"))
    plain = n.groupBy("source_id").agg(F.round(F.min("norm"), 6).alias("least"), F.round(F.avg("norm"), 6).alias("mean"), F.round(F.max("norm"), 6).alias("most"))
    shares = ev.percentiles(n, ["source_id"], "norm", [0.5, 0.95]).withColumnsRenamed({"p50": "median", "source_id": "s"})
    return plain.join(shares, plain.source_id.eqNullSafe(shares.s)).select("source_id", "n", "least", "median", "mean", "p95", "most")


_FUSED = f"""WITH {RUNS},
    a AS (SELECT * FROM runs WHERE retrieval_source = 'vector' AND run = 1 AND rank <= 20),
    b AS (SELECT * FROM runs WHERE retrieval_source = 'fts' AND run = 1 AND rank <= 20),
    fused AS (SELECT coalesce(a.evaluation_id, b.evaluation_id) AS evaluation_id, coalesce(a.canonical_chunk_id, b.canonical_chunk_id) AS canonical_chunk_id,
        a.rank AS rank_a, b.rank AS rank_b, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS score
        FROM a FULL JOIN b ON a.evaluation_id = b.evaluation_id AND a.canonical_chunk_id = b.canonical_chunk_id)
"""


def _arms(spark, sf):
    r = runs(spark, sf, 20).where("run = 1").select("retrieval_source", "evaluation_id", "canonical_chunk_id", "rank")
    return r.where("retrieval_source = 'vector'"), r.where("retrieval_source = 'fts'")


@query(_FUSED + """SELECT evaluation_id, canonical_chunk_id, rank_a, rank_b, round(score, 9) AS score,
    row_number() OVER (PARTITION BY evaluation_id ORDER BY score DESC, canonical_chunk_id) AS rank FROM fused QUALIFY rank <= 10""")
def rank_fusion(spark, sf):
    """Vector and full-text lists fused by reciprocal ranks."""
    fused = rt.reciprocal_rank_fusion(*_arms(spark, sf), ["evaluation_id"], "canonical_chunk_id", k=10)
    return fused.withColumn("score", F.round("score", 9))


@query(f"""WITH {RUNS},
    parts AS (SELECT evaluation_id, canonical_chunk_id, 0 AS part, rank FROM runs WHERE retrieval_source = 'vector' AND run = 1 AND rank <= 20
        UNION ALL SELECT evaluation_id, canonical_chunk_id, 1, rank FROM runs WHERE retrieval_source = 'fts' AND run = 1 AND rank <= 10),
    firsts AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY evaluation_id, canonical_chunk_id ORDER BY part, rank) = 1)
    SELECT evaluation_id, canonical_chunk_id, part, row_number() OVER (PARTITION BY evaluation_id ORDER BY part, rank, canonical_chunk_id) AS position FROM firsts""")
def candidate_union(spark, sf):
    """The first twenty of vector, then what the first ten of full text add."""
    vector, words = _arms(spark, sf)
    return rt.ordered_union([vector, words.where("rank <= 10")], ["evaluation_id"], "canonical_chunk_id")


@query(f"""WITH {RUNS}
    SELECT v.evaluation_id, v.canonical_chunk_id, r.score, row_number() OVER (PARTITION BY v.evaluation_id ORDER BY r.score DESC, v.canonical_chunk_id) AS place
    FROM runs v JOIN runs r ON r.evaluation_id = v.evaluation_id AND r.canonical_chunk_id = v.canonical_chunk_id
    WHERE v.retrieval_source = 'vector' AND v.run = 1 AND v.rank <= 20 AND r.retrieval_source = 'reranker' AND r.run = 1 QUALIFY place <= 5""")
def reranked(spark, sf):
    """Candidates of vector retrieval in the order of the reranker's scores, five of each."""
    candidates = runs(spark, sf, 20).where("run = 1 AND retrieval_source = 'vector'").select("evaluation_id", "canonical_chunk_id")
    scores = items_of_runs(spark, sf).where("run = 1 AND retrieval_source = 'reranker'").select("evaluation_id", "canonical_chunk_id", "score")
    return rt.rerank(candidates, scores, ["evaluation_id"], "canonical_chunk_id", "score", 5).withColumnRenamed("rank", "place")


@query(f"""WITH {RUNS} SELECT r.evaluation_id, r.rank, r.canonical_chunk_id, d.title, c.source_id, upper(c.visibility) AS visibility,
    CASE WHEN d.is_synthetic THEN 'synthetic' ELSE 'real' END AS provenance, array_to_string(c.heading_path, ' > ') AS heading
    FROM runs r JOIN policy_chunks c USING (canonical_chunk_id) JOIN policy_documents d USING (document_id)
    WHERE r.retrieval_source = 'hybrid' AND r.run = 1 AND r.rank <= 5""")
def evidence_rows(spark, sf):
    """What a consumer gets: each served item with its chunk and document."""
    r = runs(spark, sf, 5).where("retrieval_source = 'hybrid' AND run = 1")
    chunks = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "document_id", "source_id", "visibility", "heading_path")
    documents = table(spark, sf, "policy_documents").select("document_id", "title", "is_synthetic")
    return r.join(chunks, "canonical_chunk_id").join(documents, "document_id").select(
        "evaluation_id", "rank", "canonical_chunk_id", "title", "source_id", F.upper("visibility").alias("visibility"),
        F.when(F.col("is_synthetic"), "synthetic").otherwise("real").alias("provenance"), F.array_join("heading_path", " > ").alias("heading"))


_INDEX = """
    WITH posted AS (
        SELECT chunk_id AS id, 'B' AS weight, unnest(regexp_extract_all(lower(array_to_string(heading_path, ' ')), '[\\p{L}\\p{N}]+')) AS term FROM policy_chunks
        UNION ALL SELECT chunk_id, 'C', unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) FROM policy_chunks),
    idx AS (SELECT id, term, count(*) FILTER (weight = 'B') AS tf_b, count(*) FILTER (weight = 'C') AS tf_c FROM posted GROUP BY ALL),
    terms AS (SELECT evaluation_id AS query_id, unnest(t) AS term, len(t) AS terms FROM (
        SELECT evaluation_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS t FROM gold_queries
        WHERE regexp_extract(evaluation_id, '(\\d+)$', 1)::BIGINT % 100 = 0)),
    found AS (SELECT query_id, id, count(*) AS matched, any_value(terms) AS terms, round(sum(
        0.4 * CASE WHEN tf_b > 0 THEN 1 + ln(tf_b) ELSE 0 END + 0.2 * CASE WHEN tf_c > 0 THEN 1 + ln(tf_c) ELSE 0 END), 6) AS score
        FROM idx JOIN terms USING (term) GROUP BY ALL)
"""


_FIELDS = {"heading": "B", "content": "C"}


def _chunks(spark, sf):
    return table(spark, sf, "policy_chunks").select("chunk_id", F.array_join("heading_path", " ").alias("heading"), "content")


def _index(spark, sf):
    return ft.postings(_chunks(spark, sf), "chunk_id", _FIELDS)


def _terms(spark, sf):
    gold = table(spark, sf, "gold_queries").where(F.regexp_extract("evaluation_id", r"(\d+)$", 1).cast("long") % 100 == 0)
    return ft.query_terms(gold, "evaluation_id", "query")


@query(_INDEX + "SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found QUALIFY rank <= 10")
def fulltext_any(spark, sf):
    """Any term matches; weighted, dampened occurrences."""
    return ft.search(_chunks(spark, sf), "chunk_id", _FIELDS, _terms(spark, sf), "or", 10)


@query(_INDEX + "SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found WHERE matched = terms QUALIFY rank <= 10")
def fulltext_all(spark, sf):
    """Every term must match."""
    return ft.search(_chunks(spark, sf), "chunk_id", _FIELDS, _terms(spark, sf), "and", 10)


@query(_INDEX + "SELECT term, count(*) AS documents, sum(tf_b + tf_c) AS occurrences FROM idx GROUP BY ALL")
def term_statistics(spark, sf):
    """Document and occurrence counts of every term."""
    tf = ft.term_frequencies(_index(spark, sf))
    return tf.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.col("tf_a") + F.col("tf_b") + F.col("tf_c")).alias("occurrences"))


@query(_INDEX + "SELECT term, count(*) AS documents, sum(tf_b + tf_c) AS occurrences FROM idx GROUP BY ALL")
def refreshed_terms(spark, sf):
    """Term counts after the newer half of the chunks was indexed again over a stale index of half of their text."""
    chunks = table(spark, sf, "policy_chunks").select("chunk_id", F.array_join("heading_path", " ").alias("heading"), "content", (F.dayofmonth("created_at") > 15).alias("newer"))
    newer = F.coalesce("newer", F.lit(False))
    stale = chunks.withColumn("content", F.when(newer, F.left("content", F.lit(40))).otherwise(F.col("content")))
    fresh = chunks.where(newer)
    index = ft.refreshed(ft.term_frequencies(ft.postings(stale, "chunk_id", _FIELDS)), fresh.select(F.col("chunk_id").alias("id")), ft.postings(fresh, "chunk_id", _FIELDS))
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.col("tf_a") + F.col("tf_b") + F.col("tf_c")).alias("occurrences"))


_TITLED_INDEX = """
    WITH titled AS (SELECT c.chunk_id, d.title, array_to_string(c.heading_path, ' ') AS heading, c.content FROM policy_chunks c LEFT JOIN policy_documents d ON d.document_id = c.document_id),
    posted AS (
        SELECT chunk_id AS id, 'A' AS weight, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS term FROM titled
        UNION ALL SELECT chunk_id, 'B', unnest(regexp_extract_all(lower(heading), '[\\p{L}\\p{N}]+')) FROM titled
        UNION ALL SELECT chunk_id, 'C', unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) FROM titled),
    idx AS (SELECT id, term, count(*) FILTER (weight = 'A') AS tf_a, count(*) FILTER (weight = 'B') AS tf_b, count(*) FILTER (weight = 'C') AS tf_c FROM posted GROUP BY ALL),
    terms AS (SELECT evaluation_id AS query_id, unnest(t) AS term, len(t) AS terms FROM (
        SELECT evaluation_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS t FROM gold_queries
        WHERE regexp_extract(evaluation_id, '(\\d+)$', 1)::BIGINT % 100 = 0)),
    found AS (SELECT query_id, id, count(*) AS matched, any_value(terms) AS terms, round(sum(1.0 * CASE WHEN tf_a > 0 THEN 1 + ln(tf_a) ELSE 0 END
        + 0.4 * CASE WHEN tf_b > 0 THEN 1 + ln(tf_b) ELSE 0 END + 0.2 * CASE WHEN tf_c > 0 THEN 1 + ln(tf_c) ELSE 0 END), 6) AS score
        FROM idx JOIN terms USING (term) GROUP BY ALL)
"""


_TITLED = {"title": "A", **_FIELDS}


def _titled(spark, sf):
    """Chunks with the title of their document, if it is known."""
    chunks = table(spark, sf, "policy_chunks").select("chunk_id", "document_id", F.array_join("heading_path", " ").alias("heading"), "content")
    return chunks.join(table(spark, sf, "policy_documents").select("document_id", "title"), "document_id", "left")


@query(_TITLED_INDEX + "SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found QUALIFY rank <= 10")
def fulltext_titled_any(spark, sf):
    """``fulltext_any`` over titles too, the field of greatest weight."""
    return ft.search(_titled(spark, sf), "chunk_id", _TITLED, _terms(spark, sf), "or", 10)


@query(_TITLED_INDEX + "SELECT query_id, id, matched, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found WHERE matched = terms QUALIFY rank <= 10")
def fulltext_titled_all(spark, sf):
    """``fulltext_all`` over titles too."""
    return ft.search(_titled(spark, sf), "chunk_id", _TITLED, _terms(spark, sf), "and", 10)


@query(_TITLED_INDEX + "SELECT term, count(*) AS documents, sum(tf_a) AS in_titles, sum(tf_a + tf_b + tf_c) AS occurrences FROM idx GROUP BY ALL")
def titled_term_statistics(spark, sf):
    """``term_statistics`` over titles too."""
    tf = ft.term_frequencies(ft.postings(_titled(spark, sf), "chunk_id", _TITLED))
    return tf.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf_a").alias("in_titles"), F.sum(F.col("tf_a") + F.col("tf_b") + F.col("tf_c")).alias("occurrences"))


@query(_TITLED_INDEX + "SELECT term, count(*) AS documents, sum(tf_a) AS in_titles, sum(tf_a + tf_b + tf_c) AS occurrences FROM idx GROUP BY ALL")
def retitled_terms(spark, sf):
    """Term counts after some documents got longer titles: all chunks of such a document are indexed again."""
    chunks = _titled(spark, sf)
    retitled = F.coalesce(F.length("title") > 20, F.lit(False))
    stale = chunks.withColumn("title", F.when(retitled, F.left("title", F.lit(20))).otherwise(F.col("title")))
    fresh = chunks.where(retitled)
    index = ft.refreshed(ft.term_frequencies(ft.postings(stale, "chunk_id", _TITLED)), fresh.select(F.col("chunk_id").alias("id")), ft.postings(fresh, "chunk_id", _TITLED))
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf_a").alias("in_titles"), F.sum(F.col("tf_a") + F.col("tf_b") + F.col("tf_c")).alias("occurrences"))


@query()
def fulltext_cover_density(spark, sf):
    """Titles, headings and contents in which all terms of a query stand close together (any of them where no chunk holds all), ranked by cover density."""
    return ft.cover_search(_titled(spark, sf), "chunk_id", _TITLED, _terms(spark, sf), 10)
