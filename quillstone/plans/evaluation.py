"""Evaluation of retrieval runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import evaluation as ev
from quillstone.plans.common import LIST, RUNS, items_of_runs, runs
from quillstone.plans.registry import query
from quillstone.session import table

BY = ["retrieval_source", "run"]
_METRICS = f"""
    WITH {RUNS},
    sizes AS (SELECT DISTINCT evaluation_id, gold_size FROM gold),
    found AS (
        SELECT retrieval_source, run, evaluation_id, rank FROM runs JOIN gold USING (evaluation_id) WHERE item = canonical_chunk_id),
    lists AS (SELECT DISTINCT retrieval_source, run, evaluation_id FROM runs),
    ks AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
    ideal AS (SELECT k, g, (SELECT sum(1 / log2(r + 1)) FROM range(1, least(k, g) + 1) t(r)) AS idcg
              FROM ks, (SELECT DISTINCT gold_size AS g FROM sizes)),
    metrics AS (
        SELECT l.retrieval_source, l.run, l.evaluation_id, k,
            CASE WHEN count(f.rank) FILTER (f.rank <= k) > 0 THEN 1.0 ELSE 0.0 END AS hit,
            count(f.rank) FILTER (f.rank <= k) / any_value(s.gold_size)::DOUBLE AS recall,
            coalesce(1.0 / min(f.rank) FILTER (f.rank <= k), 0) AS mrr,
            coalesce(sum(1 / log2(f.rank + 1)) FILTER (f.rank <= k), 0) / any_value(i.idcg) AS ndcg
        FROM lists l JOIN sizes s USING (evaluation_id) CROSS JOIN ks JOIN ideal i USING (k)
        LEFT JOIN found f ON f.retrieval_source = l.retrieval_source AND f.run = l.run AND f.evaluation_id = l.evaluation_id
        WHERE i.g = s.gold_size GROUP BY ALL)
"""
_MEANS = "count(*) AS n, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"


def _gold(spark, sf):
    return ev.gold_items(table(spark, sf, "gold_queries"), "evaluation_id", "expected_canonical_chunk_ids")


def _metrics(spark, sf):
    found = ev.hits(runs(spark, sf, 20), _gold(spark, sf), BY, "evaluation_id", "canonical_chunk_id")
    return ev.metrics_at(found, BY, "evaluation_id", [1, 3, 5, 10, 20])


@query(_METRICS + f"SELECT retrieval_source, run, k, {_MEANS} FROM metrics GROUP BY ALL")
def ranking_metrics(spark, sf):
    """Hit, recall, MRR and nDCG of every source and run at 1, 3, 5, 10 and 20."""
    return ev.breakdown(_metrics(spark, sf), [*BY, "k"])


@query(_METRICS + "SELECT retrieval_source, run, evaluation_id, k, round(hit, 6) AS hit, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM metrics WHERE k = 5")
def metrics_per_query(spark, sf):
    m = _metrics(spark, sf).where("k = 5")
    return m.select(*BY, "evaluation_id", "k", *(F.round(c, 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")))


@query(_METRICS + f"""SELECT lower(specialist_scope) AS scope, query_type, retrieval_source, {_MEANS}
    FROM metrics JOIN gold_queries USING (evaluation_id) WHERE k = 5 GROUP BY ALL""")
def metrics_by_scope(spark, sf):
    about = table(spark, sf, "gold_queries").select("evaluation_id", F.lower("specialist_scope").alias("scope"), "query_type")
    return ev.breakdown(_metrics(spark, sf).where("k = 5").join(about, "evaluation_id"), ["scope", "query_type", "retrieval_source"])


@query(f"""WITH {RUNS},
    found AS (SELECT retrieval_source, run, evaluation_id, min(rank) AS first_rank FROM runs JOIN gold USING (evaluation_id)
              WHERE item = canonical_chunk_id GROUP BY ALL),
    lists AS (SELECT DISTINCT retrieval_source, run, evaluation_id FROM runs WHERE evaluation_id IN (SELECT evaluation_id FROM gold))
    SELECT retrieval_source, run, CASE WHEN first_rank <= 10 THEN '1-10' WHEN first_rank <= 20 THEN '11-20' WHEN first_rank > 20 THEN '>20' ELSE 'absent' END AS bucket,
        count(*) AS queries FROM lists LEFT JOIN found USING (retrieval_source, run, evaluation_id) GROUP BY ALL""")
def first_rank_buckets(spark, sf):
    """Where the first expected passage stands. Only the first twenty are ranked; below, being there is enough."""
    gold, items = _gold(spark, sf), items_of_runs(spark, sf)
    found = ev.hits(runs(spark, sf, 20), gold, BY, "evaluation_id", "canonical_chunk_id")
    there = items.join(gold.select("evaluation_id", F.col("item").alias("canonical_chunk_id")), ["evaluation_id", "canonical_chunk_id"]).select(*LIST).distinct().withColumn("there", F.lit(True))
    first = F.try_element_at("ranks", F.lit(1))
    bucket = F.when(first <= 10, "1-10").when(first <= 20, "11-20").when(F.col("there"), ">20").otherwise("absent")
    return found.join(there, LIST, "left").groupBy(*BY, bucket.alias("bucket")).agg(F.count("*").alias("queries"))


@query(f"""WITH {RUNS},
    sizes AS (SELECT DISTINCT evaluation_id, gold_size FROM gold),
    depths AS (SELECT unnest([5, 10, 20, 50]) AS depth),
    lists AS (SELECT retrieval_source, evaluation_id, depth, count(*) FILTER (rank <= depth) AS candidates
              FROM runs CROSS JOIN depths WHERE run = 1 GROUP BY ALL),
    found AS (SELECT retrieval_source, evaluation_id, depth, count(*) AS hits FROM runs JOIN gold USING (evaluation_id) CROSS JOIN depths
              WHERE item = canonical_chunk_id AND run = 1 AND rank <= depth GROUP BY ALL)
    SELECT retrieval_source, depth, count(*) AS queries, round(avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit,
        round(avg(coalesce(hits, 0) / gold_size::DOUBLE), 6) AS recall, round(avg(candidates), 6) AS candidates
    FROM lists JOIN sizes USING (evaluation_id) LEFT JOIN found USING (retrieval_source, evaluation_id, depth) GROUP BY ALL""")
def candidate_coverage(spark, sf):
    """Hit, recall and number of candidates at depths 5 to 50, first run."""
    r = runs(spark, sf, 50).where("run = 1")
    found = ev.hits(r, _gold(spark, sf), ["retrieval_source"], "evaluation_id", "canonical_chunk_id")
    sizes = r.groupBy("retrieval_source", "evaluation_id").agg(F.count("*").alias("length"))
    each = found.join(sizes, ["retrieval_source", "evaluation_id"]).withColumn("depth", F.explode(F.array(*map(F.lit, (5, 10, 20, 50)))))
    inside = F.size(F.filter("ranks", lambda x: x <= F.col("depth")))
    return each.groupBy("retrieval_source", "depth").agg(
        F.count("*").alias("queries"), F.round(F.avg(F.when(inside > 0, 1.0).otherwise(0.0)), 6).alias("hit"),
        F.round(F.avg(inside / F.col("gold_size")), 6).alias("recall"), F.round(F.avg(F.least("length", "depth")), 6).alias("candidates"))


_PAIR = f"""WITH {RUNS},
    x AS (SELECT * FROM runs WHERE run = 1 AND rank <= 10), y AS (SELECT * FROM runs WHERE run = 2 AND rank <= 10),
    pairs AS (
        SELECT coalesce(x.retrieval_source, y.retrieval_source) AS retrieval_source, coalesce(x.evaluation_id, y.evaluation_id) AS evaluation_id,
            x.rank AS rank_a, y.rank AS rank_b, x.score AS score_a, y.score AS score_b
        FROM x FULL JOIN y ON x.retrieval_source = y.retrieval_source AND x.evaluation_id = y.evaluation_id AND x.canonical_chunk_id = y.canonical_chunk_id),
    compared AS (
        SELECT retrieval_source, evaluation_id,
            round(count(*) FILTER (rank_a IS NOT NULL AND rank_b IS NOT NULL) / greatest(count(rank_a), count(rank_b))::DOUBLE, 6) AS overlap,
            count(*) FILTER (rank_a = rank_b) AS same_position, round(max(abs(score_a - score_b)), 6) AS score_drift
        FROM pairs GROUP BY ALL)
"""


def _repeated(spark, sf):
    r = runs(spark, sf, 10)
    return ev.agreement(r.where("run = 1"), r.where("run = 2"), ["retrieval_source", "evaluation_id"], "canonical_chunk_id", 10)


@query(_PAIR + "SELECT * FROM compared")
def run_agreement(spark, sf):
    """First against second run: overlap of the ten best, equal positions, drift of scores."""
    return _repeated(spark, sf)


@query(_PAIR + """SELECT retrieval_source, count(*) AS queries, round(min(overlap), 6) AS overlap_min, round(avg(overlap), 6) AS overlap_mean,
    round(max(overlap), 6) AS overlap_max, max(score_drift) AS drift_max, round(avg(score_drift), 6) AS drift_mean FROM compared GROUP BY ALL""")
def repeatability(spark, sf):
    return _repeated(spark, sf).groupBy("retrieval_source").agg(
        F.count("*").alias("queries"), F.round(F.min("overlap"), 6).alias("overlap_min"), F.round(F.avg("overlap"), 6).alias("overlap_mean"),
        F.round(F.max("overlap"), 6).alias("overlap_max"), F.max("score_drift").alias("drift_max"), F.round(F.avg("score_drift"), 6).alias("drift_mean"))


@query(f"""WITH {RUNS},
    first AS (SELECT retrieval_source, evaluation_id, min(rank) AS rank FROM runs JOIN gold USING (evaluation_id)
              WHERE item = canonical_chunk_id AND run = 1 AND rank <= 20 GROUP BY ALL),
    both_arms AS (SELECT q.evaluation_id, a.rank AS rank_before, b.rank AS rank_after FROM (SELECT DISTINCT evaluation_id FROM gold) q
        LEFT JOIN first a ON a.evaluation_id = q.evaluation_id AND a.retrieval_source = 'vector'
        LEFT JOIN first b ON b.evaluation_id = q.evaluation_id AND b.retrieval_source = 'reranker')
    SELECT *, CASE WHEN rank_before IS NULL AND rank_after IS NULL THEN 'UNRECOVERABLE'
        WHEN rank_before IS NULL OR rank_after < rank_before THEN 'IMPROVED'
        WHEN rank_after IS NULL OR rank_after > rank_before THEN 'WORSENED' ELSE 'UNCHANGED' END AS change FROM both_arms""")
def rerank_changes(spark, sf):
    """Vector against reranker: what reranking did to the first expected passage."""
    r = runs(spark, sf, 20).where("run = 1")
    return ev.rank_changes(r.where("retrieval_source = 'vector'"), r.where("retrieval_source = 'reranker'"), _gold(spark, sf), "evaluation_id", "canonical_chunk_id")


@query(f"""WITH {RUNS},
    top AS (SELECT * FROM runs WHERE run = 1 AND rank <= 5),
    state AS (SELECT q.evaluation_id,
        bool_or(r.canonical_chunk_id IN (SELECT item FROM gold g WHERE g.evaluation_id = q.evaluation_id) AND r.rank <= 5) AS in_top,
        bool_or(r.canonical_chunk_id IN (SELECT item FROM gold g WHERE g.evaluation_id = q.evaluation_id)) AS in_list, count(r.rank) AS n
        FROM (SELECT DISTINCT evaluation_id FROM gold) q LEFT JOIN runs r ON r.evaluation_id = q.evaluation_id AND r.run = 1 AND r.retrieval_source = 'vector' GROUP BY ALL),
    near AS (SELECT DISTINCT t.evaluation_id FROM top t JOIN policy_chunks c USING (canonical_chunk_id) JOIN gold g USING (evaluation_id)
        JOIN policy_chunks e ON e.canonical_chunk_id = g.item WHERE t.retrieval_source = 'vector' AND e.source_id = c.source_id)
    SELECT evaluation_id, CASE WHEN n = 0 THEN 'NO_RESULT' WHEN in_top THEN 'FOUND' WHEN in_list THEN 'RANKED_TOO_LOW'
        WHEN evaluation_id IN (SELECT evaluation_id FROM near) THEN 'RIGHT_SOURCE' ELSE 'WRONG_SOURCE' END AS miss FROM state""")
def miss_classes(spark, sf):
    """Why an expected passage isn't among the first five of vector retrieval: ordered rules, the first that holds."""
    gold = _gold(spark, sf)
    wanted_items = gold.select("evaluation_id", F.col("item").alias("canonical_chunk_id"))
    items = items_of_runs(spark, sf).where("run = 1 AND retrieval_source = 'vector'").select("evaluation_id", "canonical_chunk_id")
    r = runs(spark, sf, 5).where("run = 1 AND retrieval_source = 'vector'").select("evaluation_id", "canonical_chunk_id", "rank")
    source = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "source_id")
    found = r.join(wanted_items, ["evaluation_id", "canonical_chunk_id"]).groupBy("evaluation_id").agg(F.min("rank").alias("first"))
    size = items.groupBy("evaluation_id").agg(F.count("*").alias("n"))
    lower = items.join(wanted_items, ["evaluation_id", "canonical_chunk_id"]).select("evaluation_id").distinct().withColumn("lower", F.lit(True))
    served = r.join(source, "canonical_chunk_id").select("evaluation_id", "source_id")
    wanted = gold.join(source, gold.item == source.canonical_chunk_id).select("evaluation_id", "source_id")
    near = served.join(wanted, ["evaluation_id", "source_id"]).select("evaluation_id").distinct().withColumn("near", F.lit(True))
    state = gold.select("evaluation_id").distinct().join(size, "evaluation_id", "left").join(found, "evaluation_id", "left").join(lower, "evaluation_id", "left").join(near, "evaluation_id", "left")
    miss = (F.when(F.col("n").isNull(), "NO_RESULT").when(F.col("first").isNotNull(), "FOUND").when(F.col("lower"), "RANKED_TOO_LOW")
            .when(F.col("near"), "RIGHT_SOURCE").otherwise("WRONG_SOURCE"))
    return state.select("evaluation_id", miss.alias("miss"))


@query(f"""WITH {RUNS},
    lists AS (SELECT retrieval_source, evaluation_id, list(canonical_chunk_id ORDER BY rank) AS ids FROM runs WHERE run = 1 AND rank <= 5 GROUP BY ALL),
    sides AS (SELECT h.evaluation_id, h.ids AS hybrid, v.ids AS vector FROM lists h JOIN lists v USING (evaluation_id)
              WHERE h.retrieval_source = 'hybrid' AND v.retrieval_source = 'vector')
    SELECT evaluation_id, list_sort(list_filter(hybrid, lambda x: NOT list_contains(vector, x))) AS displacers,
        list_sort(list_filter(vector, lambda x: NOT list_contains(hybrid, x))) AS displaced FROM sides""")
def hybrid_displacements(spark, sf):
    """Items that fusion brought into the five best and those that it pushed out."""
    lists = runs(spark, sf, 5).where("run = 1").groupBy("retrieval_source", "evaluation_id").agg(F.collect_list("canonical_chunk_id").alias("ids"))
    side = lambda s: lists.where(F.col("retrieval_source") == s).select("evaluation_id", F.col("ids").alias(s))
    return side("hybrid").join(side("vector"), "evaluation_id").select(
        "evaluation_id", F.sort_array(F.array_except("hybrid", "vector")).alias("displacers"), F.sort_array(F.array_except("vector", "hybrid")).alias("displaced"))


@query("""WITH phases AS (
    SELECT generator_model, 'generation' AS phase, generation_latency_ms::DOUBLE AS ms FROM rag_answers
    UNION ALL SELECT generator_model, 'per_token', 1000 / tokens_per_second FROM rag_answers WHERE tokens_per_second > 0)
    SELECT generator_model, phase, count(ms) AS n, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95
    FROM phases WHERE ms IS NOT NULL GROUP BY ALL""")
def latency_percentiles(spark, sf):
    """Median and 95th percentile of each phase, long form."""
    answers = table(spark, sf, "rag_answers")
    per_token = F.when(F.col("tokens_per_second") > 0, F.lit(1000) / F.col("tokens_per_second"))
    each = answers.select("generator_model", F.explode(F.create_map(F.lit("generation"), F.col("generation_latency_ms").cast("double"), F.lit("per_token"), per_token)).alias("phase", "ms"))
    return ev.percentiles(each, ["generator_model", "phase"], "ms", [0.5, 0.95])


@query("""SELECT source, scope, count(*) AS answers, count(*) FILTER (abstention_detected) AS abstained, count(*) FILTER (generation_error IS NOT NULL) AS failed,
    count(*) FILTER (abstention_detected IS NULL) AS unknown, round(avg(technical_retries), 6) AS retries FROM rag_answers GROUP BY ALL""")
def answer_flags(spark, sf):
    return table(spark, sf, "rag_answers").groupBy("source", "scope").agg(
        F.count("*").alias("answers"), F.count_if("abstention_detected").alias("abstained"), F.count_if(F.col("generation_error").isNotNull()).alias("failed"),
        F.count_if(F.col("abstention_detected").isNull()).alias("unknown"), F.round(F.avg("technical_retries"), 6).alias("retries"))


@query("""WITH cited AS (
    SELECT trace_id, scope, list_distinct(list_transform(regexp_extract_all(answer, '\\[E(\\d+)\\]', 1), lambda x: x::INT)) AS ids FROM rag_answers WHERE answer IS NOT NULL)
    SELECT scope, count(*) AS answers, count(*) FILTER (len(ids) = 0) AS uncited,
        count(*) FILTER (len(list_filter(ids, lambda x: x < 1 OR x > 5)) > 0) AS invalid, sum(len(ids)) AS citations FROM cited GROUP BY ALL""")
def citation_structure(spark, sf):
    """Citations [E1] to [E5] of answers; others are invalid."""
    from quillstone.functions.text import citations

    cited = table(spark, sf, "rag_answers").where("answer IS NOT NULL").select("scope", citations(F.col("answer")).alias("ids"))
    return cited.groupBy("scope").agg(
        F.count("*").alias("answers"), F.count_if(F.size("ids") == 0).alias("uncited"),
        F.count_if(F.exists("ids", lambda x: (x < 1) | (x > 5))).alias("invalid"), F.sum(F.size("ids")).alias("citations"))


@query("""SELECT trace_id, evaluation_id, run FROM rag_answers QUALIFY row_number() OVER (PARTITION BY evaluation_id, run ORDER BY generated_at DESC NULLS LAST, trace_id DESC) = 1""")
def latest_answer(spark, sf):
    """The last delivery of each query and run."""
    rows = table(spark, sf, "rag_answers").select("trace_id", "evaluation_id", "run", "generated_at")
    return ev.top_of_each(rows, ["evaluation_id", "run"], [F.desc_nulls_last("generated_at"), F.desc("trace_id")]).select("trace_id", "evaluation_id", "run")


@query("""SELECT specialist_scope, status, query_type, count(*) AS queries, count(*) FILTER (len(tags) > 0) AS tagged,
    count(*) FILTER (assessment_date IS NULL) AS undated FROM gold_queries GROUP BY ALL""")
def gold_distribution(spark, sf):
    return table(spark, sf, "gold_queries").groupBy("specialist_scope", "status", "query_type").agg(
        F.count("*").alias("queries"), F.count_if(F.size("tags") > 0).alias("tagged"), F.count_if(F.col("assessment_date").isNull()).alias("undated"))


@query("""SELECT g.evaluation_id, list_sort(list(DISTINCT c.version_id)) AS contradicted FROM (SELECT evaluation_id, forbidden_version_ids,
    unnest(expected_canonical_chunk_ids) AS canonical_chunk_id FROM gold_queries) g JOIN policy_chunks c USING (canonical_chunk_id)
    WHERE list_contains(g.forbidden_version_ids, c.version_id) GROUP BY ALL""")
def gold_contradictions(spark, sf):
    """Queries that expect a passage of a version which they forbid."""
    gold = table(spark, sf, "gold_queries").select("evaluation_id", "forbidden_version_ids", F.explode("expected_canonical_chunk_ids").alias("canonical_chunk_id"))
    versions = table(spark, sf, "policy_chunks").select("canonical_chunk_id", "version_id")
    bad = gold.join(versions, "canonical_chunk_id").where(F.array_contains("forbidden_version_ids", F.col("version_id")))
    return bad.groupBy("evaluation_id").agg(F.sort_array(F.collect_set("version_id")).alias("contradicted"))


@query("""SELECT min(evaluation_id) AS first_id, count(*) AS copies, trim(regexp_replace(lower(query), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS question
    FROM gold_queries GROUP BY question HAVING count(*) > 1""")
def repeated_questions(spark, sf):
    from quillstone.functions.text import question_key

    keyed = table(spark, sf, "gold_queries").select("evaluation_id", question_key(F.col("query")).alias("question"))
    return keyed.groupBy("question").agg(F.min("evaluation_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


@query(f"""WITH {RUNS} SELECT retrieval_source, run, evaluation_id, max(score) - min(score) AS spread, count(*) AS items,
    max(score) - max(CASE WHEN rank > 20 THEN score END) AS margin FROM runs GROUP BY ALL""")
def score_margins(spark, sf):
    """Spread of each list and the margin of its best score over rank 21; only 21 of each list are ranked."""
    whole = items_of_runs(spark, sf).groupBy(*LIST).agg((F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("items"))
    top = runs(spark, sf, 21).groupBy(*LIST).agg((F.max("score") - F.max(F.when(F.col("rank") > 20, F.col("score")))).alias("margin"))
    return whole.join(top, LIST).select(*LIST, "spread", "items", "margin")


@query("""SELECT retrieval_source, score_semantics, count(*) AS items, count(*) FILTER (score IS NULL) AS no_score, count(*) FILTER (NOT isfinite(score)) AS not_finite,
    count(*) FILTER (rank IS NULL OR rank < 1) AS no_rank, count(*) FILTER (ingested_at > retrieved_at + INTERVAL 1 DAY) AS late FROM ranked_results GROUP BY ALL""")
def result_defects(spark, sf):
    finite = ~F.isnan("score") & (F.abs("score") < F.lit(float("inf")))
    return table(spark, sf, "ranked_results").groupBy("retrieval_source", "score_semantics").agg(
        F.count("*").alias("items"), F.count_if(F.col("score").isNull()).alias("no_score"), F.count_if(~finite).alias("not_finite"),
        F.count_if(F.col("rank").isNull() | (F.col("rank") < 1)).alias("no_rank"), F.count_if(F.expr("ingested_at > retrieved_at + INTERVAL 1 DAY")).alias("late"))


@query("""WITH v AS (SELECT *, count(*) OVER (PARTITION BY retrieval_source, run, evaluation_id, canonical_chunk_id) AS copies FROM ranked_results)
    SELECT retrieval_source, count(*) AS repeated_rows, count(DISTINCT (run, evaluation_id, canonical_chunk_id)) AS repeated_items FROM v WHERE copies > 1 GROUP BY ALL""")
def repeated_deliveries(spark, sf):
    counts = table(spark, sf, "ranked_results").groupBy(*LIST, "canonical_chunk_id").agg(F.count("*").alias("copies")).where("copies > 1")
    return counts.groupBy("retrieval_source").agg(F.sum("copies").alias("repeated_rows"), F.count("*").alias("repeated_items"))


