"""Levels of provisions, noise, identities of passages, stricter rules for gold queries and passages, and comparisons of ranks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text
from quillstone.operators import parsing
from quillstone.operators.running import running_total
from quillstone.plans.common import RUNS, STRETCH, copied_stretch, runs
from quillstone.plans.registry import query
from quillstone.session import table

SCOPES = ("credit", "risk_management", "legal_compliance", "customer_relationship", "collateral_appraisal")

_LINES = """WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g'), chr(10))) AS text,
        generate_subscripts(string_split(regexp_replace(regexp_replace(text, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g'), chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
    lined AS (SELECT doc_id AS id, line, text FROM l WHERE length(trim(text, ' ')) > 0)
"""


def _lined(spark, sf):
    return parsing.lines(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")


def _levels_sql() -> str:
    own = ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in patterns) + f") AS own_{name}" for name, patterns in parsing.LEVELS.items())
    names, seen, steps = list(parsing.LEVELS), [], [f", own AS (SELECT *, {own} FROM lined)"]
    counts = []
    for name in names:
        above = " OR ".join(f"own_{n} IS NOT NULL" for n in seen)
        counts.append((f"sum(CASE WHEN {above} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line ROWS UNBOUNDED PRECEDING)" if seen else "0") + f" AS in_{name}")
        seen.append(name)
    steps.append(f", placed AS (SELECT *, {', '.join(counts)} FROM own)")
    carried = ", ".join(f"last_value(own_{n} IGNORE NULLS) OVER (PARTITION BY id, in_{n} ORDER BY line ROWS UNBOUNDED PRECEDING) AS {n}" for n in names)
    return _LINES + "".join(steps) + f" SELECT id, line, {carried} FROM placed"


@query(_levels_sql())
def provision_lines(spark, sf):
    """Each line with the part, chapter, section, article, clause and point it stands under; a level ends where one above it begins."""
    return parsing.levelled(_lined(spark, sf)).select("id", "line", *parsing.LEVELS)


_NOISE = {"page": r"^\s*(?:trang|page)\s*\d+(?:\s*/\s*\d+)?\s*$|^\s*\d+\s*/\s*\d+\s*$", "number": r"^\s*\d+\s*$", "rule": r"^[\s\-=_*.]+$", "bullet": r"^\s*[•●▪–-]\s*$"}


@query(_LINES + ", k AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in _NOISE.items()) + """ END AS kind FROM lined)
    SELECT coalesce(kind, 'kept') AS kind, count(*) AS lines, count(DISTINCT id) AS documents, sum(length(text)) AS characters FROM k GROUP BY ALL""")
def noise_ledger(spark, sf):
    """Lines that hold no text of their own, by kind, and those that are kept."""
    kind = F.coalesce(*(F.when(F.col("text").rlike("(?iu)" + p), F.lit(k)) for k, p in _NOISE.items()), F.lit("kept"))
    return _lined(spark, sf).groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"), F.count_distinct("id").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query()
def cleaned_texts(spark, sf):
    """Texts in compatibility composition without signs that no reader sees; what changed by that."""
    rows = table(spark, sf, "documents").where("text IS NOT NULL")
    clean = rows.select("doc_id", "text", text.cleaned(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.length("text").alias("before"), F.length("clean").alias("after"), (~F.col("text").eqNullSafe(F.col("clean"))).alias("changed"), F.sha2("clean", 256).alias("clean_hash"))


# identities of passages

@query("""SELECT g.evaluation_id, g.position, c.chunk_id FROM (SELECT evaluation_id, unnest(expected_canonical_chunk_ids) AS k, generate_subscripts(expected_canonical_chunk_ids, 1) AS position
    FROM gold_queries) g LEFT JOIN policy_chunks c ON c.canonical_chunk_id = g.k""")
def expected_in_order(spark, sf):
    """The passages expected for each query in the order of its list; null where there is none of that name."""
    keys = table(spark, sf, "gold_queries").select("evaluation_id", F.posexplode("expected_canonical_chunk_ids").alias("p", "k"))
    chunks = table(spark, sf, "policy_chunks").select("chunk_id", "canonical_chunk_id")
    return keys.join(chunks, F.col("k") == F.col("canonical_chunk_id"), "left").select("evaluation_id", (F.col("p") + 1).alias("position"), "chunk_id")


@query("""WITH named AS (SELECT canonical_chunk_id AS k, count(*) AS n FROM policy_chunks GROUP BY ALL), placed AS (SELECT source_id AS s, version_id AS v, article AS a, count(*) AS n FROM policy_chunks GROUP BY ALL)
    SELECT e.evidence_id, CASE WHEN named.n IS NOT NULL THEN 'name' WHEN placed.n IS NOT NULL THEN 'place' ELSE 'none' END AS found_by, coalesce(named.n, placed.n, 0) AS passages
    FROM evidence e LEFT JOIN named ON named.k = e.canonical_chunk_id LEFT JOIN placed ON s = e.document_source_id AND v = e.document_version_id AND a = e.locator.article""")
def resolved_evidence(spark, sf):
    """How a served passage is found in the corpus: by its name, else by source, version and article, and how many passages that gives.

    Places are counted before they are joined, so an article of very many passages is one row.
    """
    chunks = table(spark, sf, "policy_chunks")
    named = chunks.groupBy(F.col("canonical_chunk_id").alias("k")).agg(F.count("*").alias("n1"))
    placed = chunks.groupBy(F.col("source_id").alias("s"), F.col("version_id").alias("v"), F.col("article").alias("a")).agg(F.count("*").alias("n2"))
    rows = table(spark, sf, "evidence").select("evidence_id", "canonical_chunk_id", "document_source_id", "document_version_id", F.col("locator.article").alias("article"))
    both = rows.join(named, F.col("canonical_chunk_id") == F.col("k"), "left").join(
        placed, (F.col("document_source_id") == F.col("s")) & (F.col("document_version_id") == F.col("v")) & (F.col("article") == F.col("a")), "left")
    how = F.when(F.col("n1").isNotNull(), "name").when(F.col("n2").isNotNull(), "place").otherwise("none")
    return both.select("evidence_id", how.alias("found_by"), F.coalesce("n1", "n2", F.lit(0)).alias("passages"))


@query("""SELECT chunk_id, concat_ws(' > ', chapter, section, article, clause, point) AS place, CASE WHEN page_start = page_end THEN 'p. ' || page_start WHEN page_start < page_end THEN 'pp. ' || page_start || '-' || page_end END AS pages,
    len(list_filter([chapter, section, article, clause, point], lambda x: x IS NOT NULL)) AS levels FROM policy_chunks""")
def chunk_locators(spark, sf):
    """Where a passage stands, as one structure: the levels that it has and its pages."""
    levels = F.struct("chapter", "section", "article", "clause", "point", "page_start", "page_end").alias("at")
    pages = F.when(F.col("at.page_start") == F.col("at.page_end"), F.concat(F.lit("p. "), F.col("at.page_start"))).when(
        F.col("at.page_start") < F.col("at.page_end"), F.concat(F.lit("pp. "), F.col("at.page_start"), F.lit("-"), F.col("at.page_end")))
    each = F.array(*(F.col(f"at.{c}") for c in ("chapter", "section", "article", "clause", "point")))
    return table(spark, sf, "policy_chunks").select("chunk_id", levels).select("chunk_id", F.array_join(each, " > ").alias("place"), pages.alias("pages"), F.size(F.array_compact(each)).alias("levels"))


@query("""WITH c AS (SELECT content_hash AS k, list_sort(list(chunk_id)) AS ids FROM policy_chunks GROUP BY ALL HAVING count(*) > 1), r AS (SELECT sha256(content) AS k, list_sort(list(chunk_id)) AS ids FROM policy_chunks GROUP BY ALL HAVING count(*) > 1)
    SELECT coalesce(c.k, r.k) AS content_hash, coalesce(len(c.ids), 0) AS claimed, coalesce(len(r.ids), 0) AS real FROM c FULL JOIN r ON c.k = r.k WHERE c.ids IS DISTINCT FROM r.ids""")
def copy_group_members(spark, sf):
    """Groups of copies by the stored hash that don't have exactly the members of the group by content. Members are compared by
    their number and the sum of their hashes, so no group is gathered."""
    rows = table(spark, sf, "policy_chunks")

    def groups(key, s):
        g = rows.groupBy(key.alias("content_hash")).agg(F.count("*").alias(f"n{s}"), F.sum(F.xxhash64("chunk_id").cast("decimal(38,0)")).alias(f"m{s}"))
        return g.where(F.col(f"n{s}") > 1)

    both = groups(F.col("content_hash"), 1).join(groups(F.sha2("content", 256), 2), "content_hash", "full")
    return both.where(~(F.col("n1").eqNullSafe(F.col("n2")) & F.col("m1").eqNullSafe(F.col("m2")))).select(
        "content_hash", F.coalesce("n1", F.lit(0)).alias("claimed"), F.coalesce("n2", F.lit(0)).alias("real"))


# rules

@query(f"""SELECT DISTINCT g.evaluation_id, c.chunk_id FROM (SELECT evaluation_id, lower(query) AS q, unnest(list_distinct(expected_canonical_chunk_ids)) AS k FROM gold_queries) g
    JOIN (SELECT chunk_id, canonical_chunk_id, lower(content) AS c FROM policy_chunks) c ON c.canonical_chunk_id = g.k
    WHERE contains(q, c) OR (length(q) >= {STRETCH} AND len(list_filter(range(1, length(q) - {STRETCH} + 2), lambda i: contains(c, substr(q, i, {STRETCH})))) > 0)""")
def copied_stretches(spark, sf):
    """Questions that copy a stretch of 80 characters, from wherever in an expected passage, or all of a shorter one."""
    gold = table(spark, sf, "gold_queries").select("evaluation_id", F.lower("query").alias("q"), F.explode(F.array_distinct("expected_canonical_chunk_ids")).alias("canonical_chunk_id"))
    chunks = table(spark, sf, "policy_chunks").select("chunk_id", "canonical_chunk_id", F.lower("content").alias("c"))
    return gold.join(chunks, "canonical_chunk_id").where(copied_stretch(F.col("q"), F.col("c"))).select("evaluation_id", "chunk_id").distinct()


_QUESTION_RULES = {
    "blank": "query IS NULL OR trim(query) = ''", "no question mark": "query NOT LIKE '%?'", "under five words": "length(query) - length(replace(query, ' ', '')) < 4",
    "name malformed": "NOT {matches}(evaluation_id, '^ev-[0-9]{{2}}-[0-9]{{6}}$')", "negative with passages": "query_type = 'NEGATIVE' AND {size}(expected_canonical_chunk_ids) > 0",
    "positive without passages": "query_type <> 'NEGATIVE' AND {size}(expected_canonical_chunk_ids) = 0", "unknown status": "status NOT IN ('DRAFT', 'REVIEWED', 'REJECTED')",
    "assessed before written": "assessment_date > CAST(created_at AS DATE)", "forbidden versions repeated": "{size}(forbidden_version_ids) <> {size}({distinct}(forbidden_version_ids))",
    "reviewed without a date": "status = 'REVIEWED' AND assessment_date IS NULL"}
_DUCK, _SPARK = {"matches": "regexp_matches", "size": "len", "distinct": "list_distinct"}, {"matches": "regexp_like", "size": "size", "distinct": "array_distinct"}


def _broken(rows, key, rules):
    flags = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(r)) for r, c in rules.items())))
    return rows.select(key, F.explode(flags).alias("rule"))


def _broken_sql(source, key, rules):
    return f"SELECT {key}, unnest(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{r}{chr(39)} END' for r, c in rules.items())}], lambda x: x IS NOT NULL)) AS rule FROM {source}"


_ASKED_TWICE = """ UNION ALL SELECT evaluation_id, 'asked twice' FROM (SELECT evaluation_id, count(*) OVER (PARTITION BY trim(regexp_replace(lower(query), '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS n FROM gold_queries) WHERE n > 1
    UNION ALL SELECT DISTINCT g.evaluation_id, 'passage missing' FROM (SELECT evaluation_id, unnest(expected_canonical_chunk_ids) AS k FROM gold_queries) g ANTI JOIN policy_chunks c ON c.canonical_chunk_id = g.k"""


@query(_broken_sql("gold_queries", "evaluation_id", {r: c.format(**_DUCK) for r, c in _QUESTION_RULES.items()}) + _ASKED_TWICE)
def gold_rules(spark, sf):
    """Broken rules of gold queries, one row each: their own fields, repeats of a question, passages that don't exist."""
    rows = table(spark, sf, "gold_queries")
    own = _broken(rows, "evaluation_id", {r: c.format(**_SPARK) for r, c in _QUESTION_RULES.items()})
    keyed = rows.select("evaluation_id", text.question_key(F.col("query")).alias("k"))
    twice = keyed.join(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "k").select("evaluation_id", F.lit("asked twice").alias("rule"))
    missing = rows.select("evaluation_id", F.explode("expected_canonical_chunk_ids").alias("canonical_chunk_id")).join(
        table(spark, sf, "policy_chunks").select("canonical_chunk_id"), "canonical_chunk_id", "left_anti").select("evaluation_id", F.lit("passage missing").alias("rule")).distinct()
    return own.unionByName(twice).unionByName(missing)


_PASSAGE_RULES = {
    "blank": "content IS NULL OR trim(content) = ''", "stale hash": "content_hash <> {sha}", "pages reversed": "page_end < page_start", "page below one": "page_start < 1",
    "fragment without a place": "is_fragment AND fragment_index IS NULL", "place without a fragment": "NOT is_fragment AND fragment_index > 0", "no headings": "{size}(heading_path) = 0",
    "visibility spelled otherwise": "visibility NOT IN ('SHARED', 'SCOPED')", "point without an article": "point IS NOT NULL AND article IS NULL",
    "heading is not the article": "article IS NOT NULL AND heading_path[{last}] <> article", "no vector": "embedding IS NULL OR {size}(embedding) <> 128"}


@query(_broken_sql("policy_chunks", "chunk_id", {r: c.format(**_DUCK, sha="sha256(content)", last="-1") for r, c in _PASSAGE_RULES.items()}))
def passage_rules(spark, sf):
    """Broken rules of passages, one row each."""
    return _broken(table(spark, sf, "policy_chunks"), "chunk_id", {r: c.format(**_SPARK, sha="sha2(content, 256)", last="size(heading_path) - 1") for r, c in _PASSAGE_RULES.items()})


@query("""SELECT evaluation_id FROM gold_queries WHERE status = 'DRAFT' AND evaluation_id NOT IN (SELECT evaluation_id FROM evidence WHERE evaluation_id IS NOT NULL)""")
def staged_queries(spark, sf):
    """Drafts for which nothing was served yet."""
    served = table(spark, sf, "evidence").select("evaluation_id")
    return table(spark, sf, "gold_queries").where("status = 'DRAFT'").join(served, "evaluation_id", "left_anti").select("evaluation_id")


@query("""WITH c AS (SELECT coalesce(status, '?') AS status, coalesce(query_type, '?') AS query_type, count(*) AS queries FROM gold_queries GROUP BY ALL)
    SELECT *, round(queries / sum(queries) OVER (PARTITION BY status), 6) AS share FROM c""")
def label_distribution(spark, sf):
    """Kinds of queries by status, with their share."""
    counts = table(spark, sf, "gold_queries").groupBy(F.coalesce("status", F.lit("?")).alias("status"), F.coalesce("query_type", F.lit("?")).alias("query_type")).agg(F.count("*").alias("queries"))
    return counts.withColumn("share", F.round(F.col("queries") / F.sum("queries").over(Window.partitionBy("status")), 6))


@query("""SELECT trace_id, position FROM (SELECT trace_id, row_number() OVER (ORDER BY ingested_at, trace_id) AS position FROM rag_answers WHERE ingested_at IS NOT NULL) WHERE position % 10 = 1""")
def every_tenth_answer(spark, sf):
    """Every tenth answer in the order of arrival. Positions come from the counts of days, so no task orders the whole table."""
    rows = table(spark, sf, "rag_answers").where("ingested_at IS NOT NULL").select("trace_id", "ingested_at", F.lit(1).alias("one"), F.lit(0).alias("all"))
    placed = running_total(rows, ["all"], F.to_date("ingested_at"), ["ingested_at", "trace_id"], "one")
    return placed.select("trace_id", (F.col("total_before") + 1).alias("position")).where("position % 10 = 1")


# ranks

def _gold(spark, sf):
    ids = F.array_distinct(F.filter("expected_canonical_chunk_ids", lambda x: x.isNotNull()))
    return table(spark, sf, "gold_queries").select("evaluation_id", F.explode(ids).alias("canonical_chunk_id"), F.size(ids).alias("gold_size"))


@query(f"""WITH {RUNS}, f AS (SELECT l.retrieval_source, l.run, l.evaluation_id, min(r.rank) AS first FROM (SELECT DISTINCT retrieval_source, run, evaluation_id FROM items WHERE evaluation_id IN (SELECT evaluation_id FROM gold)) l
        LEFT JOIN (SELECT r.* FROM runs r JOIN gold g ON g.evaluation_id = r.evaluation_id AND g.item = r.canonical_chunk_id WHERE rank <= 50) r USING (retrieval_source, run, evaluation_id) GROUP BY ALL)
    SELECT retrieval_source, run, CASE WHEN first <= 5 THEN 'A' WHEN first <= 20 THEN 'B' WHEN first <= 50 THEN 'C' ELSE 'D' END AS bucket, count(*) AS queries FROM f GROUP BY ALL""")
def rerankability(spark, sf):
    """What a reranker could do for each list: A has its first right item in the first 5, B in 20, C in 50, D not at all."""
    gold = _gold(spark, sf)
    found = runs(spark, sf, 50).join(gold.select("evaluation_id", "canonical_chunk_id"), ["evaluation_id", "canonical_chunk_id"]).groupBy(
        "retrieval_source", "run", "evaluation_id").agg(F.min("rank").alias("first"))
    lists = runs(spark, sf, 1).select("retrieval_source", "run", "evaluation_id").join(gold.select("evaluation_id").distinct(), "evaluation_id", "left_semi")
    bucket = F.when(F.col("first") <= 5, "A").when(F.col("first") <= 20, "B").when(F.col("first") <= 50, "C").otherwise("D")
    return lists.join(found, ["retrieval_source", "run", "evaluation_id"], "left").groupBy("retrieval_source", "run", bucket.alias("bucket")).agg(F.count("*").alias("queries"))


@query(f"""WITH {RUNS}, m AS (SELECT l.retrieval_source, l.run, l.evaluation_id, l.gold_size, count(r.rank) AS hits FROM (SELECT DISTINCT i.retrieval_source, i.run, g.evaluation_id, g.gold_size FROM items i JOIN gold g USING (evaluation_id) WHERE gold_size > 1) l
        LEFT JOIN (SELECT r.* FROM runs r JOIN gold g ON g.evaluation_id = r.evaluation_id AND g.item = r.canonical_chunk_id WHERE rank <= 10) r USING (retrieval_source, run, evaluation_id) GROUP BY ALL)
    SELECT retrieval_source, run, count(*) AS queries, count(*) FILTER (hits > 0) AS any_found, count(*) FILTER (hits = gold_size) AS all_found, round(avg(hits / gold_size), 6) AS recall FROM m GROUP BY ALL""")
def several_expected(spark, sf):
    """Queries with several expected passages: how many find one, and how many all of them, among the first ten."""
    gold = _gold(spark, sf).where("gold_size > 1")
    hits = runs(spark, sf, 10).join(gold, ["evaluation_id", "canonical_chunk_id"]).groupBy("retrieval_source", "run", "evaluation_id").agg(F.count("*").alias("hits"))
    lists = runs(spark, sf, 1).select("retrieval_source", "run", "evaluation_id").join(gold.select("evaluation_id", "gold_size").distinct(), "evaluation_id")
    each = lists.join(hits, ["retrieval_source", "run", "evaluation_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return each.groupBy("retrieval_source", "run").agg(
        F.count("*").alias("queries"), F.count_if(F.col("hits") > 0).alias("any_found"), F.count_if(F.col("hits") == F.col("gold_size")).alias("all_found"), F.round(F.avg(F.col("hits") / F.col("gold_size")), 6).alias("recall"))


@query(f"""WITH {RUNS} SELECT run, evaluation_id, retrieval_source, canonical_chunk_id, rank + CASE retrieval_source WHEN 'vector' THEN 0 ELSE 3 END AS position FROM runs
    WHERE rank <= 3 AND retrieval_source IN ('vector', 'fts')""")
def concatenated_arms(spark, sf):
    """The first three by vector and behind them the first three by words, nothing merged."""
    top = runs(spark, sf, 3)
    arm = lambda source, offset: top.where(F.col("retrieval_source") == source).select("run", "evaluation_id", "retrieval_source", "canonical_chunk_id", (F.col("rank") + offset).alias("position"))
    return arm("vector", 0).unionByName(arm("fts", 3))
