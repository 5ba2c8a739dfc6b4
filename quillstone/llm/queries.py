"""The queries of the numbered problems, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.garbled import find_garbled
from quillstone.llm.neighbours import nearest, neighbour_pairs
from quillstone.llm.near_duplicates import expand_pairs, link_counts, near_duplicates
from quillstone.llm.pair_defects import find_defects, labels_of, one_type
from quillstone.llm.packing import fill_containers, fill_report
from quillstone.llm.tokenizer import count_tokens, encode_documents
from quillstone.llm.topn import top_items
from quillstone.llm.truncation import find_truncated, hidden_limits, truncation_by_source
from quillstone.session import table


_PAIR = {"question": "question", "answer": "answer", "abstained": "abstention_detected", "error": "generation_error",
         "tokens": "completion_tokens", "source": "source", "model": "generator_model"}
_CUT = {k: _PAIR[k] for k in ("source", "model", "tokens", "question")}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return one_type(find_defects(table(spark, sf, "rag_answers"), "trace_id", **_PAIR)).withColumnRenamed("id", "trace_id")


def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels_of(find_defects(table(spark, sf, "rag_answers"), "trace_id", **_PAIR)).withColumnRenamed("id", "trace_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = find_truncated(table(spark, sf, "rag_answers"), "trace_id", "answer", **_CUT)
    return found.where("truncated").select(F.col("id").alias("trace_id"))


def p2_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_by_source(find_truncated(table(spark, sf, "rag_answers"), "trace_id", "answer", **_CUT))


def p2_limits(spark: SparkSession, sf: str) -> DataFrame:
    return hidden_limits(table(spark, sf, "rag_answers"), "source", "answer")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neighbour_pairs(nearest(table(spark, sf, "policy_chunks"), "chunk_id", "embedding", k=5))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = nearest(table(spark, sf, "policy_chunks"), "chunk_id", "embedding", k=5)
    return found.select(F.col("id").alias("chunk_id"), "neighbour", F.round("similarity", 6).alias("similarity"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    top = top_items(table(spark, sf, "ranked_results"), ["evaluation_id", "retrieval_source"], "canonical_chunk_id", "score", 5)
    return top.select("evaluation_id", "retrieval_source", "canonical_chunk_id")


def p4_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return top_items(table(spark, sf, "ranked_results"), ["evaluation_id", "retrieval_source"], "canonical_chunk_id", "score", 20)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "evidence"), "evidence_id", "content", size=1, threshold=0.8)
    return expand_pairs(*found).select(F.col("id_a").alias("evidence_id_a"), F.col("id_b").alias("evidence_id_b"))


def p5_links(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "evidence"), "evidence_id", "content", size=1, threshold=0.8)
    return link_counts(*found).withColumnRenamed("id", "evidence_id")


def p5_weighted(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "evidence"), "evidence_id", "content", size=1, threshold=0.8, weighted=True)
    return link_counts(*found).withColumnRenamed("id", "evidence_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_documents(table(spark, sf, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf, "documents"), "doc_id", "text")
    packed = fill_containers(sizes, "doc_id", "tokens", table(spark, sf, "pack_profiles"), "profile_id", "capacity_tokens")
    return packed.withColumnsRenamed({"profile": "profile_id", "id": "doc_id", "size": "tokens"})


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    sizes = count_tokens(table(spark, sf, "documents"), "doc_id", "text")
    profiles = table(spark, sf, "pack_profiles")
    packed = fill_containers(sizes, "doc_id", "tokens", profiles, "profile_id", "capacity_tokens")
    return fill_report(packed, profiles, "profile_id", "capacity_tokens").withColumnRenamed("profile", "profile_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return find_garbled(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return find_garbled(table(spark, sf, "documents"), "doc_id", "text")


_WORDS = """
    WITH words AS (
        SELECT evidence_id AS id, unnest(list_distinct(regexp_extract_all(lower(nfc_normalize(content)), '[\\p{L}\\p{N}]+'))) AS word
        FROM evidence),
    sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
    shared AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM words a JOIN words b ON a.word = b.word AND a.id < b.id GROUP BY ALL),
    pairs AS (
        SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9)
"""
_TOP = """
    WITH best AS (
        SELECT evaluation_id, retrieval_source, canonical_chunk_id, max(score) AS score FROM ranked_results
        WHERE score IS NOT NULL AND isfinite(score) AND canonical_chunk_id IS NOT NULL GROUP BY ALL),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY evaluation_id, retrieval_source ORDER BY score DESC, canonical_chunk_id) AS rank
        FROM best)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _WORDS + "SELECT a AS evidence_id_a, b AS evidence_id_b FROM pairs",
        "p5_links": _WORDS + """,
            sets AS (SELECT id, list_sort(list(word)) AS words FROM words GROUP BY id),
            ends AS (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs)
            SELECT id AS evidence_id, min(id) OVER (PARTITION BY words) AS class_id,
                (SELECT count(*) FROM ends e WHERE e.id = sets.id) AS links FROM sets""",
        "p4_found": _TOP + "SELECT evaluation_id, retrieval_source, canonical_chunk_id FROM ranked WHERE rank <= 5",
        "p4_ranked": _TOP + "SELECT evaluation_id, retrieval_source, canonical_chunk_id, score, rank FROM ranked WHERE rank <= 20",
    }
