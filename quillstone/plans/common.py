"""Inputs that several plans share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.retrieval import ranked
from quillstone.session import table

DIM = 128
LIST = ["retrieval_source", "run", "evaluation_id"]


def items_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per list and item with its best finite score: deliveries of the same item count once."""
    rows = table(spark, sf, "ranked_results").where(
        F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < F.lit(float("inf"))))
    return rows.groupBy(*LIST, "canonical_chunk_id").agg(F.max("score").alias("score"))


def runs(spark: SparkSession, sf: str, depth: int | None = None) -> DataFrame:
    """The lists of every run, ranked anew: score descending, item ascending."""
    return ranked(items_of_runs(spark, sf), LIST, "score", "canonical_chunk_id", depth)


RUNS = """
    items AS (
        SELECT retrieval_source, run, evaluation_id, canonical_chunk_id, max(score) AS score FROM ranked_results
        WHERE score IS NOT NULL AND isfinite(score) GROUP BY ALL),
    runs AS (
        SELECT *, row_number() OVER (PARTITION BY retrieval_source, run, evaluation_id ORDER BY score DESC, canonical_chunk_id) AS rank
        FROM items),
    gold AS (
        SELECT evaluation_id, unnest(ids) AS item, len(ids) AS gold_size
        FROM (SELECT evaluation_id, list_distinct(list_filter(expected_canonical_chunk_ids, lambda x: x IS NOT NULL)) AS ids FROM gold_queries))
"""

USABLE = f"""
    usable AS (
        SELECT chunk_id, source_id, visibility, embedding::DOUBLE[] AS v FROM policy_chunks
        WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""

#: Which scope may read a scoped source: the sources whose passages were served to it.
ACCESS = "access AS (SELECT DISTINCT document_source_id AS source_id, specialist_scope AS scope FROM evidence WHERE document_source_id IS NOT NULL)"


#: Characters that a question may have in common with a passage before it counts as copied.
STRETCH = 80


def copied_stretch(question: Column, passage: Column) -> Column:
    """The question holds a stretch of ``STRETCH`` characters from anywhere in the passage, or all of a shorter passage.

    A common stretch is one of the question's own, of which there are few, so the whole passage is searched for those.
    """
    starts = F.when(F.length(question) >= STRETCH, F.sequence(F.lit(1), F.length(question) - STRETCH + 1))
    return question.contains(passage) | F.coalesce(F.exists(starts, lambda i: passage.contains(F.substring(question, i, F.lit(STRETCH)))), F.lit(False))


def access(spark: SparkSession, sf: str) -> DataFrame:
    served = table(spark, sf, "evidence").where("document_source_id IS NOT NULL")
    return served.select(F.col("document_source_id").alias("source_id"), F.col("specialist_scope").alias("scope")).distinct()
