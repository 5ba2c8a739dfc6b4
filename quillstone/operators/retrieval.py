"""Queries over a corpus: who may see a passage, fusing ranked lists, reranking, ordered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def visible(chunks: DataFrame, access: DataFrame, scope: Column, key: str = "source_id") -> DataFrame:
    """Chunks that are shared, and scoped ones of a source that ``access(key, scope)`` opens to the scope.

    An EXISTS, not a join: a chunk comes once however many access rows it has.
    """
    shared = F.upper("visibility") == "SHARED"
    opened = access.where(F.col("scope").eqNullSafe(scope)).select(key)
    return chunks.where(shared).unionByName(chunks.where(~shared).join(opened, key, "left_semi").select(*chunks.columns))


def ranked(df: DataFrame, by: list[str], score: str, item: str, k: int | None = None, rank: str = "rank") -> DataFrame:
    """Rank by score descending, item ascending; at most ``k`` of each group if given."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(item).asc())
    df = df.withColumn(rank, F.row_number().over(w))
    return df if k is None else df.where(F.col(rank) <= k)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, by: list[str], item: str, *, k0: int = 60, depth: int = 20, k: int = 10) -> DataFrame:
    """``*by, item, rank_a, rank_b, score, rank``: two ranked lists (with a column ``rank``) fused by 1/(k0 + rank).

    A full outer join: an item of one list only keeps its one term. Equal scores go to the smaller item.
    """
    left, right = (x.where(F.col("rank") <= depth).select(*by, item, F.col("rank").alias(name)) for x, name in ((a, "rank_a"), (b, "rank_b")))
    term = lambda c: F.coalesce(1.0 / (F.lit(k0) + F.col(c)), F.lit(0.0))
    fused = left.join(right, [*by, item], "full").withColumn("score", term("rank_a") + term("rank_b"))
    return ranked(fused, by, "score", item, k)


def rerank(candidates: DataFrame, scores: DataFrame, by: list[str], item: str, score: str, k: int) -> DataFrame:
    """Candidates in the order of an outside score, cut to ``k``; scores are never blended, unscored candidates fall out."""
    return ranked(candidates.join(scores.select(*by, item, score), [*by, item]), by, score, item, k)


def ordered_union(parts: list[DataFrame], by: list[str], item: str) -> DataFrame:
    """``*by, item, part, position``: the lists one after the other, each item once at its first place."""
    tagged = [p.select(*by, item, F.lit(i).alias("part"), F.col("rank")) for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    first = every.groupBy(*by, item).agg(F.min(F.struct("part", "rank")).alias("at"))
    w = Window.partitionBy(*by).orderBy("at.part", "at.rank", item)
    return first.select(*by, item, F.col("at.part").alias("part"), F.row_number().over(w).alias("position"))


def over_fetch(df: DataFrame, by: list[str], score: str, item: str, k: int, least: float, factor: int = 4, cap: int = 80) -> DataFrame:
    """First min(cap, factor * k) by score, then those of at least ``least``, then ``k``: a filter after the candidate limit."""
    wide = ranked(df, by, score, item, min(cap, factor * k))
    return ranked(wide.where(F.col(score) >= least).drop("rank"), by, score, item, k)
