"""Ranking metrics and comparisons of retrieval runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.running import running_total

#: Slices of a group's range of values for percentiles.
SLICES = 1000


def gold_items(gold: DataFrame, query: str, items: str) -> DataFrame:
    """``query, item, gold_size``: the expected items of each query, each once."""
    unique = gold.select(query, F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("g"))
    return unique.select(query, F.explode("g").alias("item"), F.size("g").alias("gold_size"))


def hits(runs: DataFrame, gold: DataFrame, by: list[str], query: str, item: str) -> DataFrame:
    """``*by, query, gold_size, ranks``: for each list the sorted ranks at which expected items stand.

    ``runs`` has one row per (by, query, item) with a column ``rank``. A list without any expected item has no ranks. The
    join is on (query, item), so that one query with very many results is spread over all tasks.
    """
    expected = gold.select(F.col(query), F.col("item").alias(item))
    found = runs.join(expected, [query, item]).groupBy(*by, query).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    lists = runs.select(*by, query).distinct()
    sizes = gold.select(query, "gold_size").distinct()
    same = [*by, query]
    return lists.join(sizes, query).join(found, same, "left").select(
        *same, "gold_size", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


def metrics_at(found: DataFrame, by: list[str], query: str, ks: list[int]) -> DataFrame:
    """``*by, query, k, hit, recall, mrr, ndcg``: binary relevance at each depth."""
    each = found.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.filter("ranks", lambda r: r <= F.col("k"))
    gain = F.aggregate(inside, F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "gold_size")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1.0)))
    first = F.element_at(inside, 1)
    some = F.size(inside) > 0
    return each.select(*by, query, "k", F.when(some, 1.0).otherwise(0.0).alias("hit"), (F.size(inside) / F.col("gold_size")).alias("recall"),
                       F.when(some, 1 / first).otherwise(0.0).alias("mrr"), (gain / ideal).alias("ndcg"))


def breakdown(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Macro means of the metrics with the number of queries, rounded to six places."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in ("hit", "recall", "mrr", "ndcg")))


def agreement(a: DataFrame, b: DataFrame, query: list[str], item: str, k: int) -> DataFrame:
    """``*query, overlap, same_position, score_drift``: two runs compared over their first ``k``; two empty lists agree."""
    x, y = (d.where(F.col("rank") <= k).select(*query, item, F.col("rank").alias(f"rank_{s}"), F.col("score").alias(f"score_{s}")) for d, s in ((a, "a"), (b, "b")))
    both = x.join(y, [*query, item], "full")
    return both.groupBy(*query).agg(
        F.count("rank_a").alias("n_a"), F.count("rank_b").alias("n_b"), F.count_if(F.col("rank_a").isNotNull() & F.col("rank_b").isNotNull()).alias("shared"),
        F.count_if(F.col("rank_a") == F.col("rank_b")).alias("same_position"), F.round(F.max(F.abs(F.col("score_a") - F.col("score_b"))), 6).alias("score_drift")
    ).select(*query, F.round(F.col("shared") / F.greatest("n_a", "n_b"), 6).alias("overlap"), "same_position", "score_drift")


def rank_changes(before: DataFrame, after: DataFrame, gold: DataFrame, query: str, item: str) -> DataFrame:
    """``query, rank_before, rank_after, change``: the first expected item's rank in two arms, queries of the gold set."""
    first = lambda d, name: d.join(gold.select(query, F.col("item").alias(item)), [query, item]).groupBy(query).agg(F.min("rank").alias(name))
    both = gold.select(query).distinct().join(first(before, "rank_before"), query, "left").join(first(after, "rank_after"), query, "left")
    change = (F.when(F.col("rank_before").isNull() & F.col("rank_after").isNull(), "UNRECOVERABLE")
              .when(F.col("rank_before").isNull() | (F.col("rank_after") < F.col("rank_before")), "IMPROVED")
              .when(F.col("rank_after").isNull() | (F.col("rank_after") > F.col("rank_before")), "WORSENED").otherwise("UNCHANGED"))
    return both.withColumn("change", change)


def percentiles(df: DataFrame, by: list[str], value: str, points: list[float]) -> DataFrame:
    """Exact percentiles by linear interpolation; nulls are left out.

    Equal values are counted first; their places come from running totals over slices of the range of a group, so a group of
    any size is spread and no task holds all of its values.
    """
    kept, by = by, by or ["_all"]
    rows = df.withColumn("_all", F.lit(0)).where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumnsRenamed({b: f"_{b}" for b in by})
    known = counts.join(ends, [counts[b].eqNullSafe(ends[f"_{b}"]) for b in by]).drop(*(f"_{b}" for b in by))
    slice_ = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SLICES)).otherwise(F.lit(0))
    placed = running_total(known, by, slice_, ["_v"], "_c", "_before")
    named = []
    for p in points:
        at = (F.col("n") - 1) * F.lit(float(p))
        holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_c"))
        low, high = (F.max(F.when(holds(f(at)), F.col("_v"))) for f in (F.floor, F.ceil))
        share = F.max(at - F.floor(at))
        named.append(F.round(low + (high - low) * share, 6).alias(f"p{round(p * 100)}"))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), *named).select(*kept, "n", *(f"p{round(p * 100)}" for p in points))


def top_of_each(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
