"""The N best items of every group, with groups of any size: a hot-cold split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups with more rows than this are heavy. Most heavy groups whose list is broadcast; beyond it the split is a join.
HEAVY_ROWS, BROADCAST_GROUPS = 20_000, 100_000
#: Into so many parts that join spreads each group.
SALTS = 64


def top_items(df: DataFrame, groups: list[str], item: str, score: str, n: int, *, heavy_rows: int = HEAVY_ROWS,
              broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``*groups, item, score, rank``: the ``n`` best items of each group by score descending, then item ascending.

    An item that comes more than once in a group counts once, with its highest score. Rows whose score is null, NaN or
    infinite and rows whose item is null are left out; a null in a group column is a group of its own. -0.0 equals 0.0. An
    empty table gives no rows. Other columns of ``df`` are ignored, whatever their names.

    Exact row counts split the groups. Light groups are hash-partitioned once: the same partitioning serves the
    aggregation of repeated items and the ordinary window. Heavy groups get a salt from the item, are range-partitioned by
    (group, salt), and keep their ``n`` best of each salt before one small window joins the salts: no task sorts more than
    its range, and all copies of an item share a salt, so aggregating them needs no other shuffle.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    finite = F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") < F.lit(float("inf")))
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys)), F.col(item).alias("_i"),
                     (F.col(score).cast("double") + F.lit(0.0)).alias("_s")).where(finite & F.col("_i").isNotNull())
    heavy = rows.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") > heavy_rows)
    count = heavy.count()

    def best(x: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("_s"), F.asc("_i"))
        return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)

    def items(x: DataFrame, by: list[str]) -> DataFrame:
        return x.groupBy(*by, "_i").agg(F.max("_s").alias("_s"))

    out = ["_i", "_s", "_r"]
    if not count:
        result = best(items(rows.repartition(*keys), keys), keys).select(*keys, *out)
    else:
        part = F.pmod(F.xxhash64("_i", F.lit(SALTS)), F.lit(SALTS)).cast("int").alias("_part")
        if count <= broadcast_groups:
            hot, known = F.broadcast(heavy.withColumn("_p", F.lit(0))), rows.select("*", F.lit(0).alias("_part"))
        else:  # a join by the group alone would send a heavy group to one task
            hot, known = heavy.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), rows.select("*", part)
        hot = hot.select(*(F.col(k).alias(f"h{k}") for k in keys), "_c", "_p")
        match = [known[k].eqNullSafe(hot[f"h{k}"]) for k in keys] + [known["_part"] == hot["_p"]]
        cold = known.join(hot, match, "left_anti").drop("_part")
        salted = known.join(hot, match).select(
            *keys, "_i", "_s", F.pmod(F.xxhash64("_i"), F.ceil(F.col("_c") / heavy_rows)).alias("_salt"))
        ranged = items(salted.repartitionByRange(*keys, "_salt"), [*keys, "_salt"])
        partial = best(ranged, [*keys, "_salt"]).select(*keys, "_i", "_s")
        result = best(items(cold.repartition(*keys), keys), keys).select(*keys, *out).unionByName(
            best(partial, keys).select(*keys, *out))
    return result.select(*(F.col(k).alias(g) for g, k in zip(groups, keys)), F.col("_i").alias(item), F.col("_s").alias(score),
                         F.col("_r").alias("rank"))
