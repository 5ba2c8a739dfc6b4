"""Ordered computations over groups of any size: totals of blocks first, then windows inside the blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_total(df: DataFrame, by: list[str], block: Column, order: list, value: str, name: str = "total_before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of the group that come earlier.

    ``block`` must not decrease in the given order (a day of a timestamp, a range of an id). Only the sums of blocks go
    through a window per group; rows are sorted within (group, block), so a group of any size is spread over its blocks.
    """
    named = df.withColumn("_b", block)
    sums = named.groupBy(*by, "_b").agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = named.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = [within[c].eqNullSafe(starts[f"_k{i}"]) for i, c in enumerate(by)] + [within["_b"].eqNullSafe(starts["_kb"])]
    joined = within.join(starts, same)
    return joined.select(*(within[c] for c in df.columns), (F.col("_start") + F.col("_in")).alias(name))


def within_budget(df: DataFrame, by: list[str], block: Column, order: list, size: str, budget: int) -> DataFrame:
    """Rows in order until ``budget`` is used up, with ``taken``: how much of the last row still fits."""
    run = running_total(df, by, block, order, size)
    return run.where(F.col("total_before") < budget).withColumn("taken", F.least(F.col(size), budget - F.col("total_before"))).drop("total_before")


def islands(df: DataFrame, by: list[str], order: list, changes: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of consecutive rows; ``changes`` is true on the first row of each. Groups must be of bounded size."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(changes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands_in_blocks(df: DataFrame, by: list[str], block: Column, order: str, columns: list[str], name: str = "island") -> DataFrame:
    """Numbers the runs of rows in which ``columns`` stay the same (null equals null), for groups of any size.

    ``block`` must not decrease in the given order, and ``order`` orders the rows of a block. A block is compared inside itself;
    its first row is compared with the last one of the block before, of which there is one row a block.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    state = F.struct(*columns)
    named = df.withColumn("_block", block)
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    lasts = named.groupBy(*by, "_block").agg(F.max_by(state, order).alias("_last"))
    earlier = lasts.select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("_block").alias("_kb"),
                           F.lag("_last").over(Window.partitionBy(*by).orderBy("_block")).alias("_before"))
    rows = named.withColumns({"_inside": F.lag(state).over(inside), "_head": F.row_number().over(inside) == 1})
    joined = rows.join(earlier, [rows[b].eqNullSafe(earlier[k]) for b, k in zip(by, keys)] + [rows["_block"].eqNullSafe(earlier["_kb"])]).drop(*keys, "_kb")
    before = F.when(F.col("_head"), F.col("_before")).otherwise(F.col("_inside"))
    fresh = before.isNull()
    for c in columns:
        fresh = fresh | ~before[c].eqNullSafe(F.col(c))
    counted = running_total(joined.withColumn("_fresh", fresh.cast("int")), by, F.col("_block"), [order], "_fresh", "_total")
    return counted.select(*df.columns, (F.col("_total") + F.col("_fresh")).alias(name))


def carried_forward(df: DataFrame, by: list[str], order: list, columns: list[str]) -> DataFrame:
    """The last value that isn't null so far, for each of the columns."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
