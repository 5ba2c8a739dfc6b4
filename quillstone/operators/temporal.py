"""Joins and marks on time that Spark lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its group that isn't later; null where there is none.

    Both sides go through one sort: the last right value so far is carried forward over the union, so no pair of rows is ever
    built. On equal times the right row counts as earlier.
    """
    carry = F.struct(*values).alias("_v")
    nothing = F.lit(None).cast(right.select(carry).schema["_v"].dataType).alias("_v")
    own = F.struct(*left.columns).alias("_row")
    no_row = F.lit(None).cast(left.select(own).schema["_row"].dataType).alias("_row")
    union = right.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_side"), carry, no_row).unionByName(
        left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), nothing, own))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return union.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], time: str, start: str, end: str, width: int) -> DataFrame:
    """Points within [start, end) of a span of their group: an equi-join on buckets of ``width`` seconds, then the exact test.

    A span goes into each bucket that it touches, a point into one, so each pair meets once.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / width)
    last = F.greatest(bucket(F.col(start)), bucket(F.col(end) - F.expr("INTERVAL 1 SECOND")))
    cut = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), last)))
    return points.withColumn("_b", bucket(F.col(time))).join(cut, [*by, "_b"]).where(
        (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b")
