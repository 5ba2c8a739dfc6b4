"""Comparing two states of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_columns(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``*keys, state, changed``: NEW, GONE, SAME or CHANGED with the names of the columns that differ; null equals null."""
    a = before.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a"))
    b = after.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)))
    there = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    changed = F.when(there, differ).otherwise(F.array().cast("array<string>"))
    state = (F.when(F.col("in_a").isNull(), "NEW").when(F.col("in_b").isNull(), "GONE").when(F.size(differ) == 0, "SAME").otherwise("CHANGED"))
    return both.select(*keys, state.alias("state"), changed.alias("changed"))


def upsert_plan(existing: DataFrame, staged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What an insert that never overwrites would do with each staged row: NEW, SAME or CONFLICT."""
    plan = changed_columns(existing, staged, keys, columns).where("state <> 'GONE'")
    return plan.withColumn("state", F.when(F.col("state") == "CHANGED", "CONFLICT").otherwise(F.col("state")))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: ``side`` is a or b. Equal tables give none."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def violations(checks: dict[str, DataFrame], key: str) -> DataFrame:
    """``check, key``: the offending rows of all checks in one table."""
    return reduce(DataFrame.unionByName, (d.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("key")) for name, d in checks.items()))
