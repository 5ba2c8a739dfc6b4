"""Line-delimited JSON with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Every line is an object of the schema; a line that isn't fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def file_problems(spark: SparkSession, path: str) -> DataFrame:
    """``path, problem`` for files with a byte-order mark, a blank line or no line end at their end."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("t"))
    each = F.array_compact(F.array(
        F.when(F.col("t").startswith("﻿"), F.lit("byte-order mark")), F.when((F.length("t") > 0) & ~F.col("t").endswith("\n"), F.lit("no final line end")),
        F.when(F.col("t").rlike(r"(?:^|\n)[ \t\r]*\n"), F.lit("blank line"))))
    return raw.select("path", F.explode(each).alias("problem"))


def lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): blank lines are skipped; a reject has ``path, line, text``. Line numbers are counted per file.

    Files are read whole by one task each, as line numbers demand; keep files at the size of a block.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line", "text"))
    lines = raw.where(F.length(F.trim(F.regexp_replace("text", "\r$", ""))) > 0).select("path", (F.col("line") + 1).alias("line"), "text")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    broken = T.StructType([*kind.fields, T.StructField("_broken", T.StringType())])
    parsed = lines.withColumn("r", F.from_json("text", broken, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    bad = F.col("r").isNull() | F.col("r._broken").isNotNull() | ~F.ltrim("text").startswith("{")
    return parsed.where(~bad).select("path", "line", *(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields)), parsed.where(bad).select("path", "line", "text")


def document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that is one JSON object or array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
