"""Files as rows: uploads by their kind, vectors, sinks that never leave half a result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.json import redacted

_PAGE = r"(?m)^--- PAGE (\d+) ---\s*$"


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """``path, kind, sha256, byte_size, text, problem``: text and JSON files in UTF-8; others have no text. A file that should be
    UTF-8 and isn't has no text but a problem; the others are read all the same."""
    raw = spark.read.format("binaryFile").load(path)
    kind = (F.when(F.col("path").rlike(r"(?i)\.json$"), "json").when(F.col("path").rlike(r"(?i)\.(txt|md|csv)$"), "text").otherwise("other"))
    valid = F.try_validate_utf8(F.col("content").cast("string"))
    readable = F.col("kind") != "other"
    return raw.select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), "content").select(
        "path", "kind", "sha256", "byte_size", F.when(readable, F.regexp_replace(valid, "^﻿", "")).alias("text"),
        F.when(readable & valid.isNull(), "not UTF-8").alias("problem"))


def pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, page, text``: a text cut at its lines ``--- PAGE n ---``; what stands before the first is page 0."""
    numbers = F.concat(F.array(F.lit("0")), F.regexp_extract_all(F.col(text_col), F.lit(_PAGE), 1))
    parts = F.split(F.col(text_col), _PAGE)
    zipped = df.select(F.col(id_col).alias("id"), F.explode(F.arrays_zip(numbers.alias("n"), parts.alias("t"))).alias("p"))
    return zipped.select("id", F.col("p.n").cast("int").alias("page"), F.trim(F.regexp_replace("p.t", r"^\s+|\s+$", "")).alias("text")).where("text <> ''")


def vectors(spark: SparkSession, path: str, id_col: str, vector_col: str) -> DataFrame:
    """Only ids and vectors of a table: the scan reads two columns."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))


def publish(df: DataFrame, path: str, *, format: str = "parquet", compression: str = "zstd", check: DataFrame | None = None) -> None:
    """Writes beside ``path`` and moves the result there when it is whole; an existing ``path`` is an error and stays.

    ``check`` is a table of violations: with a row in it nothing is published.
    """
    if check is not None and check.limit(1).count():
        raise ValueError("rows violate the contract; nothing was written")
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        df.write.format(format).option("compression", compression if format == "parquet" else "none").save(staged)
        if fs.exists(to) or not fs.rename(jvm.org.apache.hadoop.fs.Path(staged), to):
            raise FileExistsError(path)
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)


def publish_identical(df: DataFrame, path: str) -> bool:
    """Publishes if ``path`` is missing; if it is there, its rows must be the same. True if it was written."""
    spark = df.sparkSession
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
        there = spark.read.parquet(path).select(*df.columns)
        if there.exceptAll(df).limit(1).count() or df.exceptAll(there).limit(1).count():
            raise ValueError(f"{path} holds other rows")
        return False
    publish(df, path)
    return True


def append_audit(df: DataFrame, path: str, payload: str) -> None:
    """Appends rows to an audit log; payloads lose their secrets first, and nothing that is there is ever changed."""
    df.withColumn(payload, redacted(F.col(payload))).write.mode("append").parquet(path)


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order of rows and of columns, over as many files as the range needs."""
    df.select(*sorted(df.columns)).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(path)
