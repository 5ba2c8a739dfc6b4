"""Vectors in array columns, computed in double; and exact search of a stated query set in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.session import ensure_checkpoint_dir

#: Queries that are sent to the tasks at once, so that what is broadcast has a bound: at 1,024 dimensions 160 MB in double.
BLOCK_QUERIES = 20_000


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def defect(vector: Column, dim: int, tolerance: float = 1e-4) -> Column:
    """Why a vector cannot be used, or that it isn't of unit length; null where nothing is wrong. Vectors are never mended."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.when(vector.isNull(), "missing").when(F.size(vector) != dim, "dimension").when(bad, "not finite")
            .when(norm(vector) == 0, "zero").when(F.abs(norm(vector) - 1) > tolerance, "not unit"))


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dim`` finite numbers, not all zero, and their unit vectors in double."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    return rows[good], x[good] / length[good, None]


def token_hashes(df: DataFrame, id_col: str, token_col: str, size: int = 64) -> DataFrame:
    """``id, vector``: each token adds 1 or -1 to a bucket, both taken from its SHA-256. A null list of tokens has no row.

    A task hashes each distinct token of a batch once; all tokens of a row are in it, so nothing is shuffled.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            words = batch.column(1).flatten().dictionary_encode()
            digests = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
            bucket = np.array([int.from_bytes(d[:4]) % size for d in digests], np.int64)
            sign = np.array([1 - 2 * (d[4] % 2) for d in digests], np.float64)
            at = words.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            sums = np.bincount(row * size + bucket[at], sign[at], minlength=batch.num_rows * size) if len(at) else np.zeros(batch.num_rows * size)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sums.astype(np.int32)))], ["id", "vector"])

    return df.where(F.col(token_col).isNotNull()).select(id_col, token_col).mapInArrow(run, f"id {id_type}, vector array<int>")


def search(queries: DataFrame, corpus: DataFrame, k: int, dim: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, id, similarity, rank``: the ``k`` nearest of ``corpus(id, vector)`` to each of ``queries(query_id, vector)``.

    Exact cosine in double, ties by smaller id, a row is no answer to a query with its own id. The corpus is never shuffled:
    each task holds its rows against a block of queries and keeps ``k`` for each; one shuffle by query joins the tasks' best.
    Queries go out in blocks of bounded size, one pass over the corpus each. Only one block is held and broadcast at a time: with
    more than one, the answers of each are checkpointed before the next goes out. Unusable vectors take no part.
    """
    spark = queries.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // block))
    named = corpus.select(F.col("id").cast("long").alias("id"), "vector").where(F.col("id").isNotNull())
    parts = []
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        table = own.select(F.col("query_id").cast("long").alias("query_id"), "vector").toArrow()
        rows, q = _matrix(table["vector"].combine_chunks(), dim)
        sent = spark.sparkContext.broadcast((table["query_id"].to_numpy()[rows], q))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            for batch in batches:
                at, x = _matrix(batch.column("vector"), dim)
                ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
                if not len(ids) or not len(qid):
                    continue
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                for a in range(0, len(qid), 512):
                    sims = q[a : a + 512] @ x.T
                    sims[qid[a : a + 512, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(sims, top, 1)
                    keep = np.isfinite(value)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(qid[a : a + 512], keep.sum(1))), pa.array(ids[top][keep]), pa.array(value[keep])],
                        ["query_id", "id", "similarity"])

        found = named.mapInArrow(best, "query_id long, id long, similarity double")
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
        parts.append(one_block(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), sent, blocks))
    return reduce(DataFrame.unionByName, parts)


def one_block(found: DataFrame, sent: Broadcast, blocks: int) -> DataFrame:
    """The answers to a block of queries; where there are several blocks they are computed now and the block is let go."""
    if blocks == 1:
        return found
    ensure_checkpoint_dir(found.sparkSession)
    found = found.checkpoint()
    sent.destroy()
    return found
