"""Identity by content."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Between the parts of an identity; a null part is marked so that it differs from an empty one.
SEPARATOR, NULL = "\u001f", "\u0000"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identity(*parts: Column | str) -> Column:
    """One hash over several columns, in their order."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit(NULL)) for p in parts)), 256)


def uuid5(namespace: str):
    """A pandas function: the name-based UUID of a text in a namespace."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, namespace)

    @F.pandas_udf(T.StringType())
    def named(text: pd.Series) -> pd.Series:
        return text.map(lambda t: str(uuid.uuid5(space, t)), na_action="ignore")

    return named


@F.pandas_udf(T.StringType())
def vector_hash(vector: pd.Series) -> pd.Series:
    """SHA-256 of a vector as little-endian floats."""
    return vector.map(lambda v: hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest(), na_action="ignore")


def joined_hash(df: DataFrame, key: str, order: list[str], text: str, between: str = "\n") -> DataFrame:
    """``key, hash, n``: SHA-256 of the texts of each key, joined in order, and their number; null texts are left out of both.

    The rows of a key are sorted in one task, which can spill, and hashed as they pass: its joined text is never held.
    """
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("hash", T.StringType()), T.StructField("n", T.LongType())])
    schema = to_arrow_schema(out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = None, None, 0
        for batch in batches:
            done = {key: [], "hash": [], "n": []}
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                if not n or k != last:
                    if n:
                        for c, v in zip(done, (last, state.hexdigest(), n)):
                            done[c].append(v)
                    last, state, n = k, hashlib.sha256(), 0
                state.update(((between if n else "") + t).encode())
                n += 1
            yield pa.RecordBatch.from_pydict(done, schema)
        if n:
            yield pa.RecordBatch.from_pydict({key: [last], "hash": [state.hexdigest()], "n": [n]}, schema)

    return df.where(F.col(text).isNotNull()).repartition(key).sortWithinPartitions(key, *order, text).select(key, text).mapInArrow(hashed, out)
