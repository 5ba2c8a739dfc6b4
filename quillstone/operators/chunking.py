"""Splitting texts into fragments."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[.!?;。！？；](?:\s+|$)")
_BREAK = re.compile(r"\n|\. ")


def lossless(text: str, limit: int = 2400) -> list[tuple[int, int]]:
    """(start, end) of fragments of at most ``limit`` characters whose concatenation is the text.

    A fragment ends at the last blank line that fits, else behind the last sentence, else behind the last white space, else
    at the limit.
    """
    spans, start = [], 0
    while len(text) - start > limit:
        stop = start + limit
        window = text[start:stop]
        gap = window.rfind("\n\n")
        end = gap + 2 if gap > 0 else 0
        if not end:
            found = [m.end() for m in _SENTENCE.finditer(window)]
            end = found[-1] if found else 0
        if not end:
            white = max(window.rfind(c) for c in " \n\t")
            end = white + 1 if white > 0 else limit
        spans.append((start, start + end))
        start += end
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def overlapping(text: str, size: int = 1200, overlap: int = 150) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``size`` that overlap; a window ends at a line or sentence past its middle if it can.

    All places to break are found once: behind a line end, or behind a full stop whose space still lies in the window.
    """
    found = [(m.start() + 1, m.end()) for m in _BREAK.finditer(text)]
    breaks, needs = ([place for place, _ in found], [need for _, need in found])
    spans, begin, end = [], 0, 0
    while end < len(text):
        end = min(len(text), begin + size)
        last = bisect_right(needs, end) - 1
        if end < len(text) and last >= 0 and breaks[last] > begin + size // 2 + 1:
            end = breaks[last]
        spans.append((begin, end))
        begin = max(end - overlap, begin + 1)
    return [(a, b) for a, b in spans if not text[a:b].isspace()]


def fragments(df: DataFrame, id_col: str, text_col: str, split: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """``id, index, start, content``: the fragments of each text; none for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, a, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for n, (a, b) in enumerate(split(t))]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "index", "start", "content"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, index int, start long, content string")
