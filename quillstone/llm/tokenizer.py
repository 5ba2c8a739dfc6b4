"""Encoding of whole columns with a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is itself a token in one probe. A miss is
merged by a heap of candidate pairs over a doubly linked list of its bytes. Both run inside Spark tasks on Arrow batches; the
hash table is built once from the vocabulary file and broadcast (its size is that of the vocabulary).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The published pre-token pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class PerfectHash:
    """A minimal perfect hash of byte strings: as many slots as keys, one probe per look-up (hash and displace)."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        buckets: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % n, []).append(i)
        self.shift, self.keys, self.values = [0] * n, [b""] * n, [0] * n
        free, taken = None, bytearray(n)
        for home, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(own) > 1:  # search a seed that sends the whole bucket to free slots
                seed = 1
                while True:
                    slots = [xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    seed += 1
                self.shift[home] = seed
            else:  # a single key takes any free slot, named directly
                free = free or iter([s for s in range(n) if not taken[s]])
                slots = [next(free)]
                self.shift[home] = -slots[0] - 1
            for i, s in zip(own, slots):
                taken[s], self.keys[s], self.values[s] = 1, keys[i], values[i]

    def get(self, key: bytes) -> int | None:
        shift = self.shift[xxhash.xxh3_64_intdigest(key) % self.n]
        slot = -shift - 1 if shift < 0 else xxhash.xxh3_64_intdigest(key, shift) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class Encoder(dict):
    """Maps a space-delimited unit of text to its packed ids; the dictionary keeps what was encoded before.

    A single space between two other characters always starts a pre-token, so ``" unit"`` encodes alike in every text. A unit
    that begins or ends with white space is part of a longer run of it and maps to None: its text takes the pre-token way.
    """

    #: Most bytes that the units and the pieces kept may take each, with so many for the entry itself.
    LIMIT, ENTRY = 128 << 20, 200

    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.table, self.split = table, regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.held = self.held_pieces = 0
        self.kind = np.uint16 if max(table.values) < 65_536 else np.uint32

    def __missing__(self, unit: str) -> bytes | None:
        if not unit or unit[0].isspace() or unit[-1].isspace():
            ids = None
        else:
            ids = self.pre_tokens(" " + unit)
        self.held += self.ENTRY + 2 * len(unit) + len(ids or b"")
        if self.held > self.LIMIT:
            self.clear()
            self.held = 0
        self[unit] = ids
        return ids

    def pre_tokens(self, text: str) -> bytes:
        known = self.pieces
        if self.held_pieces > self.LIMIT:
            known.clear()
            self.held_pieces = 0
        return b"".join([known.get(p) or self.piece(p) for p in self.split(text)])

    def piece(self, text: str) -> bytes:
        raw = text.encode()
        whole = self.table.get(raw)
        ids = self.pieces[text] = np.array([whole] if whole is not None else self.merge(raw), self.kind).tobytes()
        self.held_pieces += self.ENTRY + 2 * len(text) + len(ids)
        return ids

    def merge(self, raw: bytes) -> list[int]:
        """Byte-pair merges in the order of rank: a heap of pairs over linked parts; stale pairs are skipped when popped."""
        get = self.table.get
        part = [raw[i : i + 1] for i in range(len(raw))]
        after, before = list(range(1, len(raw) + 1)), list(range(-1, len(raw) - 1))
        heap = [(rank, i, part[i], part[i + 1]) for i in range(len(raw) - 1) if (rank := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j >= len(raw) or part[j] != right:
                continue
            part[i], part[j], k = left + right, b"", after[j]
            after[i] = k
            if k < len(raw):
                before[k] = i
                if (rank := get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (rank, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (rank := get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (rank, h, part[h], part[i]))
        return [get(p) for p in part if p]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        head, *units = text.split(" ")
        if head and not head[-1].isspace():
            try:
                return self.pre_tokens(head) + b"".join(map(self.__getitem__, units))
            except TypeError:  # a run of white space
                pass
        return self.pre_tokens(text)


def load_table(path: str) -> PerfectHash:
    """The vocabulary file: a base64 token and its rank (which is its id) on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return PerfectHash([base64.b64decode(t) for t, _ in pairs], [int(r) for _, r in pairs])


_TABLES: dict[str, PerfectHash] = {}


def broadcast_table(spark: SparkSession, vocabulary: str | None = None) -> Broadcast:
    path = vocabulary or default_vocabulary()
    if path not in _TABLES:
        _TABLES[path] = load_table(path)
    return spark.sparkContext.broadcast(_TABLES[path])


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(table: Broadcast) -> Encoder:
    """One encoder for each Python worker and vocabulary: what it has learnt serves the worker's next tasks."""
    key = id(table.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(table.value)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``id_col, ids``: the token ids of each text, without special tokens (their strings are ordinary text).

    A null and an empty text have the empty list; blank text has the ids of its white space. Rows are neither merged nor
    dropped, so repeated ids and null ids stay. Whole texts are encoded, whatever their length. Other columns are ignored.
    """
    table = broadcast_table(df.sparkSession, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(table)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                packed = [encoder.encode(t) for t in part.column(1).to_pylist()]
                width = np.dtype(encoder.kind).itemsize
                ends = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(p) // width for p in packed], out=ends[1:])
                ids = np.frombuffer(b"".join(packed), encoder.kind).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``id_col, tokens``: the number of tokens of each text; 0 for null and empty texts."""
    table = broadcast_table(df.sparkSession, vocabulary)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(table)
        width = np.dtype(encoder.kind).itemsize
        for batch in batches:
            counts = [len(encoder.encode(t)) // width for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], [id_col, "tokens"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {id_type}, tokens int")
