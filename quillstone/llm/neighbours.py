"""k most similar vectors for every vector: collision counting over sorted single projections, in parts of the space.

How it works
------------
1. *Parts.* A bounded sample (``sample_rows``) is clustered in two levels on the driver, into as many cells as give each about
   ``cell_rows`` rows. Every row, sampled or not, goes to its nearest cell and to at most ``replicas - 1`` others that are
   nearly as close (``slack``), so a row is copied no more often in a large table than in a small one. A cell is large: it is
   what one task can hold, not the set of candidates.
2. *Index.* Each of ``projections`` random projections of a cell is kept as one sorted array, cut into runs of equal length.
   For every run the set of rows before it is kept as a bitmap, so any window of the array is the difference of two bitmaps.
3. *Collision counting.* A query opens a window of half width ``width * R`` around its own projection in each array and counts
   for all rows of the cell in how many windows they lie. The windows are added as bitmaps, 64 rows in a word, by carry-save
   adders. Rows with at least ``threshold * projections`` collisions are verified with the exact cosine in double; no other
   vector is touched. Virtual rehashing widens R by the factor ``growth`` on the same arrays. A query is finished when its k-th
   verified distance is within R, when more than ``k + budget`` vectors were verified, or when R spans the whole sphere.
4. *Merge.* The at most ``replicas * k`` finds of a query are merged with one shuffle on the query id.

Groups of exact copies larger than k + 1 are answered by their k + 1 smallest ids (equal similarity: smaller id first), so
a third of all rows being one vector costs one slim window and never reaches a cell. A cell that the clustering cannot split
(very many vectors that differ by rounding only) is searched in pairs of blocks of ``BLOCK_ROWS``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a cell as planned, fewest cells of a table with more than ``ONE_CELL`` rows, and rows that a task holds at most.
CELL_ROWS, LEAST_CELLS, ONE_CELL, BLOCK_ROWS = 12_000, 8, 4_000, 50_000
#: Most rows of the sample from which the cells are fitted. Every row is indexed, whether sampled or not.
SAMPLE_ROWS = 262_144
#: Most groups of copies whose first ids are broadcast; beyond it they are joined with salts.
BROADCAST_GROUPS, SALTS = 100_000, 32
#: Runs of a sorted projection, queries counted at once, rows verified at once.
RUNS, BATCH, VERIFY = 64, 64, 4096


def usable(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors (``dim`` finite numbers, not all zero) and those vectors as float32 rows."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(flat).all(1) & (flat != 0).any(1)
    return rows[good], flat[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Spherical k-means; a centroid that loses its rows keeps its place."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        own = (x @ c.T).argmax(1)
        order = np.argsort(own, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], heads, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[own[order][heads]] = sums / np.maximum(norm, 1e-12)
    return c


class Cells:
    """Two levels of centroids. ``blocks[c]`` is the number of blocks into which cell c is split, from the sample's load."""

    def __init__(self, sample: np.ndarray, rows: int, replicas: int, slack: float, probes: int, cell_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        want = 1 if rows <= ONE_CELL else max(LEAST_CELLS, -(-rows * replicas // cell_rows))
        want = max(1, min(len(sample) // 4, want))
        self.replicas, self.slack, self.probes = replicas, slack, probes
        self.coarse = _lloyd(sample, int(np.ceil(np.sqrt(want))), rng)
        own = (sample @ self.coarse.T).argmax(1)
        fine, parent = [], []
        for g in range(len(self.coarse)):
            part = sample[own == g]
            if len(part):
                c = _lloyd(part, max(1, round(want * len(part) / len(sample))), rng)
                fine.append(c)
                parent += [g] * len(c)
        self.fine, self.parent = np.vstack(fine), np.array(parent)
        self.start = np.searchsorted(self.parent, np.arange(len(self.coarse) + 1))
        cells = self.route(sample)[0]
        load = np.bincount(cells[cells >= 0], minlength=len(self.fine)) * (rows / len(sample))
        self.blocks = np.maximum(1, np.ceil(load / BLOCK_ROWS)).astype(np.int64)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of each row, nearest first, -1 where there are fewer than ``replicas``; and their similarities."""
        near = np.argsort(-(x @ self.coarse.T), axis=1)[:, : self.probes]
        best = np.full((len(x), self.replicas), -np.inf, np.float32)
        cell = np.full((len(x), self.replicas), -1, np.int64)
        for g in range(len(self.coarse)):
            a, b = self.start[g], self.start[g + 1]
            rows = np.flatnonzero((near == g).any(1))
            if a == b or not len(rows):
                continue
            sims = x[rows] @ self.fine[a:b].T
            top = np.argsort(-sims, axis=1)[:, : self.replicas]
            s = np.hstack([best[rows], np.take_along_axis(sims, top, 1)])
            c = np.hstack([cell[rows], top + a])
            pick = np.argsort(-s, axis=1, kind="stable")[:, : self.replicas]
            best[rows], cell[rows] = np.take_along_axis(s, pick, 1), np.take_along_axis(c, pick, 1)
        return np.where(best >= best[:, :1] - self.slack, cell, -1), best

    def groups(self, x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, cell, block, block): every group that a row belongs to. A cell of one block has the group (0, 0)."""
        cells = self.route(x)[0]
        rows, at = np.nonzero(cells >= 0)
        cells = cells[rows, at]
        n = self.blocks[cells]
        rep = np.repeat(np.arange(len(rows)), n)
        other = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        mine = (ids[rows] * 2654435761 % 4294967296 >> 7)[rep] % n[rep]
        return rows[rep], cells[rep], np.minimum(mine, other), np.maximum(mine, other)


class Projections:
    """The sorted projections of a cell in runs: ``edges`` has the first value of each run, ``before`` the rows before it."""

    def __init__(self, p: np.ndarray, runs: int = RUNS):
        self.p, (n, m) = p, p.shape
        size = -(-n // runs)
        runs = -(-n // size)
        self.edges = np.empty((m, runs))
        self.before = np.zeros((m, runs + 1, -(-n // 64)), np.uint64)
        run_of = np.empty(n, np.int64)
        for j in range(m):
            order = np.argsort(p[:, j], kind="stable")
            self.edges[j] = p[order[::size], j]
            run_of[order] = np.arange(n) // size
            bits = np.zeros((runs, 64 * self.before.shape[2]), bool)
            bits[run_of, np.arange(n)] = True
            self.before[j, 1:] = np.bitwise_or.accumulate(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), axis=0)

    def windows(self, queries: np.ndarray, half: float) -> Iterator[np.ndarray]:
        """Of each projection the rows in the runs that the window of each query touches, as one bitmap a query."""
        for j, edges in enumerate(self.edges):
            low = np.searchsorted(edges, self.p[queries, j] - half, "right") - 1
            high = np.searchsorted(edges, self.p[queries, j] + half, "right")
            window = self.before[j].take(high, axis=0)
            window ^= self.before[j].take(np.maximum(low, 0), axis=0)
            yield window


def at_least(sets: Iterable[np.ndarray], need: int) -> np.ndarray:
    """The elements that lie in ``need`` or more of the bitmaps: counts are kept as planes of bits, summed by full adders."""
    planes: list[list[np.ndarray]] = [[]]

    def add(level: int, bits: np.ndarray) -> None:
        if level == len(planes):
            planes.append([])
        planes[level].append(bits)
        if len(planes[level]) == 3:
            a, b, c = planes[level]
            half = a ^ b
            planes[level] = [half ^ c]
            add(level + 1, (a & b) | (half & c))

    for bits in sets:
        add(0, bits)
    level = 0
    while level < len(planes):
        if len(planes[level]) == 2:
            a, b = planes[level]
            planes[level] = [a ^ b]
            add(level + 1, a & b)
        level += 1
    some = next(p[0] for p in planes if p)
    enough = np.full_like(some, ~np.uint64(0)) if need < 1 << len(planes) else np.zeros_like(some)
    for level, plane in enumerate(planes):  # compared from the lowest digit: the highest in which they differ decides
        digit = plane[0] if plane else np.zeros_like(some)
        enough = enough & digit if need >> level & 1 else enough | digit
    return enough


def colliding(index: Projections, queries: np.ndarray, half: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the query, row) of all rows other than the query itself with enough collisions, by place, then row."""
    places, rows = [], []
    for a in range(0, len(queries), BATCH):
        part = queries[a : a + BATCH]
        enough = at_least(index.windows(part, half), need)
        enough[np.arange(len(part)), part >> 6] &= ~(np.uint64(1) << (part & 63).astype(np.uint64))
        at, word = np.nonzero(enough)
        hit, bit = np.nonzero(np.unpackbits(enough[at, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        places.append(at[hit] + a)
        rows.append(word[hit] * 64 + bit)
    return np.concatenate(places), np.concatenate(rows)


def search_cell(ids: np.ndarray, x: np.ndarray, k: int, axes: np.ndarray, start: float, growth: float, width: float,
                threshold: float, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, neighbour id and cosine of the k best verified vectors of each vector of a cell (collision counting)."""
    order = np.argsort(ids, kind="stable")  # a tie of the cosine goes to the smaller id by position
    ids, x = ids[order], unit(x[order])
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0], np.empty(0)
    index, need = Projections(x @ axes), int(np.ceil(threshold * axes.shape[1]))
    short = x.astype(np.float32)
    out = []
    for a in range(0, n, 512):
        todo, radius = np.arange(a, min(n, a + 512)), start
        while len(todo):
            q, c = colliding(index, todo, width * radius, need)
            found = np.bincount(q, minlength=len(todo))
            near = np.empty(len(q), np.float32)  # only what is within rounding of the k best is verified in double
            for s in range(0, len(q), VERIFY):
                near[s : s + VERIFY] = np.einsum("ij,ij->i", short[todo[q[s : s + VERIFY]]], short[c[s : s + VERIFY]])
            kth = np.full(len(todo), -9.0)
            enough = np.flatnonzero(found >= k)
            kth[enough] = near[np.argsort(q * 8.0 - near)[(np.cumsum(found) - found)[enough] + k - 1]] - 1e-5
            close = near >= kth[q]
            q, c = q[close], c[close]
            sims = np.einsum("ij,ij->i", x[todo[q]], x[c])
            best = np.lexsort((c, -sims, q))
            q, c, sims = q[best], c[best], sims[best]
            sizes = np.bincount(q, minlength=len(todo))
            rank = np.arange(len(q)) - (np.cumsum(sizes) - sizes)[q]
            reach = np.full(len(todo), np.inf)
            last = rank == k - 1
            reach[q[last]] = np.sqrt(np.maximum(0, 2 - 2 * sims[last]))
            done = (reach <= radius) | (found >= min(n - 1, k + budget)) | (radius >= 2)
            keep = done[q] & (rank < k)
            out.append((todo[q[keep]], c[keep], sims[keep]))
            todo, radius = todo[~done], radius * growth
    q, c, sims = (np.concatenate(x) for x in zip(*out))
    return ids[q], ids[c], sims


def _copies(rows: DataFrame, k: int, few: bool) -> DataFrame:
    """``id, ids``: the rows that have at least k + 1 copies with smaller ids, with these k + 1 ids in order."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    slim = rows.where(finite).select("id", *_hashes())
    by_id = Window.partitionBy("h", "g").orderBy("id")
    heads = slim.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    full = heads.groupBy("h", "g").agg(F.count("*").alias("c"), F.sort_array(F.collect_list("id")).alias("ids")).where(F.col("c") == k + 1).drop("c")
    if few:
        joined = slim.join(F.broadcast(full), ["h", "g"])
    else:  # copies of one vector are spread over the salts
        salted = slim.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(full.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "g", "s"])
    return joined.where(~F.array_contains("ids", F.col("id"))).select("id", "ids")


def _hashes() -> list:
    """128 bits of a vector: equal for copies, and for other vectors with no chance that counts."""
    return [F.xxhash64("vec").alias("h"), F.xxhash64(F.lit(1), "vec").alias("g")]


def nearest(df: DataFrame, id_col: str, vec_col: str, *, k: int = 5, dim: int = 128, replicas: int = 4, slack: float = 0.12, probes: int = 8,
            cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, projections: int = 28, start: float = 0.5,
            growth: float = 1.2, width: float = 1.36, threshold: float = 0.64, budget: int = 48, seed: int = 17) -> DataFrame:
    """``id, neighbour, similarity``: for each usable vector its k most similar others (cosine in double; ties: smaller id).

    Unusable vectors (null, another length than ``dim``, a null or non-finite number, all zero) are neither queries nor
    answers. Copies are neighbours of each other. Rows with a null id are left out. Fewer than k others give fewer rows; an
    empty table gives none. Other columns of ``df`` are ignored, whatever their names.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") == dim) & F.exists("vec", lambda v: v != 0))
    per_vector = rows.groupBy(*_hashes()).agg(F.count("*").alias("c"))
    total, crowded = per_vector.agg(F.sum("c"), F.count_if(F.col("c") > k + 1)).first()
    schema = "id long, neighbour long, similarity double"
    if not total:
        return spark.createDataFrame([], schema)

    copies = None
    if crowded:  # groups of copies: the k + 1 smallest ids stand for them, the others are answered at once
        rest = _copies(rows, k, crowded <= BROADCAST_GROUPS)
        rows = rows.join(rest.select("id"), "id", "left_anti")
        copies = rest.select("id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("similarity"))

    share = min(1.0, min(sample_rows, max(4000, 256 * total * replicas // cell_rows)) / total)
    pick = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec")
    taken = pick.limit(2 * sample_rows).toArrow()
    sample = usable(taken["vec"], dim)[1]
    if not len(sample):  # no usable vector among the sample: one cell
        sample = np.eye(1, dim, dtype=np.float32)
    cells = spark.sparkContext.broadcast(Cells(unit(sample).astype(np.float32), total, replicas, slack, probes, cell_rows, seed))
    axes = np.random.default_rng(seed).standard_normal((dim, projections))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column("vec"), dim)
            if not len(at):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
            row, cell, a, b = cells.value.groups(unit(x).astype(np.float32), ids)
            ends = np.arange(len(row) + 1, dtype=np.int32) * (4 * dim)
            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(x[row].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(a), pa.array(b), pa.array(ids[row]), packed], ["cell", "a", "b", "id", "vec"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        x = np.frombuffer(b"".join(table["vec"].to_pylist()), np.float32).reshape(-1, dim)
        q, c, s = search_cell(ids, x, k, axes, start, growth, width, threshold, budget)
        return pa.table({"id": pa.array(q, pa.int64()), "neighbour": pa.array(c, pa.int64()), "similarity": pa.array(s, pa.float64())})

    found = rows.mapInArrow(route, "cell long, a long, b long, id long, vec binary").groupBy("cell", "a", "b").applyInArrow(search, schema)
    best = F.slice(F.array_distinct(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("d"), "neighbour")))), 1, k)
    merged = found.groupBy("id").agg(best.alias("b")).select("id", F.explode("b").alias("x")).select(
        "id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.d")).alias("similarity"))
    return merged.unionByName(copies) if copies is not None else merged


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``id_a < id_b``: each pair of which one is among the nearest of the other, once."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
