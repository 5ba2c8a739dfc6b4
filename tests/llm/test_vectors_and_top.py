import numpy as np
import pytest

from quillstone.llm import neighbours as nb
from quillstone.llm.topn import top_items
from tests.conftest import rows


def clustered(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 8), dim))
    return [(i, (centres[i % len(centres)] + 0.3 * rng.standard_normal(dim)).astype(float).tolist()) for i in range(n)]


def brute(data, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in order[i]}


def test_recall_against_brute_force(spark):
    data = clustered(3000)
    got = nb.nearest(spark.createDataFrame(data, "id long, v array<float>"), "id", "v", k=5, dim=16, cell_rows=100)
    found = {(r.id, r.neighbour) for r in got.collect()}
    true = brute(data, 5)
    assert len(found & true) / len(true) > 0.97


def test_unusable_vectors_and_scale(spark):
    data = clustered(60, 4) + [(100, None), (101, [1.0]), (102, [0.0] * 4), (103, [float("nan"), 1.0, 1.0, 1.0]), (104, [float("inf"), 0.0, 0.0, 1.0]), (105, [None, 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "id long, v array<float>, vec string")
    ids = {r.id for r in nb.nearest(df, "id", "v", k=3, dim=4).collect()}
    assert ids == set(range(60))
    big = spark.createDataFrame([(i, [x * 10 ** (i % 3) for x in v]) for i, v in clustered(60, 4)], "id long, v array<float>")
    plain = spark.createDataFrame(clustered(60, 4), "id long, v array<float>")
    pairs = lambda d: rows(nb.neighbour_pairs(nb.nearest(d, "id", "v", k=3, dim=4)))
    assert pairs(big) == pairs(plain)


def test_many_copies(spark):
    data = clustered(200) + [(1000 + i, [1.0] * 16) for i in range(150)]
    found = nb.nearest(spark.createDataFrame(data, "id long, v array<float>"), "id", "v", k=5, dim=16)
    own = {}
    for r in found.collect():
        own.setdefault(r.id, []).append(r.neighbour)
    assert sorted(own[1100]) == [1000, 1001, 1002, 1003, 1004] and sorted(own[1002]) == [1000, 1001, 1003, 1004, 1005]
    assert len(own) == 350 and all(len(x) == 5 for x in own.values())


def test_few_rows(spark):
    make = lambda data: spark.createDataFrame(data, "id long, v array<float>")
    assert nb.nearest(make([]), "id", "v", dim=2).count() == 0
    assert nb.nearest(make([(1, [1.0, 0.0])]), "id", "v", dim=2).count() == 0
    assert nb.nearest(make([(1, None), (2, [0.0, 0.0])]), "id", "v", dim=2).count() == 0
    assert rows(nb.neighbour_pairs(nb.nearest(make([(1, [1.0, 0.0]), (2, [0.0, 1.0])]), "id", "v", dim=2))) == [(1, 2)]


def test_blocks_of_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 40)
    data = clustered(400)
    got = {(r.id, r.neighbour) for r in nb.nearest(spark.createDataFrame(data, "id long, v array<float>"), "id", "v", k=5, dim=16, cell_rows=200).collect()}
    true = brute(data, 5)
    assert len(got & true) / len(true) > 0.97 and len(got) == 2000


def plain_top(data, n):
    best = {}
    for g, i, s in data:
        if i is not None and s is not None and np.isfinite(s):
            best[g, i] = max(best.get((g, i), -np.inf), s + 0.0)
    out = []
    for g in {g for g, _ in best}:
        own = sorted((-s, i) for (h, i), s in best.items() if h == g)[:n]
        out += [(g, i, -s, r + 1) for r, (s, i) in enumerate(own)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [5, 10_000])
def test_top_items(spark, heavy):
    rng = np.random.default_rng(2)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.integers(30)}", f"i{rng.integers(40)}", round(float(rng.random()), 1)) for _ in range(900)]
    data += [(None, "a", 1.0), (None, "b", 1.0), ("g1", None, 9.0), ("g1", "n", float("nan")), ("g1", "m", None), ("g2", "z", float("inf")), ("g3", "neg", -0.0), ("g3", "pos", 0.0)]
    df = spark.createDataFrame([(*d, 1) for d in data], "g string, item string, score double, rank int")
    assert rows(top_items(df, ["g"], "item", "score", 5, heavy_rows=heavy)) == plain_top(data, 5)
    assert rows(top_items(df, ["g"], "item", "score", 5, heavy_rows=heavy, broadcast_groups=0)) == plain_top(data, 5)


def test_top_of_nothing(spark):
    assert top_items(spark.createDataFrame([], "g string, item string, score double"), ["g"], "item", "score", 5).count() == 0
