import math

import numpy as np
import pytest

from relweave.llm import hnsw, knn


def brute(rows, k, t):
    ids = np.array(sorted(rows))
    v = np.array([rows[i] for i in ids], "f8")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(v @ v.T, 9)
    np.fill_diagonal(s, -3)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= t:
                out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def data(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dim))
    m = (centres[rng.integers(0, 60, n)] + 0.25 * rng.normal(size=(n, dim))).astype("f4")
    rows = {i: m[i] for i in range(n)}
    for i in range(20):  # a large class of equal vectors, and a scaled one
        rows[n + i] = m[0]
    rows[n + 30] = m[1] * 4
    rows[n + 31] = m[1]
    return rows


def frame(spark, rows, extra=()):
    listed = [(int(i), [float(x) for x in v], "x") for i, v in rows.items()]
    return spark.createDataFrame(listed + list(extra), "vec_id bigint, embedding array<float>, ids string")


def test_recall_against_brute_force(spark):
    rows = data()
    extra = [(5, [float(x) for x in rows[5]], "x"), (7000, None, "x"), (7001, [], "x"), (7002, [0.0] * 16, "x"), (7003, [math.nan] + [1.0] * 15, "x"), (7004, [1.0] * 15, "x"), (7005, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (7006, [math.inf] + [1.0] * 15, "x")]
    s = knn.Settings(dim=16, k=5, cell=150, shard=100, block=200)
    got = {tuple(r) for r in knn.similar_pairs(frame(spark, rows, extra), 0.85, settings=s).collect()}
    want = brute(rows, 5, 0.85)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    same = {0, *range(900, 920)}
    copies = {p for p in want if set(p) <= same}
    assert copies and copies <= got


def test_small_and_empty(spark):
    s = knn.Settings(dim=2, k=5)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in knn.similar_pairs(df, 0.85, settings=s).collect()} == {(1, 2)}
    assert knn.similar_pairs(df.limit(1), 0.85, settings=s).count() == 0
    assert knn.similar_pairs(df.limit(0), 0.85, settings=s).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40, 300, 2500])
def test_graph_of_any_size(n):
    rng = np.random.default_rng(n)
    v = knn.unit(rng.normal(size=(n, 12))).astype("f4")
    g = hnsw.build(v)
    ids, sims = g.search(v, 3, 24)
    s = v @ v.T
    want = np.argsort(-s, axis=1)[:, : min(3, n)]
    assert (ids[:, 0] == np.arange(n)).mean() > 0.99
    assert np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(ids, want)]) > 0.95


def test_extreme_values():
    assert np.allclose(knn.unit(np.array([[3e37, 4e37], [3e-40, 4e-40]], "f4")), [[0.6, 0.8]] * 2, atol=1e-3)


def recall(spark, m, settings):
    near = knn.nearest_vectors(frame(spark, dict(enumerate(m))), settings=settings).collect()
    s = np.round(knn.unit(m) @ knn.unit(m).T, 9)
    np.fill_diagonal(s, -3)
    want = {(i, int(j)) for i in range(len(m)) for j in np.argsort(-s[i], kind="stable")[: settings.k]}
    assert len(near) == len(m) * settings.k
    return len(want & {(r.vec_id, r.neighbour) for r in near}) / len(want)


@pytest.mark.parametrize("cells, fan", [(12, 4096), (60, 4096), (500, 4096), (60, 8), (500, 30)])
def test_recall_of_all_neighbours(spark, cells, fan):
    """At every number of cells, and with centroids in two levels."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 16))
    m = np.concatenate([centres[rng.integers(0, 400, 4500)] + 0.3 * rng.normal(size=(4500, 16)), rng.normal(size=(500, 16))]).astype("f4")
    assert recall(spark, m, knn.Settings(dim=16, k=5, cell=len(m) // cells, shard=2 * len(m) // cells, block=2000, fan=fan)) >= 0.95


def test_different_vectors_under_one_id_and_copies(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    near = knn.nearest_vectors(df, settings=knn.Settings(dim=2, k=2)).collect()
    assert {(r.vec_id, r.neighbour) for r in near if r.vec_id in (2, 3)} >= {(2, 3), (3, 2)}
    assert all(sum(r.vec_id == i for r in near) == 2 for i in (1, 2, 3, 4))
