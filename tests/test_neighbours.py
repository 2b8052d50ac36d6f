"""Neighbour and graph operators against brute force, with a third of the rows in one spot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import density, graph, neighbours as N, tiles
from gleaner.operators.kmeans import fit, vectors


def cloud(p=2, n=300, hot=150, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 0.4, (n // 2, p))
    b = rng.normal(3, 0.4, (n - n // 2, p))
    return np.vstack([a, b, np.full((hot, p), 1.0)])


def frame(spark, x):
    cols = [f"v{i}" for i in range(x.shape[1])]
    d = spark.createDataFrame([(3 * i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols])
    return d.repartition(4), cols


def distances(x, metric="euclidean"):
    d = x[:, None] - x[None]
    if metric == "manhattan":
        return np.abs(d).sum(-1)
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return 1 - u @ u.T
    return np.sqrt((d**2).sum(-1))


def brute_knn(x, k):
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    return {(3 * i, 3 * int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}


@pytest.mark.parametrize("p,prune", [(2, False), (2, True), (6, False)])
def test_knn_exact_with_copies(spark, monkeypatch, p, prune):
    if prune:
        monkeypatch.setattr(N, "PRUNE_FROM_BLOCKS", 2)
        monkeypatch.setattr(tiles, "MIN_BLOCK_ROWS", 30)
    x = cloud(p)
    d, cols = frame(spark, x)
    got = N.knn(d, "id", cols, 5).collect()
    assert {(r["src"], r["dst"]) for r in got} == brute_knn(x, 5)
    full = distances(x)
    assert all(abs(full[r["src"] // 3, r["dst"] // 3] - r["d"]) < 1e-9 for r in got)


@pytest.mark.parametrize("metric", ["manhattan", "cosine"])
def test_knn_other_metrics(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(1, 1, (80, 3))
    d, cols = frame(spark, x)
    got = {r["src"]: r["m"] for r in N.knn(d, "id", cols, 4, metric).groupBy("src").agg(F.max("d").alias("m")).collect()}
    full = np.sort(distances(x, metric), axis=1)
    assert np.allclose([got[3 * i] for i in range(80)], full[:, 4])


@pytest.mark.parametrize("leaf", [64, 4])
@pytest.mark.parametrize("p", [1, 2, 8])
def test_radius_counts(spark, monkeypatch, p, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    x = cloud(p)
    d, cols = frame(spark, x)
    eps = 0.4 * p**0.5
    got = {r["id"]: r["neighbours"] for r in N.eps_degree(d, "id", cols, eps).collect()}
    want = (distances(x) <= eps).sum(1)
    assert [got[3 * i] for i in range(len(x))] == want.tolist()


def brute_dbscan(x, eps, m):
    d = distances(x) <= eps
    core = d.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = c
            while todo:
                v = todo.pop()
                for w in np.flatnonzero(d[v] & core & (label < 0)):
                    label[w] = c
                    todo.append(w)
            c += 1
    for i in np.flatnonzero(~core):
        near = label[d[i] & core]
        if len(near):
            label[i] = near.min()
    return label


@pytest.mark.parametrize("p,eps,leaf", [(2, 0.3, 64), (2, 0.3, 3), (8, 1.6, 16)])
def test_dbscan(spark, monkeypatch, p, eps, leaf):
    monkeypatch.setattr(N, "LEAF", leaf)
    x = cloud(p)
    d, cols = frame(spark, x)
    want = brute_dbscan(x, eps, 6)
    got = {r["id"]: r["label"] for r in density.dbscan(d.repartition(p + 1), "id", cols, eps, 6).collect()}
    assert [got[3 * i] for i in range(len(x))] == want.tolist()


def test_two_dense_groups_and_noise(spark):
    x = np.array([[0, 0], [0, 0.1], [0.1, 0], [0.1, 0.1], [0.05, 0.05], [5, 5], [5, 5.1], [5.1, 5], [5.1, 5.1], [5.05, 5.05], [50, 50]])
    d, cols = frame(spark, x)
    lab = {r["id"]: r["label"] for r in density.dbscan(d, "id", cols, 0.2, 4).collect()}
    assert [lab[3 * i] for i in range(11)] == [0] * 5 + [1] * 5 + [-1]
    core = {r["id"]: r["core_distance"] for r in density.optics_core_distance(d, "id", cols, 4).collect()}
    assert np.allclose([core[3 * i] for i in range(11)], np.sort(distances(x), axis=1)[:, 3])


def test_optics_flat_cosine(spark):
    rng = np.random.default_rng(2)
    t = np.concatenate([rng.normal(0.2, 0.01, 30), rng.normal(1.2, 0.01, 30)])
    r = rng.uniform(1, 9, 60)
    d, cols = frame(spark, np.column_stack([r * np.cos(t), r * np.sin(t)]))
    lab = {q["id"]: q["label"] for q in density.optics_dbscan(d, "id", cols, 0.01, 5, "cosine").collect()}
    assert len({lab[3 * i] for i in range(30)}) == 1 and len({lab[3 * i] for i in range(30, 60)}) == 1
    assert lab[0] != lab[90]


def test_mean_shift(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(4, 0.2, (40, 2))])
    d, cols = frame(spark, x)
    for binned in (True, False):
        lab, modes = density.mean_shift(d, "id", cols, 1.5, binned)
        got = {r["id"]: r["label"] for r in lab.collect()}
        assert [got[3 * i] for i in range(100)] == [0] * 60 + [1] * 40
        assert np.allclose([r["n"] for r in modes.orderBy("label").collect()], [60, 40])


def union_find(n, edges):
    par = list(range(n))

    def find(v):
        while par[v] != v:
            par[v] = par[par[v]]
            v = par[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = np.random.default_rng(7)
    n = 200
    if kind == "chain":
        order = rng.permutation(n)
        edges = [(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 100]
    elif kind == "star":
        edges = [(150, i) for i in range(100)]
    else:
        edges = [tuple(map(int, e)) for e in rng.integers(0, n, (120, 2))]
    got = graph.components(spark.range(n), spark.createDataFrame(edges, "a long, b long")).collect()
    want = union_find(n, edges)
    assert {r["id"]: r["comp"] for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_spanning_tree(spark, metric):
    x = cloud(2, 120, 40)
    d, cols = frame(spark, x)
    tree = graph.spanning_tree(d, "id", cols, metric).collect()
    dist = distances(x, metric)
    iu = np.triu_indices(len(x), 1)
    par, total = list(range(len(x))), 0.0

    def find(v):
        while par[v] != v:
            v = par[v]
        return v

    for q in np.argsort(dist[iu], kind="stable"):
        a, b = find(iu[0][q]), find(iu[1][q])
        if a != b:
            par[a] = b
            total += dist[iu][q]
    assert len(tree) == len(x) - 1
    assert sum(r["d"] for r in tree) == pytest.approx(total)
    assert len(set(union_find(len(x), [(r["a"] // 3, r["b"] // 3) for r in tree]))) == 1


def test_spectral_embedding_residuals(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, (60, 2)) for c in (0, 3, 6)])
    d, cols = frame(spark, x)
    near = N.knn(d, "id", cols, 10)
    edges = graph.symmetrise(graph.heat_weights(near, 2.0)).cache()
    vec = vectors(d, cols, ["id"])
    parts = fit(vec, 40, max_iter=5).label(vec, "part")
    seeds, width = graph.coarse_start(edges, parts, 7)
    out, lam, res = graph.spectral_embedding(
        graph.edge_product(edges), graph.degrees(edges), 3, start=(parts.join(seeds, "part").drop("part"), width), steps=6
    )
    w = np.zeros((180, 180))
    for r in edges.collect():
        w[r["src"] // 3, r["dst"] // 3] = r["w"]
    s = 1 / np.sqrt(w.sum(1))
    lap = np.eye(180) - s[:, None] * w * s[None]
    want, vecs = np.linalg.eigh(lap)
    assert np.allclose(lam, want[:3], atol=1e-4) and max(res) < 1e-2
    v = out.orderBy("id").toPandas()[["v0", "v1", "v2"]].to_numpy()
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6)
    assert np.linalg.norm(lap @ v - v * lam) < 0.05


def test_laplacian_rows_sum_to_zero_in_degree_scale(spark):
    x = cloud(2, 60, 0)
    d, cols = frame(spark, x)
    e = graph.symmetrise(graph.heat_weights(N.knn(d, "id", cols, 5))).cache()
    deg = {r["id"]: r["degree"] for r in graph.degrees(e).collect()}
    acc = {}
    for r in graph.normalised_laplacian(e).collect():
        acc[r["src"]] = acc.get(r["src"], 0) + r["l"] * deg[r["dst"]] ** 0.5
    assert max(abs(v) for v in acc.values()) < 1e-9
