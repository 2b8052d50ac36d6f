"""The spanning tree against Kruskal, through its listed and its block rounds."""

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import cluster, graph, tiles


def kruskal(x, metric):
    d = tiles.exact_distance(np.repeat(x, len(x), 0), np.tile(x, (len(x), 1)), metric).reshape(len(x), -1)
    i, j = np.triu_indices(len(x), 1)
    up, picked = list(range(len(x))), []

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for e in np.lexsort((j, i, d[i, j])):
        a, b = root(i[e]), root(j[e])
        if a != b:
            up[a] = b
            picked.append(d[i[e], j[e]])
    return np.sort(picked)


def groups(seed, n, p):
    """Tight groups far apart, so lists of neighbours end inside; rows of every group are spread over the ids."""
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(n, p)) + 30 * c for c in rng.normal(size=(6, p))])
    x[:12] = x[0]
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("metric,p,rows", [("euclidean", 2, 16), ("euclidean", 7, 32), ("manhattan", 3, 40), ("cosine", 3, 2048)])
def test_same_tree_as_kruskal(spark, metric, p, rows, monkeypatch):
    monkeypatch.setattr(tiles, "MIN_BLOCK_ROWS", rows)
    monkeypatch.setattr(graph, "block_count", lambda df, n: tiles.block_count(df, n, rows))
    x = groups(p, 50, p)
    cols = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(len(x))))
    tree = graph.spanning_tree(df, "id", cols, metric, k=4).toPandas()
    assert len(tree) == len(x) - 1
    assert np.allclose(np.sort(tree["d"]), kruskal(x, metric), atol=1e-7)
    assert (tree["a"] != tree["b"]).all()


def test_block_rounds_skip_most_pairs(spark, monkeypatch):
    """A long row of groups: only neighbouring blocks are compared."""
    rng = np.random.default_rng(0)
    x = np.column_stack([np.repeat(np.arange(40.0) * 10, 50), np.zeros(2000)]) + rng.random((2000, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(len(x))))
    seen = []
    real = graph.tile_apply

    def counted(state, blocks, fn, schema, partners=None):
        seen.append((partners.filter("_b <= _o").count(), blocks * (blocks + 1) // 2))
        return real(state, blocks, fn, schema, partners)

    monkeypatch.setattr(graph, "tile_apply", counted)
    monkeypatch.setattr(graph, "block_count", lambda df, n: 40)
    tree = graph.spanning_tree(df, "id", ["a", "b"], k=6).toPandas()
    assert len(tree) == 1999 and np.isclose(tree["d"].sum(), kruskal(x, "euclidean").sum())
    assert seen and all(visited <= of / 4 for visited, of in seen)


def test_cut_at_a_height(spark):
    x = np.array([0.0, 1, 2, 10, 11, 30])
    df = spark.createDataFrame(pd.DataFrame({"id": [5, 3, 9, 1, 7, 8], "c": x}))
    got = {r["id"]: r["label"] for r in cluster.single_linkage(df, "id", ["c"], height=1.0).collect()}
    assert got == {1: 0, 7: 0, 3: 1, 5: 1, 9: 1, 8: 2}
    assert cluster.single_linkage(df, "id", ["c"], height=0.5).select("label").distinct().count() == 6
    assert cluster.single_linkage(df, "id", ["c"], height=1e9).select("label").distinct().count() == 1
