"""Spectral sums over all pairs of rows without visiting the pairs."""

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import select as S


def brute(x, gamma):
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    z = x / k.sum(1)[:, None]
    return {"cut": (z * (k @ z)).sum(0), "norm": (x * z).sum(0), "mass": z.sum(0)}


def table(kind):
    rng = np.random.default_rng(3)
    n = 700
    if kind == "one-hot":
        return np.column_stack([rng.normal(size=n), np.eye(5)[rng.integers(0, 5, n)][:, 1:]])
    if kind == "two continuous":
        return np.column_stack([rng.normal(size=n), rng.exponential(size=n)])
    if kind == "far and repeated":
        return np.column_stack([np.r_[rng.normal(size=n - 3), 40.0, -900.0, 40.0].round(1), rng.integers(0, 3, n)])
    return np.column_stack([rng.integers(0, 4, n), np.full(n, 2.5)]).astype(float)


@pytest.mark.parametrize("kind", ["one-hot", "two continuous", "far and repeated", "no continuous"])
def test_all_pairs_count_but_none_is_formed(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "tile_apply", lambda *a, **k: pytest.fail("visits all pairs of rows"))
    monkeypatch.setattr(S, "kernel_sums", lambda *a, **k: pytest.fail("visits all pairs of rows"))
    x = table(kind)
    cols = [f"c{i}" for i in range(x.shape[1])]
    d = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(len(x))))
    found, want = S.spec_sums(d, "id", cols), brute(x, 1 / len(cols))
    for name in want:
        assert np.allclose(found[name], want[name], rtol=1e-12, atol=1e-12), name


def test_many_continuous_columns_and_missing_values_take_the_tiles(spark, monkeypatch):
    tiles, real = [], S.tile_apply
    monkeypatch.setattr(S, "tile_apply", lambda *a, **k: tiles.append(1) or real(*a, **k))
    x = np.random.default_rng(0).normal(size=(90, 5))
    cols = [f"c{i}" for i in range(5)]
    d = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(90)))
    found, want = S.spec_sums(d, "id", cols), brute(x, 0.2)
    assert tiles and all(np.allclose(found[k], want[k]) for k in want)
    holes = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 3.0), (2, 0.5, 1.0)], "id long, c0 double, c1 double")
    assert np.isnan(S.spec_sums(holes, "id", ["c0", "c1"])["norm"][0])
