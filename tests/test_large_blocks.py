"""Tiles of large blocks: a row travels to few tiles whatever the table's size, and pieces of a tile add up to the whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import neighbours, tiles


def points(spark, x, **more):
    cols = {f"x{i}": x[:, i] for i in range(x.shape[1])}
    return spark.createDataFrame(pd.DataFrame({"_id": np.arange(len(x)), **cols, **more}))


def test_blocks_follow_the_cores_not_the_rows(spark):
    d = spark.range(1)
    few = tiles.large_block_count(d, 60_000)
    assert tiles.large_block_count(d, 500_000) == few <= 16
    assert tiles.large_block_count(d, 10 * tiles.TILE_ROWS) == max(few, 10)
    assert tiles.large_block_count(d, 300) == tiles.block_count(d, 300)


def test_every_tile_of_a_wide_table_is_large(spark, monkeypatch):
    seen = []
    real = neighbours.tile_apply
    monkeypatch.setattr(neighbours, "tile_apply", lambda df, blocks, *a: seen.append(blocks) or real(df, blocks, *a))
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 16)
    x = np.random.default_rng(3).normal(size=(900, 20))
    near = neighbours.knn(points(spark, x), "_id", [f"x{i}" for i in range(20)], 3).collect()
    assert seen[0] <= 16  # 57 blocks of 16 rows
    d = tiles.exact_distance(np.repeat(x, 900, 0), np.tile(x, (900, 1)), "euclidean").reshape(900, 900)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), d[i]))[:3]}
    assert {(r["src"], r["dst"]) for r in near} == want


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("na,nb,k", [(50, 33, 4), (40, 0, 3), (23, 2, 5), (30, 30, 7)])
def test_nearest_of_blocks(monkeypatch, metric, na, nb, k):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(na)
    x = rng.integers(0, 4, (na + nb, 6)).astype(float)  # many equal distances
    t = pd.DataFrame(x, columns=[f"x{i}" for i in range(6)]).assign(_id=rng.permutation(na + nb))
    with np.errstate(all="ignore"):
        d = np.array([[tiles.exact_distance(u[None], v[None], metric)[0] for v in x] for u in x])
    np.fill_diagonal(d, np.nan)

    def brute(rows, others):
        out = set()
        for i in rows:
            ok = sorted((d[i, j], int(t["_id"][j])) for j in others if np.isfinite(d[i, j]))
            out |= {(int(t["_id"][i]), j) for _, j in ok[:k]}
        return out

    got = neighbours._nearest_of_blocks(t[:na], t[na:], 6, k, metric, False)
    assert set(zip(got["src"], got["dst"])) == brute(range(na), range(na, na + nb)) | brute(range(na, na + nb), range(na))
    got = neighbours._nearest_of_blocks(t, t, 6, k, metric, True)
    assert set(zip(got["src"], got["dst"])) == brute(range(na + nb), range(na + nb))
    t.loc[3, "x2"] = np.nan  # a missing value in the first block: as _nearest
    for one, other, own in ((t[:na], t[na:], False), (t, t, True)):
        got = neighbours._nearest_of_blocks(one, other, 6, k, metric, own)
        sides = [neighbours._nearest(one, other, 6, k, metric, own)] + ([] if own else [neighbours._nearest(other, one, 6, k, metric, False)])
        want = [s for s in sides if len(s)]
        assert set(zip(got["src"], got["dst"])) == {(int(r.src), int(r.dst)) for s in want for r in s.itertuples()}


@pytest.mark.parametrize("kernel", ["rbf", "laplacian", "poly", "sigmoid"])
def test_kernel_sums_of_one_block_and_of_many(spark, kernel):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(2500, 6)), rng.normal(size=2500)
    dots = 0.3 * (x @ x.T) + 1.0
    gaps = x[:, None] - x[None]
    dense = {
        "rbf": lambda: np.exp(-0.3 * (gaps**2).sum(2)), "laplacian": lambda: np.exp(-0.3 * np.abs(gaps).sum(2)),
        "poly": lambda: np.maximum(dots**3, 0), "sigmoid": lambda: np.maximum(np.tanh(dots), 0),
    }[kernel]()
    for blocks in (1, 3):
        placed = tiles.hash_blocks(points(spark, x, y=y), "_id", blocks)
        got = tiles.kernel_sums(placed, 6, kernel, 0.3, ["y"], blocks).orderBy("_id").toPandas()
        assert np.allclose(got["y"], dense @ y)


def test_label_sums_of_one_block_and_of_many(spark):
    rng = np.random.default_rng(2)
    x, label, w = rng.normal(size=(2500, 3)), rng.integers(0, 5, 2500), rng.integers(1, 4, 2500).astype(float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = np.column_stack([(d * (w * (label == v))).sum(1) for v in range(5)])
    for blocks in (1, 3):
        placed = tiles.hash_blocks(points(spark, x, label=label, _w=w), "_id", blocks)
        got = tiles.label_distance_sums(placed, 3, blocks).groupBy("_id").pivot("other", list(range(5))).agg(F.first("dist"))
        assert np.allclose(got.orderBy("_id").drop("_id").toPandas().to_numpy(float), want)
