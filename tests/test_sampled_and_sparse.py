"""Silhouette of a sample, one-hot vectors of any number of levels, stored histories."""

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import measures, prep
from gleaner.sources import store


def test_exact_mean_is_inside_the_interval(spark):
    rng = np.random.default_rng(0)
    label = rng.integers(0, 4, 4000)
    x = rng.normal(size=(4000, 3)) + 2.5 * np.eye(4, 3)[label]
    cols = ["a", "b", "c"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=np.arange(4000), label=label)).cache()
    exact = measures.silhouette(df, "id", cols, "label").first()["s"]
    inside = 0
    for seed in range(5):
        got = measures.silhouette_sampled(df, "id", cols, "label", sample=400, seed=seed).first()
        assert got["low"] < got["s"] < got["high"] and got["n"] == 400 and got["high"] - got["low"] < 0.1
        inside += got["low"] <= exact <= got["high"]
    assert inside >= 4
    whole = measures.silhouette_sampled(df, "id", cols, "label", sample=4000).first()
    assert whole["s"] == pytest.approx(exact, abs=1e-9) and whole["low"] == whole["high"]


def test_sampled_silhouette_at_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 0.0, 0), (3, 5.0, 1), (4, 9.0, -1)], "id long, a double, label long")
    got = measures.silhouette_sampled(df, "id", ["a"], "label", drop_noise=True).first()
    assert got["n"] == 3 and got["s"] == pytest.approx((1 + 1 + 0) / 3)
    assert measures.silhouette_sampled(df.filter("label = 0"), "id", ["a"], "label").first()["s"] is None
    assert measures.silhouette_sampled(df.limit(0), "id", ["a"], "label").first()["n"] == 0
    with pytest.raises(ValueError):
        measures.silhouette_sampled(df, "id", ["a"], "label", sample=10**6)


@pytest.mark.parametrize("shipped", [0, 200_000])
def test_sparse_vectors(spark, shipped, monkeypatch):
    monkeypatch.setattr(prep, "BROADCAST_LEVELS", shipped)
    n = 12_000  # more levels than a list of columns can hold
    rows = [(i, f"name {i:05d}", [10, 9, 100, None][i % 4], "k") for i in range(n)]
    df = spark.createDataFrame(rows, "id int, who string, size int, other string")
    got = {r["id"]: r["features"] for r in prep.one_hot_sparse(df, ["who", "size"]).collect()}
    assert len(got) == n and all(v["size"] == n - 1 + 2 for v in got.values())
    assert got[0]["indices"] == [n - 1] and got[1]["indices"] == [0]  # first name: none; 10 is the second size, 9 the first
    assert got[2]["indices"] == [1, n] and got[3]["indices"] == [2] and got[2]["values"] == [1.0, 1.0]
    assert prep.one_hot_sparse(df.limit(0), ["who"]).count() == 0


def test_a_search_that_is_run_again_replaces_its_history(spark, tmp_path):
    base = f"file://{tmp_path}"
    for score in (1.0, 2.0):
        store.write_history(spark.createDataFrame([(1, score)], "candidate_id long, score double"), base, "d", "m")
    store.write_history(spark.createDataFrame([(1, 3.0)], "candidate_id long, score double"), base, "e", "m")
    assert [tuple(r) for r in store.read_history(spark, base, "d").collect()] == [(1, 2.0, "d", "m")]
    assert store.read_history(spark, base).count() == 2
