"""Sparse k-means sorts its columns once; each round is a scan of packed rows."""

import numpy as np
import pytest

from gleaner.functions import reduce
from gleaner.operators import assign, select as S


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(0, 1, 900), rng.integers(0, 4, 900), np.zeros(900)])
    x[300:600, 0] += 9
    data = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id long, a double, b double, c double").repartition(5), ["a", "b", "c"], x


def pairs(v):
    return np.abs(v[:, None] - v[None]).sum()


def test_sums_by_nearest_centre(rows, monkeypatch):
    monkeypatch.setattr(reduce, "BLOCK", 7)
    df, cols, x = rows
    centres, w = np.array([[0.0, 1.0, 0.0], [9.0, 2.0, 0.0], [99.0, 0.0, 0.0]]), np.array([0.9, 0.4, 0.1])
    lab = assign.nearest_labels(list((x * w).T), centres * w)
    want = {r["id"]: r["l"] for r in assign.nearest(df.selectExpr("id", "a*0.9D a", "b*0.4D b", "c*0.1D c"), cols, centres * w, "l").collect()}
    assert lab.tolist() == [want[i] for i in range(len(x))]
    held = S.sorted_blocks(df, cols)
    assert held.selectExpr("max(size(x0))").first()[0] == 7
    got = {(r["feature"], r["label"]): (r["n"], r["pairs"]) for r in S.sorted_absolute_sums(held, cols, centres, w).collect()}
    assert set(got) == {(c, g) for c in cols for g in (0, 1)}
    for (c, g), (n, q) in got.items():
        v = x[lab == g, cols.index(c)]
        assert n == len(v) and q == pytest.approx(pairs(v), rel=1e-9, abs=1e-9)


def test_null_counts_as_in_the_exchange(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None), (2, None, 1.0), (2, -3.0, 4.0), (None, 2.0, None), (5, 7.0, -2.5)], "id long, a double, b double"
    )
    order = lambda d: sorted((r["feature"], r["n"], round(r["pairs"], 9)) for r in d.collect())
    assert order(S.sorted_absolute_sums(S.sorted_blocks(df, ["a", "b"]), ["a", "b"])) == order(S.pairwise_absolute_sums(df, ["a", "b"]))
    by, means = S._lloyd(reduce.row_blocks(df, ["a", "b"]), np.array([[0.0, 0.0], [6.0, -2.0]]), np.ones(2), rounds=1)
    assert by.tolist() == [[0.0, 0.0], [6.0, -2.0]]
    assert means == pytest.approx(np.array([[1 / 3, 2.5], [7.0, -2.5]]))  # missing cells are left out of the means


def test_a_repeated_value_is_dealt_over_tasks(rows):
    df, cols, _ = rows
    held = S.sorted_blocks(df, cols)
    most = held.filter("_f = 2").selectExpr("shiftright(_at, 33) as chunk", "size(x0) as n").groupBy("chunk").sum("n")
    assert most.selectExpr("max(`sum(n)`)").first()[0] < 300


def test_rounds_sort_nothing(rows, monkeypatch):
    df, cols, _ = rows
    calls = []
    running = S.running
    monkeypatch.setattr(S, "running", lambda *a, **k: calls.append(1) or running(*a, **k))
    found, labels = S.sparse_kmeans(df, "id", cols, 1.2, 2, max_iterations=3)
    assert not calls
    assert labels.count() == 900 and labels.select("label").distinct().count() == 2
    few = {r["feature"]: r["score"] for r in found.collect()}
    monkeypatch.setattr(S, "SORTED_COLUMNS", 2)  # many columns: sums by exchanges
    many = {r["feature"]: r["score"] for r in S.sparse_kmeans(df, "id", cols, 1.2, 2, max_iterations=3)[0].collect()}
    assert calls and few == pytest.approx(many, abs=1e-9)
