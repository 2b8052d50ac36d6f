"""Quantiles by histogram refinement."""

import math

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import order


@pytest.mark.parametrize("bracket", [1, 50, 100_000])
def test_equal_to_numpy(spark, bracket):
    rng = np.random.default_rng(1)
    cols = {
        "normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(size=3000) * 12), "few": rng.integers(0, 3, 3000).astype(float),
        "one": np.full(3000, 4.25), "hot": np.r_[np.zeros(2000), rng.random(1000) * 1e-9],
        "huge": np.r_[rng.random(1500) * 1.7e308, -rng.random(1500) * 1.7e308], "two": np.r_[np.full(1500, 1.0), np.full(1500, np.nextafter(1, 2))],
    }
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in cols.items()])
    probs = (0.0, 0.2, 0.25, 0.5, 0.8, 0.999, 1.0)
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r["k"]: [r[f"q{i}"] for i in range(len(probs))] for r in order.narrowed_quantiles(df, "k", "v", probs, bracket).collect()}
    assert set(got) == set(cols)
    for k, v in cols.items():
        s = np.sort(v)
        for q, value in zip(probs, got[k]):
            at = q * (len(s) - 1)
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            assert value == pytest.approx(lo + (hi - lo) * (at - math.floor(at)), rel=1e-12), (k, q)


def test_infinite_missing_and_no_values(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", x) for x in (-inf, -inf, 1.0, 2.0, inf, nan, nan)] + [("b", None), ("c", inf), ("d", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in order.narrowed_quantiles(df, "k", "v", (0.0, 0.5, 1.0)).collect()}
    assert got["d"] == (5.0, 5.0, 5.0) and "b" not in got
    assert got["a"][1] == 2.0 and math.isnan(got["a"][2])
    assert order.narrowed_quantiles(df.limit(0), "k", "v", (0.5,)).count() == 0


def test_exchange_does_not_grow_with_the_rows(spark):
    """The same distribution, five times the rows: as many rows pass through the exchange of a round."""
    rng = np.random.default_rng(2)
    sizes = []
    for n in (4_000, 20_000):
        df = spark.createDataFrame(pd.DataFrame({"k": "x", "v": rng.random(n)}))
        seen = []
        real = type(df).collect

        def collect(self, *a, _seen=seen, _real=real, **b):
            out = _real(self, *a, **b)
            _seen.append(len(out))
            return out

        try:
            type(df).collect = collect
            order.narrowed_quantiles(df, "k", "v", (0.25, 0.5), bracket=100)
        finally:
            type(df).collect = real
        sizes.append(max(seen))
    assert max(sizes) <= order.BINS and sizes[1] <= sizes[0] * 1.2
