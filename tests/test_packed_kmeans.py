"""K-means over packed rows against Spark ML's."""

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import kmeans as km, localised as L, select as S
from gleaner.session import cut


@pytest.mark.parametrize("n, parts, k, seed", [(3_000, 5, 4, 42), (20_000, 2, 7, 1), (40, 3, 3, 5), (6, 2, 5, 9)])
def test_centres_labels_and_cost_are_those_of_spark(spark, n, parts, k, seed):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 3)) + rng.integers(0, 3, (n, 1))
    scale = [1.0, 0.5, 2.0]
    d = cut(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(n))).repartition(parts))
    vec = km.vectors(d, list("abc"), ["id"], scale=scale)
    want, found = km.fit(vec, k, seed), km.Packed(d, list("abc")).fit(k, seed, scale=np.array(scale))
    assert want.centres.shape == found.centres.shape and np.allclose(want.centres, found.centres, atol=1e-9)
    assert np.isclose(want.cost, found.cost)
    a, b = want.label(vec).toPandas().set_index("id")["label"], found.label(d).toPandas().set_index("id")["label"]
    assert (a.sort_index() == b.sort_index()).all()


def test_some_columns_one_cluster_and_missing_values(spark):
    x = np.random.default_rng(0).normal(size=(500, 3))
    d = cut(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=np.arange(500))))
    packed = km.Packed(d, list("abc"))
    want = km.fit(km.vectors(d, ["c", "a"]), 3, 4)
    assert np.allclose(packed.fit(3, 4, cols=["c", "a"]).centres, want.centres, atol=1e-9)
    assert np.allclose(packed.fit(1).centres, x.mean(0)) and np.isclose(packed.fit(1).cost, ((x - x.mean(0)) ** 2).sum())
    holes = cut(spark.createDataFrame([(0, 1.0), (1, None)], "id long, a double"))
    with pytest.raises(Exception, match="missing values"):
        km.Packed(holes, ["a"])
