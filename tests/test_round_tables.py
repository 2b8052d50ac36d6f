"""What loops leave on disk."""

import os

import numpy as np
import pandas as pd

from gleaner import session
from gleaner.operators import cluster as C


def written(spark):
    top = session._scratch(spark).removeprefix("file:")
    return {d for d in os.listdir(top)} if os.path.isdir(top) else set()


def test_affinity_propagation_keeps_the_tables_of_one_round(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    d = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(75)))
    was = written(spark)
    labels = C.affinity_propagation(d, "id", ["a", "b"], n_neighbors=8).toPandas()
    assert len(labels) == 75 and labels["label"].nunique() >= 3
    assert len(written(spark) - was) < 15  # more than fifteen rounds of two tables were run


def test_dropped_tables_are_gone_and_others_stay(spark):
    a, b = session.cut(spark.range(3).toDF("v")), session.cut(spark.range(4).toDF("v"))
    paths = [t._written for t in (a, b)]
    session.drop(a, spark.range(2))
    assert not os.path.exists(paths[0].removeprefix("file:")) and b.count() == 4
