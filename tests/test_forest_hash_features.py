"""Isolation forest, hashed neighbours, manhattan radius joins, clustering features, power iteration."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.operators import cluster, density, neighbours, outliers, prep
from gleaner.recipes import WIDE, wide_raw
from gleaner.session import cut

SF = "/root/testdata/sf0.1"


def frame(spark, x, first=0):
    cols = [f"c{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "id", np.arange(first, first + len(x)))
    return spark.createDataFrame(pdf), cols


def blobs(seed, k, n, p, spread=0.1, far=4.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, p)) * far
    label = np.repeat(np.arange(k), n)
    return centres[label] + rng.normal(size=(k * n, p)) * spread, label


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


# ---------------------------------------------------------------- isolation forest


def test_path_lengths_by_hand():
    """Root cuts column 0 at 1: a leaf of 1 row on the left; on the right column 1 is cut at 5: leaves of 2 and 3 rows."""
    harmonic = np.log(2) + outliers.EULER
    c3 = 2 * harmonic - 4 / 3
    forest = outliers.Forest(
        roots=np.array([0]), column=np.array([0, -1, 1, -1, -1]), cut=np.array([1.0, 0, 5, 0, 0]),
        left=np.array([1, -1, 3, -1, -1]), right=np.array([2, -1, 4, -1, -1]),
        path=np.array([0.0, 1 + 0, 0, 2 + 1, 2 + c3]), sample=6,
    )
    x = np.array([[0.0, 9], [1, 4], [2, 5], [np.nan, 0], [2, np.nan]])
    assert np.allclose(forest.mean_paths(x), [1, 3, 2 + c3, 3, 2 + c3])
    norm = 2 * (np.log(5) + outliers.EULER) - 2 * 5 / 6
    assert np.allclose(forest.scores(x), 2 ** (-forest.mean_paths(x) / norm))


def test_a_tree_isolates_every_row_it_can():
    x = np.arange(8.0)[:, None]
    nodes = outliers._grow(x, np.random.default_rng(0), height=20)
    leaves = [n for n in nodes if n[0] == -1]
    assert len(leaves) == 8 and len(nodes) == 15
    assert len(outliers._grow(np.ones((9, 2)), np.random.default_rng(0), 8)) == 1


def test_planted_outliers_score_highest(spark):
    x, _ = blobs(1, 1, 5_000, 3, spread=1.0, far=0)
    x[:10] = np.random.default_rng(2).choice([-9.0, 9.0], size=(10, 3))
    df, cols = frame(spark, x)
    got = outliers.isolation_forest(df, "id", cols, contamination=0.002).toPandas().set_index("id")
    assert len(got) == 5_000 and got["score"].between(0, 1).all()
    assert set(got.index[got["outlier"]]) == set(range(10))
    again = outliers.isolation_forest(df.repartition(7), "id", cols, contamination=0.002).toPandas().set_index("id")
    assert np.allclose(got["score"].sort_index(), again["score"].sort_index())
    kept = outliers.remove_outliers(df, outliers.forest_filter("id", cols, contamination=0.002))
    assert kept.columns == df.columns and kept.count() == 4_990


def test_forest_at_edges(spark):
    df, cols = frame(spark, np.ones((50, 2)))
    same = outliers.isolation_forest(df, "id", cols).toPandas()
    assert len(same) == 50 and not same["outlier"].any() and same["score"].nunique() == 1
    assert outliers.isolation_forest(df.limit(0), "id", cols, contamination=0.1).count() == 0
    holes = df.withColumn("c0", F.when(F.col("id") > 5, F.col("c0"))).withColumn("c1", F.when(F.col("id") != 7, F.lit(float("nan"))))
    assert outliers.isolation_forest(holes, "id", cols).filter("score IS NOT NULL").count() == 50
    one = outliers.isolation_forest(df.limit(1), "id", cols).collect()
    assert len(one) == 1
    with pytest.raises(ValueError):
        outliers.fit_forest(df, "id", cols, trees=10_000, sample=256)
    assert outliers.remove_outliers(df, "isolation_forest") is df


# ---------------------------------------------------------------- hashed neighbours


def recall(spark, df, cols, k, **how):
    key = df.columns[0]
    true = neighbours.knn(df, key, cols, k).select("src", "dst")
    got = neighbours.knn(df, key, cols, k, method="lsh", **how).select("src", "dst")
    return true.join(got, ["src", "dst"]).count() / true.count()


def test_hashed_neighbours_of_clustered_rows(spark):
    x, _ = blobs(3, 120, 25, 24, spread=0.3, far=1.0)
    df, cols = frame(spark, x)
    assert recall(spark, df, cols, 10, tables=8, bucket=256) >= 0.9


def test_hashed_neighbours_of_the_embeddings(spark):
    assert recall(spark, wide_raw(spark, SF).select("vec_id", *WIDE), WIDE, 8) >= 0.9


@pytest.mark.parametrize("metric", ["manhattan", "cosine"])
def test_hashed_neighbours_of_other_metrics(spark, metric):
    x, _ = blobs(4, 40, 20, 12, spread=0.2, far=2.0)
    df, cols = frame(spark, x)
    true = neighbours.knn(df, "id", cols, 5, metric).select("src", "dst")
    got = neighbours.knn(df, "id", cols, 5, metric, method="lsh", tables=8, bucket=128).select("src", "dst")
    assert true.join(got, ["src", "dst"]).count() / true.count() >= 0.9


def test_buckets_are_bounded_and_every_row_travels_once_per_table(spark):
    """Hot values too: rows that no direction separates are dealt out."""
    x, _ = blobs(5, 10, 300, 6)
    x[:1_000] = x[0]
    for scale in (1, 3):
        df, cols = frame(spark, np.tile(x, (scale, 1)))
        rows = df.select(F.col("id").alias("_id"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)])
        held = cut(neighbours.hash_tables(rows, 6, "euclidean", rows.count(), 5, 64, 1))
        assert held.count() == 5 * 3_000 * scale
        assert held.groupBy("node").count().agg(F.max("count")).first()[0] <= 3 * 64


def test_copies_find_each_other_under_hashing(spark):
    x = np.repeat(np.arange(30.0)[:, None] ** 2, 20, axis=0)
    df, cols = frame(spark, x)
    near = neighbours.knn(df, "id", cols, 4, method="lsh", tables=2, bucket=16).groupBy("src").agg(F.count("*").alias("n"), F.max("d").alias("d"))
    assert near.filter("n = 4 AND d = 0").count() == 600
    with pytest.raises(ValueError):
        neighbours.knn(df, "id", cols, 4, method="guess")


# ---------------------------------------------------------------- manhattan radius


def brute_dbscan(x, eps, least):
    near = np.abs(x[:, None] - x[None]).sum(2) <= eps
    core = near.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], n
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = n
                    stack.append(j)
        n += 1
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return label


@pytest.mark.parametrize("p,eps", [(1, 0.02), (3, 0.35), (5, 0.9)])
def test_manhattan_dbscan(spark, p, eps):
    rng = np.random.default_rng(p)
    x = np.round(rng.random((500, p)) * 2, 3)
    x[:60] = x[60]
    df, cols = frame(spark, x)
    got = density.optics_dbscan(df, "id", cols, eps, 6, "l1").toPandas().sort_values("id")["label"].to_numpy()
    assert (got == brute_dbscan(x, eps, 6)).all()
    degree = neighbours.eps_degree(df, "id", cols, eps, "cityblock").toPandas().sort_values("id")["neighbours"].to_numpy()
    assert (degree == (np.abs(x[:, None] - x[None]).sum(2) <= eps).sum(1)).all()


# ---------------------------------------------------------------- clustering features


def test_store_keeps_to_the_radius():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(3_000, 4)), np.zeros((500, 4)), rng.normal(size=(50, 4)) * 1e6])
    store = cluster.FeatureStore(4, 0.5)
    took = np.concatenate([store.add(np.ones(len(b)), b, (b * b).sum(1)) for b in np.array_split(x, 7)])
    assert (took >= 0).all() and store.n.sum() == len(x)
    for f in range(len(store.n)):
        own = x[took == f]
        assert len(own) == store.n[f] and np.allclose(own.sum(0), store.s[f])
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1).mean()) <= 0.5 * (1 + 1e-3) or len(own) == 1
    assert len(store.n) < 1_000


def test_features_of_partitions_are_merged(spark, monkeypatch):
    x, label = blobs(6, 5, 400, 3, spread=0.05)
    df, cols = frame(spark, x)
    rows = df.select("id", *[F.col(c).alias(f"x{i}") for i, c in enumerate(cols)]).repartition(9)
    features, members = cluster.birch_features(rows, 3, 0.5)
    assert 5 <= features.count() <= 10
    of = members.toPandas().sort_values("id")["feature"]
    assert len(set(zip(of, label))) == of.nunique()  # no feature spans two blobs
    got = cluster.birch(df, "id", cols, 5).toPandas().sort_values("id")["label"]
    assert same_partition(got, label)
    assert cluster.birch_features(rows.limit(0), 3, 0.5)[1].count() == 0


# ---------------------------------------------------------------- power iteration


def test_power_iteration_agrees_with_the_spectral_embedding(spark):
    x = np.vstack([blobs(8 + i, 1, 60, 2, spread=s, far=0)[0] + 40 * i for i, s in enumerate((0.2, 0.6, 1.2))])
    x = np.vstack([x, x[:5]])  # copies
    df, cols = frame(spark, x)
    fast = cluster.power_iteration(df, "id", cols, 3).toPandas().sort_values("id")["label"].to_numpy()
    exact = cluster.spectral(df, "id", cols, 3, "nearest_neighbors").toPandas().sort_values("id")["label"].to_numpy()
    assert len(fast) == 185 and (fast[180:] == fast[:5]).all() and same_partition(fast, exact)
    lone, cols = frame(spark, np.ones((4, 2)))
    assert cluster.power_iteration(lone, "id", cols, 1).select("label").distinct().count() == 1


def test_search_offers_what_is_there():
    from gleaner.plans.search import CLUSTERERS

    assert {"manhattan", "l1"} <= set(CLUSTERERS["OPTICS"]["metric"][1])
    assert prep.remove_outliers is outliers.remove_outliers
