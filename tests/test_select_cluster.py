import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import cluster as C, localised as L, measures as E, select as S
from gleaner.operators.assign import jaccard, nearest
from gleaner.sources import synth
from tests.test_neighbours import distances, frame


def agreement(a, b):
    """Share of row pairs on which two labellings agree."""
    a, b = np.asarray(a), np.asarray(b)
    same = (a[:, None] == a[None]) == (b[:, None] == b[None])
    return same.mean()


@pytest.fixture(scope="module")
def blobs(spark):
    d = synth.blobs(synth.ids(spark, 400), n_features=4, n_clusters=4, random_state=3).cache()
    return d, [f"f{i}" for i in range(4)]


@pytest.fixture(scope="module")
def mixed(spark):
    """Two informative columns, one copy, two noise columns, some repeated rows."""
    rng = np.random.default_rng(8)
    c = rng.integers(0, 3, 150)
    base = np.array([[0, 0], [4, 0], [0, 4]])[c] + rng.normal(0, 0.3, (150, 2))
    x = np.column_stack([base, base[:, 0], rng.normal(0, 1, (150, 2))])
    x[:50] = x[0]
    x = (x - x.mean(0)) / x.std(0)
    d, cols = frame(spark, x)
    return d.cache(), cols, x


def dense_spec(x, clusters=3):
    n, p = x.shape
    k = np.exp(-distances(x) ** 2 / p)
    deg = k.sum(1)
    s = 1 / np.sqrt(deg)
    lap = s[:, None] * (np.diag(deg) - k) * s[None]
    f = s[:, None] * x
    f = f / np.linalg.norm(f, axis=0)
    cut = np.einsum("ij,ik,kj->j", f, lap, f)
    generic = cut / (1 - (f.T @ s))
    val, vec = np.linalg.eigh(lap)
    fixed = -sum((2 - val[j]) * (f.T @ vec[:, j]) ** 2 for j in range(1, clusters))
    return cut, generic, fixed


def scores(df):
    return np.array([r["score"] for r in df.orderBy("idx").collect()])


def test_spectral_scores_match_dense(mixed):
    d, cols, x = mixed
    cut, generic, fixed = dense_spec(x)
    assert np.allclose(scores(S.normalized_cut(d, "id", cols)), cut)
    assert np.allclose(scores(S.generic_spec(d, "id", cols)), generic)
    assert np.allclose(scores(S.fixed_spec(d, "id", cols, 3)), fixed, atol=1e-4)


def test_random_features_are_close(mixed):
    d, cols, x = mixed
    cut, generic, fixed = dense_spec(x)
    assert np.abs(scores(S.normalized_cut(d, "id", cols, "rff")) - cut).max() < 0.05
    # One eigenvector: the later ones lie close together and mix under approximation.
    one = dense_spec(x, 2)[2]
    assert np.corrcoef(scores(S.fixed_spec(d, "id", cols, 2, "rff")), one)[0, 1] > 0.9


def test_copied_columns_score_alike(mixed):
    d, cols, _ = mixed
    for got in (
        S.normalized_cut(d, "id", cols), S.generic_spec(d, "id", cols), S.fixed_spec(d, "id", cols),
        S.wkmeans(d, "id", cols, 3, 2.0)[0], S.sparse_kmeans(d, "id", cols, 1.5, 3, max_iterations=3)[0],
    ):
        s = scores(got)
        assert s[0] == pytest.approx(s[2], abs=1e-9)


def test_mcfs_matches_dense_embedding(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.6, (50, 3)) for c in (0, 2, 4)])
    d, cols = frame(spark, x)
    vec, lam, _ = S.knn_embedding(d, "id", cols, 3)
    v = vec.orderBy("id").toPandas()[["v0", "v1", "v2"]].to_numpy()
    a = np.column_stack([x, np.ones(150)])
    want = np.abs(np.linalg.lstsq(a, v, rcond=None)[0][:3]).max(1)
    got = scores(S.mcfs(d, "id", cols, 3))
    assert np.allclose(got, want, atol=1e-2)
    lasso = S.regression_coefficients(vec.select("id", F.col("v1").alias("t")).join(d, "id"), cols, ["t"], "lasso", 0.0005)
    assert np.abs(lasso).sum() <= np.abs(np.linalg.lstsq(a, v[:, 1], rcond=None)[0][:3]).sum() + 1e-6
    with pytest.raises(ValueError):
        S.regression_coefficients(d, cols, cols[:1], "other")


def test_top_k_rules(spark):
    t = S.score_table(spark, list("abcde"), [1.0, 3.0, 3.0, float("nan"), 3.0])
    assert S.chosen(S.top_k(t, 3)) == ["c", "d", "e"]
    assert S.chosen(S.top_k(t, 99)) == list("abcde")
    assert S.chosen(S.above(t, 2.0)) == ["b", "c", "d", "e"]
    with pytest.raises(ValueError):
        S.top_k(t, 0)


def test_weighted_kmeans_weights():
    d = np.array([2.0, 4.0, 8.0, 1e-5])
    w = S.weights_from_dispersion(d, 3.0)
    want = (d[:3] ** -0.5) / (d[:3] ** -0.5).sum()
    assert np.allclose(w[:3], want) and w[3] == 0 and w.sum() == pytest.approx(1)
    assert S.weights_from_dispersion(np.array([3.0, 1.0, 2.0]), 1).tolist() == [0, 1, 0]


def test_constrained_weights_meet_the_bound():
    o = np.array([5.0, 3.0, 1.0, -2.0])
    w = S.constrained_weights(o, 1.2)
    assert np.linalg.norm(w) == pytest.approx(1) and w.sum() == pytest.approx(1.2, abs=1e-6)
    loose = S.constrained_weights(o, 5.0)
    assert np.allclose(loose, np.clip(o, 0, None) / np.linalg.norm(np.clip(o, 0, None)))
    tight = S.constrained_weights(o, 0.01)
    assert tight.argmax() == 0 and tight.sum() == pytest.approx(1, abs=1e-4)


def test_pairwise_sums_match_double_loop(mixed):
    d, cols, x = mixed
    lab = d.withColumn("label", F.col("id") % 3)
    got = {r["feature"]: r["objective"] for r in S.sparse_objective(lab, cols, "label").collect()}
    l = (np.arange(len(x)) * 3) % 3
    for j, c in enumerate(cols):
        m = np.abs(x[:, j][:, None] - x[:, j][None])
        want = m.sum() / len(x) - sum(m[np.ix_(l == g, l == g)].sum() / (l == g).sum() for g in set(l))
        assert got[c] == pytest.approx(want, abs=1e-7)


def test_sparse_kmeans_prefers_informative(mixed):
    d, cols, _ = mixed
    s = scores(S.sparse_kmeans(d, "id", cols, 1.6, 3, max_iterations=6)[0])
    assert min(s[:3]) > max(s[3:])


def test_separability_from_scatter(mixed):
    d, cols, x = mixed
    lab = d.withColumn("label", (F.col("id") / 3).cast("long") % 2)
    t = L.scatter_tables(lab, cols, "label")
    l = np.arange(len(x)) % 2
    for g in (0, 1):
        c = x[l == g] - x[l == g].mean(0)
        assert np.allclose(t[g].around(t[g].mean), c.T @ c)
    w, b = np.diag([2.0, 4.0]), np.diag([1.0, 1.0])
    assert L.separability(w, b, 1, [0, 1]) == pytest.approx(0.75)
    assert L.separability(np.zeros((2, 2)) + 1, b, 2, [0, 1]) == pytest.approx(0.5)


def test_localised_selection(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal([0, 0, 0], [0.2, 0.2, 3], (60, 3)), rng.normal([5, 5, 0], [0.2, 0.2, 3], (60, 3))])
    d, cols = frame(spark, x)
    out = L.localised_selection(d, "id", cols, 2, max_iterations=2)
    lab = out.labels.orderBy("id").toPandas()["label"].to_numpy()
    assert len(lab) == 120 and set(lab) <= {0, 1}
    assert len(out.features) == 2 and all(f for f in out.features)


@pytest.mark.parametrize(
    "run",
    [
        lambda d, c: C.kmeans(d, "row_id", c, 4),
        lambda d, c: C.bisecting(d, "row_id", c, 4),
        lambda d, c: C.minibatch_kmeans(d, "row_id", c, 4, 100),
        lambda d, c: C.birch(d, "row_id", c, 4),
        lambda d, c: C.gaussian_mixture(d, "row_id", c, 4, "full"),
        lambda d, c: C.gaussian_mixture(d, "row_id", c, 4, "tied"),
        lambda d, c: C.gaussian_mixture(d, "row_id", c, 4, "diag"),
        lambda d, c: C.gaussian_mixture(d, "row_id", c, 4, "spherical"),
        lambda d, c: C.single_linkage(d, "row_id", c, 4),
        lambda d, c: C.spectral(d, "row_id", c, 4, "nearest_neighbors"),
        lambda d, c: C.spectral(d, "row_id", c, 4, "rbf", gamma=0.1),
    ],
    ids=["kmeans", "bisecting", "minibatch", "birch", "gmm-full", "gmm-tied", "gmm-diag", "gmm-sph", "single", "spectral-nn", "spectral-rbf"],
)
def test_blobs_are_recovered(blobs, run):
    d, cols = blobs
    lab = run(d.drop("label"), cols).withColumnRenamed("id", "row_id").withColumnRenamed("label", "got")
    pdf = d.select("row_id", "label").join(lab, "row_id").toPandas()
    assert len(pdf) == 400 and agreement(pdf["label"], pdf["got"]) > 0.85


def test_one_cluster(blobs):
    d, cols = blobs
    assert {r["label"] for r in C.kmeans(d, "row_id", cols, 1).collect()} == {0}
    assert {r["label"] for r in C.gaussian_mixture(d, "row_id", cols, 1, "diag").collect()} == {0}


def test_rings_and_moons(spark):
    from gleaner.operators.density import dbscan

    def check(d, lab):
        got = lab.withColumnRenamed("id", "row_id").withColumnRenamed("label", "got")
        pdf = d.select("row_id", "label").join(got, "row_id").toPandas()
        assert agreement(pdf["label"], pdf["got"]) > 0.97

    rings = synth.circles(synth.ids(spark, 600), (300, 300), noise=0.01).cache()
    check(rings, dbscan(rings, "row_id", ["f0", "f1"], 0.09, 5).select("id", "label"))
    moons = synth.moons(synth.ids(spark, 400), (200, 200), noise=0.01).cache()
    check(moons, C.spectral(moons, "row_id", ["f0", "f1"], 2, "nearest_neighbors"))


def dense_affinity_propagation(s, damping, rounds):
    n = len(s)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(rounds):
        b = a + s
        first = b.argmax(1)
        top = b.max(1)
        b[np.arange(n), first] = -np.inf
        second = b.max(1)
        rn = s - top[:, None]
        rn[np.arange(n), first] = s[np.arange(n), first] - second
        r = damping * r + (1 - damping) * rn
        rp = np.maximum(r, 0)
        np.fill_diagonal(rp, np.diag(r))
        an = rp.sum(0)[None] - rp
        diag = np.diag(an).copy()
        an = np.minimum(an, 0)
        np.fill_diagonal(an, diag)
        a = damping * a + (1 - damping) * an
    return set(np.flatnonzero(np.diag(r + a) > 0))


def test_affinity_propagation_matches_dense(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.3, (10, 2)) for c in (0, 3, 6)])
    d, cols = frame(spark, x)
    lab = C.affinity_propagation(d, "id", cols, 0.7, max_iter=40, n_neighbors=29).toPandas()
    s = -distances(x) ** 2
    off = s[~np.eye(30, dtype=bool)]
    np.fill_diagonal(s, np.median(off))
    ex = dense_affinity_propagation(s, 0.7, 40)
    assert lab["label"].nunique() == len(ex)
    want = distances(x)[:, sorted(ex)].argmin(1)
    assert lab.sort_values("id")["label"].tolist() == want.tolist()


def dense_measures(x, l):
    d = distances(x)
    ks = sorted(set(l))
    s = []
    for i in range(len(x)):
        own = (l == l[i]).sum()
        if own == 1:
            s.append(0.0)
            continue
        a = d[i][l == l[i]].sum() / (own - 1)
        b = min(d[i][l == k].mean() for k in ks if k != l[i])
        s.append((b - a) / max(a, b))
    c = np.array([x[l == k].mean(0) for k in ks])
    sp = np.array([np.linalg.norm(x[l == k] - c[i], axis=1).mean() for i, k in enumerate(ks)])
    db = np.mean([max((sp[i] + sp[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    w = sum(((x[l == k] - c[i]) ** 2).sum() for i, k in enumerate(ks))
    b = sum((l == k).sum() * ((c[i] - x.mean(0)) ** 2).sum() for i, k in enumerate(ks))
    return np.mean(s), db, (b / (len(ks) - 1)) / (w / (len(x) - len(ks)))


def test_measures_match_dense(mixed):
    d, cols, x = mixed
    l = np.arange(len(x)) % 4
    l[-1] = 9  # a singleton
    lab = d.withColumn("label", F.when(F.col("id") == 3 * (len(x) - 1), 9).otherwise((F.col("id") / 3).cast("long") % 4))
    s, db, ch = dense_measures(x, l)
    assert E.silhouette(lab, "id", cols, "label").first()["s"] == pytest.approx(s, abs=1e-7)
    assert E.davies_bouldin(lab, cols, "label").first()["raw"] == pytest.approx(db)
    assert E.calinski_harabasz(lab, cols, "label").first()["raw"] == pytest.approx(ch)
    swapped = lab.withColumn("label", 100 - F.col("label"))
    assert E.davies_bouldin(swapped, cols, "label").first()["raw"] == pytest.approx(db)
    assert E.score("silhouette", lab.withColumn("label", F.lit(1)), "id", cols, "label")[0] == math.inf


def test_noise_counts_as_a_cluster_unless_dropped(mixed):
    d, cols, _ = mixed
    lab = d.withColumn("label", (F.col("id") / 3).cast("long") % 3 - 1)
    kept = E.score("calinski_harabasz", lab, "id", cols, "label")[1]
    dropped = E.score("calinski_harabasz", lab, "id", cols, "label", drop_noise=True)[1]
    assert kept != dropped


def test_nearest_and_jaccard(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.5)], "id long, x double")
    got = {r["id"]: r["label"] for r in nearest(d, ["x"], np.array([[0.0], [1.0]])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    t = spark.createDataFrame([(0, "p"), (0, "p"), (0, "q"), (1, "q")], "a long, b string")
    j = {(r["a"], r["b"]): r["jaccard"] for r in jaccard(t, "a", "b").collect()}
    assert j[(0, "p")] == pytest.approx(2 / 3) and j[(0, "q")] == pytest.approx(1 / 4) and j[(1, "q")] == pytest.approx(1 / 2)
