"""Centre, mixture, spectral, hierarchical and message-passing clusterers.

Each takes a matrix DataFrame (key column, feature columns) and returns ``(id, label)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import name, total
from ..functions.reduce import sum_vectors
from ..session import cut, drop, keep
from . import graph, kmeans as km
from .assign import nearest
from .neighbours import knn
from .order import exact_quantiles, with_row_id
from .tiles import hash_blocks, kernel_sums, large_block_count

SMALL_SIDE = 1_000_000  # rows of a name and a number that are broadcast
KERNELS = ("rbf", "laplacian", "poly", "sigmoid")


def _rows(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    return df.select(
        name(id_col).cast("long").alias("id"),
        *[name(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
    )


def kmeans(df, id_col, cols, n_clusters: int = 5, seed: int = 42, max_iter: int = 50) -> DataFrame:
    vec = km.vectors(_rows(df, id_col, cols), [f"x{i}" for i in range(len(cols))], ["id"])
    return km.fit(vec, n_clusters, seed, max_iter).label(vec)


def bisecting(df, id_col, cols, n_clusters: int = 10, seed: int = 42) -> DataFrame:
    """Divisive clustering under the variance objective."""
    vec = km.vectors(_rows(df, id_col, cols), [f"x{i}" for i in range(len(cols))], ["id"])
    return km.fit(vec, n_clusters, seed, bisecting=True).label(vec)


def minibatch_kmeans(
    df, id_col, cols, n_clusters: int = 10, batch_size: int = 100, max_iter: int = 100, tol: float = 1e-3, seed: int = 42
) -> DataFrame:
    """Mini-batch k-means: every row moves a centre in every epoch.

    An epoch is one pass. Each partition takes the centres, runs its rows through them in batches (a
    centre moves by batch mean / rows seen so far) and returns its centres with their row counts; their
    count-weighted mean starts the next epoch. It ends when no centre moves by more than ``tol``
    standard deviations, or after ``max_iter`` epochs. The result depends on the partitioning.
    """
    p = len(cols)
    x = [f"x{i}" for i in range(p)]
    rows = keep(_rows(df, id_col, cols))
    draw = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(n_clusters).select(*x).collect()
    centres = np.unique(np.array([[r[c] for c in x] for r in draw], float).reshape(-1, p), axis=0)
    if not len(centres):
        return rows.select("id", F.lit(0).cast("long").alias("label"))
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in x]).first()
    scale = np.array([spread[c] or 1.0 for c in x])
    schema = "j long, n double, " + ", ".join(f"{c} double" for c in x)
    for _ in range(max_iter):

        def epoch(frames, start=centres):
            own, seen = start.copy(), np.zeros(len(start))
            for frame in frames:
                a = frame[x].to_numpy(float)
                for k in range(0, len(a), batch_size):
                    b = a[k : k + batch_size]
                    near = ((b * b).sum(1)[:, None] - 2 * b @ own.T + (own * own).sum(1)[None, :]).argmin(1)
                    n = np.bincount(near, minlength=len(own))
                    hit = n > 0
                    sums = np.zeros_like(own)
                    np.add.at(sums, near, b)
                    seen += n
                    own[hit] += (sums[hit] - n[hit, None] * own[hit]) / seen[hit, None]
            if seen.any():
                out = pd.DataFrame(own * seen[:, None], columns=x)
                out.insert(0, "n", seen)
                out.insert(0, "j", np.arange(len(own)))
                yield out

        sums = rows.select(*x).mapInPandas(epoch, schema).groupBy("j").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in x])
        old = centres.copy()
        for r in sums.collect():  # one row per centre
            if r["n"]:
                centres[r["j"]] = np.array([r[c] for c in x]) / r["n"]
        if (np.abs(centres - old) / scale).max() <= tol:
            break
    out = nearest(_rows(df, id_col, cols), x, centres, "label").select("id", "label")
    rows.unpersist()
    return out


# ---------------------------------------------------------------- Birch


def birch_summaries(rows: DataFrame, p: int, threshold: float = 0.5) -> DataFrame:
    """Clustering features (n, linear sums, square sum) of grid cells whose diameter is 2 x threshold.

    Sub-cluster radius never exceeds the threshold, and the summaries do not depend on row order.
    """
    side = 2 * threshold / math.sqrt(p)
    key = F.array(*[F.floor(F.col(f"x{i}") / F.lit(side)).cast("long") for i in range(p)])
    return rows.groupBy(key.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
        F.sum(total([F.col(f"x{i}") * F.col(f"x{i}") for i in range(p)])).alias("ss"),
    )


class FeatureStore:
    """Clustering features (count, sum, sum of squares) of the rows or features that were added, none wider than a radius.

    A feature's radius is the root mean square distance of its rows from their mean. What is added goes to the feature with the
    nearest mean if that keeps its radius within ``threshold``, else it starts a feature of its own. Added items are taken
    in batches: the items of a feature join in the order of their distance, as many as the radius allows; of the others, one
    per cell of a grid four thresholds wide starts a feature, and the rest try again.
    """

    def __init__(self, p: int, threshold: float):
        self.p, self.limit = p, float(threshold) ** 2
        self.side = max(4 * float(threshold), 1e-300)
        self.n, self.s, self.q = np.zeros(0), np.zeros((0, p)), np.zeros(0)

    def _fits(self, n, s, q):
        """Whether the mean square distance from the mean is within the limit, but for rounding."""
        centre = s / n[:, None]
        return q / n - (centre * centre).sum(1) <= self.limit + 1e-9 * (q / n)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = self.s / self.n[:, None]
        best, far = np.zeros(len(x), int), np.full(len(x), np.inf)
        for at in range(0, len(m), 1024):
            part = m[at : at + 1024]
            d = (x * x).sum(1)[:, None] + (part * part).sum(1)[None] - 2 * x @ part.T
            j = d.argmin(1)
            low = d[np.arange(len(x)), j]
            better = low < far
            best[better], far[better] = at + j[better], low[better]
        return best, far

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of the feature that took each item; items must be within the limit themselves."""
        took = np.full(len(n), -1)
        left = np.arange(len(n))
        while len(left):
            x = s[left] / n[left][:, None]
            if len(self.n):
                best, far = self._nearest(x)
                order = np.lexsort((far, best))
                rows, to = left[order], best[order]
                start = np.r_[0, np.flatnonzero(np.diff(to)) + 1]
                size = np.diff(np.r_[start, len(to)])
                base = np.repeat(start, size)
                runs = []
                for own, v in ((self.n, n), (self.s, s), (self.q, q)):
                    c = np.cumsum(v[rows], axis=0)
                    before = np.concatenate([np.zeros_like(c[:1]), c])[base]
                    runs.append(own[to] + c - before)
                bad = ~self._fits(*runs)
                stopped = np.cumsum(bad)
                stopped = stopped - np.r_[0, stopped][base]
                joined = stopped == 0  # all up to the first that does not fit
                ok = rows[joined]
                took[ok] = to[joined]
                np.add.at(self.n, to[joined], n[ok])
                np.add.at(self.s, to[joined], s[ok])
                np.add.at(self.q, to[joined], q[ok])
                left = np.sort(rows[~joined])
                if not len(left):
                    break
                x = s[left] / n[left][:, None]
            _, lead = np.unique(np.floor(x / self.side), axis=0, return_index=True)
            own = left[np.sort(lead)]
            took[own] = len(self.n) + np.arange(len(own))
            self.n, self.s, self.q = np.r_[self.n, n[own]], np.vstack([self.s, s[own]]), np.r_[self.q, q[own]]
            left = np.setdiff1d(left, own, assume_unique=True)
        return took


MOST_FEATURES = 20_000  # of a task's store; a full one is handed on and a new one started


def birch_features(df: DataFrame, p: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Summaries of rows (id, x0..) none of which has a radius over ``threshold``: (features, members).

    Features are (feature, n, s0.., ss); members (id, feature). Every partition fills a store of its own; then the features
    of neighbouring means, by cells some thresholds wide, meet in one task and are merged by the same rule. Rows follow the
    feature that took them. What a cell holds is bounded by its size and the number of partitions, not by its rows.
    """
    x, ss = [f"x{i}" for i in range(p)], [f"s{i}" for i in range(p)]

    def fill(batches):
        task = TaskContext.get().partitionId()
        stores = 0
        store = FeatureStore(p, threshold)

        def handed():
            out = {"part": np.full(len(store.n), task), "store": np.full(len(store.n), stores), "own": np.arange(len(store.n))}
            out |= {"id": [None] * len(store.n), "n": store.n, "ss": store.q}
            return pd.DataFrame(out | {c: store.s[:, i] for i, c in enumerate(ss)})

        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                own = pdf.iloc[at : at + 4096]
                v = own[x].to_numpy(float)
                took = store.add(np.ones(len(v)), v, (v * v).sum(1))
                none = np.full(len(own), np.nan)
                out = {"part": task, "store": stores, "own": took, "id": own["id"].to_numpy(), "n": none, "ss": none}
                yield pd.DataFrame(out | {c: none for c in ss})
                if len(store.n) >= MOST_FEATURES:
                    yield handed()
                    store, stores = FeatureStore(p, threshold), stores + 1
        if len(store.n):
            yield handed()

    sums = ", ".join(f"{c} double" for c in ss)
    first = cut(df.select("id", *x).mapInPandas(fill, f"part long, store long, own long, id long, n double, ss double, {sums}"))
    key = ["part", "store", "own"]
    cell = F.array(*[F.floor(F.col(c) / F.col("n") / F.lit(8.0 * threshold)).cast("long") for c in ss[:8]])
    local = first.filter("n IS NOT NULL").select(*key, "n", "ss", *ss, cell.alias("cell"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", *key], ascending=[False, True, True, True])
        store = FeatureStore(p, threshold)
        took = store.add(pdf["n"].to_numpy(float), pdf[ss].to_numpy(float), pdf["ss"].to_numpy(float))
        lead = pdf.iloc[np.unique(took, return_index=True)[1]]  # a feature is named by its first part
        out = pdf[key].assign(**{f"of_{c}": lead[c].to_numpy()[took] for c in key})
        return out.assign(n=pdf["n"], ss=pdf["ss"], **{c: pdf[c] for c in ss})

    names = ", ".join(f"{c} long, of_{c} long" for c in key)
    placed = cut(local.groupBy("cell").applyInPandas(merge, f"{names}, n double, ss double, {sums}"))
    feature = F.concat_ws(":", *[f"of_{c}" for c in key])
    features = placed.groupBy(feature.alias("feature")).agg(
        F.sum("n").cast("long").alias("n"), *[F.sum(c).alias(c) for c in ss], F.sum("ss").alias("ss")
    )
    members = first.filter("n IS NULL").select("id", *key).join(placed.select(*key, feature.alias("feature")), key)
    return features, members.select("id", "feature")


def birch(
    df, id_col, cols, n_clusters: int = 5, branching_factor: int = 50, threshold: float = 0.5, seed: int = 42
) -> DataFrame:
    """Clustering features of a bounded radius, weighted k-means over their means; rows go with their feature.

    ``branching_factor`` lays out an in-memory tree elsewhere; it has no counterpart here.
    """
    del branching_factor
    p = len(cols)
    features, members = birch_features(_rows(df, id_col, cols), p, threshold)
    means = cut(features.select("feature", F.col("n").cast("double").alias("w"), *[(F.col(f"s{i}") / F.col("n")).alias(f"x{i}") for i in range(p)]))
    vec = km.vectors(means, [f"x{i}" for i in range(p)], ["feature", "w"])
    labelled = cut(km.fit(vec, n_clusters, seed, weight="w").label(vec).select("feature", "label"))
    # Rows of one feature were taken by many tasks, so a hot feature is a hot key; labels are few and small.
    side = F.broadcast(labelled) if labelled.count() <= SMALL_SIDE else labelled
    return members.join(side, "feature").select("id", "label")


# ---------------------------------------------------------------- Gaussian mixture


def _log_density(x, means, covs, kind):
    """log N(x | component) for every component (n x k)."""
    n, p = x.shape
    out = np.empty((n, len(means)))
    for k, m in enumerate(means):
        d = x - m
        if kind in ("full", "tied"):
            c = covs[k] if kind == "full" else covs
            chol = np.linalg.cholesky(c)
            z = np.linalg.solve(chol, d.T)
            out[:, k] = -0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum()
        else:
            v = covs[k] if kind == "diag" else np.full(p, covs[k])
            out[:, k] = -0.5 * (d * d / v).sum(1) - 0.5 * np.log(v).sum()
    return out - 0.5 * p * math.log(2 * math.pi)


def _responsibilities(x, weights, means, covs, kind):
    lp = _log_density(x, means, covs, kind) + np.log(np.maximum(weights, 1e-300))
    top = lp.max(1, keepdims=True)
    e = np.exp(lp - top)
    s = e.sum(1, keepdims=True)
    return e / s, float((top + np.log(s)).sum())


def gmm_m_step(stats: np.ndarray, k: int, p: int, kind: str, reg: float = 1e-6):
    """Weights, means and covariances from the summed statistics of one E pass."""
    square = p * p if kind in ("full", "tied") else p
    nk = stats[:k] + 10 * np.finfo(float).eps
    sx = stats[k : k + k * p].reshape(k, p)
    sq = stats[k + k * p : k + k * p + k * square]
    means = sx / nk[:, None]
    if kind in ("full", "tied"):
        sq = sq.reshape(k, p, p)
        if kind == "tied":
            cov = (sq.sum(0) - sum(nk[j] * np.outer(means[j], means[j]) for j in range(k))) / nk.sum()
            return nk / nk.sum(), means, cov + reg * np.eye(p)
        covs = np.array([sq[j] / nk[j] - np.outer(means[j], means[j]) + reg * np.eye(p) for j in range(k)])
        return nk / nk.sum(), means, covs
    var = np.maximum(sq.reshape(k, p) / nk[:, None] - means**2, 0) + reg
    return nk / nk.sum(), means, var if kind == "diag" else var.mean(1)


def _stats(x, r, kind):
    k, p = r.shape[1], x.shape[1]
    sx = r.T @ x
    if kind in ("full", "tied"):
        sq = np.array([(x * r[:, [j]]).T @ x for j in range(k)]).reshape(k, p * p)
    else:
        sq = r.T @ (x * x)
    return np.concatenate([r.sum(0), sx.ravel(), sq.ravel()])


def gaussian_mixture(
    df, id_col, cols, n_components: int = 5, covariance_type: str = "full", init_params: str = "kmeans",
    warm_start: bool = False, max_iter: int = 100, tol: float = 1e-3, seed: int = 42,
) -> DataFrame:
    """EM: every round is one pass that sums responsibilities and moments per partition.

    ``warm_start`` concerns repeated fits of one object and changes nothing here.
    """
    del warm_start
    if covariance_type not in ("full", "tied", "diag", "spherical"):
        raise ValueError(f"unknown covariance type {covariance_type!r}")
    p, k, kind = len(cols), n_components, covariance_type
    x = [f"x{i}" for i in range(p)]
    rows = keep(_rows(df, id_col, cols))
    n = rows.count()
    # Columns are centred on the way in; second moments then lose no digits.
    at = rows.agg(*[F.avg(c).alias(c) for c in x]).first()
    shift = np.array([at[c] for c in x])
    if init_params == "kmeans":
        vec = km.vectors(rows, x, ["id", *x])
        first = km.fit(vec, k, seed).label(vec)
        start = sum_vectors(first, [*x, "label"], lambda a: _stats(a[:, :p] - shift, np.eye(k)[a[:, p].astype(int)], kind))
    elif init_params == "random":
        u = [F.pmod(F.xxhash64("id", F.lit(seed), F.lit(j)), F.lit(1_000_003)) + 1 for j in range(k)]
        drawn = rows.select(*x, *[c.cast("double").alias(f"r{j}") for j, c in enumerate(u)])

        def weigh(a):
            r = a[:, p:]
            return _stats(a[:, :p] - shift, r / r.sum(1, keepdims=True), kind)

        start = sum_vectors(drawn, [*x, *[f"r{j}" for j in range(k)]], weigh)
    else:
        raise ValueError(f"unknown init {init_params!r}")
    weights, means, covs = gmm_m_step(start, k, p, kind)
    last = -math.inf
    for _ in range(max_iter):

        def e_step(a, w=weights, m=means, c=covs):
            r, ll = _responsibilities(a - shift, w, m, c, kind)
            return np.append(_stats(a - shift, r, kind), ll)

        stats = sum_vectors(rows, x, e_step)
        weights, means, covs = gmm_m_step(stats[:-1], k, p, kind)
        ll = stats[-1] / max(n, 1)
        if abs(ll - last) < tol:
            break
        last = ll

    def label(*series: pd.Series) -> pd.Series:
        a = np.column_stack([s.to_numpy(float) for s in series]) - shift
        return pd.Series(_responsibilities(a, weights, means, covs, kind)[0].argmax(1))

    out = _rows(df, id_col, cols).select("id", F.pandas_udf(label, "long")(*x).alias("label"))
    rows.unpersist()
    return out


def mixture_log_density(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Diagonal E step with parameters taken from given labels: per row the log-likelihood and the
    largest responsibility. Parameters are one row per label, held as a small array column."""
    p = len(cols)
    d = df.select("*", *[name(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    par = d.groupBy(name(label).alias("_l")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(f"_x{i}").alias(f"m{i}") for i in range(p)],
        *[(F.var_pop(f"_x{i}") + 1e-6).alias(f"v{i}") for i in range(p)],
    )
    rows = par.orderBy("_l").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("over 1000 components")
    n = sum(r["n"] for r in rows)
    logs = [
        F.lit(math.log(r["n"] / n) - 0.5 * sum(math.log(2 * math.pi * r[f"v{i}"]) for i in range(p)))
        - 0.5 * total([(F.col(f"_x{i}") - F.lit(r[f"m{i}"])) ** 2 / F.lit(r[f"v{i}"]) for i in range(p)])
        for r in rows
    ]
    out = d.withColumn("_lp", F.array(*logs)).withColumn("_top", F.array_max("_lp"))
    s = F.aggregate("_lp", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_top")))
    return (
        out.withColumn("_s", s)
        .withColumn("log_likelihood", F.col("_top") + F.log("_s"))
        .withColumn("max_responsibility", 1 / F.col("_s"))
        .drop("_lp", "_top", "_s", *[f"_x{i}" for i in range(p)])
    )


# ---------------------------------------------------------------- spectral


def spectral(
    df, id_col, cols, n_clusters: int = 10, affinity: str = "rbf", assign_labels: str = "kmeans",
    gamma: float = 1.0, n_neighbors: int = 10, seed: int = 42, search: str = "exact",
) -> DataFrame:
    """Spectral clustering: affinity, bottom eigenvectors, k-means on the scaled embedding.

    Nearest-neighbour affinity is a sparse edge table; kernel affinities are never stored, each
    multiplication runs over tiles. Rows are assigned by k-means on the embedding.
    """
    if assign_labels != "kmeans":
        raise ValueError(f"assignment {assign_labels!r} is not available: use 'kmeans'")
    p = len(cols)
    x = [f"x{i}" for i in range(p)]
    rows = cut(_rows(df, id_col, cols))
    n = rows.count()
    vec = km.vectors(rows, x, ["id"])
    parts = cut(km.fit(vec, max(min(100, n // 4), min(n, n_clusters + 1)), seed, max_iter=5).label(vec, "part"))
    if affinity == "nearest_neighbors":
        near = knn(rows, "id", x, n_neighbors - 1, method=search)  # the row itself is one of its neighbours
        ones = near.select("src", "dst", F.lit(1.0).alias("w")).unionByName(
            rows.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
        )
        edges = cut(graph.symmetrise(ones, "mean"))
        seeds, width = graph.coarse_start(edges, parts, n_clusters + 4)
        start = (parts.join(F.broadcast(seeds), "part").drop("part"), width)  # one row per part
        out, lam, _ = graph.spectral_embedding(
            graph.edge_product(edges), graph.degrees(edges), n_clusters, seed=seed, start=start
        )
    elif affinity in KERNELS:
        blocks = large_block_count(rows, n)
        placed = hash_blocks(rows.withColumnRenamed("id", "_id"), "_id", blocks)
        one = placed.withColumn("one", F.lit(1.0))
        deg = cut(
            kernel_sums(one, p, affinity, gamma, ["one"], blocks).select(
                F.col("_id").alias("id"), F.greatest("one", F.lit(1e-300)).alias("degree")
            )
        )

        def product(vectors, ys):
            state = placed.join(vectors.withColumnRenamed("id", "_id"), "_id")
            return kernel_sums(state, p, affinity, gamma, ys, blocks).withColumnRenamed("_id", "id")

        # Part indicators seed the block: the slow modes of a kernel graph vary between parts.
        width = min(n_clusters + 4, 40)
        flags = [F.pmod(F.xxhash64(F.col("part"), F.lit(j)), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1 for j in range(width - 1)]
        start = (
            parts.select("id", F.lit(1.0).alias("c0"), *[f.alias(f"c{j + 1}") for j, f in enumerate(flags)]),
            width,
        )
        out, lam, _ = graph.spectral_embedding(product, deg, n_clusters, seed=seed, start=start)
    else:
        raise ValueError(f"unknown affinity {affinity!r}")
    vs = [f"v{i}" for i in range(len(lam))]
    scaled = cut(out.select("id", *[(F.col(v) * F.col("_s")).alias(v) for v in vs]))
    evec = km.vectors(scaled, vs, ["id"])
    return km.fit(evec, n_clusters, seed, max_iter=50).label(evec)


def power_iteration(
    df, id_col, cols, n_clusters: int = 10, n_neighbors: int = 10, sigma: float | None = None, max_iter: int = 40,
    search: str = "exact",
) -> DataFrame:
    """Spark's power iteration clustering on the neighbour graph: the fast alternative to :func:`spectral`.

    One vector is multiplied by the normalised affinities ``max_iter`` times and its values are clustered, so a round is one
    pass over the edges. Affinities are heat weights exp(-d^2 / sigma), sigma by default the mean squared distance of
    neighbours. Every copy of a row has the label of the row's first copy, so weights between copies play no part; a row
    without neighbours is a vertex with an edge to itself. Clusters are numbered by their smallest id. One vector tells groups
    apart by how dense they are; groups that no edge joins and that are alike in this may share a label.
    """
    p = len(cols)
    x = [f"x{i}" for i in range(p)]
    if n_clusters < 2:
        return _rows(df, id_col, cols).select("id", F.lit(0).cast("long").alias("label"))
    rows = cut(_rows(df, id_col, cols))
    first = cut(rows.groupBy(*x).agg(F.min("id").alias("id")))
    near = cut(knn(first, "id", x, n_neighbors, method=search))
    if sigma is None:
        sigma = near.agg(F.avg(F.col("d") * F.col("d"))).first()[0] or 1.0
    weight = F.greatest(F.exp(-F.col("d") * F.col("d") / F.lit(float(sigma))), F.lit(1e-12))
    # Each undirected edge once; a pair that is listed from both sides has one distance.
    edges = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("w"))
    edges = edges.groupBy("src", "dst").agg(F.max("w").alias("w"))
    touched = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    lone = first.select("id").join(touched, "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    graph_ = cut(edges.unionByName(lone))
    if graph_.isEmpty():
        return rows.select("id", F.lit(0).cast("long").alias("label"))
    pic = PowerIterationClustering(k=n_clusters, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="w")
    found = cut(pic.assignClusters(graph_).select(F.col("id").alias("id"), F.col("cluster").cast("long").alias("cluster")))
    order = found.groupBy("cluster").agg(F.min("id").alias("least"))  # one row per cluster
    ranked = order.select("cluster", (F.row_number().over(W.orderBy("least")) - 1).cast("long").alias("label"))
    labels = found.join(F.broadcast(ranked), "cluster").join(first, "id").select("label", *x)
    return rows.join(labels, x).select("id", "label")


# ---------------------------------------------------------------- single linkage


def single_linkage(
    df, id_col, cols, n_clusters: int = 10, affinity: str = "euclidean", height: float | None = None
) -> DataFrame:
    """Cut the n_clusters - 1 heaviest edges of the minimum spanning tree; the pieces are the clusters.

    With ``height`` all edges longer than it are cut instead. Clusters are numbered by their smallest id.
    """
    rows = _rows(df, id_col, cols)
    tree = cut(graph.spanning_tree(rows, "id", [f"x{i}" for i in range(len(cols))], affinity))
    if height is None:
        heavy = tree.orderBy(F.desc("d"), "a", "b").limit(max(n_clusters - 1, 0))
        light = tree.join(heavy.select("a", "b"), ["a", "b"], "left_anti")
    else:
        light = tree.filter(F.col("d") <= F.lit(float(height)))
    comp = cut(graph.components(rows.select("id"), light.select("a", "b")))
    ranked = with_row_id(comp.select("comp").distinct(), ["comp"], "label")
    return comp.join(ranked, "comp").select("id", "label")


def agglomerative(df, id_col, cols, n_clusters: int = 10, linkage: str = "single", affinity: str = "euclidean", seed: int = 42):
    """Exact single linkage; the divisive method under the variance objective is :func:`bisecting`."""
    if linkage != "single":
        raise ValueError(f"{linkage!r} linkage is not available: use 'single', or the clusterer Bisecting")
    return single_linkage(df, id_col, cols, n_clusters, affinity)


# ---------------------------------------------------------------- affinity propagation


def affinity_propagation(
    df, id_col, cols, damping: float = 0.5, affinity: str = "euclidean", max_iter: int = 200,
    convergence_iter: int = 15, n_neighbors: int = 10, seed: int = 42, search: str = "exact",
) -> DataFrame:
    """Affinity propagation on the k-nearest-neighbour graph, preference = median similarity.

    One edge table (i, k, s, r, a). Responsibilities need the two largest a + s of a row, whose
    out-degree is bounded by the neighbour count; availabilities are one sum per exemplar, combined
    before the exchange. Rows finally go to the most similar exemplar.
    """
    if affinity != "euclidean":
        raise ValueError("only the euclidean affinity is available")
    if not 0.5 <= damping < 1:
        raise ValueError("damping must be in [0.5, 1)")
    p = len(cols)
    x = [f"x{i}" for i in range(p)]
    rows = cut(_rows(df, id_col, cols))
    near = cut(knn(rows, "id", x, n_neighbors, method=search).select("src", "dst", (-F.col("d") * F.col("d")).alias("s")))
    med = exact_quantiles(near.select(F.lit("s").alias("f"), "s"), "f", "s", (0.5,)).first()["q0"]
    # A tiny fixed jitter breaks ties between equal similarities.
    jitter = (F.pmod(F.xxhash64("i", "k", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)) * 1e-9
    loops = rows.select(F.col("id").alias("i"), F.col("id").alias("k"), F.lit(med).alias("s"))
    e = near.select(F.col("src").alias("i"), F.col("dst").alias("k"), "s").unionByName(loops)
    e = cut(e.withColumn("s", F.col("s") + jitter).select("i", "k", "s", F.lit(0.0).alias("r"), F.lit(0.0).alias("a")))
    drop(near)
    keep_, new = F.lit(damping), F.lit(1 - damping)
    w = W.partitionBy("i")  # at most n_neighbors + 1 rows
    last, same = None, 0
    for _ in range(max_iter):
        both = F.col("a") + F.col("s")
        top = e.withColumn("_b", both).withColumn("_m", F.slice(F.sort_array(F.collect_list("_b").over(w), asc=False), 1, 2))
        rival = F.when((F.col("_b") == F.col("_m")[0]) & (F.size("_m") > 1), F.try_element_at("_m", F.lit(2))).otherwise(F.col("_m")[0])
        lone = F.size("_m") == 1
        r_new = F.when(lone, F.col("s")).otherwise(F.col("s") - rival)
        upd = top.withColumn("r", keep_ * F.col("r") + new * r_new).drop("_b", "_m")
        upd = cut(upd)
        cols_ = upd.groupBy("k").agg(
            F.sum(F.when(F.col("i") != F.col("k"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).alias("pos"),
            F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).alias("rkk"),
        )
        j = upd.join(cols_, "k")
        a_new = F.when(F.col("i") == F.col("k"), F.col("pos")).otherwise(
            F.least(F.lit(0.0), F.col("rkk") + F.col("pos") - F.greatest("r", F.lit(0.0)))
        )
        before, e = e, cut(j.select("i", "k", "s", "r", (keep_ * F.col("a") + new * a_new).alias("a")))
        del top, cols_, j
        drop(before, upd)  # the disk holds the messages of one round
        mark = e.filter("i = k and r + a > 0").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("k")).alias("h")).first()
        state = (mark["n"], mark["h"])
        same = same + 1 if state == last else 0
        last = state
        if same >= convergence_iter and mark["n"]:
            break
    ex = e.filter("i = k and r + a > 0").select(F.col("k").alias("id")).join(rows, "id").orderBy("id").limit(100_001).collect()
    if not ex:
        return rows.select("id", F.lit(-1).cast("long").alias("label"))
    if len(ex) > 100_000:
        raise ValueError("over 100000 exemplars: raise n_neighbors or the preference")
    centres = np.array([[r[c] for c in x] for r in ex])
    return nearest(rows, x, centres, "label").select("id", "label")
