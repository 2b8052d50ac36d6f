"""Unsupervised feature selection.

Every selector scores the columns and returns a table ``(feature, idx, score)`` with one row per
column; the k best are kept, ties going to the later column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.numeric import name, soft_threshold, unpivot
from ..functions.reduce import block_pieces, gram, row_blocks, sum_blocks, sum_vectors, values
from ..session import cut, drop, keep
from . import graph, kmeans
from .assign import nearest, nearest_labels
from .kmeans import closest
from .neighbours import knn
from .order import chunks_for, running
from .smooth import cells_of, weighted_sums
from .tiles import collapse, features, hash_blocks, kernel_matrix, kernel_sums, large_block_count, pieces, tile_apply

RANDOM_FEATURES = 1024  # of method "rff"
METHODS = ("exact", "rff")


def score_table(spark: SparkSession, cols: Sequence[str], scores) -> DataFrame:
    rows = [
        (c, i, None if s is None else float(s)) for i, (c, s) in enumerate(zip(cols, scores))
    ]
    return spark.createDataFrame(rows, "feature string, idx long, score double")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Add ``selected``: the k largest scores, NaN largest of all, ties to the larger idx.

    The score table has one row per column of the data, so one window partition is enough.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    order = W.orderBy(F.col("score").desc_nulls_last(), F.col("idx").desc())
    return scores.withColumn("selected", F.row_number().over(order) <= k)


def above(scores: DataFrame, threshold: float) -> DataFrame:
    """Add ``selected``: score strictly above the threshold."""
    return scores.withColumn("selected", F.coalesce(F.col("score") > threshold, F.lit(False)))


def chosen(marked: DataFrame) -> list[str]:
    rows = marked.filter("selected").select("feature", "idx").collect()
    return [r["feature"] for r in sorted(rows, key=lambda r: r["idx"])]


# ---------------------------------------------------------------- spectral scores


def _random_features(p: int, gamma: float, m: int, seed: int):
    """phi with E[phi(x).phi(y)] = exp(-gamma |x-y|^2): cosines of random projections."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (p, m // 2))

    def phi(x: np.ndarray) -> np.ndarray:
        z = x @ w
        return np.hstack([np.cos(z), np.sin(z)]) * math.sqrt(2.0 / m)

    return phi


def spec_sums(
    df: DataFrame, id_col: str, cols: Sequence[str], method: str = "exact", seed: int = 42
) -> dict[str, np.ndarray]:
    """The per-column sums all spectral scores are made of, for the RBF graph with gamma = 1/p.

    ``cut``  = sum_il x_ij k_il x_lj / (d_i d_l)
    ``norm`` = sum_i x_ij^2 / d_i          ``mass`` = sum_i x_ij / d_i

    ``exact``: two tile passes (degrees, then p numbers per tile), or two linear passes that give the same to rounding
    where the columns allow it (:mod:`.smooth`). ``rff``: two linear passes over random features, an estimate whose
    error falls with the square root of their number. The caller chooses; the size of the table never does.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: use one of {METHODS}")
    p = len(cols)
    gamma = 1.0 / p
    pts = cut(collapse(df, id_col, cols))
    n = pts.count()
    x = [f"x{i}" for i in range(p)]
    if method == "rff":
        phi = _random_features(p, gamma, RANDOM_FEATURES, seed)
        mass_phi = sum_vectors(pts, [*x, "_w"], lambda a: phi(a[:, :p]).T @ a[:, p])
        m = len(mass_phi)

        def parts(a):
            f = phi(a[:, :p])
            d = np.maximum(f @ mass_phi, 1.0)  # a row is at least similar to itself
            xs, w = a[:, :p], a[:, p]
            z = xs / d[:, None] * w[:, None]
            return np.concatenate([(f.T @ z).ravel(), (xs * z).sum(0), z.sum(0)])

        flat = sum_vectors(pts, [*x, "_w"], parts)
        fz = flat[: m * p].reshape(m, p)
        return {"cut": (fz * fz).sum(0), "norm": flat[m * p : m * p + p], "mass": flat[m * p + p :]}
    if cells := cells_of(pts, x, gamma):

        def with_moments(a, w, d):
            z = a * (w / d)[:, None]
            return np.concatenate([cells.moments(a, z).ravel(), (a * z).sum(0), z.sum(0)])

        _, flat = weighted_sums(pts, x, "_w", cells, with_moments)
        m = len(cells.codes) * cells.size * p
        moments = flat[:m].reshape(-1, cells.size, p)
        return {"cut": (moments * cells.apply(moments)).sum((0, 1)), "norm": flat[m : m + p], "mass": flat[m + p :]}
    blocks = large_block_count(df, n)
    placed = hash_blocks(pts, "_id", blocks)
    deg = kernel_sums(placed, p, "rbf", gamma, ["_w"], blocks).withColumnRenamed("_w", "deg")
    state = cut(placed.join(deg, "_id"))

    def tile(a, b, same):
        import pandas as pd

        xa, xb = features(a, p), features(b, p)
        za = xa * (a["_w"] / a["deg"]).to_numpy()[:, None]
        zb = xb * (b["_w"] / b["deg"]).to_numpy()[:, None]
        part = np.zeros(p)
        for i, j, own in pieces(len(a), len(b), same):
            part += (za[i] * (kernel_matrix(xa[i], xb[j], "rbf", gamma) @ zb[j])).sum(0) * (1.0 if own else 2.0)
        return pd.DataFrame({"pos": np.arange(p), "val": part})

    rows = (
        tile_apply(state, blocks, tile, "pos long, val double")
        .groupBy("pos").agg(F.sum("val").alias("val")).collect()
    )
    cuts = np.zeros(p)
    for r in rows:
        cuts[r["pos"]] = r["val"]
    def parts(a):
        z = a[:, :p] * (a[:, p] / a[:, p + 1])[:, None]
        return np.concatenate([(a[:, :p] * z).sum(0), z.sum(0)])

    flat = sum_vectors(state, [*x, "_w", "deg"], parts)
    return {"cut": cuts, "norm": flat[:p], "mass": flat[p:]}


def normalized_cut(df, id_col, cols, method: str = "exact", sums: dict[str, np.ndarray] | None = None) -> DataFrame:
    """f' L f of every degree-scaled, unit-length column on the normalised RBF Laplacian.

    ``sums``: the :func:`spec_sums` of this table, if they are known.
    """
    s = sums or spec_sums(df, id_col, cols, method)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = 1 - s["cut"] / s["norm"]
    return score_table(df.sparkSession, cols, score)


def generic_spec(df, id_col, cols, method: str = "exact", sums: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The cut score divided by one minus the column's share of the trivial eigenvector. ``sums`` as in :func:`normalized_cut`."""
    s = sums or spec_sums(df, id_col, cols, method)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (1 - s["cut"] / s["norm"]) / (1 - s["mass"] / np.sqrt(s["norm"]))
    return score_table(df.sparkSession, cols, score)


def fixed_spec(df, id_col, cols, clusters: int = 3, method: str = "exact", seed: int = 42):
    """- sum over the first non-trivial eigenvectors of (2 - eigenvalue) cos^2(column, eigenvector)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: use one of {METHODS}")
    p = len(cols)
    gamma = 1.0 / p
    pts = cut(collapse(df, id_col, cols))
    n = pts.count()
    x = [f"x{i}" for i in range(p)]
    if method == "rff":
        phi = _random_features(p, gamma, RANDOM_FEATURES // 2, seed)
        mass_phi = sum_vectors(pts, [*x, "_w"], lambda a: phi(a[:, :p]).T @ a[:, p])
        m = len(mass_phi)

        def parts(a):
            f = phi(a[:, :p])
            s = np.sqrt(a[:, p] / np.maximum(f @ mass_phi, 1.0))[:, None]
            both = np.hstack([f * s, a[:, :p] * s])
            return both.T @ both

        g = sum_vectors(pts, [*x, "_w"], parts).reshape(m + p, m + p)
        mu, q = np.linalg.eigh(g[:m, :m])
        top = np.argsort(mu)[::-1][:clusters]
        mu, q = mu[top], q[:, top]
        dots = (g[m:, :m] @ q) / np.sqrt(np.maximum(mu, 1e-300))
        norms, lam = np.diag(g[m:, m:]), 1 - mu
    else:
        blocks = large_block_count(df, n)
        placed = hash_blocks(pts, "_id", blocks)
        deg = cut(kernel_sums(placed, p, "rbf", gamma, ["_w"], blocks).withColumnRenamed("_w", "deg"))

        def product(vectors, ys):
            state = placed.select("_id", "_b", *x).join(vectors.withColumnRenamed("id", "_id"), "_id")
            return kernel_sums(state, p, "rbf", gamma, ys, blocks).withColumnRenamed("_id", "id")

        # Copies share one vertex: degree / copies makes the reduced matrix symmetric.
        scale = pts.join(deg, "_id").select(F.col("_id").alias("id"), (F.col("deg") / F.col("_w")).alias("degree"))
        vec, lam, _ = graph.spectral_embedding(product, scale, clusters, seed=seed)
        vs = [f"v{i}" for i in range(len(lam))]
        joined = vec.join(pts.withColumnRenamed("_id", "id"), "id").select(
            *[(F.col(c) * F.col("_s")).alias(c) for c in x], *vs
        )
        g = gram(joined, [*x, *vs])
        dots = g[:p, p:] / np.sqrt(np.diag(g[p:, p:]))
        norms = np.diag(g[:p, :p])
    cos2 = dots**2 / np.where(norms > 0, norms, 1.0)[:, None]
    score = -sum((2 - lam[j]) * cos2[:, j] for j in range(1, min(clusters, len(lam))))
    return score_table(df.sparkSession, cols, np.zeros(p) + score)


# ---------------------------------------------------------------- regression on the embedding


def knn_embedding(
    df: DataFrame, id_col: str, cols: Sequence[str], k_vectors: int, p: int = 8,
    sigma: float = 1.0, seed: int = 42, parts: int = 100, tol: float = graph.TOLERANCE, search: str = "exact",
):
    """Bottom generalised eigenvectors L y = lambda D y of the symmetrised heat-kernel kNN graph.

    ``search`` is the method of the neighbour graph: "exact" or "lsh".
    """
    near = knn(df, id_col, cols, p, method=search)
    edges = cut(graph.symmetrise(graph.heat_weights(near, sigma)))
    deg = graph.degrees(edges).select("id", F.greatest("degree", F.lit(1e-300)).alias("degree"))
    vec = kmeans.vectors(df.withColumn("id", name(id_col).cast("long")), cols, ["id"])
    n = df.count()
    coarse = max(min(parts, n // 4), k_vectors + 1)
    labelled = cut(kmeans.fit(vec, coarse, seed=seed, max_iter=5).label(vec, "part"))
    seeds, width = graph.coarse_start(edges, labelled, k_vectors + 4)
    start = (labelled.join(F.broadcast(seeds), "part").drop("part"), width)  # one row per part
    out, lam, res = graph.spectral_embedding(
        graph.edge_product(edges), deg, k_vectors, seed=seed, start=start, tol=tol
    )
    ys = [(F.col(f"v{i}") * F.col("_s")).alias(f"v{i}") for i in range(len(lam))]
    return out.select("id", *ys), lam, res


def regression_coefficients(df: DataFrame, cols, targets, mode: str = "default", alpha: float = 0.01):
    """Coefficients (p x targets) of each target on the columns, with intercept.

    ``default`` is least squares from one Gram pass; ``lasso`` fits Spark's linear regression with
    an L1 penalty.
    """
    if mode == "default":
        p = len(cols)
        every = [*cols, *targets]
        row = df.agg(*[F.avg(name(c)).alias(f"m{i}") for i, c in enumerate(every)]).first()
        centred = df.select(*[(name(c) - F.lit(row[f"m{i}"])).alias(f"c{i}") for i, c in enumerate(every)])
        g = gram(centred, centred.columns)
        return np.linalg.lstsq(g[:p, :p], g[:p, p:], rcond=1e-12)[0]
    if mode != "lasso":
        raise ValueError(f"unknown mode {mode!r}: use 'default' or 'lasso'")
    vec = keep(kmeans.vectors(df, cols, targets))
    out = []
    for t in targets:
        lr = LinearRegression(
            featuresCol="_v", labelCol=t, elasticNetParam=1.0, regParam=alpha, standardization=False
        )
        out.append(lr.fit(vec).coefficients.toArray())
    vec.unpersist()
    return np.column_stack(out)


def mcfs(
    df: DataFrame, id_col: str, cols: Sequence[str], clusters: int = 3, p: int = 8, sigma: float = 1.0,
    mode: str = "default", alpha: float = 0.01, skip_trivial: bool = False, seed: int = 42, search: str = "exact",
) -> DataFrame:
    """Largest absolute regression coefficient over the bottom eigenvectors of the kNN graph."""
    vec, lam, _ = knn_embedding(df, id_col, cols, clusters, p, sigma, seed=seed, search=search)
    x, ys = [f"x{i}" for i in range(len(cols))], [f"v{i}" for i in range(len(lam))]
    rows = df.select(
        name(id_col).cast("long").alias("id"), *[name(c).cast("double").alias(xi) for c, xi in zip(cols, x)]
    )
    coef = regression_coefficients(cut(vec.join(rows, "id")), x, ys[1:] if skip_trivial else ys, mode, alpha)
    return score_table(df.sparkSession, cols, np.abs(coef).max(1))


# ---------------------------------------------------------------- weighted k-means


def weights_from_dispersion(d: np.ndarray, beta: float, eps: float = 1e-3) -> np.ndarray:
    """w_j proportional to D_j^(-1/(beta-1)) over columns with D >= eps; beta = 1 is one-hot."""
    d = np.asarray(d, float)
    if beta == 1:
        return (np.arange(len(d)) == d.argmin()).astype(float)
    live = np.abs(d) >= eps
    w = np.zeros(len(d))
    if live.any():
        e = -np.log(d[live]) / (beta - 1)
        e = np.exp(e - e.max())
        w[live] = e / e.sum()
    return w


def dispersion(df: DataFrame, cols: Sequence[str], label: str, centres: np.ndarray | None = None) -> np.ndarray:
    """Sum of absolute deviations from the label's centre, per column.

    Centres (label order) default to the label means. The centre table has one row per label and is
    joined as a small side; the sums are one aggregation.
    """
    p = len(cols)
    if centres is None:
        cent = df.groupBy(name(label).alias("_l")).agg(*[F.avg(name(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    else:
        rows = [(k, *map(float, c)) for k, c in enumerate(centres)]
        schema = "_l long, " + ", ".join(f"c{i} double" for i in range(p))
        cent = df.sparkSession.createDataFrame(rows, schema)
    j = df.select(name(label).alias("_l"), *[name(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).join(cent, "_l")
    row = j.agg(*[F.sum(F.abs(F.col(f"x{i}") - F.col(f"c{i}"))).alias(f"d{i}") for i in range(p)]).first()
    return np.array([row[f"d{i}"] or 0.0 for i in range(p)])


def wkmeans(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int, beta: float = 1.0,
    n_clusters: int | None = None, eps: float = 1e-3, max_iterations: int = 10, seed: int = 42,
):
    """Column weights learnt together with a k-means clustering. Returns (scores, labels)."""
    n_clusters = n_clusters or k
    rng = np.random.default_rng(seed)
    w = np.exp(rng.random(len(cols)))
    w /= w.sum()
    packed = kmeans.Packed(df, cols)
    model = packed.fit(n_clusters, seed, scale=w**beta)
    for _ in range(max_iterations):
        div = w**beta
        centres = model.centres / np.where(np.abs(div) < eps, 1.0, div)

        def deviations(xs, scale=model.scale, held=model.centres, centres=centres):
            lab = closest(xs * scale[:, None], held)[0]
            return np.array([np.abs(x - c[lab]).sum() for x, c in zip(xs, centres.T)])

        w = weights_from_dispersion(packed.total(deviations), beta, eps)
        old = model.cost
        model = packed.fit(n_clusters, seed, scale=w**beta)
        if abs(model.cost - old) < eps:
            break
    labels = cut(model.label(df.select(name(id_col).alias("id"), *[name(c) for c in cols])).select("id", "label"))
    packed.release()
    return score_table(df.sparkSession, cols, w), labels


# ---------------------------------------------------------------- sparse k-means


def pairwise_absolute_sums(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Per column (and label): size and sum over ordered pairs of |x_i - x_j|, in O(n log n).

    Sorted, the sum is 2 sum (2r - n - 1) x_r. Equal values are counted first, and the running
    counts come from range chunks, so neither a repeated value nor a large cluster lands in one task.
    """
    d = df.select(
        *([name(label).cast("long").alias("label")] if label else [F.lit(0).cast("long").alias("label")]),
        *[name(c).cast("double").alias(c) for c in cols],
    )
    long = unpivot(d, cols, "feature", "v", keep=["label"])
    counts = long.groupBy("feature", "label", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = running(counts, ["feature", "label"], ["v"], "c", "before")
    # 2 sum v c (2 before + c - n) needs n: split into parts that do not.
    v, c, b = F.col("v"), F.col("c").cast("double"), F.col("before").cast("double")
    g = cum.groupBy("feature", "label").agg(
        F.sum("c").alias("n"), F.sum(v * c * (2 * b + c)).alias("s"), F.sum(v * c).alias("t")
    )
    return g.select("feature", "label", "n", (2 * (F.col("s") - F.col("n") * F.col("t"))).alias("pairs"))


def sparse_objective(df: DataFrame, cols: Sequence[str], label: str, overall: DataFrame | None = None) -> DataFrame:
    """Between-cluster share of the pairwise distances per column: (feature, objective)."""
    overall = overall if overall is not None else pairwise_absolute_sums(df, cols)
    return _between(overall, pairwise_absolute_sums(df, cols, label))


def _between(overall: DataFrame, by_label: DataFrame) -> DataFrame:
    whole = overall.select("feature", (F.col("pairs") / F.col("n")).alias("total"))
    inner = by_label.groupBy("feature").agg(F.sum(F.col("pairs") / F.col("n")).alias("within"))
    return whole.join(inner, "feature").select("feature", (F.col("total") - F.col("within")).alias("objective"))


SORTED_COLUMNS = 16  # most columns for which rows are kept once per column


def sorted_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All rows once per column, in its order, packed: (_f, _at, x0, x1, ...).

    ``_f`` is the column's place; ``_at`` grows with its values, by one from block to block of a range chunk. The rows of a
    repeated value are dealt over chunks by their number, so ``df`` should stand on stored rows.
    """
    x = [f"x{i}" for i in range(len(cols))]
    rows = df.select(*[name(c).cast("double").alias(xi) for c, xi in zip(cols, x)], F.monotonically_increasing_id().alias("_n"))
    parts, out = chunks_for(df), None
    for i, xi in enumerate(x):
        chunks = rows.repartitionByRange(parts, xi, "_n").sortWithinPartitions(xi, "_n")
        one = row_blocks(chunks, x).select(F.lit(i).cast("long").alias("_f"), F.monotonically_increasing_id().alias("_at"), *x)
        out = one if out is None else out.unionByName(one)
    return cut(out)


def _label_pairs(x: np.ndarray, lab: np.ndarray, k: int) -> np.ndarray:
    """Per label of sorted values: size, sum, and sum over ordered pairs of |x_i - x_j| (3 x k)."""
    order = np.argsort(lab.astype(np.min_scalar_type(k)), kind="stable")
    n = np.bincount(lab, minlength=k)
    held, v = lab[order], x[order]
    rank = np.arange(len(x)) - (np.cumsum(n) - n)[held]
    return np.array([n, np.bincount(held, v, k), 2 * np.bincount(held, v * (2 * rank + 1 - n[held]), k)])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`_label_pairs` of the values of ``a`` followed by those of ``b``, none of which is smaller."""
    out = a + b
    out[2] += 2 * (a[0] * b[1] - b[0] * a[1])
    return out


def sorted_absolute_sums(
    held: DataFrame, cols: Sequence[str], centres: np.ndarray | None = None, scale: np.ndarray | None = None
) -> DataFrame:
    """:func:`pairwise_absolute_sums` of :func:`sorted_blocks`, by nearest centre (of columns times ``scale``) if there are some.

    Every row is labelled where it lies. Values of different chunks are in order already, so a chunk's sizes and sums per label
    say all about its pairs with other chunks: one scan, whose exchange holds a row per chunk and label. Null counts as a
    smallest value that adds nothing, as in the other function.
    """
    k = 1 if centres is None else len(centres)

    def fold(batches):
        run = None  # (_f, first _at, the next one, sums)

        def rows(run):
            f, at, _, (n, s, q) = run
            some = np.flatnonzero(n)
            m = len(some)
            arrays = [np.full(m, f), np.full(m, at), some, n[some].astype(np.int64), s[some], q[some]]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["_f", "_at", "label", "n", "s", "q"])

        for batch in batches:
            fs, ats = (c.to_numpy() for c in batch.columns[:2])
            # Blocks that follow each other are read as one.
            ends = np.r_[np.flatnonzero((np.diff(fs) != 0) | (np.diff(ats) != 1)) + 1, len(fs)] if len(fs) else []
            first = 0
            for end in ends:
                f, at, after = int(fs[first]), int(ats[first]), int(ats[end - 1]) + 1
                whole = None
                for columns in block_pieces([c.slice(first, end - first) for c in batch.columns[2:]]):
                    x = values(columns[f].fill_null(0.0))
                    lab = np.zeros(len(x), np.int64)
                    if centres is not None:
                        lab = nearest_labels([values(c) * v for c, v in zip(columns, scale)], centres * scale)
                    part = _label_pairs(x, lab, k)
                    whole = part if whole is None else _joined(whole, part)
                if run and run[0] == f and run[2] == at:
                    run = (f, run[1], after, _joined(run[3], whole))
                else:
                    if run:
                        yield rows(run)
                    run = (f, at, after, whole)
                first = end
        if run:
            yield rows(run)

    parts = held.mapInArrow(fold, "_f long, _at long, label long, n long, s double, q double")
    before = W.partitionBy("_f", "label").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # a row per chunk
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    across = ahead("n").cast("double") * F.col("s") - F.col("n").cast("double") * ahead("s")
    sums = parts.withColumn("q", F.col("q") + 2 * across).groupBy("_f", "label").agg(F.sum("n").alias("n"), F.sum("q").alias("pairs"))
    feature = F.array(*[F.lit(c) for c in cols])[F.col("_f").cast("int")]
    return sums.select(feature.alias("feature"), "label", "n", "pairs")


def soft_weights(objective: DataFrame, delta: float) -> DataFrame:
    """Soft-thresholded objective scaled to unit length: (feature, weight)."""
    s = objective.select("feature", soft_threshold(F.col("objective"), delta).alias("s"))
    norm = s.agg(F.sqrt(F.sum(F.col("s") * F.col("s")))).first()[0]  # p rows
    return s.select("feature", F.try_divide(F.col("s"), F.lit(norm)).alias("weight"))


def constrained_weights(objective: np.ndarray, bound: float, tol: float = 1e-10) -> np.ndarray:
    """Unit-length soft-thresholded objective whose L1 norm meets the bound (bisection)."""

    def at(delta):
        s = np.clip(np.clip(objective, 0, None) - delta, 0, None)
        n = np.linalg.norm(s)
        return s / n if n else s

    w = at(0.0)
    if not w.any() or np.abs(w).sum() <= bound:
        return w
    lo, hi = 0.0, float(objective.max())
    for _ in range(200):
        mid = (lo + hi) / 2
        v = at(mid)
        if v.any() and v.sum() > bound:
            lo = mid
        else:
            hi = mid
        if hi - lo < tol * max(hi, 1.0):
            break
    w = at(hi)
    return w if w.any() else at(lo)


def _lloyd(blocks: DataFrame, centres: np.ndarray, w: np.ndarray, rounds: int = 10, tol: float = 1e-6):
    """Weighted k-means of packed rows from given centres: (centres that label the rows, their means). Each round is one scan."""
    k, p = centres.shape
    for _ in range(rounds):
        old = centres.copy()

        def part(columns):
            xs = [values(c) for c in columns]
            lab = nearest_labels([x * v for x, v in zip(xs, w)], old * w)
            sizes = np.bincount(lab, minlength=k)
            sums, counts = np.empty((p, k)), np.tile(sizes, (p, 1))
            for j, (c, x) in enumerate(zip(columns, xs)):
                if c.null_count:
                    there = c.is_valid().to_numpy(zero_copy_only=False)
                    counts[j] = np.bincount(lab[there], minlength=k)
                    sums[j] = np.bincount(lab[there], x[there], k)
                else:
                    sums[j] = np.bincount(lab, x, k)
            return np.vstack([sizes, counts, sums])

        found = sum_blocks(blocks, part).reshape(2 * p + 1, k)
        some = found[0] > 0
        with np.errstate(invalid="ignore"):
            centres[some] = (found[1 + p :] / found[1 : 1 + p]).T[some]
        if np.abs(centres - old).max() <= tol:
            break
    return old, centres


def sparse_kmeans(
    df: DataFrame, id_col: str, cols: Sequence[str], norm_constraint: float = 2.0, n_clusters: int = 8,
    eps: float = 1e-4, max_iterations: int = 100, seed: int = 42,
):
    """Column weights under an L1 bound, alternating with k-means. Returns (scores, labels)."""
    p = len(cols)
    base = df.select(name(id_col).alias("id"), *[name(c).cast("double").alias(c) for c in cols])
    if p > SORTED_COLUMNS:  # rows are then read in every round
        base = keep(base)
    blocks = cut(row_blocks(base, cols))
    # Labels change from round to round, the order of the values does not: few columns are sorted once.
    held = sorted_blocks(base, cols) if p <= SORTED_COLUMNS else None
    overall = cut(pairwise_absolute_sums(base, cols) if held is None else sorted_absolute_sums(held, cols))
    w = np.full(p, 1 / math.sqrt(p))
    packed = kmeans.Packed(base, cols)
    centres = packed.fit(n_clusters, seed, scale=w).centres / w
    packed.release()

    def labelled(by, w):
        scaled = base.select("id", *cols, *[(name(c) * F.lit(float(v))).alias(f"_z{i}") for i, (c, v) in enumerate(zip(cols, w))])
        zs = [f"_z{i}" for i in range(p)]
        return cut(nearest(scaled, zs, by * w, "label").drop(*zs))

    for _ in range(max_iterations):
        # Rounds go on from the last centres, so both steps only ever improve the objective and the weights settle.
        by, centres = _lloyd(blocks, centres, w)
        used = w
        if held is None:
            objective = sparse_objective(labelled(by, w), cols, "label", overall)
        else:
            objective = _between(overall, sorted_absolute_sums(held, cols, by, w))
        found = {r["feature"]: r["objective"] for r in objective.collect()}  # p rows
        new = constrained_weights(np.array([found[c] for c in cols]), norm_constraint)
        step = np.linalg.norm(new - w)
        if step < eps:
            break
        w = new
    labels = labelled(by, used).select("id", "label")
    drop(blocks, *([] if held is None else [held]))
    base.unpersist()
    return score_table(df.sparkSession, cols, w), labels
