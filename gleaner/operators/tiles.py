"""All-pairs computations as tiles.

Rows are dealt into B blocks. Every row is sent, by its block, to the B tiles its block takes part
in, and one task at a time sees only the two blocks of one tile. A tile returns per-row or
per-tile sums, never the pairs themselves, so the output grows with n, not with n squared.

A row travels once per block, so where all tiles are visited blocks are large and their number follows the
cores (:func:`large_block_count`); a tile compares them piece by piece (:func:`pieces`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import name, quoted

BLOCK_ROWS = 2048  # a tile then holds a few dozen megabytes of distances
MIN_BLOCK_ROWS = 256
TILE_ROWS = 65_536  # of a large block: a task holds two of them
TILE_CELLS = 4_000_000  # sums that a tile of large blocks holds for each of them
STRIP_CELLS = 1 << 17  # distances worked on at a time, about a core's cache

# Accepted spellings of the distance measures.
METRICS = {
    "euclidean": "euclidean", "l2": "euclidean", "minkowski": "euclidean",
    "manhattan": "manhattan", "l1": "manhattan", "cityblock": "manhattan",
    "cosine": "cosine",
}


def distance_matrix(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", squared: bool = False):
    """Dense distances between two blocks."""
    if metric == "manhattan":
        return _by_columns(a, b, np.abs)
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        scale = np.outer(np.where(na == 0, 1, na), np.where(nb == 0, 1, nb))
        return np.clip(1.0 - (a @ b.T) / scale, 0, None)
    if a.shape[1] <= 4:  # few columns: direct differences are as fast and exact
        d = _by_columns(a, b, np.square)
    else:
        d = a @ b.T
        aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
        for s in _strips(d):
            part = d[s]
            part *= 2.0
            np.subtract(aa[s] + bb, part, out=part)
            np.maximum(part, 0, out=part)
    return d if squared else np.sqrt(d, out=d)


def _strips(d: np.ndarray) -> list[slice]:
    """Runs of rows of ``d`` of about ``STRIP_CELLS`` cells each."""
    step = max(STRIP_CELLS // max(d.shape[1], 1), 1)
    return [slice(at, at + step) for at in range(0, len(d), step)]


def _by_columns(a: np.ndarray, b: np.ndarray, term: Callable) -> np.ndarray:
    """Sum over the columns of ``term`` of the differences."""
    out, turned = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    for s in _strips(out):
        part = out[s]
        one = np.empty_like(part)
        for j, other in enumerate(turned):
            np.subtract(a[s, j, None], other[None, :], out=one)
            term(one, out=one)
            part += one
    return out


def exact_distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Row-by-row distance of two equally long blocks, by differences."""
    if metric == "manhattan":
        return np.abs(x - y).sum(1)
    if metric == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        scale = np.where(nx == 0, 1, nx) * np.where(ny == 0, 1, ny)
        return np.clip(1.0 - (x * y).sum(1) / scale, 0, None)
    return np.sqrt(((x - y) ** 2).sum(1))


def kernel_matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, coef0: float = 1.0):
    """Similarities between two blocks; negative ones become 0."""
    if kernel in ("rbf", "laplacian"):
        out = distance_matrix(a, b, squared=True) if kernel == "rbf" else distance_matrix(a, b, "manhattan")
    else:
        out = a @ b.T
    for s in _strips(out):
        part = out[s]
        if kernel in ("rbf", "laplacian"):
            part *= -gamma
            np.exp(part, out=part)
            continue
        part *= gamma
        part += coef0
        if kernel == "poly":
            part *= part * part
        else:
            np.tanh(part, out=part)
        np.maximum(part, 0, out=part)
    return out


def block_count(df: DataFrame, n: int, rows: int = BLOCK_ROWS) -> int:
    """Blocks of at most ``rows`` rows, and enough of them to occupy the cores on small inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = min(math.ceil(math.sqrt(2 * cores)), math.ceil(n / MIN_BLOCK_ROWS))
    return max(math.ceil(n / rows), spread, 1)


def large_block_count(df: DataFrame, n: int, rows: int = TILE_ROWS) -> int:
    """Blocks for work that visits all tiles: a few tiles per core, as many as ``rows`` rows ask for beyond that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return min(block_count(df, n), max(math.ceil(n / max(rows, BLOCK_ROWS)), math.ceil(math.sqrt(8 * cores))))


def pieces(na: int, nb: int, same: bool) -> Iterator[tuple[slice, slice, bool]]:
    """Pairs of runs of at most ``BLOCK_ROWS`` rows of two blocks, each unordered pair once if both are the same block."""
    for i in range(0, na, BLOCK_ROWS):
        for j in range(i if same else 0, nb, BLOCK_ROWS):
            yield slice(i, i + BLOCK_ROWS), slice(j, j + BLOCK_ROWS), same and i == j


def hash_blocks(df: DataFrame, id_col: str, blocks: int) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(name(id_col)), F.lit(blocks)).cast("long"))


def tile_apply(
    df: DataFrame,
    blocks: int,
    fn: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    partners: DataFrame | None = None,
) -> DataFrame:
    """Run ``fn(block_a, block_b, same)`` on every unordered pair of blocks.

    ``df`` carries the block number in ``_b``. ``partners(_b, _o)`` restricts the pairs (both
    directions listed); otherwise all pairs are visited.
    """
    if partners is None:
        spread = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_o"))
        tiles = blocks * (blocks + 1) // 2
    else:
        lists = partners.groupBy("_b").agg(F.collect_set("_o").alias("_os"))  # one row per block
        spread = df.join(lists, "_b").select("*", F.explode("_os").alias("_o")).drop("_os")
        tiles = blocks * 8
    keyed = spread.select(
        "*", F.least("_b", "_o").alias("_ti"), F.greatest("_b", "_o").alias("_tj")
    ).drop("_o")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = pdf["_ti"].iat[0], pdf["_tj"].iat[0]
        pdf = pdf.drop(columns=["_ti", "_tj"])
        if ti == tj:
            return fn(pdf, pdf, True)
        return fn(pdf[pdf["_b"] == ti], pdf[pdf["_b"] == tj], False)

    # A fixed partition count: adaptive coalescing looks at bytes, but tiles cost compute. With several
    # partitions per tile few tiles share a task.
    return (
        keyed.repartition(max(min(4 * tiles, 8192), 1), "_ti", "_tj")
        .groupBy("_ti", "_tj")
        .applyInPandas(run, schema)
    )


def _as_x(cols: Sequence[str]) -> list[str]:
    """SQL projections of feature columns to x0..xp-1."""
    return [f"cast({quoted(c)} as double) as x{i}" for i, c in enumerate(cols)]


def collapse(df: DataFrame, id_col: str, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Merge identical rows: ``_id`` (smallest id), ``_w`` (copies), extra columns, x0..xp-1.

    A value that a third of all rows share becomes one weighted row before any pairing.
    """
    slim = df.selectExpr(f"{quoted(id_col)} as _id", *[quoted(e) for e in extra], *_as_x(cols))
    keys = [*extra, *[f"x{i}" for i in range(len(cols))]]
    return slim.groupBy(*keys).agg(
        F.min("_id").alias("_id"), F.count(F.lit(1)).cast("double").alias("_w")
    )


def features(pdf: pd.DataFrame, p: int) -> np.ndarray:
    return pdf[[f"x{i}" for i in range(p)]].to_numpy(dtype=float)


def kernel_sums(
    points: DataFrame, p: int, kernel: str, gamma: float, ys: Sequence[str], blocks: int
) -> DataFrame:
    """For every row i and column y: sum over all rows j of k(i, j) * y_j (self included).

    ``points`` holds ``_id, _b, x0.., ys``. Returns ``_id`` and the sums under the same names.
    """
    ys = list(ys)

    def tile(a, b, same):
        xa, xb, ya, yb = features(a, p), features(b, p), a[ys].to_numpy(float), b[ys].to_numpy(float)
        sa = np.zeros(ya.shape)
        sb = sa if same else np.zeros(yb.shape)
        for i, j, own in pieces(len(a), len(b), same):
            k = kernel_matrix(xa[i], xb[j], kernel, gamma)
            sa[i] += k @ yb[j]
            if not own:
                sb[j] += k.T @ ya[i]
        sides = [(a, sa)] if same else [(a, sa), (b, sb)]
        return pd.concat([pd.DataFrame({"_id": t["_id"].to_numpy()} | {y: s[:, c] for c, y in enumerate(ys)}) for t, s in sides])

    schema = "_id long, " + ", ".join(f"{y} double" for y in ys)
    slim = points.select("_b", "_id", *[f"x{i}" for i in range(p)], *ys)
    return tile_apply(slim, blocks, tile, schema).groupBy("_id").agg(*[F.sum(y).alias(y) for y in ys])


def label_distance_sums(
    points: DataFrame, p: int, blocks: int, metric: str = "euclidean"
) -> DataFrame:
    """For every row and label: weighted sum of distances to the rows of that label.

    ``points`` holds ``_id, _b, _w, label, x0..``; returns ``_id, other, dist``.
    """

    def weights(code, w, labels):
        onehot = np.zeros((len(code), len(labels)))
        onehot[np.arange(len(code)), code] = w
        return onehot

    def one_side(a, labels, s):
        return pd.DataFrame(
            {
                "_id": np.repeat(a["_id"].to_numpy(), len(labels)),
                "other": np.tile(labels, len(a)),
                "dist": s.ravel(),
            }
        )

    def tile(a, b, same):
        xa, xb, wa, wb = features(a, p), features(b, p), a["_w"].to_numpy(), b["_w"].to_numpy()
        la, ca = np.unique(a["label"].to_numpy(), return_inverse=True)
        lb, cb = np.unique(b["label"].to_numpy(), return_inverse=True)
        sa = np.zeros((len(a), len(lb)))
        sb = sa if same else np.zeros((len(b), len(la)))
        for i, j, own in pieces(len(a), len(b), same):
            d = distance_matrix(xa[i], xb[j], metric)
            if own:
                np.fill_diagonal(d, 0.0)
            sa[i] += d @ weights(cb[j], wb[j], lb)
            if not own:
                sb[j] += d.T @ weights(ca[i], wa[i], la)
        return one_side(a, lb, sa) if same else pd.concat([one_side(a, lb, sa), one_side(b, la, sb)])

    return (
        tile_apply(points, blocks, tile, "_id long, other long, dist double")
        .groupBy("_id", "other")
        .agg(F.sum("dist").alias("dist"))
    )


def label_blocks(points: DataFrame) -> int:
    """Blocks for :func:`label_distance_sums`, smaller ones where there are many labels."""
    size = points.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
    return large_block_count(points, size["n"], min(TILE_ROWS, TILE_CELLS // max(size["k"], 1)))


def pair_distance_means(
    df: DataFrame, id_col: str, cols: Sequence[str], label: str, metric: str = "euclidean"
) -> DataFrame:
    """Per row and label: mean distance to the rows of that label (self included)."""
    metric = METRICS[metric]
    pts = collapse(df.withColumn("label", name(label).cast("long")), id_col, cols, ["label"])
    blocks = label_blocks(pts)
    sums = label_distance_sums(hash_blocks(pts, "_id", blocks), len(cols), blocks, metric)
    sizes = df.groupBy(name(label).cast("long").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    means = sums.join(sizes, "other").select("_id", "other", (F.col("dist") / F.col("m")).alias("mean_dist"))
    # Give every copy of a merged row its result back.
    x = [f"x{i}" for i in range(len(cols))]
    rows = df.selectExpr(f"{quoted(id_col)} as id", f"cast({quoted(label)} as bigint) as label", *_as_x(cols))
    owner = rows.join(pts.select("_id", "label", *x), ["label", *x]).select("id", "_id")
    return owner.join(means, "_id").select("id", "other", "mean_dist")


def rbf_degree(df: DataFrame, id_col: str, cols: Sequence[str], gamma: float | None = None) -> DataFrame:
    """Sum of RBF similarities of each row to all rows, itself included."""
    p = len(cols)
    pts = collapse(df, id_col, cols)
    blocks = large_block_count(df, pts.count())
    deg = kernel_sums(hash_blocks(pts, "_id", blocks), p, "rbf", gamma or 1.0 / p, ["_w"], blocks)
    x = [f"x{i}" for i in range(p)]
    rows = df.selectExpr(f"{quoted(id_col)} as id", *_as_x(cols))
    owner = rows.join(pts.select("_id", *x), x).select("id", "_id")
    return owner.join(deg, "_id").select("id", F.col("_w").alias("degree"))
