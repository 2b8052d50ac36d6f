"""Nearest-neighbour and radius joins."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numeric import (
    box_far_l1, box_far_sq, box_near_l1, box_near_sq, manhattan_distance, name, squared_distance,
)
from ..session import cut
from .tiles import (
    METRICS, TILE_CELLS, TILE_ROWS, block_count, distance_matrix, exact_distance, features, hash_blocks, large_block_count, pieces,
    tile_apply,
)

PRUNE_FROM_BLOCKS = 12
PRUNE_MAX_COLUMNS = 16
MAX_BOX_CELLS = 50_000_000  # block boxes shipped for pruning; beyond it every tile is visited
TABLES, BUCKET = 12, 512  # hash tables of method "lsh", and rows of a bucket
CUTS, EXTRA = 3, 2  # directions per step, steps beyond those of an even split
SHIPPED = 100_000  # buckets of one long and a few floats that are broadcast
GRID_DIMS = 3
LEAF = 64
SPLIT = 6
MAX_LEVEL = 200


# ---------------------------------------------------------------- k nearest neighbours


def _nearest(a: pd.DataFrame, b: pd.DataFrame, p: int, k: int, metric: str, same: bool) -> pd.DataFrame:
    """The k nearest rows of ``b`` for each row of ``a``, ties to the smaller id."""
    xa, xb = features(a, p), features(b, p)
    ia, ib = a["_id"].to_numpy(), b["_id"].to_numpy()
    d = distance_matrix(xa, xb, metric, squared=metric == "euclidean")
    if same:
        np.fill_diagonal(d, np.inf)
    m = min(k, len(ib) - (1 if same else 0))
    if m <= 0:
        return pd.DataFrame({"src": ia[:0], "dst": ib[:0], "d": np.zeros(0)})
    kth = np.partition(d, m - 1, axis=1)[:, m - 1]
    # The fast distances pick candidates with a margin, exact ones decide.
    scale = 1.0 + (xa * xa).sum(1) + float((xb * xb).sum(1).max())
    i, j = np.nonzero(d <= (kth + 1e-11 * scale)[:, None])
    exact = exact_distance(xa[i], xb[j], metric)
    order = np.lexsort((ib[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    start = np.r_[0, np.flatnonzero(np.diff(i)) + 1]
    rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    top = rank < k
    return pd.DataFrame({"src": ia[i[top]], "dst": ib[j[top]], "d": exact[top]})


class _Best:
    """The k nearest rows found so far of each row of a block, ties to the smaller id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, metric: str, top: float):
        self.x, self.ids, self.k, self.metric = x, ids, k, metric
        self.d = np.full((len(x), k), np.inf)
        self.to = np.full((len(x), k), np.iinfo(np.int64).max)
        # The fast distances pick candidates with a margin, exact ones decide.
        self.margin = 1e-11 * (1.0 + (x * x).sum(1) + top)

    def add(self, rows: slice, x: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """``d``: fast distances of the rows of a piece (squared if euclidean) to other rows; NaN is no pair."""
        kth = self.d[rows, -1]
        bound = kth * kth if self.metric == "euclidean" else kth.copy()
        if d.shape[1] >= self.k and np.isinf(bound).any():
            bound = np.fmin(bound, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        bound = bound + self.margin[rows]
        # Looked through in the order of storage.
        i, j = np.nonzero(d <= bound[:, None]) if d.flags.c_contiguous else np.nonzero(d.T <= bound)[::-1]
        if not len(i):
            return
        at = i + rows.start
        exact = exact_distance(self.x[at], x[j], self.metric)
        own, code = np.unique(at, return_inverse=True)
        code = np.r_[np.repeat(np.arange(len(own)), self.k), code]
        dist, to = np.r_[self.d[own].ravel(), exact], np.r_[self.to[own].ravel(), ids[j]]
        order = np.lexsort((to, dist, code))
        size = np.bincount(code)
        first = order[np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < self.k]
        self.d[own], self.to[own] = dist[first].reshape(-1, self.k), to[first].reshape(-1, self.k)

    def frame(self) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(self.d))
        return pd.DataFrame({"src": self.ids[i], "dst": self.to[i, j], "d": self.d[i, j]})


def _nearest_of_blocks(a: pd.DataFrame, b: pd.DataFrame, p: int, k: int, metric: str, same: bool) -> pd.DataFrame:
    """The k nearest rows of ``b`` for each row of ``a`` and the other way round, from one distance per pair.

    As in :func:`_nearest`, a row finds none in a block that holds a row with a missing value.
    """
    xa, xb = features(a, p), features(b, p)
    most = lambda x: float((x * x).sum(1).max(initial=0.0))
    left = _Best(xa, a["_id"].to_numpy(), k, metric, most(xb))
    right = left if same else _Best(xb, b["_id"].to_numpy(), k, metric, most(xa))
    for i, j, own in pieces(len(a), len(b), same):
        d = distance_matrix(xa[i], xb[j], metric, squared=metric == "euclidean")
        if own:
            np.fill_diagonal(d, np.nan)
        left.add(i, xb[j], right.ids[j], d)
        if not own:
            right.add(j, xa[i], left.ids[i], d.T)
    return left.frame() if same else pd.concat([left.frame(), right.frame()])


def _z_key(df: DataFrame, p: int, one_scale: bool = False) -> Column:
    """Interleaved bits of the leading columns: near rows get near keys. With ``one_scale`` all columns have the widest's unit."""
    g, bits = min(p, GRID_DIMS), 10
    ends = df.agg(*[f(f"x{j}").alias(f"{t}{j}") for j in range(g) for t, f in (("a", F.min), ("b", F.max))]).first()
    key = F.lit(0).cast("long")
    widest = max((ends[f"b{j}"] - ends[f"a{j}"] for j in range(g) if ends[f"a{j}"] is not None), default=0.0)
    for j in range(g):
        lo, hi = ends[f"a{j}"], ends[f"b{j}"]
        if lo is None or lo == hi:
            continue
        q = F.floor((F.col(f"x{j}") - F.lit(lo)) / F.lit(widest if one_scale else hi - lo) * F.lit(float(2**bits - 1))).cast("long")
        for bit in range(bits):
            one = F.shiftright(q, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key + F.shiftleft(one, bit * g + j)
    return key


def along_curve(points: DataFrame, p: int, blocks: int, one_scale: bool = False) -> DataFrame:
    """``points`` (_id, x0..) with a block number ``_b``: ranges of a space-filling curve, in a written table."""
    ranged = points.withColumn("_z", _z_key(points, p, one_scale)).repartitionByRange(blocks, "_z", "_id")
    return cut(ranged.withColumn("_b", F.spark_partition_id().cast("long")).drop("_z"))


def _pruned_partners(pts: DataFrame, p: int, k: int, metric: str) -> DataFrame:
    """Block pairs that can hold a k-nearest pair: box gap within a block's own k-th distance."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _nearest(pdf, pdf, p, k, metric, True)
        full = len(pdf) > k
        reach = near["d"].max() if full else np.inf
        x = features(pdf, p)
        return pd.DataFrame(
            {"_b": [pdf["_b"].iat[0]], "reach": [reach], "lo": [x.min(0)], "hi": [x.max(0)]}
        )

    boxes = cut(
        pts.groupBy("_b").applyInPandas(
            bound, "_b long, reach double, lo array<double>, hi array<double>"
        )
    )
    table = boxes.toPandas()  # one row per block
    ids = table["_b"].to_numpy()
    lo, hi = np.stack(table["lo"]), np.stack(table["hi"])
    shared = pts.sparkSession.sparkContext.broadcast((ids, lo, hi))

    def candidates(batches):
        bid, blo, bhi = shared.value
        for pdf in batches:
            for b, reach, l, h in zip(pdf["_b"], pdf["reach"], pdf["lo"], pdf["hi"]):
                gap = np.maximum(0, np.maximum(blo - np.asarray(h), np.asarray(l) - bhi))
                dist = gap.sum(1) if metric == "manhattan" else np.sqrt((gap * gap).sum(1))
                hit = bid[dist <= reach * (1 + 1e-9) + 1e-12]
                yield pd.DataFrame({"_b": b, "_o": hit})

    one = boxes.mapInPandas(candidates, "_b long, _o long")
    return one.unionByName(one.select(F.col("_o").alias("_b"), F.col("_b").alias("_o"))).distinct()


def knn(
    df: DataFrame, id_col: str, cols: Sequence[str], k: int, metric: str = "euclidean", method: str = "exact",
    tables: int = TABLES, bucket: int = BUCKET, seed: int = 42,
) -> DataFrame:
    """k nearest other rows of every row: (src, dst, d), ties to the smaller id.

    ``method="exact"`` compares blocks of rows, all of them where there are too many columns to prune by boxes.
    ``method="lsh"`` compares the rows of a bucket in each of ``tables`` random-projection hash tables (:func:`hashed_pairs`):
    work and traffic grow with the rows, and a row may miss some neighbours or have fewer than k. Distances are exact.

    Identical rows are represented by their first k+1 ids; the other copies get the first k at
    distance 0, so a large group of copies is never paired with itself.
    """
    metric, p = METRICS[metric], len(cols)
    x = [f"x{i}" for i in range(p)]
    rows = df.select(
        name(id_col).cast("long").alias("_id"), *[name(c).cast("double").alias(xi) for c, xi in zip(cols, x)]
    )
    # The rank filter is applied per map task before the exchange, so copies are cut early.
    rank = F.row_number().over(W.partitionBy(*x).orderBy("_id"))
    reps = cut(rows.withColumn("_rn", rank).filter(F.col("_rn") <= k + 1))
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method!r}: use 'exact' or 'lsh'")
    n = reps.count()
    if method == "lsh":
        cand = hashed_pairs(reps.select("_id", *x), p, k, metric, n, tables, bucket, seed)
        return _with_copies(cand, rows, reps, x, k)
    blocks = block_count(df, n)
    prune = (
        metric != "cosine"
        and p <= PRUNE_MAX_COLUMNS
        and blocks >= PRUNE_FROM_BLOCKS
        and blocks * (2 * p + 2) <= MAX_BOX_CELLS
    )
    if prune:
        placed = along_curve(reps, p, blocks)
    else:
        blocks = large_block_count(df, n, min(TILE_ROWS, TILE_CELLS // max(k, 1)))
        placed = hash_blocks(reps, "_id", blocks)
    placed = placed.select("_b", "_id", *x)
    partners = _pruned_partners(placed, p, k, metric) if prune else None

    def tile(a, b, same):
        return _nearest_of_blocks(a, b, p, k, metric, same)

    cand = tile_apply(placed, blocks, tile, "src long, dst long, d double", partners)
    return _with_copies(cand, rows, reps, x, k)


def _with_copies(cand: DataFrame, rows: DataFrame, reps: DataFrame, x: list[str], k: int) -> DataFrame:
    """The k best candidates of every representative, and the first k copies for every other copy."""
    best = F.row_number().over(W.partitionBy("src").orderBy("d", "dst"))
    near = cand.withColumn("_r", best).filter(F.col("_r") <= k).select("src", "dst", "d")
    extra = rows.join(reps.select("_id"), "_id", "left_anti")
    copies = extra.select(F.col("_id").alias("src"), *x).join(
        reps.filter(F.col("_rn") <= k).select(F.col("_id").alias("dst"), *x), x
    )
    return near.unionByName(copies.select("src", "dst", F.lit(0.0).alias("d")))


# ---------------------------------------------------------------- random-projection hash tables


def hash_tables(reps: DataFrame, p: int, metric: str, n: int, tables: int, bucket: int, seed: int) -> DataFrame:
    """(_id, node): the bucket of every row in each table, ``tables`` rows per row; buckets of different tables differ.

    A table halves its buckets along ``CUTS`` random directions at a time, at their medians inside the bucket, until none has
    more than ``bucket`` rows. All tables take a step together: one aggregation over (bucket, row) pairs gives the medians. The
    buckets to be cut are shipped while they are few and large; once they are many they are small, and joined by key. Buckets
    that ``EXTRA`` steps more than an even split would need leave too large are dealt out by a hash of the id.
    """
    steps = max(math.ceil(math.log(max(n / bucket, 1)) / math.log(2**CUTS)), 0)
    steps += EXTRA if steps else 0
    ways = np.random.default_rng(seed).normal(size=(p, tables * max(steps, 1) * CUTS)).astype(np.float32)
    shared = reps.sparkSession.sparkContext.broadcast(ways)
    width = max(steps, 1) * CUTS

    def project(batches):
        for pdf in batches:
            x = features(pdf, p)
            if metric == "cosine":
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm == 0, 1, norm)
            y = (x @ shared.value).astype(np.float32).reshape(-1, width)
            yield pd.DataFrame(
                {"_id": np.repeat(pdf["_id"].to_numpy(), tables), "node": np.tile(np.arange(tables, dtype=np.int64), len(pdf)), "y": list(y)}
            )

    held = reps.mapInPandas(project, "_id long, node long, y array<float>")
    if not steps:
        return held.select("_id", "node")
    held = cut(held)
    for step in range(steps):
        at = [F.col("y")[step * CUTS + c] for c in range(CUTS)]
        mids = held.groupBy("node").agg(
            F.count(F.lit(1)).alias("size"), *[F.percentile_approx(a, 0.5, 1_000).alias(f"m{c}") for c, a in enumerate(at)]
        )
        large = cut(mids.filter(F.col("size") > bucket))
        few = large.count()
        if not few:
            break
        side = F.broadcast(large) if few <= SHIPPED else large
        bits = sum(((a > F.col(f"m{c}")).cast("int") * 2**c for c, a in enumerate(at)), F.lit(0))
        node = F.when(F.col("size").isNotNull(), F.xxhash64("node", bits)).otherwise(F.col("node"))
        held = cut(held.join(side, "node", "left").select("_id", node.alias("node"), "y"))
    sizes = held.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * bucket)
    salt = F.xxhash64("node", F.pmod(F.xxhash64("_id"), F.ceil(F.col("size") / F.lit(bucket)).cast("long")))
    node = F.when(F.col("size").isNotNull(), salt).otherwise(F.col("node"))
    # Only buckets that could not be cut are left; as they are large, there are few: under n * tables / (2 * bucket).
    left = cut(sizes)
    return held.join(F.broadcast(left) if left.count() <= SHIPPED else left, "node", "left").select("_id", node.alias("node"))


def hashed_pairs(
    reps: DataFrame, p: int, k: int, metric: str, n: int, tables: int = TABLES, bucket: int = BUCKET, seed: int = 42
) -> DataFrame:
    """(src, dst, d): for every row its k nearest rows of each bucket it is in, each pair once.

    Every row travels ``tables`` times, whatever the table's size; a task holds one bucket at a time.
    """
    where = hash_tables(reps, p, metric, n, tables, bucket, seed)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf, pdf, p, k, metric, True)

    near = where.join(reps, "_id").groupBy("node").applyInPandas(inside, "src long, dst long, d double")
    return near.groupBy("src", "dst").agg(F.min("d").alias("d"))


# ---------------------------------------------------------------- radius joins on nested grids


def _halvings(p: int, level: int) -> list[int]:
    """How often each column has been halved at a level: at most SPLIT columns per level, in turn."""
    done = level * min(SPLIT, p)
    return [done // p + (j < done % p) for j in range(p)]


def grid_key(p: int, side: float, level: int) -> Column:
    """Cell of the nested grid. A cell has at most 2^SPLIT children, whatever the column count."""
    cells = [
        f"cast(floor(x{j} * {2.0**h / side!r}D) as bigint)" for j, h in enumerate(_halvings(p, level))
    ]
    return F.expr("array(" + ", ".join(cells) + ")")


def _parent(key: str, p: int, level: int) -> Column:
    """Key one level up, of a key at ``level``: halved columns are shifted right."""
    now, before = _halvings(p, level), _halvings(p, level - 1)
    cells = [f"shiftright({key}[{j}], {a - b})" if a > b else f"{key}[{j}]" for j, (a, b) in enumerate(zip(now, before))]
    return F.expr("array(" + ", ".join(cells) + ")")


def grid_nodes(points: DataFrame, p: int, side: float, level: int, aggs: dict[str, Column]) -> DataFrame:
    """One row per occupied cell: point count, tight box, aggregates."""
    box = [f(f"x{j}").alias(f"{t}{j}") for j in range(p) for t, f in (("lo", F.min), ("hi", F.max))]
    return (
        points.groupBy(grid_key(p, side, level).alias("key"))
        .agg(F.count(F.lit(1)).alias("cnt"), *box, *[c.alias(k) for k, c in aggs.items()])
    )


def depth_needed(points: DataFrame, p: int, side: float, leaf: int = LEAF) -> int:
    """First grid level whose fullest cell holds at most ``leaf`` distinct points."""
    for level in range(MAX_LEVEL):
        top = (
            points.groupBy(grid_key(p, side, level).alias("key"))
            .count()
            .agg(F.max("count"))
            .first()[0]
        )
        if top is None or top <= leaf:
            return level
    return MAX_LEVEL


def _adjacent(key: str, g: int) -> Column:
    """The 3^g cells around the leading coordinates of a key."""
    cells = [
        "array(" + ", ".join(f"{key}[{j}] + {o}L" for j, o in enumerate(off)) + ")"
        for off in itertools.product((-1, 0, 1), repeat=g)
    ]
    return F.expr("explode(array(" + ", ".join(cells) + "))")


def _ball_terms(metric: str, p: int, radius: float) -> tuple[str, str, str]:
    """SQL of the least and the greatest distance between a query q0.. and a box lo0.. hi0.., and the radius to compare with.

    Euclidean distances are compared squared.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"no box distances for metric {metric!r}")
    square = metric == "euclidean"
    term = "pow({}, 2)" if square else "({})"
    near = " + ".join(term.format(f"greatest(0D, lo{j} - q{j}, q{j} - hi{j})") for j in range(p))
    far = " + ".join(term.format(f"greatest(hi{j} - q{j}, q{j} - lo{j})") for j in range(p))
    return near, far, f"{radius**2 if square else radius!r}D"


class BallIndex:
    """Points summarised by nested grid cells, for aggregates over balls of one radius (euclidean or manhattan).

    ``points(x0.., value columns)`` have distinct coordinates; ``aggs`` maps an output name to
    (``sum`` | ``min``, value column). A cell wholly inside a ball contributes its aggregate without
    being opened, a cell outside is dropped, and only cells crossing the boundary are replaced by
    their children, down to leaves of at most LEAF points. Work per query follows the ball's
    surface, not its content, so dense cells do not turn into pairs. ``store`` writes the cell
    tables once for repeated queries.
    """

    def __init__(
        self, points: DataFrame, p: int, radius: float, aggs: dict[str, tuple[str, str]], store: bool = False,
        metric: str = "euclidean",
    ):
        self.p, self.radius, self.metric = p, float(radius), metric
        fold = {"sum": F.sum, "min": F.min}
        self.fold = {k: fold[how] for k, (how, _) in aggs.items()}
        node_aggs = {k: fold[how](col) for k, (how, col) in aggs.items()}
        box = [f"{t}{j}" for j in range(p) for t in ("lo", "hi")]
        fields = ["key", *box, *aggs]
        last = depth_needed(points, p, radius, LEAF)
        nodes = [grid_nodes(points, p, radius, level, node_aggs) for level in range(last + 1)]
        # children[l]: what stands in for an opened cell of level l, keyed by that cell (`up`):
        # its sub-cells, or its points as boxes of no extent.
        self.children = []
        for level in range(last + 1):
            leaves = points.select(
                grid_key(p, radius, level).alias("up"),
                F.array(*[F.lit(None).cast("long")] * p).alias("key"),
                *[F.col(f"x{j}").alias(f"{t}{j}") for j in range(p) for t in ("lo", "hi")],
                *[F.col(c).alias(k) for k, (_, c) in aggs.items()],
            )
            if level < last:
                full = nodes[level].filter(F.col("cnt") > LEAF).select(F.col("key").alias("up"))
                cells = nodes[level + 1].select(_parent("key", p, level + 1).alias("up"), *fields)
                kids = cells.join(full, "up", "left_semi").unionByName(leaves.join(full, "up", "left_anti"))
            else:
                kids = leaves
            self.children.append(
                kids.selectExpr(
                    "up", "true as open", "true as hit",
                    *[f"{c} as k_{c}" for c in ["key", *box, *aggs]],
                )
            )
        self.around = nodes[0].select(*fields, _adjacent("key", min(p, GRID_DIMS)).alias("coarse"))
        if store:
            self.around = cut(self.around)
            self.children = [cut(c) for c in self.children]

    def query(self, queries: DataFrame, carry: bool = False) -> DataFrame:
        """Aggregate, for every query ``(_q, x0..)``, the points within the radius (inclusive).

        ``carry`` keeps the query's coordinates as q0.. in the result. One chain of joins: a row is a
        (query, cell) pair; settled rows pass through each level, open ones become their children.
        """
        p, names = self.p, list(self.fold)
        qn = [f"q{j}" for j in range(p)]
        box = [f"{t}{j}" for j in range(p) for t in ("lo", "hi")]
        sides = range(p)
        near, far, r2 = _ball_terms(self.metric, p, self.radius)
        home = ", ".join(f"cast(floor(x{j} * {1.0 / self.radius!r}D) as bigint)" for j in range(min(p, GRID_DIMS)))
        state = (
            queries.selectExpr("_q", f"array({home}) as coarse", *[f"x{j} as q{j}" for j in sides])
            .join(self.around, "coarse")
            .selectExpr("_q", *qn, "key", *box, *names, f"{far} <= {r2} as inside")
            .filter(f"inside or {near} <= {r2}")
        )
        for kids in self.children:
            # Settled rows take their query id as key: they match nothing and stay spread out.
            left = state.selectExpr(
                "*", "if(inside, array(cast(_q as bigint)), key) as up", "not inside as open"
            )
            state = (
                left.join(kids, ["up", "open"], "left")
                .selectExpr("_q", *qn, *[f"if(hit, k_{c}, {c}) as {c}" for c in ["key", *box, *names]], "inside")
                .filter(f"inside or {near} <= {r2}")
                .selectExpr("_q", *qn, "key", *box, *names, f"inside or {far} <= {r2} as inside")
            )
        keys = ["_q", *(qn if carry else [])]
        return state.groupBy(*keys).agg(*[fold(k).alias(k) for k, fold in self.fold.items()])


def ball_join(
    queries: DataFrame, points: DataFrame, p: int, radius: float, aggs: dict[str, tuple[str, str]], metric: str = "euclidean"
) -> DataFrame:
    """One-off :class:`BallIndex` query."""
    return BallIndex(points, p, radius, aggs, metric=metric).query(queries)


def eps_degree(df: DataFrame, id_col: str, cols: Sequence[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """Rows within ``eps`` of each row, itself included: (id, neighbours)."""
    from .tiles import collapse

    p, metric = len(cols), METRICS[metric]
    pts = cut(collapse(df, id_col, cols))
    x = [f"x{i}" for i in range(p)]
    deg = ball_join(pts.withColumnRenamed("_id", "_q"), pts, p, eps, {"neighbours": ("sum", "_w")}, metric)
    rows = df.select(name(id_col).alias("id"), *[name(c).cast("double").alias(xi) for c, xi in zip(cols, x)])
    return (
        rows.join(pts.select(F.col("_id").alias("_q"), *x), x)
        .join(deg, "_q")
        .select("id", F.col("neighbours").cast("long").alias("neighbours"))
    )


def cell_links(core: DataFrame, p: int, eps: float, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """Cells of core points and the pairs of cells joined by a core pair within ``eps``.

    Cells have side eps / sqrt(p) (manhattan: eps / p): points of one cell are always within eps of each other. Pairs of
    neighbouring cells are settled by their boxes where possible (all within eps, or none), by
    their few points, or by halving the cells and looking again. Returns (points with their cell id
    ``cell``, links ``a, b``).
    """
    square = metric == "euclidean"
    sides = math.sqrt(p) if square else p  # cell sides that a pair within eps can span in one column
    side = eps / sides * (1 - 1e-12)
    m = max(math.ceil(sides), 1)
    g = min(p, GRID_DIMS)
    e2 = F.lit(float(eps) ** 2 if square else float(eps))
    box_near, box_far = (box_near_sq, box_far_sq) if square else (box_near_l1, box_far_l1)
    between = squared_distance if square else manhattan_distance
    x = [f"x{j}" for j in range(p)]
    top = grid_nodes(core, p, side, 0, {"cell": F.min("_id")})
    cells = top.select("key", "cell")
    owned = cut(core.withColumn("key", grid_key(p, side, 0)).join(cells, "key").drop("key"))

    def cols_of(t):
        return [F.col(f"{t}lo{j}") for j in range(p)], [F.col(f"{t}hi{j}") for j in range(p)]

    def side_of(nodes, t):
        keep = ["key", "cell", "cnt", *[f"{e}{j}" for j in range(p) for e in ("lo", "hi")]]
        return nodes.select(*[F.col(c).alias(t + c) for c in keep if c in nodes.columns])

    def judge(d):
        (alo, ahi), (blo, bhi) = cols_of("a_"), cols_of("b_")
        return d.filter(box_near(alo, ahi, blo, bhi) <= e2).withColumn(
            "linked", box_far(alo, ahi, blo, bhi) <= e2
        )

    coarse = F.transform(F.slice("key", 1, g), lambda v: F.floor(v / F.lit(m)).cast("long"))
    placed = top.withColumn("coarse", coarse)
    left = side_of(placed, "a_").withColumn("k", F.transform(F.slice("a_key", 1, g), lambda v: F.floor(v / F.lit(m)).cast("long")))
    right = side_of(placed, "b_").withColumn("c0", F.transform(F.slice("b_key", 1, g), lambda v: F.floor(v / F.lit(m)).cast("long")))
    right = right.select("*", _adjacent("c0", g).alias("k")).drop("c0")
    state = judge(left.join(right, "k").drop("k").filter("a_cell < b_cell"))
    found = []
    for level in range(MAX_LEVEL + 1):
        state = cut(state)
        yes = state.filter("linked").select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b")).distinct()
        open_ = state.filter("not linked").join(
            yes.select(F.col("a").alias("a_cell"), F.col("b").alias("b_cell")), ["a_cell", "b_cell"], "left_anti"
        )
        found.append(yes)
        few = (F.col("a_cnt") * F.col("b_cnt") <= LEAF * LEAF) if level < MAX_LEVEL else F.lit(True)
        pts = owned.select(grid_key(p, side, level).alias("key"), *x)
        ax = pts.select(F.col("key").alias("a_key"), *[F.col(c).alias(f"a{c}") for c in x])
        bx = pts.select(F.col("key").alias("b_key"), *[F.col(c).alias(f"b{c}") for c in x])
        near = between([F.col(f"a{c}") for c in x], [F.col(f"b{c}") for c in x]) <= e2
        direct = (
            open_.filter(few)
            .select("a_cell", "b_cell", "a_key", "b_key")
            .join(ax, "a_key")
            .join(bx, "b_key")
            .filter(near)
            .select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"))
            .distinct()
        )
        found.append(direct)
        if level == MAX_LEVEL:
            break
        big = open_.filter(~few)
        if big.isEmpty():
            break
        nodes = grid_nodes(owned, p, side, level + 1, {}).withColumn("up", _parent("key", p, level + 1))
        na = side_of(nodes.drop("cell"), "a_").join(
            nodes.select(F.col("key").alias("a_key"), F.col("up").alias("a_up")), "a_key"
        )
        nb = side_of(nodes.drop("cell"), "b_").join(
            nodes.select(F.col("key").alias("b_key"), F.col("up").alias("b_up")), "b_key"
        )
        roots = big.select("a_cell", "b_cell", F.col("a_key").alias("a_up"), F.col("b_key").alias("b_up"))
        state = judge(roots.join(na, "a_up").join(nb, "b_up").drop("a_up", "b_up"))
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    return owned, cut(links.distinct())
