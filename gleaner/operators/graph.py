"""Graph operators on edge DataFrames: components, Laplacian, spanning forest, spectral embedding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import name
from ..functions.reduce import gram
from ..session import cut
from .tiles import METRICS, block_count, distance_matrix, features, hash_blocks, large_block_count, pieces, tile_apply


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: (id, comp) with comp the smallest id of the component.

    Each round every root with a smaller neighbouring root hooks to the smallest one, hooks are
    shortened by pointer doubling, and the edges are rewritten between roots and shrink. A chain
    that doubling leaves unfinished keeps its edges and is taken up by the next round. The vertex
    table is touched once, at the end, by the chain of shrinking hook tables.
    """
    e = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    hooks = []
    while not e.isEmpty():  # every round joins each root that has a smaller neighbour to another one
        # Stored as a < b, so the smaller neighbour of b is a.
        hook = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to"))
        hook = cut(_double(hook))
        hook = cut(_double(hook))
        hooks.append(hook)
        ha = hook.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        hb = hook.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        e = cut(
            e.join(ha, "a", "left")
            .join(hb, "b", "left")
            .select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v"))
            .filter("u <> v")
            .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
            .distinct()
        )
    own = vertices.select("id", F.col("id").alias("comp"))
    for hook in hooks:
        own = own.join(hook.withColumnRenamed("id", "comp"), "comp", "left").select(
            "id", F.coalesce("to", "comp").alias("comp")
        )
    return own


def _double(hook: DataFrame) -> DataFrame:
    """Follow every hook one step further."""
    nxt = hook.select(F.col("id").alias("to"), F.col("to").alias("to2"))
    return hook.join(nxt, "to", "left").select("id", F.coalesce("to2", "to").alias("to"))


def symmetrise(edges: DataFrame, how: str = "max") -> DataFrame:
    """Undirected weights from directed ones: the larger of both, or their half sum."""
    both = edges.select("src", "dst", "w").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    )
    agg = F.max("w") if how == "max" else F.sum("w") / 2
    return both.groupBy("src", "dst").agg(agg.alias("w"))


def heat_weights(edges: DataFrame, sigma: float = 1.0) -> DataFrame:
    return edges.select("src", "dst", F.exp(-F.col("d") * F.col("d") / F.lit(float(sigma))).alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))


def normalised_laplacian(edges: DataFrame) -> DataFrame:
    """Entries of D^-1/2 (D - W) D^-1/2: one per edge and one per vertex (src = dst)."""
    deg = degrees(edges)
    off = (
        edges.filter("src <> dst")
        .join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src")
        .join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
        .select("src", "dst", (-F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("l"))
    )
    loops = edges.filter("src = dst").select(F.col("src").alias("id"), F.col("w").alias("self"))
    diag = deg.join(loops, "id", "left").select(
        F.col("id").alias("src"),
        F.col("id").alias("dst"),
        (1 - F.coalesce("self", F.lit(0.0)) / F.col("degree")).alias("l"),
    )
    return off.unionByName(diag)


LIST = 12  # neighbours that the first rounds of a spanning tree look at


def spanning_tree(df: DataFrame, id_col: str, cols: Sequence[str], metric: str = "euclidean", k: int = LIST) -> DataFrame:
    """Exact minimum spanning tree of the complete distance graph: (a, b, d).

    Boruvka rounds: every component adds the shortest edge that leaves it; ties are broken by (distance, ids), a strict
    order, so the chosen edges never close a cycle.

    * The first rounds look at each row's ``k`` nearest rows only. The shortest listed edge that leaves a component is its
      shortest one if it is shorter than the reach of every row whose whole list lies inside; other components sit the
      round out. When none is sure any more, what is left are groups of over ``k`` rows each.
    * The other rounds compare pairs of row blocks along a space-filling curve. No component's edge is longer than the greatest
      distance between the boxes of one of its blocks and a foreign one, so block pairs whose boxes are further apart than
      this, and pairs inside one component, are not visited. Cosine distances have no box bounds and visit all pairs.
    """
    metric, p = METRICS[metric], len(cols)
    rows = cut(
        df.select(
            name(id_col).cast("long").alias("_id"),
            *[name(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
        )
    )
    # Copies of a row hang on their first copy at distance 0 and need no search.
    x = [f"x{i}" for i in range(p)]
    first = cut(rows.groupBy(*x).agg(F.min("_id").alias("_id")))
    zero = (
        rows.withColumnRenamed("_id", "b")
        .join(first.withColumnRenamed("_id", "a"), x)
        .filter("a <> b")
        .select("a", "b", F.lit(0.0).alias("d"))
    )
    comp = first.select(F.col("_id").alias("id"), F.col("_id").alias("comp"))
    near, comp = _listed_rounds(first, comp, x, metric, k)
    far = _block_rounds(first, comp, p, metric)
    tree = zero
    for part in (*near, *far):
        tree = tree.unionByName(part)
    return tree


def _chosen(pick: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of one round's picks (comp, d, a, b, to), and the components they leave. Not every component need pick."""
    idle = pick.select(F.col("to").alias("comp")).distinct().join(pick.select("comp"), "comp", "left_anti")
    root = _flatten(pick.select("comp", "to").unionByName(idle.select("comp", F.col("comp").alias("to"))))
    merged = cut(
        comp.join(root, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    )
    return pick.select("a", "b", "d").dropDuplicates(["a", "b"]), merged


def _listed_rounds(first: DataFrame, comp: DataFrame, x: list[str], metric: str, k: int) -> tuple[list, DataFrame]:
    """Rounds on the lists of nearest rows: the edges found, and the components at the end."""
    from .neighbours import knn

    near = cut(knn(first, "_id", x, k, metric))
    # A row with fewer than k others has them all in its list.
    reach = near.groupBy(F.col("src").alias("id")).agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("n"))
    reach = cut(reach.filter(F.col("n") >= k).select("id", "reach"))
    edges, picks = near, []
    while True:
        src = comp.select(F.col("id").alias("src"), F.col("comp").alias("comp"))
        dst = comp.select(F.col("id").alias("dst"), F.col("comp").alias("to"))
        edges = cut(
            edges.select("src", "dst", "d").join(src, "src").join(dst, "dst").filter("comp <> to")
        )
        best = edges.groupBy("comp").agg(
            F.min(F.struct("d", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "to")).alias("e")
        )
        spent = reach.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti").join(comp, "id")
        least = spent.groupBy("comp").agg(F.min("reach").alias("reach"))
        sure = best.join(least, "comp", "left").filter("reach IS NULL OR e.d < reach")
        pick = cut(sure.select("comp", "e.*"))
        if pick.isEmpty():
            return picks, comp
        found, comp = _chosen(pick, comp)
        picks.append(found)


def _block_rounds(first: DataFrame, comp: DataFrame, p: int, metric: str) -> list:
    """Rounds on pairs of row blocks until one component is left."""
    if comp.select("comp").distinct().limit(2).count() < 2:
        return []
    from .neighbours import PRUNE_MAX_COLUMNS, along_curve

    # Boxes of many columns tell little: large blocks then, of which a row meets few.
    n = first.count()
    blocks = block_count(first, n) if p <= PRUNE_MAX_COLUMNS else large_block_count(first, n)
    boxed = metric != "cosine"
    placed = along_curve(first, p, blocks, one_scale=True) if boxed else hash_blocks(first, "_id", blocks)
    placed = cut(placed.select("_b", "_id", *[f"x{i}" for i in range(p)]))
    picks = []

    def best(a, b, d):
        ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
        ia, ib = a["_id"].to_numpy(), b["_id"].to_numpy()
        d = np.where(ca[:, None] == cb[None, :], np.inf, d)
        low = d.min(1, initial=np.inf)
        i, j = np.nonzero((d == low[:, None]) & np.isfinite(low)[:, None])
        lo, hi = np.minimum(ia[i], ib[j]), np.maximum(ia[i], ib[j])
        out = pd.DataFrame({"comp": ca[i], "d": low[i], "a": lo, "b": hi, "to": cb[j]})
        return out.sort_values(["comp", "d", "a", "b"]).drop_duplicates("comp")

    def tile(a, b, same):
        a = a.sort_values("comp", kind="stable", ignore_index=True)  # pairs of pieces inside one component are skipped
        b = a if same else b.sort_values("comp", kind="stable", ignore_index=True)
        xa, xb, ca, cb = features(a, p), features(b, p), a["comp"].to_numpy(), b["comp"].to_numpy()
        found = [best(a[:0], b[:0], np.zeros((0, 0)))]
        for i, j, own in pieces(len(a), len(b), same):
            if ca[i][0] == ca[i][-1] == cb[j][0] == cb[j][-1]:
                continue
            d = distance_matrix(xa[i], xb[j], metric)
            if own:
                d = np.minimum(d, d.T)  # one value per pair, whichever end looks
            found.append(best(a[i], b[j], d))
            if not own:
                found.append(best(b[j], a[i], d.T))
        return pd.concat(found).sort_values(["comp", "d", "a", "b"]).drop_duplicates("comp")

    while comp.select("comp").distinct().limit(2).count() > 1:  # the number of components halves at least
        state = cut(placed.join(comp.withColumnRenamed("id", "_id"), "_id"))
        partners = _foreign_blocks(state, p, metric) if boxed else None
        cand = tile_apply(state, blocks, tile, "comp long, d double, a long, b long, to long", partners)
        pick = cut(
            cand.groupBy("comp")
            .agg(F.min(F.struct("d", "a", "b", "to")).alias("e"))
            .select("comp", "e.*")
        )
        found, comp = _chosen(pick, comp)
        picks.append(found)
    return picks


def _foreign_blocks(state: DataFrame, p: int, metric: str) -> DataFrame:
    """Block pairs (_b, _o), in both directions, that may hold the shortest edge leaving some component.

    A block in one component is an end of an edge no longer than its greatest distance to a block that is not all in that
    component; a block that mixes components has such an edge, for each of them, to every block that mixes some, itself
    included. A component's shortest edge is bounded by the least of these over its blocks, and a block looks as far as
    the loosest bound of its components. Boxes, one per block, are shipped.
    """
    square = metric == "euclidean"
    box = [f(f"x{j}").alias(f"{t}{j}") for j in range(p) for t, f in (("lo", F.min), ("hi", F.max))]
    boxes = cut(state.groupBy("_b").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), *box))
    table = boxes.toPandas().sort_values("_b")  # one row per block
    lo, hi = table[[f"lo{j}" for j in range(p)]].to_numpy(float), table[[f"hi{j}" for j in range(p)]].to_numpy(float)
    ids, least, most = (table[c].to_numpy() for c in ("_b", "least", "most"))
    shared = state.sparkSession.sparkContext.broadcast((ids, lo, hi, least, most))

    def length(gap):
        return np.sqrt((gap * gap).sum(1)) if square else gap.sum(1)

    def each(pdf):
        own = shared.value
        for row in pdf.itertuples(index=False):
            at = int(np.searchsorted(own[0], row[0]))
            mixed = own[3] != own[4]
            yield at, own, mixed | mixed[at] | (own[3] != own[3][at]), mixed

    def reaches(batches):
        for pdf in batches:
            out = []
            for at, (bid, blo, bhi, _, _), foreign, mixed in each(pdf):
                far = length(np.maximum(bhi - blo[at], bhi[at] - blo))
                sure = mixed if mixed[at] else foreign  # blocks with a foreign row for each component of this one
                out.append((bid[at], float(far[sure].min()) if sure.any() else np.inf))
            yield pd.DataFrame(out, columns=["_b", "reach"])

    reach = cut(boxes.select("_b").mapInPandas(reaches, "_b long, reach double"))
    # A component takes the least reach of its blocks, a block the greatest of its components.
    held = state.select("_b", "comp").distinct().join(reach, "_b")
    of = held.groupBy("comp").agg(F.min("reach").alias("reach"))
    bound = cut(held.select("_b", "comp").join(of, "comp").groupBy("_b").agg(F.max("reach").alias("reach")))

    def partners(batches):
        for pdf in batches:
            for (at, (bid, blo, bhi, _, _), foreign, _), reach in zip(each(pdf), pdf["reach"]):
                gap = length(np.maximum(0, np.maximum(blo - bhi[at], blo[at] - bhi)))
                hit = bid[foreign & (gap <= reach * (1 + 1e-9) + 1e-12)]
                yield pd.DataFrame({"_b": np.full(len(hit), bid[at]), "_o": hit})

    one = bound.mapInPandas(partners, "_b long, _o long")
    return one.unionByName(one.select(F.col("_o").alias("_b"), F.col("_b").alias("_o"))).distinct()


def _flatten(pick: DataFrame) -> DataFrame:
    """Roots of a pick-one-neighbour forest: (comp, to = root). A mutual pick ends in its smaller id."""
    back = pick.select(F.col("comp").alias("to"), F.col("to").alias("to2"))
    up = pick.join(back, "to").select(
        "comp",
        F.when((F.col("to2") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp"))
        .otherwise(F.col("to"))
        .alias("to"),
    )
    while True:  # picks form a forest: doubling reaches every root
        for _ in range(2):
            nxt = up.select(F.col("comp").alias("to"), F.col("to").alias("to2"))
            up = up.join(nxt, "to").select("comp", F.col("to2").alias("to"))
        up = cut(up)
        roots = up.select(F.col("comp").alias("to"), F.col("to").alias("to2"))
        if up.join(roots, "to").filter("to <> to2").isEmpty():
            return up


# ---------------------------------------------------------------- spectral embedding


def edge_product(edges: DataFrame) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Multiplication by a sparse symmetric matrix given as edges (src, dst, w)."""

    def apply(vectors: DataFrame, ys: Sequence[str]) -> DataFrame:
        v = vectors.select(F.col("id").alias("dst"), *ys)
        return (
            edges.join(v, "dst")
            .groupBy(F.col("src").alias("id"))
            .agg(*[F.sum(F.col("w") * F.col(y)).alias(y) for y in ys])
        )

    return apply


def _combine(df: DataFrame, ys: Sequence[str], m: np.ndarray, outs: Sequence[str]) -> list:
    """Linear combinations of columns by a small matrix."""
    return [
        total([F.lit(float(m[i, j])) * F.col(y) for i, y in enumerate(ys)]).alias(o)
        for j, o in enumerate(outs)
    ]


def coarse_start(edges: DataFrame, parts: DataFrame, k: int):
    """Bottom eigenvectors of the graph between parts, one value per part.

    ``parts(id, part)`` assigns every vertex to one of a few hundred parts; their c x c affinity is
    one aggregation of the edges. Piecewise-constant vectors over a fine partition are already
    close to the slow modes that plain iteration finds last.
    """
    src = parts.select(F.col("id").alias("src"), F.col("part").alias("ps"))
    dst = parts.select(F.col("id").alias("dst"), F.col("part").alias("pd"))
    rows = (
        edges.join(src, "src").join(dst, "dst").groupBy("ps", "pd").agg(F.sum("w").alias("w")).collect()
    )
    names = sorted({r["ps"] for r in rows} | {r["pd"] for r in rows})
    at = {v: i for i, v in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in rows:
        w[at[r["ps"]], at[r["pd"]]] = r["w"]
    w = (w + w.T) / 2
    s = 1 / np.sqrt(np.maximum(w.sum(1), 1e-300))
    val, vec = np.linalg.eigh(np.eye(len(names)) - s[:, None] * w * s[None, :])
    y = vec[:, :k] * s[:, None]
    return parts.sparkSession.createDataFrame(
        [(int(v), *map(float, y[i])) for v, i in at.items()],
        "part long, " + ", ".join(f"c{j} double" for j in range(y.shape[1])),
    ), y.shape[1]


def _rotate(df: DataFrame, ys: Sequence[str], m: np.ndarray, outs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Replace columns ``ys`` by their linear combinations; ``keep`` columns ride along."""
    outs, ys = list(outs), list(ys)

    def run(batches):
        for pdf in batches:
            yield pd.concat([pdf[list(keep)], pd.DataFrame(pdf[ys].to_numpy(float) @ m, columns=outs, index=pdf.index)], axis=1)

    types = dict(df.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{o} double" for o in outs])
    return df.select(*keep, *[y for y in ys if y not in keep]).mapInPandas(run, schema)


TOLERANCE = 1e-3  # residual of (I + N) / 2, whose eigenvalues lie in [0, 1]


class NotConverged(ArithmeticError):
    """An iteration reached its last round above its tolerance."""


def spectral_embedding(
    product: Callable[[DataFrame, Sequence[str]], DataFrame],
    scale: DataFrame,
    k: int,
    steps: int = 6,
    extra: int = 8,
    seed: int = 42,
    start: tuple[DataFrame, int] | None = None,
    tol: float = TOLERANCE,
    max_restarts: int = 40,
):
    """Bottom k eigenpairs of the normalised Laplacian I - N, N = D^-1/2 W D^-1/2.

    ``scale(id, degree)`` lists every vertex. The block Krylov space of (I + N) / 2 is built by
    ``steps`` products, and Rayleigh-Ritz on it gives the vectors; (I + N) / 2 has no negative
    eigenvalue, so its leading vectors belong to the smallest Laplacian eigenvalues. The leading
    ``k + extra`` vectors start the next space until the residuals of the first k are at most ``tol``;
    :class:`NotConverged` is raised if ``max_restarts`` spaces do not get there. ``start``
    (``id`` and c0.. columns, in the degree-scaled form of :func:`coarse_start`) seeds the block,
    otherwise it is pseudo-random. Only Gram matrices of the basis reach the driver.

    Returns (vectors ``id, _s, v0..`` with ``_s`` = degree^-1/2, eigenvalues ascending, residuals).
    """
    base = scale.select("id", (1.0 / F.sqrt("degree")).alias("_s"))
    noise = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i)), F.lit(2_000_003)) / F.lit(1_000_001.5) - 1
    width = k + extra
    if start is not None:
        seeds, have = start
        first = [(F.col(f"c{j}") / F.col("_s")).alias(f"y{j}") for j in range(have)]
        block = base.join(seeds, "id")
    else:
        have, block = 1, base
        first = [(1.0 / F.col("_s")).alias("y0")]  # the trivial vector D^1/2 1 is known
    block = cut(block.select("id", "_s", *first, *[noise(i).alias(f"y{i}") for i in range(have, width)]))
    width = max(width, have)
    res: list[float] = []
    for _ in range(max_restarts):
        block, mu, res = _krylov(product, block, [f"y{j}" for j in range(width)], k + extra, steps)
        width = len(mu)
        if max(res[:k], default=0.0) <= tol:
            break
    else:
        raise NotConverged(f"residual {max(res[:k]):.2g} above {tol:.2g} after {max_restarts} restarts")
    found = min(k, width)
    out = block.select("id", "_s", *[F.col(f"y{i}").alias(f"v{i}") for i in range(found)])
    return out, 2 * (1 - mu[:found]), res[:found]


def _krylov(product: Callable, block: DataFrame, ys: list[str], k: int, steps: int) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Ritz vectors (id, _s, y0..), values and residuals of one block Krylov space of (I + N) / 2."""

    def whiten(g: np.ndarray, tol: float) -> np.ndarray:
        val, vec = np.linalg.eigh((g + g.T) / 2)
        ok = val > tol
        return vec[:, ok] / np.sqrt(val[ok])

    g = gram(block, ys)
    m = whiten(g, 1e-12 * max(float(np.diag(g).max()), 1e-300))
    cur = [f"b0_{j}" for j in range(m.shape[1])]
    space = cut(_rotate(block, ys, m, cur, ["id", "_s"]))
    basis, image = list(cur), []
    for step in range(steps):
        prod = product(
            space.select("id", *[(F.col(c) * F.col("_s")).alias(c) for c in cur]), cur
        ).select("id", *[F.col(c).alias("p" + c) for c in cur])
        new = ["m" + c for c in cur]
        half = [
            (F.lit(0.5) * (F.coalesce(F.col("p" + c), F.lit(0.0)) * F.col("_s") + F.col(c))).alias("m" + c)
            for c in cur
        ]
        space = cut(space.join(prod, "id", "left").select(*space.columns, *half))
        image += new
        g = gram(space, basis + image)
        if step == steps - 1:
            break
        # New directions: the image minus its part inside the basis.
        q, at = len(basis), [len(basis) + image.index(c) for c in new]
        cross = g[:q][:, at]
        m = whiten(g[np.ix_(at, at)] - cross.T @ cross, 1e-11)
        if not m.shape[1]:
            break
        cur = [f"b{step + 1}_{j}" for j in range(m.shape[1])]
        space = cut(_rotate(space, basis + new, np.vstack([-cross @ m, m]), cur, space.columns))
        basis += cur
    q = len(image)
    used = basis[:q]
    ib, ii = list(range(q)), list(range(len(basis), len(basis) + q))
    gb, h, gi = g[np.ix_(ib, ib)], g[np.ix_(ib, ii)], g[np.ix_(ii, ii)]
    h = (h + h.T) / 2
    t = whiten(gb, 1e-10 * float(np.linalg.eigvalsh(gb).max()))
    ritz, u = np.linalg.eigh(t.T @ h @ t)
    top = np.argsort(ritz)[::-1][: min(k, t.shape[1])]
    coef, mu = t @ u[:, top], ritz[top]
    res = [
        float(np.sqrt(max(c @ gi @ c - 2 * v * (c @ h @ c) + v * v * (c @ gb @ c), 0.0)))
        for c, v in zip(coef.T, mu)
    ]
    out = cut(_rotate(space, used, coef, [f"y{i}" for i in range(len(top))], ["id", "_s"]))
    return out, mu, res
