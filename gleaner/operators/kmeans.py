"""K-means behind the matrix convention (key column, feature columns): Spark ML's, and the same fit over packed rows.

Spark ML keeps every row as an object, which a table larger than the memory pays for with writing and reading those objects
in every round. :class:`Packed` holds the rows as arrays and repeats Spark's k-means|| (with its random numbers) and its
Lloyd rounds on them, so both give the same centres but for rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import name, quoted
from ..functions.reduce import byte_blocks, byte_pieces, sum_bytes
from ..session import cut, drop
from .assign import nearest


def vectors(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), scale=None) -> DataFrame:
    """``keep`` columns and one vector column ``_v`` of the (optionally scaled) features."""
    scale = [1.0] * len(cols) if scale is None else list(scale)
    plain = df.selectExpr(
        *[quoted(c) for c in keep],
        *[f"cast({quoted(c)} as double) * {float(w)!r}D as _x{i}" for i, (c, w) in enumerate(zip(cols, scale))],
    )
    asm = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(cols))], outputCol="_v")
    return asm.transform(plain).select(*[name(c) for c in keep], "_v")


class Fit:
    """A fitted centre model: centres (k x p, in scaled space) and row labels."""

    def __init__(self, model, centres: np.ndarray, cost: float):
        self.model, self.centres, self.cost = model, centres, cost

    def label(self, vec: DataFrame, out: str = "label") -> DataFrame:
        if self.model is None:
            return vec.withColumn(out, F.lit(0).cast("long")).drop("_v")
        return (
            self.model.transform(vec)
            .withColumn(out, F.col("_pred").cast("long"))
            .drop("_v", "_pred")
        )


def fit(
    vec: DataFrame, k: int, seed: int = 42, max_iter: int = 20, tol: float = 1e-4,
    weight: str | None = None, bisecting: bool = False,
) -> Fit:
    """k-means|| + Lloyd (or bisecting) over the vector column; k = 1 is the grand mean."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k == 1:
        from pyspark.ml.stat import Summarizer

        w = F.col(weight) if weight else F.lit(1.0)
        row = vec.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v"), w).alias("s")).first()["s"]
        n = row["count"]
        return Fit(None, np.array([row["mean"].toArray()]), float(sum(row["variance"].toArray()) * max(n - 1, 0)))
    cls = BisectingKMeans if bisecting else KMeans
    est = cls(featuresCol="_v", predictionCol="_pred", k=k, seed=seed, maxIter=max_iter)
    if not bisecting:
        est = est.setTol(tol)
    if weight:
        est = est.setWeightCol(weight)
    model = est.fit(vec)
    return Fit(model, np.array(model.clusterCenters()), float(model.summary.trainingCost))


# ---------------------------------------------------------------- the same over packed rows

EPSILON = 5e-11  # least number that Spark's gap sampling takes a logarithm of
INIT_STEPS, LOCAL_ROUNDS = 2, 30  # of Spark's k-means||


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words, 32 bits."""
    turn = lambda v, r: ((v << r) | (v >> (32 - r))) & 0xFFFFFFFF
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = (turn(h ^ (turn(k, 15) * 0x1B873593 & 0xFFFFFFFF), 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ (h >> 16)


def _start(seed: int) -> int:
    """State of Spark's XORShiftRandom of a seed."""
    data = (seed & (2**64 - 1)).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _step(s):
    """The next state, of one or of many."""
    if isinstance(s, int):
        s ^= s << 21 & (2**64 - 1)
        s ^= s >> 35
        return s ^ (s << 4 & (2**64 - 1))
    s = s ^ (s << np.uint64(21))
    s = s ^ (s >> np.uint64(35))
    return s ^ (s << np.uint64(4))


def _signed(v: int, bits: int) -> int:
    v &= 2**bits - 1
    return v - 2**bits if v >> (bits - 1) else v


def _powers(n: int) -> list[np.ndarray]:
    """The state after 2, 4, 8, ... steps is linear in the state: what each byte of it adds (8 x 256 each)."""
    columns = np.uint64(1) << np.arange(64, dtype=np.uint64)
    columns, out = _step(_step(columns)), []
    for _ in range(n):
        table = np.zeros((8, 256), np.uint64)
        for byte in range(8):
            for bit in range(8):
                table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ columns[8 * byte + bit]
        out.append(table)
        columns = _jump(table, columns)
    return out


def _jump(table: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = table[0][s & np.uint64(255)]
    for byte in range(1, 8):
        out = out ^ table[byte][(s >> np.uint64(8 * byte)) & np.uint64(255)]
    return out


def _uniform(first: np.ndarray) -> np.ndarray:
    """Java's nextDouble from the states after the first of its two steps."""
    high, low = first & np.uint64(2**26 - 1), _step(first) & np.uint64(2**27 - 1)
    return ((high << np.uint64(27)) + low).astype(float) / 2.0**53


def draws(seed: int, at: int, n: int, powers: list[np.ndarray]) -> np.ndarray:
    """The ``at``-th and following of the numbers that XORShiftRandom(seed).nextDouble gives, without those before."""
    s = np.array([_step(_start(seed))], np.uint64)
    for b, table in enumerate(powers):
        if at >> b & 1:
            s = _jump(table, s)
    for table in powers:
        if len(s) >= n:
            break
        s = np.concatenate([s, _jump(table, s)])
    return _uniform(s[:n])


class JavaRandom:
    """java.util.Random."""

    def __init__(self, seed: int):
        self.s = (seed ^ 0x5DEECE66D) & (2**48 - 1)

    def next(self, bits: int) -> int:
        self.s = (self.s * 0x5DEECE66D + 0xB) & (2**48 - 1)
        return _signed(self.s >> (48 - bits), 32)

    def int(self) -> int:
        return self.next(32)

    def long(self) -> int:
        return _signed((self.next(32) << 32) + self.next(32), 64)

    def double(self) -> float:
        return ((self.next(26) << 27) + self.next(27)) / 2.0**53

    def below(self, n: int) -> int:
        r = self.next(31)
        if n & (n - 1) == 0:
            return n * r >> 31
        while r - (v := r % n) + n - 1 >= 2**31:
            r = self.next(31)
        return v


def closest(columns: Sequence[np.ndarray], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre (ties to the smaller one) and squared distance, for rows given as one array per column."""
    best, lab = None, np.zeros(len(columns[0]), np.min_scalar_type(len(centres)))
    diff, d = np.empty(len(lab)), np.empty(len(lab))
    for k, c in enumerate(centres):
        for j, (x, v) in enumerate(zip(columns, c)):
            to = diff if j else d
            np.subtract(x, v, out=to)
            np.multiply(to, to, out=to)
            if j:
                d += diff
        if best is None:
            best = d.copy()
        else:
            lab[d < best] = k
            np.minimum(best, d, out=best)
    return lab, best


def _plus_plus(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Spark's local weighted k-means++ with seed 0."""
    rand, of = JavaRandom(0), lambda c: ((points - c) ** 2).sum(1)
    pick = lambda r, w: int(np.searchsorted(np.cumsum(w), r))
    centres = [points[min(pick(rand.double() * weights.sum(), weights), len(points) - 1)]]
    cost = of(centres[0])
    for _ in range(1, k):
        r = rand.double() * (cost * weights).sum()
        centres.append(points[min(pick(r, cost * weights), len(points) - 1)])
        cost = np.minimum(cost, of(centres[-1]))
    out, last = np.array(centres), None
    for _ in range(LOCAL_ROUNDS):
        lab = closest(list(points.T), out)[0]
        moved = last is None or (lab != last).any()
        last = lab
        mass = np.bincount(lab, weights, k)
        for j in range(k):
            out[j] = (points[lab == j] * weights[lab == j, None]).sum(0) / mass[j] if mass[j] else points[rand.below(len(points))]
        if not moved:
            break
    return out


class Packed:
    """Rows without ids, packed once for many fits. Missing values are an error, as they are to Spark ML."""

    def __init__(self, df: DataFrame, cols: Sequence[str]):
        self.cols = list(cols)
        self.blocks = cut(byte_blocks(df, cols))
        rows = self.blocks.groupBy("_p").agg(F.sum("_n").alias("n"), F.sum("_bad").alias("bad")).collect()  # one row per partition
        if not rows:
            raise ValueError("no rows")
        if any(r["bad"] for r in rows):
            raise ValueError("missing values")
        self.sizes = {r["_p"]: r["n"] for r in rows}
        self.n = sum(self.sizes.values())

    def release(self) -> None:
        drop(self.blocks)

    def total(self, fn: Callable[[np.ndarray], np.ndarray], use: Sequence[int] | None = None) -> np.ndarray:
        """Sum of ``fn(columns)`` over all rows, given as one array per column; ``use``: the columns that are wanted."""
        if use is None or list(use) == list(range(len(self.cols))):
            return sum_bytes(self.blocks, len(self.cols), fn)
        use = list(use)
        return sum_bytes(self.blocks, len(self.cols), lambda a: fn(a[use]))

    def _runs(self, use: Sequence[int], fn: Callable[[int, int, np.ndarray], np.ndarray], where=None) -> list:
        """Rows that ``fn(partition, place, columns)`` picks, in the order of the table."""
        p, use = len(self.cols), list(use)

        def pick(batches):
            for b in batches:
                parts, places, sizes = (c.to_numpy() for c in b.columns[:3])
                # Blocks that follow each other are read as one.
                breaks = (np.diff(parts) != 0) | (places[1:] != (places + sizes)[:-1])
                ends = np.r_[np.flatnonzero(breaks) + 1, len(parts)] if len(parts) else []
                first = 0
                for end in ends:
                    part, place = int(parts[first]), int(places[first])
                    for columns in byte_pieces(b.column(3), p, first, end):
                        for j in np.flatnonzero(fn(part, place, columns[use])):
                            yield pa.RecordBatch.from_pylist([{"p": part, "o": place + int(j), "row": columns[use, j].tolist()}])
                        place += columns.shape[1]
                    first = end

        held = self.blocks if where is None else self.blocks.filter(where)
        found = held.select("_p", "_o", "_n", "v").mapInArrow(pick, "p long, o long, row array<double>").collect()
        return [np.array(r["row"]) for r in sorted(found, key=lambda r: (r["p"], r["o"]))]

    def _first(self, use: Sequence[int], seed: int) -> np.ndarray:
        """What RDD.takeSample(false, 1, seed) gives."""
        rand = JavaRandom(seed)
        order = range(max(self.sizes) + 1)
        if self.n == 1:
            at = [(p, 0) for p in self.sizes]
        else:
            f = 1.0 / self.n
            g = -math.log(1e-4) / self.n
            f = min(1.0, max(1e-10, f + g + math.sqrt(g * g + 2 * g * f)))
            at = []
            while not at:
                seeds = JavaRandom(rand.int())
                for p in order:
                    s = _start(seeds.long())

                    def double():
                        nonlocal s
                        s = _step(s)
                        high = s & (2**26 - 1)
                        s = _step(s)
                        return ((high << 27) + (s & (2**27 - 1))) / 2.0**53

                    n = self.sizes.get(p, 0)
                    if f >= 1.0:
                        at += [(p, i) for i in range(n)]
                    elif f > 0.4:
                        at += [(p, i) for i in range(n) if double() <= f]
                    else:
                        lnq = math.log1p(-f)
                        gap = lambda: int(math.log(max(double(), EPSILON)) / lnq)
                        i = gap()
                        while i < n:
                            at.append((p, i))
                            i += 1 + gap()
            for i in range(len(at) - 1, 0, -1):
                j = rand.below(i + 1)
                at[i], at[j] = at[j], at[i]
        part, place = at[0]
        where = (F.col("_p") == part) & (F.col("_o") <= place) & (F.col("_o") + F.col("_n") > place)
        return self._runs(use, lambda p, o, columns: np.arange(o, o + len(columns[0])) == place, where)[0]

    def _begin(self, use: Sequence[int], scale: np.ndarray, k: int, seed: int) -> np.ndarray:
        """Spark's k-means||."""
        s = _step(_start(seed))
        seed = _signed(s, 32)
        centres = [self._first(use, seed) * scale]
        powers = _powers(max(self.sizes.values()).bit_length() + 1)
        for step in range(INIT_STEPS):
            now = np.array(centres)
            cost = float(self.total(lambda xs, c=now: closest(xs * scale[:, None], c)[1].sum(), use)[0])

            def lucky(part, place, xs, c=now, cost=cost, step=step):
                d = closest(xs * scale[:, None], c)[1]
                u = draws(_signed(seed ^ (step << 16) ^ part, 32), place, len(d), powers)
                with np.errstate(divide="ignore", invalid="ignore"):
                    return u < 2.0 * d * k / cost

            centres += [row * scale for row in self._runs(use, lucky)]
        _, order = np.unique(np.array(centres), axis=0, return_index=True)
        points = np.array(centres)[np.sort(order)]
        if len(points) <= k:
            return points
        m = len(points)
        weights = self.total(lambda xs: np.bincount(closest(xs * scale[:, None], points)[0], minlength=m), use)
        return _plus_plus(points, weights, k)

    def fit(
        self, k: int, seed: int = 42, max_iter: int = 20, tol: float = 1e-4, scale: np.ndarray | None = None, cols: Sequence[str] | None = None
    ) -> PackedFit:
        """:func:`fit` of the (scaled) columns ``cols``."""
        if k < 1:
            raise ValueError("k must be at least 1")
        use = list(range(len(self.cols))) if cols is None else [self.cols.index(c) for c in cols]
        scale, p = np.ones(len(use)) if scale is None else np.asarray(scale, float), len(use)
        if k == 1:
            mean = self.total(lambda xs: (xs * scale[:, None]).sum(1), use) / self.n
            cost = self.total(lambda xs: closest(xs * scale[:, None], mean[None])[1].sum(), use)[0]
            return PackedFit(self, use, scale, mean[None], float(cost))
        centres, cost = self._begin(use, scale, k, seed), 0.0
        for _ in range(max_iter):
            m = len(centres)

            def part(xs, c=centres):
                xs = xs * scale[:, None]
                lab, d = closest(xs, c)
                out = np.empty((m, p + 1))
                for j in range(m):
                    own = (lab == j).astype(float)
                    out[j, 0], out[j, 1:] = own.sum(), xs @ own
                return np.append(out.ravel(), d.sum())

            found = self.total(part, use)
            cost, found = float(found[-1]), found[:-1].reshape(m, p + 1)
            sizes, sums = found[:, 0], found[:, 1:]
            old, some = centres, sizes > 0
            centres = old.copy()
            centres[some] = sums[some] / sizes[some, None]
            if (((centres - old) ** 2).sum(1) <= tol * tol).all():
                break
        return PackedFit(self, use, scale, centres, cost)


class PackedFit:
    """Centres (k x p, in scaled space), the cost of the last round, and labels of rows that have the packed columns."""

    def __init__(self, packed: Packed, use: Sequence[int], scale: np.ndarray, centres: np.ndarray, cost: float):
        self.cols, self.scale, self.centres, self.cost = [packed.cols[j] for j in use], scale, centres, cost

    def label(self, df: DataFrame, out: str = "label") -> DataFrame:
        zs = [f"_z{i}" for i in range(len(self.cols))]
        scaled = df.select("*", *[(name(c).cast("double") * F.lit(float(v))).alias(z) for c, v, z in zip(self.cols, self.scale, zs)])
        return nearest(scaled, zs, self.centres, out).drop(*zs)
