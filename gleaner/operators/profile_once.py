"""All meta-feature groups from one scan.

Every partition folds its rows into one small buffer: counts of missing and empty cells, power sums of the numeric columns about
a pivot, sums of products of column pairs, and a table of value counts. Buffers and counts are added up by one exchange, keyed by
what they count, so its size depends on columns and distinct values, not on rows. The groups then read the sums; only the shape
of the first principal component, whose weights come out of the sums, looks at the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import finite, name, summarise, total
from ..sources.spec import TableSpec
from ..session import cut
from . import profile as P

PIVOT_ROWS = 1_000  # rows whose mean is the pivot; any value near the data does
FLUSH = 200_000  # distinct values a task holds before it hands them on
NUMBERS, TARGET = -2, -1  # what a row of the buffer table counts, besides the number of a categorical column


def _flag(cond) -> F.Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def fold(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(feature, v, t, ok, val): the added-up buffers of ``df``, written once."""
    num, cat, target = list(spec.numerical), [*spec.categorical, *spec.ordinal], spec.target
    every = ([target] if target else []) + P.feature_columns(spec)
    p, k = len(num), len(cat)
    head = df.select(*[name(c).cast("double").alias(f"x{i}") for i, c in enumerate(num)]).limit(PIVOT_ROWS)
    pivot = np.zeros(p)
    if p:
        means = head.agg(*[F.avg(F.when(~F.isnan(f"x{i}"), F.col(f"x{i}"))).alias(f"x{i}") for i in range(p)]).first()
        pivot = np.array([v if v is not None and math.isfinite(v) else 0.0 for v in means])
    text = [name(c).cast("string") for c in ([target] if target else []) + cat]
    whole = F.lit(True)
    for t in text:
        whole = whole & F.coalesce(t != "", F.lit(False))
    rows = df.select(
        total([F.lit(0), *[_flag(P._missing(df, c)) for c in every]]).alias("missing"),
        total([F.lit(0), *[_flag(P._empty(df, c) | P._zero(df, c)) for c in every]]).alias("sparse"),
        total([F.lit(0), *[_flag(P._zero(df, c)) for c in num]]).alias("zeros"),
        whole.alias("ok"),
        *[name(c).cast("double").alias(f"x{i}") for i, c in enumerate(num)],
        *[name(c).cast("string").alias(f"c{i}") for i, c in enumerate(cat)],
        (name(target).cast("string") if target else F.lit(None).cast("string")).alias("t"),
    )
    wide = p > P.PAIR_EXPRESSIONS
    schema = pa.schema([("feature", pa.int32()), ("v", pa.string()), ("t", pa.string()), ("ok", pa.bool_()), ("val", pa.float64())])

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        cols = [batch.column(f"x{i}") for i in range(p)]
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]) if p else np.zeros((batch.num_rows, 0))
        null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in cols]) if p else np.zeros(x.shape, bool)
        nan = np.isnan(x) & ~null
        there = (~(null | nan)).astype(float)
        y = np.where(there > 0, x - pivot, 0.0)
        counts = [float(batch.num_rows), *[float(np.sum(batch.column(c).to_numpy(zero_copy_only=False))) for c in ("missing", "sparse", "zeros")]]
        parts = [counts, nan.sum(0), there.sum(0), *[(y**e).sum(0) for e in (1, 2, 3, 4)], there.T @ there, y.T @ y, y.T @ there, (y * y).T @ there]
        if wide:  # wide tables take covariances over rows without a missing cell
            full = y[there.all(1)]
            parts += [[len(full)], full.sum(0), full.T @ full]
        return np.concatenate([np.asarray(v, float).ravel() for v in parts])

    def packed(counts: dict) -> pa.RecordBatch:
        keys = list(zip(*counts, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*keys, counts.values()], schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = sums(batch)
            numbers = own if numbers is None else numbers + own
            held = pa.Table.from_batches([batch])
            for feature in range(TARGET, k):
                keys = [*([f"c{feature}"] if feature >= 0 else []), "t", "ok"]
                found = held.select(keys).group_by(keys).aggregate([([], "count_all")]).to_pydict()
                values = found[keys[0]]
                for v, t, ok, n in zip(values, found["t"], found["ok"], found["count_all"], strict=True):
                    key = (feature, v, t if feature >= 0 else None, ok)
                    counts[key] = counts.get(key, 0.0) + n
            if len(counts) >= FLUSH:
                yield packed(counts)
                counts = {}
        if counts:
            yield packed(counts)
        if numbers is not None:
            yield packed({(NUMBERS, str(i), None, None): v for i, v in enumerate(numbers)})

    found = rows.mapInArrow(run, "feature int, v string, t string, ok boolean, val double")
    return cut(found.groupBy("feature", "v", "t", "ok").agg(F.sum("val").alias("val")))


@dataclass
class Sums:
    """The numeric part of the buffers. Sums are about the pivot, which no result depends on."""

    n: float
    missing: float
    sparse: float
    zeros: float
    nan: np.ndarray
    count: np.ndarray
    power: np.ndarray  # 4 x p
    both: np.ndarray  # rows in which i and j are present
    product: np.ndarray
    partial: np.ndarray  # sum of column i over the rows in which j is present
    squares: np.ndarray  # sum of squares of column i over these rows
    full: tuple | None = None

    @classmethod
    def of(cls, buffers: DataFrame, p: int) -> Sums:
        rows = buffers.filter(F.col("feature") == NUMBERS).select("v", "val").collect()  # by columns and column pairs
        flat = np.zeros(4 + 6 * p + 4 * p * p + ((1 + p + p * p) if p > P.PAIR_EXPRESSIONS else 0))
        for r in rows:
            flat[int(r["v"])] = r["val"]
        at = 0

        def take(*shape):
            nonlocal at
            size = math.prod(shape)
            at += size
            return flat[at - size : at].reshape(shape)

        own = cls(*take(4), take(p), take(p), take(4, p), take(p, p), take(p, p), take(p, p), take(p, p))
        if p > P.PAIR_EXPRESSIONS:
            own.full = (take(1)[0], take(p), take(p, p))
        return own

    def shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """Skewness and excess kurtosis of every column; NaN where they are undefined."""
        s1, s2, s3, s4 = self.power
        n = self.count
        with np.errstate(all="ignore"):
            d = s1 / n
            m2 = s2 - n * d**2
            m3 = s3 - 3 * d * s2 + 2 * n * d**3
            m4 = s4 - 4 * d * s3 + 6 * d**2 * s2 - 3 * n * d**4
            m2 = np.where((m2 > 0) & (self.nan == 0), m2, np.nan)
            return np.sqrt(n) * m3 / m2**1.5, n * m4 / m2**2 - 3

    def covariance(self) -> np.ndarray:
        """Sample covariances: pairwise present rows, or rows without a missing cell where the table is wide."""
        with np.errstate(all="ignore"):
            if self.full:
                n, s, q = self.full
                return (q - np.outer(s, s) / n) / max(n - 1, 1) if n else np.full(q.shape, np.nan)
            cov = (self.product - self.partial * self.partial.T / self.both) / (self.both - 1)
            bad = self.nan > 0
            return np.where(bad[:, None] | bad[None, :] | (self.both < 2), np.nan, cov)

    def correlation(self) -> np.ndarray:
        """Correlations over the same rows as :meth:`covariance`; NaN where a column does not vary."""
        cov = self.covariance()
        with np.errstate(all="ignore"):
            if self.full:
                own = np.broadcast_to(np.diag(cov)[:, None], cov.shape)
            else:
                own = (self.squares - self.partial**2 / self.both) / (self.both - 1)
            corr = cov / np.sqrt(own) / np.sqrt(own.T)
        return np.where(np.isfinite(corr), corr, np.nan)

    def imputed_covariance(self) -> np.ndarray:
        """Sample covariance after missing cells have become the mean of their column."""
        with np.errstate(all="ignore"):
            m = np.where(self.count > 0, self.power[0] / self.count, 0.0)
        centred = self.product - m[None, :] * self.partial - m[:, None] * self.partial.T + self.both * np.outer(m, m)
        return centred / max(self.n - 1, 1)


def _columns(spark, cols: Sequence[str], values: np.ndarray) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(cols, values, strict=True)]
    return spark.createDataFrame(rows, "feature string, value double").select("feature", finite(F.col("value")).alias("value"))


def _pairs(spark, sums: Sums) -> DataFrame:
    cov, corr = sums.covariance(), sums.correlation()
    p = len(cov)
    known = lambda v: None if np.isnan(v) else float(v)
    rows = [(i, j, known(cov[i, j]), known(corr[i, j])) for i in range(p) for j in range(p)]
    return spark.createDataFrame(rows, "i long, j long, cov double, corr double")


def _first_component(df: DataFrame, num: list[str], sums: Sums, variance: float = 0.95) -> DataFrame:
    """The groups' only second look at the rows: the shape of the first component, missing cells at the mean."""
    val, vec = P.components_of(sums.imputed_covariance())
    full = P.impute_mean(df.select(*[name(c).cast("double").alias(c) for c in num]), num)
    first = total([F.lit(float(w)) * name(c) for w, c in zip(vec[:, 0], num)])
    needed = P.components_needed(val, variance) / len(num)
    return P.long_row(full.select(first.alias("pc")), {
        "pca_fraction_of_components_for_variance": F.max(F.lit(needed)),
        "pca_kurtosis_first_pc": F.kurtosis("pc"), "pca_skewness_first_pc": F.skewness("pc"),
    })


def groups(df: DataFrame, spec: TableSpec) -> dict[str, tuple[bool, object]]:
    """For each group whether its roles are there, and a function that gives its (metafeature, value) rows."""
    spark, num, cat = df.sparkSession, list(spec.numerical), [*spec.categorical, *spec.ordinal]
    buffers = fold(df, spec)
    sums = Sums.of(buffers, len(num))
    p = len(P.feature_columns(spec))
    cells = sums.n * (p + bool(spec.target))
    share = lambda a, b: a / b if b else None
    log = lambda v: math.log(v) if v and v > 0 else None
    skew, kurt = sums.shapes()
    counts = buffers.filter((F.col("feature") >= 0) & (F.col("v") != ""))
    names = F.element_at(F.array(*[F.lit(c) for c in cat]), F.col("feature") + 1) if cat else F.lit("")

    def given(values: dict) -> DataFrame:
        row = tuple(None if v is None else float(v) for v in values.values())
        return P._stack(spark.createDataFrame([row], ", ".join(f"{k} double" for k in values)), list(values))

    def general():
        return given({
            "number_of_instances": sums.n, "log_number_of_instances": log(sums.n), "number_of_missing_values": sums.missing,
            "missing_values_ratio": share(sums.missing, cells), "sparsity": share(sums.sparse, cells),
        })

    def shape():
        ratio = share(float(p), sums.n)
        some = sums.n > 0
        return given({
            "number_of_features": float(p) if some else None, "log_number_of_features": log(p) if some else None,
            "dataset_ratio": ratio, "log_dataset_ratio": log(ratio),
        })

    def labels():
        held = buffers.filter((F.col("feature") == TARGET) & (F.col("v") != ""))
        return P._entropy_row(held.groupBy("v").agg(F.sum("val").alias("c")))

    def correlation():
        return P.correlation_row(_pairs(spark, sums))

    def covariance():
        return P.long_row(_pairs(spark, sums), summarise(F.col("cov"), "_covariance"))

    def entropy():
        per = counts.groupBy("feature", "v").agg(F.sum("val").alias("c"))
        return P.entropy_row(P.entropy_of(per), sums.n)

    def mutual_information():
        joint = counts.filter("ok").select(names.alias("feature"), "v", F.col("t").alias("_t"), F.col("val").alias("c"))
        return P.long_row(P.information_of(joint), summarise(F.col("value"), "_mutual_information"))

    return {
        "general": (True, general),
        "shape": (True, shape),
        "labels": (bool(spec.target), labels),
        "numeric_sparsity": (bool(num), lambda: given({"sparsity_on_numeric_columns": share(sums.zeros, sums.n * len(num))})),
        "skewness": (bool(num), lambda: P.long_row(_columns(spark, num, skew), summarise(F.col("value"), "_skewness"))),
        "kurtosis": (bool(num), lambda: P.long_row(_columns(spark, num, kurt), summarise(F.col("value"), "_kurtosis"))),
        "correlation": (bool(num), correlation),
        "covariance": (bool(num), covariance),
        "pca": (bool(num), lambda: _first_component(df, num, sums)),
        "entropy": (bool(cat), entropy),
        "mutual_information": (bool(cat and spec.target), mutual_information),
    }
