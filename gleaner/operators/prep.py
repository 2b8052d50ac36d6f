"""Preparation of a raw table: clean, encode, truncate, standardise.

Every step is DataFrame-in, DataFrame-out. Key columns (``keys``) ride along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numeric import name, quoted, unpivot
from ..session import cut
from ..sources.spec import TableSpec
from .order import with_row_id
from .outliers import remove_outliers

MAX_LEVELS = 10_000
BROADCAST_LEVELS = 200_000  # names and numbers of levels that are broadcast
WIDE = 32


def _present(df: DataFrame, c: str):
    ok = name(c).isNotNull()
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        ok = ok & ~F.isnan(name(c))
    return ok


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop a row when any of its columns is null or NaN (ignored and target columns count)."""
    cond = None
    for c in df.columns:
        cond = _present(df, c) if cond is None else cond & _present(df, c)
    return df.filter(cond)


def drop_ignored(df: DataFrame, spec: TableSpec, keys: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in spec.ignore if c not in keys])


def drop_target(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.drop(spec.target) if spec.target else df


def levels(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct levels per column, in one job; refuses unbounded columns."""
    if not cols:
        return {}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("c"), name(c).cast("string").alias("v")) for c in cols]
    )
    rows = (
        df.select(F.explode(pairs).alias("kv"))
        .select("kv.*")
        .filter(F.col("v").isNotNull())
        .distinct()
        .limit(len(cols) * max_levels + 1)
        .collect()
    )
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c, vals in out.items():
        if len(vals) > max_levels:
            raise ValueError(f"column {c!r} has over {max_levels} levels; it cannot be one-hot encoded")
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        vals.sort(key=float if numeric else None)
    return out


def one_hot(df: DataFrame, spec: TableSpec, keys: Sequence[str] = (), known=None) -> DataFrame:
    """Indicators ``<column>_<code>`` for every level but the first, after the other columns."""
    known = known if known is not None else levels(df, spec.categorical)
    rest = [c for c in df.columns if c not in spec.categorical]
    flags = [
        F.when(name(c).cast("string") == F.lit(v), 1).otherwise(0).alias(f"{c}_{code}")
        for c in spec.categorical
        for code, v in enumerate(known[c])
        if code > 0
    ]
    return df.select(*[name(c) for c in rest], *flags)


def one_hot_sparse(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Indicators of any number of levels: ``df`` without ``cols``, with a sparse vector column ``out`` in their place.

    Levels are numbered in their sorted order (numbers as numbers, all else as text) by one distributed sort, the number joins
    the rows, and every row keeps at most one entry per column. As in :func:`one_hot` the first level of a column has no
    entry, nor has a missing value; the vector is as long as all other levels together. No list of levels leaves Spark; a
    level that a large part of the rows holds is one row of the joined side.
    """
    rest = [c for c in df.columns if c not in cols]
    if out in rest:
        raise ValueError(f"there is a column {out!r} already")
    slots, start = [], 0
    for i, c in enumerate(cols):
        level = name(c)
        ordered = level if isinstance(df.schema[c].dataType, T.NumericType) else level.cast("string")
        known = cut(with_row_id(df.select(ordered.alias("_level")).filter("_level IS NOT NULL").distinct(), ["_level"], "_at"))
        size = known.count()
        side = F.broadcast(known) if size <= BROADCAST_LEVELS else known
        df = df.join(side.select(F.col("_level").alias(f"_level{i}"), F.col("_at").alias(f"_at{i}")), ordered == F.col(f"_level{i}"), "left")
        slots.append(F.when(F.col(f"_at{i}") > 0, (F.col(f"_at{i}") - 1 + F.lit(start)).cast("int")))
        start += max(size - 1, 0)
    at = F.filter(F.array(*slots), lambda s: s.isNotNull())
    ones = F.transform(at, lambda s: F.lit(1.0))
    vector = F.struct(F.lit(start).alias("size"), at.alias("indices"), ones.alias("values"))
    return df.select(*[name(c) for c in rest], vector.alias(out))


def encode_ordinal(df: DataFrame, spec: TableSpec, unknown: str = "error") -> DataFrame:
    """Level to its rank; levels are compared as text. Unknown levels fail, or give null."""
    for c, lv in spec.ordinal.items():
        text = name(c).cast("string")
        pos = F.array_position(F.array(*[F.lit(x) for x in lv]), text)
        miss = (
            F.raise_error(F.concat(F.lit(f"unknown level of {c}: "), text)).cast("int")
            if unknown == "error"
            else F.lit(None).cast("int")
        )
        df = df.withColumn(
            c, F.when(text.isNull(), F.lit(None)).when(pos > 0, (pos - 1).cast("int")).otherwise(miss)
        )
    return df


def truncate(df: DataFrame, order: Sequence[str], threshold: int = 10_000) -> DataFrame:
    """First rows in key order: a distributed top-n, not a full sort."""
    return df.orderBy(*[name(c) for c in order]).limit(threshold)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column, one pass."""
    if not cols:
        return {}
    if len(cols) <= WIDE:
        aggs = [
            F.expr(f"{fn}({quoted(c)}) as {t}{i}")
            for i, c in enumerate(cols)
            for t, fn in (("m", "avg"), ("s", "stddev_pop"))
        ]
        row = df.agg(*aggs).first()
        return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}
    # Wide tables: one aggregate over (column, value) pairs, combined before the exchange of p rows.
    long = unpivot(df.selectExpr(*[f"cast({quoted(c)} as double) as {quoted(c)}" for c in cols]), cols, "c", "x")
    rows = long.groupBy("c").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    by = {r["c"]: (r["m"], r["s"]) for r in rows}
    return {c: by.get(c, (None, None)) for c in cols}


def standardise(df: DataFrame, cols: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / population sd per column; a constant column becomes 0."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    stats = moments(df, cols)
    out = []
    for c in df.columns:
        col = quoted(c)
        if c not in stats:
            out.append(col)
            continue
        mean, sd = stats[c]
        if not sd:
            out.append(f"if({col} is null, null, 0D) as {col}")
        else:
            out.append(f"({col} - ({float(mean)!r}D)) / {float(sd)!r}D as {col}")
    return df.selectExpr(*out)


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null and NaN become the column mean."""
    stats = df.agg(*[F.avg(F.when(_present(df, c), name(c))).alias(f"m{i}") for i, c in enumerate(cols)])
    row = stats.first()
    for i, c in enumerate(cols):
        df = df.withColumn(c, F.when(_present(df, c), name(c)).otherwise(F.lit(row[f"m{i}"])))
    return df


def project_roles(df: DataFrame, spec: TableSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Declared numerical, ordinal and categorical columns only."""
    used = [*spec.numerical, *spec.ordinal, *spec.categorical]
    return df.select(*[name(c) for c in keys if c not in used], *[name(c) for c in used])


def prepare(
    df: DataFrame,
    spec: TableSpec,
    keys: Sequence[str] = (),
    threshold: int | None = None,
    unknown: str = "error",
    outliers="dummy",
) -> DataFrame:
    """The full preparation: clean, drop, encode, truncate, standardise, remove outliers."""
    spec.check(df)
    clean = drop_target(drop_ignored(drop_missing(df), spec, keys), spec)
    clean = project_roles(clean, spec, keys)
    coded = encode_ordinal(one_hot(clean, spec, keys), spec, unknown)
    if threshold is not None:
        if not keys:
            raise ValueError("truncation needs key columns: Spark rows have no file order")
        coded = truncate(coded, keys, threshold)
    out = standardise(coded, keys=keys)
    return remove_outliers(out, outliers)


def project_selected(matrix: DataFrame, keys: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """Keep the chosen feature columns."""
    return matrix.select(*[name(c) for c in keys], *[name(c) for c in selected])
