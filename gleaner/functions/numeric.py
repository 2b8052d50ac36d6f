"""Numeric column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

# The six summaries every per-column statistic is reduced with.
SUMMARIES = ("min", "max", "median", "mean", "first_quartile", "third_quartile")


def name(col: str) -> Column:
    """Reference a column whose name may hold dots, blanks or brackets."""
    return F.col(quoted(col))


def r6(col: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return total([(x - y) * (x - y) for x, y in zip(a, b)])


def box_near_sq(alo, ahi, blo, bhi) -> Column:
    """Smallest squared distance between two axis-parallel boxes."""
    zero = F.lit(0.0)
    gaps = [F.greatest(zero, bl - ah, al - bh) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)]
    return total([g * g for g in gaps])


def box_far_sq(alo, ahi, blo, bhi) -> Column:
    """Largest squared distance between two axis-parallel boxes."""
    spans = [F.greatest(bh - al, ah - bl) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)]
    return total([s * s for s in spans])


def manhattan_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return total([F.abs(x - y) for x, y in zip(a, b)])


def box_near_l1(alo, ahi, blo, bhi) -> Column:
    """Smallest Manhattan distance between two axis-parallel boxes."""
    return total([F.greatest(F.lit(0.0), bl - ah, al - bh) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)])


def box_far_l1(alo, ahi, blo, bhi) -> Column:
    """Largest Manhattan distance between two axis-parallel boxes."""
    return total([F.greatest(bh - al, ah - bl) for al, ah, bl, bh in zip(alo, ahi, blo, bhi)])


def soft_threshold(x: Column, delta) -> Column:
    """max(x+ - delta, 0)."""
    return F.greatest(F.greatest(x, F.lit(0.0)) - F.lit(delta), F.lit(0.0))


def summarise(value: Column, prefix: str = "") -> dict[str, Column]:
    """The six summaries of a small (per-column) set of values; nulls are skipped."""
    return {
        f"min{prefix}": F.min(value),
        f"max{prefix}": F.max(value),
        f"median{prefix}": F.percentile(value, 0.5),
        f"mean{prefix}": F.avg(value),
        f"first_quartile{prefix}": F.percentile(value, 0.25),
        f"third_quartile{prefix}": F.percentile(value, 0.75),
    }


def finite(value: Column) -> Column:
    """The value, or null when it is NaN or infinite."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def quoted(col: str) -> str:
    """The column name as SQL text. Wide projections are written as SQL: one call per column."""
    return "`" + col.replace("`", "``") + "`"


def unpivot(df, columns: Sequence[str], key: str, value: str, keep=()):
    """Wide to long: one row per (kept columns, column name, value)."""
    return df.unpivot([quoted(k) for k in keep], [quoted(c) for c in columns], key, value)
