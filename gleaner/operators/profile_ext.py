"""Extended meta-features of an unlabelled table: location, spread, shape, information, items."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.numeric import finite, name, r6, unpivot
from ..sources.spec import TableSpec
from .order import narrowed_quantiles
from .profile import components_needed, covariance_matrix, long_row, pair_table, principal_components


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    d = df.select(*[name(c).cast("double").alias(c) for c in cols])
    return unpivot(d, cols, "feature", "x").filter("x is not null and not isnan(x)")


def general(df: DataFrame, spec: TableSpec) -> DataFrame:
    num, cat = list(spec.numerical), [*spec.categorical, *spec.ordinal]
    cols = num + cat
    p, n_num, n_cat = float(len(cols)), float(len(num)), float(len(cat))
    text = unpivot(df.select(*[name(c).cast("string").alias(c) for c in cols]), cols, "feature", "v")
    # Binary columns have exactly two levels: counted over the distinct (column, value) pairs.
    distinct = text.filter("v is not null").groupBy("feature", "v").agg(F.lit(1).alias("one"))
    binary = distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("k"))
    n_bin = binary.agg(F.count_if(F.col("k") == 2).cast("double")).first()[0]
    n = F.count(F.lit(1)).cast("double")
    lit = lambda v: F.max(F.lit(v).cast("double"))
    return long_row(
        df,
        {
            "nr_inst": n,
            "nr_attr": lit(p),
            "attr_to_inst": F.try_divide(F.lit(p), n),
            "inst_to_attr": n / F.lit(p),
            "nr_num": lit(n_num),
            "nr_cat": lit(n_cat),
            "nr_bin": lit(n_bin),
            "num_to_cat": lit(n_num / n_cat if n_cat else None),
            "cat_to_num": lit(n_cat / n_num if n_num else None),
        },
    )


def location(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: mean, median, geometric, harmonic and 20 %-trimmed mean."""
    long = _long(df, cols)
    q = narrowed_quantiles(long, "feature", "x", (0.2, 0.5, 0.8))
    j = long.join(F.broadcast(q), "feature")  # one row per column
    x, positive = F.col("x"), F.min("x") > 0
    inner = F.when((x >= F.col("q0")) & (x <= F.col("q2")), x)
    return j.groupBy("feature").agg(
        F.round(F.avg(x), 7).alias("mean"),
        r6(F.max("q1")).alias("median"),
        r6(F.when(positive, F.exp(F.avg(F.when(x > 0, F.log(x)))))).alias("g_mean"),
        r6(F.when(positive, F.try_divide(F.count(x).cast("double"), F.sum(F.when(x > 0, 1 / x))))).alias("h_mean"),
        F.round(F.avg(inner), 7).alias("t_mean"),
    )


def spread(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: sample variance and deviation, extremes, range, iqr, scaled mad."""
    long = _long(df, cols)
    q = narrowed_quantiles(long, "feature", "x", (0.25, 0.5, 0.75))
    dev = long.join(F.broadcast(q), "feature").select(
        "feature", F.abs(F.col("x") - F.col("q1")).alias("d")
    )
    mad = narrowed_quantiles(dev, "feature", "d", (0.5,)).withColumnRenamed("q0", "m")
    base = long.groupBy("feature").agg(
        F.var_samp("x").alias("var"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return (
        base.join(q, "feature")
        .join(mad, "feature")
        .select(
            "feature",
            *[r6(F.col(c)).alias(c) for c in ("var", "sd", "min", "max")],
            r6(F.col("max") - F.col("min")).alias("range"),
            r6(F.col("q2") - F.col("q0")).alias("iq_range"),
            r6(F.col("m") * 1.4826).alias("mad"),
        )
    )


def shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: skewness, kurtosis, and (n / distinct - 1) / (n - 1)."""
    long = _long(df, cols)
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("c"))
    distinct = counts.groupBy("feature").agg(
        F.count(F.lit(1)).cast("double").alias("d"), F.sum("c").cast("double").alias("n")
    )
    m = long.groupBy("feature").agg(F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    return m.join(distinct, "feature").select(
        "feature",
        r6(finite(F.col("s"))).alias("skewness"),
        r6(finite(F.col("k"))).alias("kurtosis"),
        r6(F.try_divide(F.col("n") / F.col("d") - 1, F.col("n") - 1)).alias("sparsity"),
    )


def pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """|corr| and |cov| per unordered pair of columns."""
    return (
        pair_table(df, cols)
        .filter("i < j")
        .select("i", "j", r6(F.abs("corr")).alias("cor"), r6(F.abs("cov")).alias("cov"))
    )


def correlated_share(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    t = pair_table(df, cols).filter("i < j")
    strong = F.count_if(F.abs("corr") >= threshold).cast("double")
    return long_row(t, {"nr_cor_attr": F.try_divide(strong, F.count(F.lit(1)).cast("double"))})


def eigenvalues(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalues of the sample covariance, largest first."""
    val = np.linalg.eigvalsh(covariance_matrix(df, cols))[::-1]
    return df.sparkSession.createDataFrame(
        [(i, float(v)) for i, v in enumerate(val)], "position long, value double"
    )


def outlier_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of columns with a value beyond 1.5 iqr of the quartiles."""
    long = _long(df, cols)
    q = narrowed_quantiles(long, "feature", "x", (0.25, 0.75))
    reach = F.lit(1.5) * (F.col("q1") - F.col("q0"))
    far = (F.col("x") < F.col("q0") - reach) | (F.col("x") > F.col("q1") + reach)
    flags = long.join(F.broadcast(q), "feature").groupBy("feature").agg(
        F.max(far.cast("int")).alias("f")
    )
    return long_row(flags, {"nr_outliers": F.sum("f")})


def bin_rule(n: int) -> int:
    """Equal-width bin count: the cube root of the row count, rounded up."""
    k = max(round(n ** (1 / 3)), 1)
    return k if k**3 >= n else k + 1


def binned(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """Equal-width bin number 0..bins-1 per column (constant columns: bin 0)."""
    bins = bins or bin_rule(df.count())
    row = df.agg(
        *[f(name(c)).cast("double").alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("a", F.min), ("b", F.max))]
    ).first()
    out = []
    for i, c in enumerate(cols):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is None or lo == hi:
            out.append(F.when(name(c).isNotNull(), F.lit(0)).cast("long").alias(c))
            continue
        slot = F.floor((name(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins)))
        out.append(F.least(slot, F.lit(bins - 1)).cast("long").alias(c))
    kept = [x for x in df.columns if x not in cols]
    return df.select(*[name(x) for x in kept], *out)


def attribute_entropy(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    long = unpivot(binned(df, cols, bins).select(*[name(c) for c in cols]), cols, "feature", "b")
    counts = long.filter("b is not null").groupBy("feature", "b").agg(F.count(F.lit(1)).alias("c"))
    c = F.col("c").cast("double")
    n = F.sum(c)
    return counts.groupBy("feature").agg(r6(F.log2(n) - F.sum(c * F.log2(c)) / n).alias("attr_ent"))


def attribute_concentration(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """Goodman-Kruskal tau of column b given column a, for ordered pairs of binned columns.

    The pairs are pairs of columns, exploded per row; only contingency counts are shuffled.
    """
    b = binned(df, cols, bins)
    structs = [
        F.struct(
            F.lit(x).alias("a"), F.lit(y).alias("b"), name(x).alias("i"), name(y).alias("j")
        )
        for x in cols
        for y in cols
        if x != y
    ]
    cell = (
        b.select(F.explode(F.array(*structs)).alias("s"))
        .select("s.*")
        .groupBy("a", "b", "i", "j")
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    by_row = W.partitionBy("a", "b", "i")  # at most `bins` cells
    inner = cell.withColumn("ri", F.sum("c").over(by_row))
    left = inner.groupBy("a", "b").agg(
        F.sum(F.col("c") * F.col("c") / F.col("ri")).alias("q"), F.sum("c").alias("n")
    )
    cj = cell.groupBy("a", "b", "j").agg(F.sum("c").alias("cj"))
    right = cj.groupBy("a", "b").agg(F.sum(F.col("cj") * F.col("cj")).alias("r"))
    n = F.col("n")
    base = F.col("r") / (n * n)
    return left.join(right, ["a", "b"]).select(
        "a", "b", r6(F.try_divide(F.col("q") / n - base, 1 - base)).alias("attr_conc")
    )


def complexity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    n = df.count()
    d = components_needed(principal_components(df, cols)[0])
    rows = [("t2", len(cols) / n), ("t3", d / n), ("t4", d / len(cols))]
    return df.sparkSession.createDataFrame([(a, float(b)) for a, b in rows], "metafeature string, value double")


def one_itemset(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """Share of rows holding each item, an item being (column, bin)."""
    b = binned(df, cols, bins).select(*[name(c) for c in cols])
    n = F.lit(float(df.count()))
    long = unpivot(b, cols, "feature", "bin").filter("bin is not null")
    return long.groupBy("feature", "bin").agg(r6(F.count(F.lit(1)) / n).alias("share"))


def two_itemset(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """Share of rows with exactly one of two items of different columns.

    Equals share(a) + share(b) - 2 share(a and b); only items that occur are listed, and item pairs
    never seen together are counted from their single shares.
    """
    n = df.count()
    bins = bins or bin_rule(n)
    b = binned(df, cols, bins)
    structs = [
        F.struct(
            F.lit(x).alias("fa"), name(x).alias("ba"), F.lit(y).alias("fb"), name(y).alias("bb")
        )
        for i, x in enumerate(cols)
        for y in cols[i + 1 :]
    ]
    both = (
        b.select(F.explode(F.array(*structs)).alias("s"))
        .select("s.*")
        .groupBy("fa", "ba", "fb", "bb")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    single = one_counts(b, cols)
    order = {c: i for i, c in enumerate(cols)}
    fb = F.explode(
        F.array(*[F.struct(F.lit(x).alias("fa"), F.lit(y).alias("fb")) for x in cols for y in cols if order[x] < order[y]])
    )
    # Items are columns x bins, a bounded vocabulary; pairs are formed between its halves by key.
    left = single.select(fb.alias("k"), "feature", "bin", "c").select(
        "k.fa", "k.fb", F.col("feature"), F.col("bin"), "c"
    )
    a = left.filter("feature = fa").select("fa", "fb", F.col("bin").alias("ba"), F.col("c").alias("ca"))
    c = left.filter("feature = fb").select("fa", "fb", F.col("bin").alias("bb"), F.col("c").alias("cb"))
    every = a.join(c, ["fa", "fb"])
    joined = every.join(both, ["fa", "ba", "fb", "bb"], "left")
    share = (F.col("ca") + F.col("cb") - 2 * F.coalesce(F.col("c"), F.lit(0))) / F.lit(float(n))
    return joined.select("fa", "ba", "fb", "bb", r6(share).alias("share"))


def one_counts(b: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = unpivot(b.select(*[name(c) for c in cols]), cols, "feature", "bin")
    return long.filter("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c"))


def summary_all(long: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """Every summary of a multi-valued meta-feature: moments, extremes, quantiles, histogram."""
    v = F.col(value)
    ends = long.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    j = long.join(ends, key)
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - F.col("_lo")) / F.nullif(width, F.lit(0.0)) * 10), F.lit(9))
    )
    q = [F.percentile(v, p) for p in (0.25, 0.5, 0.75)]
    n = F.count(v).cast("double")
    aggs = {
        "count": n, "min": F.min(v), "max": F.max(v), "mean": F.avg(v), "median": q[1],
        "sd": F.stddev_samp(v), "var": F.var_samp(v), "range": F.max(v) - F.min(v),
        "iq_range": q[2] - q[0], "skewness": finite(F.skewness(v)), "kurtosis": finite(F.kurtosis(v)),
        "q_0": F.min(v), "q_25": q[0], "q_50": q[1], "q_75": q[2], "q_100": F.max(v),
    }
    for i in range(10):
        aggs[f"hist_{i}"] = F.try_divide(F.count_if(F.col("_slot") == i).cast("double"), n)
    wide = j.withColumn("_slot", slot).groupBy(key).agg(*[r6(c).alias(k) for k, c in aggs.items()])
    return unpivot(wide, list(aggs), "summary", "value", keep=[key])
