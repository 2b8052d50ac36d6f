"""Meta-features of a table: general, label, numeric, PCA, entropy and mutual-information groups.

Each group is one or two aggregations over the rows; the summaries then run on a table with one
row per column (or column pair). Results are long: ``(metafeature, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.numeric import finite, name, quoted, r6, summarise, total, unpivot
from ..functions.reduce import gram
from ..sources.spec import TableSpec
from .prep import impute_mean, moments

PAIR_EXPRESSIONS = 30  # widest table whose column pairs are aggregated as expressions


def long_row(df: DataFrame, values: dict) -> DataFrame:
    """Aggregate to one row and turn it into (metafeature, value) rows."""
    row = df.agg(*[c.cast("double").alias(k) for k, c in values.items()])
    return _stack(row, list(values))


def _stack(row: DataFrame, names: Sequence[str]) -> DataFrame:
    return unpivot(row, names, "metafeature", "value").select("metafeature", r6(F.col("value")).alias("value"))


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _empty(df: DataFrame, c: str):
    return (name(c) == "") if _is_text(df, c) else F.lit(False)


def _missing(df: DataFrame, c: str):
    miss = name(c).isNull() | F.coalesce(_empty(df, c), F.lit(False))
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        miss = miss | F.isnan(name(c))
    return miss


def _zero(df: DataFrame, c: str):
    return (name(c) == 0) if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(False)


def _count_if(conds):
    return total([F.coalesce(F.count_if(c), F.lit(0)) for c in conds])


def feature_columns(spec: TableSpec) -> list[str]:
    return [*spec.categorical, *spec.numerical, *spec.ordinal]


def general(df: DataFrame, spec: TableSpec) -> DataFrame:
    cols = ([spec.target] if spec.target else []) + feature_columns(spec)
    n = F.count(F.lit(1)).cast("double")
    cells = n * F.lit(float(len(cols)))
    missing = _count_if([_missing(df, c) for c in cols]).cast("double")
    sparse = _count_if([_empty(df, c) | _zero(df, c) for c in cols]).cast("double")
    return long_row(
        df,
        {
            "number_of_instances": n,
            "log_number_of_instances": F.when(n > 0, F.log(n)),
            "number_of_missing_values": missing,
            "missing_values_ratio": F.try_divide(missing, cells),
            "sparsity": F.try_divide(sparse, cells),
        },
    )


def shape(df: DataFrame, spec: TableSpec) -> DataFrame:
    p = F.lit(float(len(feature_columns(spec))))
    n = F.count(F.lit(1)).cast("double")
    ratio = F.try_divide(p, n)
    return long_row(
        df,
        {
            "number_of_features": F.max(p),
            "log_number_of_features": F.max(F.log(p)),
            "dataset_ratio": ratio,
            "log_dataset_ratio": F.when(ratio > 0, F.log(ratio)),
        },
    )


def label_stats(df: DataFrame, target: str) -> DataFrame:
    """Class count and class entropy (bits), over non-empty targets."""
    t = df.select(name(target).cast("string").alias("t")).filter("t is not null and t <> ''")
    counts = t.groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    return _entropy_row(counts)


def _entropy_row(counts: DataFrame) -> DataFrame:
    c = F.col("c").cast("double")
    n = F.sum(c)
    ent = F.log2(n) - F.try_divide(F.sum(c * F.log2(c)), n)
    return long_row(
        counts,
        {"number_of_classes": F.count(F.lit(1)), "entropy_of_classes": ent},
    )


def numeric_sparsity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1)).cast("double") * F.lit(float(len(cols)))
    zeros = _count_if([_zero(df, c) for c in cols]).cast("double")
    return long_row(df, {"sparsity_on_numeric_columns": F.try_divide(zeros, n)})


def column_statistic(df: DataFrame, cols: Sequence[str], fn) -> DataFrame:
    """One aggregate per column in one pass, as (feature, value) rows."""
    row = df.agg(*[fn(name(c).cast("double")).alias(c) for c in cols])
    return unpivot(row, cols, "feature", "value").select("feature", finite(F.col("value")).alias("value"))


def skewness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_row(column_statistic(df, cols, F.skewness), summarise(F.col("value"), "_skewness"))


def kurtosis(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_row(column_statistic(df, cols, F.kurtosis), summarise(F.col("value"), "_kurtosis"))


def covariance_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sample covariance, one pass over centred rows for wide tables (p x p reaches the driver)."""
    full = df.filter(" and ".join(f"{quoted(c)} is not null" for c in cols))
    n, means = full.count(), moments(full, cols)
    if n == 0:
        return np.full((len(cols), len(cols)), np.nan)
    centred = full.selectExpr(*[f"{quoted(c)} - ({float(means[c][0])!r}D) as x{i}" for i, c in enumerate(cols)])
    return gram(centred, centred.columns) / max(n - 1, 1)


def pair_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, cov, corr) for every ordered pair of columns, diagonal included.

    Narrow tables: one aggregation of p(p+1)/2 covariances, each over the rows that have both values. Wide tables: a Gram matrix summed
    from per-partition blocks.
    """
    p = len(cols)
    if p > PAIR_EXPRESSIONS:
        cov = covariance_matrix(df, cols)
        sd = np.sqrt(np.diag(cov))
        rows = [
            (i, j, float(cov[i, j]), float(cov[i, j] / (sd[i] * sd[j])) if sd[i] and sd[j] else None)
            for i in range(p)
            for j in range(p)
        ]
        return df.sparkSession.createDataFrame(rows, "i long, j long, cov double, corr double")
    x = [name(c).cast("double") for c in cols]
    aggs = [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    both = lambda i, j: F.when(x[j].isNotNull(), x[i])
    aggs += [F.covar_samp(both(i, j), x[i]).alias(f"v{i}_{j}") for i in range(p) for j in range(p) if i != j]
    row = df.agg(*aggs)
    structs = []
    for i in range(p):
        for j in range(p):
            cov = F.col(f"c{min(i, j)}_{max(i, j)}")
            vi, vj = (f"v{i}_{j}", f"v{j}_{i}") if i != j else (f"c{i}_{i}", f"c{i}_{i}")
            scale = F.sqrt(vi) * F.sqrt(vj)
            structs.append(
                F.struct(
                    F.lit(i).cast("long").alias("i"),
                    F.lit(j).cast("long").alias("j"),
                    cov.alias("cov"),
                    F.try_divide(cov, scale).alias("corr"),
                )
            )
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min and max include the diagonal; the other summaries leave it out."""
    return correlation_row(pair_table(df, cols))


def correlation_row(pairs: DataFrame) -> DataFrame:
    off = F.when(F.col("i") != F.col("j"), F.col("corr"))
    values = summarise(off, "_correlation")
    values["min_correlation"] = F.min("corr")
    values["max_correlation"] = F.max("corr")
    return long_row(pairs, values)


def covariance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return long_row(pair_table(df, cols), summarise(F.col("cov"), "_covariance"))


def principal_components(df: DataFrame, cols: Sequence[str]):
    """Eigenvalues (descending) and loadings of the sample covariance, sign-fixed."""
    return components_of(covariance_matrix(df, cols))


def components_of(cov: np.ndarray):
    val, vec = np.linalg.eigh(cov)
    val, vec = val[::-1], vec[:, ::-1]
    lead = vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])]
    return np.clip(val, 0, None), vec * np.where(lead < 0, -1.0, 1.0)


def components_needed(eigenvalues: np.ndarray, variance: float = 0.95) -> int:
    """Fewest leading components whose share of variance reaches the target."""
    all_ = eigenvalues.sum()
    if not all_:
        return 0
    return int(min(np.searchsorted(np.cumsum(eigenvalues / all_), variance) + 1, len(eigenvalues)))


def pca(df: DataFrame, cols: Sequence[str], variance: float = 0.95) -> DataFrame:
    full = impute_mean(df.select(*[name(c).cast("double").alias(c) for c in cols]), cols)
    val, vec = principal_components(full, cols)
    first = total([F.lit(float(w)) * name(c) for w, c in zip(vec[:, 0], cols)])
    return long_row(
        full.select(first.alias("pc")),
        {
            "pca_fraction_of_components_for_variance": F.max(
                F.lit(components_needed(val, variance) / len(cols))
            ),
            "pca_kurtosis_first_pc": F.kurtosis("pc"),
            "pca_skewness_first_pc": F.skewness("pc"),
        },
    )


def _value_counts(df: DataFrame, cols: Sequence[str], extra: Sequence = ()) -> DataFrame:
    text = df.select(*extra, *[name(c).cast("string").alias(c) for c in cols])
    kept = [c for c in text.columns if c not in cols]
    long = unpivot(text, cols, "feature", "v", keep=kept).filter("v is not null and v <> ''")
    return long.groupBy("feature", *kept, "v").agg(F.count(F.lit(1)).alias("c"))


def column_entropy(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Entropy in bits per column over non-empty values, from value counts."""
    return entropy_of(_value_counts(df, cols))


def entropy_of(counts: DataFrame) -> DataFrame:
    """Entropy per feature of a table of counts ``c``."""
    c = F.col("c").cast("double")
    n = F.sum(c)
    return counts.groupBy("feature").agg((F.log2(n) - F.sum(c * F.log2(c)) / n).alias("value"))


def entropy(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Column entropies summarised, in units of log2 n."""
    return entropy_row(column_entropy(df, cols), df.count())


def entropy_row(entropies: DataFrame, n: float) -> DataFrame:
    scale = float(np.log2(n)) if n > 1 else None
    values = {
        k: F.try_divide(v, F.lit(scale).cast("double"))
        for k, v in summarise(F.col("value"), "_entropy").items()
    }
    return long_row(entropies, values)


def column_mutual_information(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Mutual information (nats) of each column with the target: H(a) + H(t) - H(a, t).

    Rows with any missing or empty cell are left out. All three entropies come from one table of
    joint counts, so the rows are shuffled once, already combined.
    """
    every = [target, *cols]
    text = df.select(*[name(c).cast("string").alias(c) for c in every])
    for c in every:
        text = text.filter(name(c).isNotNull() & (name(c) != ""))
    return information_of(_value_counts(text, cols, extra=[name(target).alias("_t")]))


def information_of(joint: DataFrame) -> DataFrame:
    """Mutual information per feature of a table of joint counts (feature, v, _t, c)."""
    c = F.col("c").cast("double")
    clogc = lambda d: d.groupBy("feature").agg(F.sum(c * F.log(c)).alias("s"), F.sum(c).alias("n"))
    ab = clogc(joint)
    a = clogc(joint.groupBy("feature", "v").agg(F.sum("c").alias("c")))
    t = clogc(joint.groupBy("feature", "_t").agg(F.sum("c").alias("c")))
    j = (
        ab.join(a.select("feature", F.col("s").alias("sa")), "feature")
        .join(t.select("feature", F.col("s").alias("st")), "feature")
    )
    return j.select(
        "feature",
        ((F.col("s") - F.col("sa") - F.col("st")) / F.col("n") + F.log("n")).alias("value"),
    )


def mutual_information(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return long_row(
        column_mutual_information(df, cols, target), summarise(F.col("value"), "_mutual_information")
    )


# Public names of the manual meta-features, group by group.
_SIX = ("min", "max", "median", "mean", "first_quartile", "third_quartile")
GROUPS = {
    "general": (
        "number_of_instances", "log_number_of_instances", "number_of_missing_values", "missing_values_ratio", "sparsity",
    ),
    "shape": ("number_of_features", "log_number_of_features", "dataset_ratio", "log_dataset_ratio"),
    "labels": ("number_of_classes", "entropy_of_classes"),
    "numeric_sparsity": ("sparsity_on_numeric_columns",),
    **{k: tuple(f"{s}_{k}" for s in _SIX) for k in ("skewness", "kurtosis", "correlation", "covariance")},
    "pca": ("pca_fraction_of_components_for_variance", "pca_kurtosis_first_pc", "pca_skewness_first_pc"),
    **{k: tuple(f"{s}_{k}" for s in _SIX) for k in ("entropy", "mutual_information")},
}
METAFEATURES = tuple(name for names in GROUPS.values() for name in names)


def vector(df: DataFrame, spec: TableSpec, names: Sequence[str] | None = None) -> DataFrame:
    """Requested meta-features (all by default); those whose roles are absent are null.

    All groups read the sums of one scan (:mod:`.profile_once`); the principal component's shape needs a second.
    """
    from .profile_once import groups as all_groups

    wanted = list(names or METAFEATURES)
    unknown = [w for w in wanted if w not in METAFEATURES]
    if unknown:
        raise ValueError(f"unknown meta-features {unknown}")
    groups = all_groups(df, spec)
    parts = [make() for group, (ok, make) in groups.items() if ok and set(GROUPS[group]) & set(wanted)]
    asked = df.sparkSession.createDataFrame(
        [(i, w) for i, w in enumerate(wanted)], "position long, metafeature string"
    )
    if not parts:
        return asked.withColumn("value", F.lit(None).cast("double"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return asked.join(union, "metafeature", "left").select("position", "metafeature", "value")
