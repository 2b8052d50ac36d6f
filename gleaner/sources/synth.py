"""Synthetic tables with known structure, generated row by row on the cluster.

Every generator starts from an id DataFrame (``spark.range(n)`` or any table's keys) and derives all
values from the id and the seed, so a lost partition is rebuilt identically.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numeric import total
from .spec import TableSpec, spec_catalog, write_catalog


def _uniform(seed: int, stream: int, col: str = "row_id") -> Column:
    """Uniform (0, 1) from the key, a stream number and the seed."""
    h = F.pmod(F.xxhash64(F.col(col), F.lit(int(seed)), F.lit(int(stream))), F.lit(2**52))
    return (h.cast("double") + 0.5) / F.lit(float(2**52))


def _normal(seed: int, stream: int) -> Column:
    """Standard normal by Box-Muller."""
    radius = F.sqrt(-2.0 * F.log(_uniform(seed, 2 * stream)))
    return radius * F.cos(2 * math.pi * _uniform(seed, 2 * stream + 1))


def ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(int(n)).withColumnRenamed("id", "row_id")


def blobs(rows: DataFrame, n_features: int = 100, n_clusters: int = 5, random_state: int = 42) -> DataFrame:
    """Unit-variance Gaussians around centres uniform in [-10, 10]: (row_id, f0.., label)."""
    centres = np.random.default_rng(random_state).uniform(-10, 10, (n_clusters, n_features))
    label = F.pmod("row_id", F.lit(n_clusters)).cast("long")
    d = rows.select("row_id", label.alias("label"))
    cols = [
        (F.element_at(F.array(*[F.lit(float(c)) for c in centres[:, j]]), (F.col("label") + 1).cast("int")) + _normal(random_state, j)).alias(f"f{j}")
        for j in range(n_features)
    ]
    return d.select("row_id", *cols, "label")


def classification(
    rows: DataFrame, n_informative: int = 20, n_redundant: int = 20, n_repeated: int = 20,
    n_clusters: int = 5, random_state: int = 42,
) -> DataFrame:
    """Clusters on hypercube vertices, linear mixtures of them, and copies of either.

    Columns f0.. are informative, then redundant, then repeated; ``label`` is the class.
    """
    rng = np.random.default_rng(random_state)
    # Two clusters per class, as far as the cube has vertices.
    vertices = min(2 * n_clusters, 2 ** min(n_informative, 30))
    codes = rng.choice(2 ** min(n_informative, 30), vertices, replace=False)
    corner = np.array([[1.0 if (int(c) >> (j % 30)) & 1 else -1.0 for j in range(n_informative)] for c in codes])
    mix = rng.uniform(-1, 1, (n_informative, n_redundant))
    copies = rng.integers(0, n_informative + n_redundant, n_repeated)
    v = F.pmod("row_id", F.lit(vertices)).cast("long")
    d = rows.select("row_id", v.alias("_v"))
    d = d.select(
        "row_id",
        F.pmod("_v", F.lit(n_clusters)).cast("long").alias("label"),
        *[
            (F.element_at(F.array(*[F.lit(float(c)) for c in corner[:, j]]), (F.col("_v") + 1).cast("int")) + _normal(random_state, j)).alias(f"f{j}")
            for j in range(n_informative)
        ],
    )
    extra = [
        total([F.lit(float(mix[i, j])) * F.col(f"f{i}") for i in range(n_informative)]).alias(f"f{n_informative + j}")
        for j in range(n_redundant)
    ]
    d = d.select("*", *extra)
    base = n_informative + n_redundant
    d = d.select("*", *[F.col(f"f{int(c)}").alias(f"f{base + j}") for j, c in enumerate(copies)])
    return d.select("row_id", *[f"f{j}" for j in range(base + n_repeated)], "label")


def _ring(rows: DataFrame, n, seed: int, noise: float, outer, inner, closed: bool) -> DataFrame:
    """Two curves: the first ids walk the outer one, the others the inner one."""
    n_out, n_in = n
    is_out = F.col("row_id") < n_out
    pos = F.when(is_out, F.col("row_id")).otherwise(F.col("row_id") - n_out).cast("double")
    size = F.when(is_out, F.lit(n_out)).otherwise(F.lit(n_in))
    turn = (2 * math.pi if closed else math.pi)
    steps = size if closed else F.greatest(size - 1, F.lit(1))
    t = F.lit(turn) * pos / steps
    d = rows.select("row_id", is_out.alias("_o"), t.alias("_t"))
    xo, yo = outer(F.col("_t"))
    xi, yi = inner(F.col("_t"))
    jig = lambda j: F.lit(float(noise)) * _normal(seed, j) if noise else F.lit(0.0)
    return d.select(
        "row_id",
        (F.when(F.col("_o"), xo).otherwise(xi) + jig(0)).alias("f0"),
        (F.when(F.col("_o"), yo).otherwise(yi) + jig(1)).alias("f1"),
        F.when(F.col("_o"), 0).otherwise(1).cast("long").alias("label"),
    )


def _pair(rows: DataFrame, n) -> tuple[int, int]:
    if n is None:
        n = rows.count()
    return tuple(int(v) for v in n) if isinstance(n, (tuple, list)) else (int(n) // 2, int(n) - int(n) // 2)


def moons(rows: DataFrame, n_samples=None, noise: float = 0.05, random_state: int = 42) -> DataFrame:
    """Two interleaved half circles; row_id must run from 0."""
    return _ring(
        rows, _pair(rows, n_samples), random_state, noise,
        lambda t: (F.cos(t), F.sin(t)),
        lambda t: (1 - F.cos(t), 0.5 - F.sin(t)),
        closed=False,
    )


def circles(rows: DataFrame, n_samples=None, noise: float = 0.05, factor: float = 0.8, random_state: int = 42) -> DataFrame:
    """A circle of radius 1 and one of radius ``factor``; row_id must run from 0."""
    return _ring(
        rows, _pair(rows, n_samples), random_state, noise,
        lambda t: (F.cos(t), F.sin(t)),
        lambda t: (factor * F.cos(t), factor * F.sin(t)),
        closed=True,
    )


GENERATORS = {"blobs": blobs, "clf": classification, "circles": circles, "moons": moons}

# The sweep behind the synthetic corpus (family, count, parameter ranges; the upper
# bounds are exclusive).
SWEEP = {
    "blobs": (200, {"n_samples": (100, 2000), "n_features": (20, 250), "n_clusters": (2, 20)}),
    "circles": (50, {"n_outer": (200, 2000), "n_inner": (200, 2000), "noise": None}),
    "clf": (400, {
        "n_samples": (250, 2000), "n_informative": (20, 100), "n_redundant": (20, 100),
        "n_clusters": (2, 50), "n_repeated": (10, 50),
    }),
    "moons": (200, {"n_outer": (100, 2000), "n_inner": (100, 2000), "noise": None}),
}


def sweep_table(spark: SparkSession, seed: int = 42, counts: dict[str, int] | None = None) -> DataFrame:
    """One row per dataset of the corpus: (dataset, family, params)."""
    rng = np.random.default_rng(seed)
    rows = []
    for family, (count, ranges) in SWEEP.items():
        for i in range((counts or {}).get(family, count)):
            params = {
                k: str(float(rng.random())) if r is None else str(int(rng.integers(*r))) for k, r in ranges.items()
            }
            rows.append((f"{family}_{i:03d}", family, params))
    return spark.createDataFrame(rows, "dataset string, family string, params map<string,string>")


def generate(spark: SparkSession, family: str, params: dict[str, str], seed: int = 42) -> DataFrame:
    """Build one dataset of the sweep."""
    p = {k: float(v) if k == "noise" else int(v) for k, v in params.items()}
    if family in ("circles", "moons"):
        n = (p.pop("n_outer"), p.pop("n_inner"))
        return GENERATORS[family](ids(spark, sum(n)), n_samples=n, random_state=seed, **p)
    return GENERATORS[family](ids(spark, p.pop("n_samples")), random_state=seed, **p)


def write_corpus(spark: SparkSession, folder: str, sweep: DataFrame, seed: int = 42) -> DataFrame:
    """Write every dataset of a sweep as parquet, and one descriptor line each; returns the catalog."""
    specs = []
    for r in sweep.collect():  # a parameter table, one row per dataset
        d = generate(spark, r["family"], r["params"], seed)
        cols = [c for c in d.columns if c.startswith("f")]
        path = f"{r['dataset']}.parquet"
        d.select(*cols).write.mode("overwrite").parquet(f"{folder}/{path}")
        specs.append({"dataset": r["dataset"], **json.loads(TableSpec(numerical=tuple(cols), path=path).to_json())})
    write_catalog(spark, specs, f"{folder}/descriptors")
    return spec_catalog(spark, f"{folder}/descriptors", lines=True)
