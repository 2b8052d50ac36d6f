"""Prepare many tables and describe each; a failing table becomes a row with its error."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..operators import prep, profile
from ..session import cut
from ..sources import store
from ..sources.spec import TableSpec


def prepare_many(
    spark: SparkSession,
    tables: dict[str, tuple[Callable[[], DataFrame], TableSpec, list[str]]],
    base: str | None = None,
    metafeatures: bool = False,
    workers: int = 4,
) -> DataFrame:
    """(dataset, n_rows, n_columns, error) after preparing every table.

    ``tables`` maps a name to (loader, descriptor, key columns). Each table is its own set of Spark
    jobs, submitted concurrently. With ``base`` the matrices (and meta-features) are stored.
    """

    def one(item):
        dataset, (load, spec, keys) = item
        try:
            matrix = prep.prepare(load(), spec, keys)
            if base:
                store.write_matrix(matrix, base, dataset)
                matrix = store.read_matrix(spark, base, dataset)
            else:
                matrix = cut(matrix)
            cols = [c for c in matrix.columns if c not in keys]
            if metafeatures:
                values = profile.vector(matrix.select(*cols), TableSpec(numerical=tuple(cols)))
                if base:
                    store.write_metafeatures(values, base, dataset)
            return dataset, matrix.count(), len(cols), None
        except Exception as exc:  # one table must not stop the batch
            return dataset, None, None, f"{type(exc).__name__}: {exc}"[:500]

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), tables.items()))
    return spark.createDataFrame(rows, "dataset string, n_rows long, n_columns long, error string")
