"""Parquet stores for matrices, meta-features and search results, and the resume rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_matrix(matrix: DataFrame, base: str, dataset: str) -> None:
    """One folder per dataset, so a reader of one dataset touches only its files."""
    matrix.write.mode("overwrite").parquet(f"{base}/matrix/dataset={dataset}")


def read_matrix(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    return spark.read.parquet(f"{base}/matrix/dataset={dataset}")


def list_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Datasets of the matrix store, from partition folders only (no row is read)."""
    df = spark.read.option("basePath", f"{base}/matrix").option("mergeSchema", "false").parquet(f"{base}/matrix")
    return df.select("dataset").distinct()


def write_metafeatures(values: DataFrame, base: str, dataset: str) -> None:
    values.withColumn("dataset", F.lit(dataset)).select("dataset", "metafeature", "value").write.mode(
        "append"
    ).parquet(f"{base}/metafeatures")


def read_metafeatures(spark: SparkSession, base: str, dataset: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{base}/metafeatures")
    return df.filter(F.col("dataset") == dataset) if dataset else df


def write_history(history: DataFrame, base: str, dataset: str, measure: str) -> None:
    """One folder per dataset and measure: a search that is run again replaces what it wrote before."""
    history.write.mode("overwrite").parquet(f"{base}/history/dataset={dataset}/measure={measure}")


def read_history(spark: SparkSession, base: str, dataset: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{base}/history")
    return df.filter(F.col("dataset") == dataset) if dataset else df


def read_ranking(spark: SparkSession, base: str, dataset: str | None = None) -> DataFrame:
    """Stored rankings; with ``dataset`` only its folder is read."""
    df = spark.read.parquet(f"{base}/ranking")
    return df.filter(F.col("dataset") == dataset) if dataset else df


def write_labels(labels: DataFrame, base: str, dataset: str, measure: str, candidate_id: int) -> None:
    labels.write.mode("overwrite").parquet(
        f"{base}/labels/dataset={dataset}/measure={measure}/candidate_id={candidate_id}"
    )


def write_ranking(ranking: DataFrame, base: str, dataset: str, measure: str) -> None:
    ranking.write.mode("overwrite").parquet(f"{base}/ranking/dataset={dataset}/measure={measure}")


def pending(catalog: DataFrame, finished: DataFrame, on: str = "dataset") -> DataFrame:
    """Catalog rows without a finished result."""
    return catalog.join(finished.select(on).distinct(), on, "left_anti")


def ranked_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Datasets with a stored ranking, from folder names; none if nothing is stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/ranking")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    found = [(n.removeprefix("dataset="),) for n in names if n.startswith("dataset=")]
    return spark.createDataFrame(found, "dataset string")
