"""Session helpers: lineage cutting and a local session for tests and benchmarks."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; where none is named, one inside the warehouse, which is shared too."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


_own: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    """This application's own folder; the file system deletes it when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = f"{_shared_folder(spark).rstrip('/')}/gleaner/{app}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop)
        fs.deleteOnExit(hadoop)
        _own[app] = path
    return _own[app]


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, gone when the application ends."""
    return f"{_scratch(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Survives the loss of executors, and unlike a row checkpoint it starts a fresh plan with real
    sizes and column pruning (a checkpointed plan keeps its constraints, which multiply over the
    rounds of a loop until planning dominates).
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what :func:`cut` wrote for these tables, which nothing may read any more, and the exchanges nobody holds."""
    for t in tables:
        path = vars(t).pop("_written", None)
        if path:
            spark = t.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    if tables:  # shuffle files go when the driver has collected the plans they belong to
        tables[0].sparkSession._jvm.System.gc()


def keep(df: DataFrame) -> DataFrame:
    """Cache rows that several jobs of one operator read; spills to disk."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def parallelism(spark: SparkSession) -> int:
    """Upper bound on tasks worth creating for one stage."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "gleaner") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
