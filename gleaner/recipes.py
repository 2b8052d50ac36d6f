"""Role descriptors and matrices for the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import prep
from .operators.order import chunks_for, with_row_id
from .session import cut
from .sources.spec import TableSpec

LINEITEM = TableSpec(
    numerical=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    categorical=("l_returnflag",),
    ignore=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"),
    target="l_linestatus",
    path="lineitem.parquet",
)
ORDERS = TableSpec(
    numerical=("o_totalprice",),
    categorical=("o_orderstatus",),
    ordinal={"o_orderpriority": ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")},
    ignore=("o_custkey", "o_orderdate"),
    path="orders.parquet",
)
PART = TableSpec(
    numerical=("p_size", "p_retailprice"), categorical=("p_type", "p_brand"), ignore=("p_name",), path="part.parquet"
)
CUSTOMER = TableSpec(
    numerical=("c_acctbal",), categorical=("c_mktsegment",), ignore=("c_name", "c_nationkey"), path="customer.parquet"
)
EVENTS = TableSpec(
    numerical=("value",), categorical=("event_type",), ignore=("ts", "user_id", "props"), path="events.parquet"
)

DIMS = 64
WIDE = [f"e{i}" for i in range(DIMS)]
PART_COLS = ["p_size", "p_retailprice"]
LINE_COLS = list(LINEITEM.numerical)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def line(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem without its date, which no operator reads."""
    return table(spark, sf, "lineitem")


def wide_raw(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as columns e0..e63."""
    e = table(spark, sf, "embeddings")
    return e.selectExpr(
        "vec_id", "cast(label as bigint) as label", *[f"cast(embedding[{i}] as double) as {c}" for i, c in enumerate(WIDE)]
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return prep.standardise(wide_raw(spark, sf), WIDE, ["vec_id", "label"])


def part_scaled(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"
    )
    return prep.standardise(p, PART_COLS, ["p_partkey"])


def line_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric lineitem columns with two label columns."""
    d = line(spark, sf).select(
        *LINE_COLS, "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus",
        "l_orderkey", "l_partkey", "l_shipdate",
    )
    return prep.standardise(d, LINE_COLS)


def line_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem rows under dense row numbers: (l_orderkey, l_linenumber) is not unique."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    d = with_row_id(line_scaled(spark, sf), key, parts=chunks_for(line(spark, sf)))
    return cut(d.select("row_id", *LINE_COLS, F.col("l_linenumber").cast("long").alias("label")))


def event_history(spark: SparkSession, sf: str) -> DataFrame:
    """events read as a search log: type = dataset, user = algorithm pair, value = score."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("dataset"),
        F.col("event_id").alias("candidate_id"),
        F.concat(F.lit("C"), (F.col("user_id") % 9).cast("string")).alias("clusterer"),
        F.concat(F.lit("S"), (F.floor(F.col("user_id") / 9).cast("long") % 7).cast("string")).alias("selector"),
        F.col("value").alias("score"),
    )
