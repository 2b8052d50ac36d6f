"""Shape of the physical plans."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    "name",
    ["eps_join", "cl_dbscan", "knn_part", "measure_calinski_harabasz", "measure_silhouette", "sparse_kmeans_objective_line", "mf_skewness", "mfx_location", "rbf_degree"],
)
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(entry.queries()["mf_skewness"](spark, SF))
    schema = [l for l in text.splitlines() if "ReadSchema" in l][0]
    assert "l_quantity" in schema and "l_orderkey" not in schema and "l_shipdate" not in schema


def test_null_filter_reaches_the_scan(spark):
    from gleaner import recipes as R
    from gleaner.operators import prep

    text = plan(prep.drop_missing(R.table(spark, SF, "orders")))
    assert "IsNotNull(o_orderstatus)" in text
