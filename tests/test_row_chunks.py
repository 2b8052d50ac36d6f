"""Row numbers: one exchange, and chunks that do not grow with the table."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gleaner.operators import order


def test_chunks_follow_the_rows(spark):
    assert order.chunks_for(spark.range(100), rows=7) == 15
    assert order.chunks_for(spark.range(10), rows=7) == 8  # as many as the session's tasks


def test_numbers_come_from_the_first_exchange(spark, monkeypatch):
    """The stored chunks hold the place of every row, so they are not dealt out again."""
    stored = []
    real = order.cut
    monkeypatch.setattr(order, "cut", lambda df: stored.append(real(df)) or stored[-1])
    v = np.random.default_rng(0).integers(0, 40, 500)
    d = spark.createDataFrame(pd.DataFrame({"v": v, "id": np.arange(500)})).repartition(5)
    out = order.with_row_id(d, ["v", "id"], parts=11)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # only the small table of chunks is dealt out
    sizes = stored[0].groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), F.max("_in").alias("m")).collect()
    assert 8 <= len(sizes) <= 11 and all(r["n"] == r["m"] + 1 and r["n"] < 150 for r in sizes)
    rows = [(r["v"], r["id"], r["row_id"]) for r in out.orderBy("row_id").collect()]
    assert [r[2] for r in rows] == list(range(500)) and [r[:2] for r in rows] == sorted(r[:2] for r in rows)
