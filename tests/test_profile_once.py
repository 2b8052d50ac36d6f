"""The vector of all meta-features from one scan, against the groups one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import profile, profile_once
from gleaner.sources.spec import TableSpec


def table(spark, rows=700, holes=True):
    rng = random.Random(2)
    data = []
    for i in range(rows):
        a = rng.gauss(1e6, 3)
        hole = holes and i % 11 == 0
        data.append((
            None if hole else a, a * 2 + rng.gauss(0, 1), float(i % 3), 7.0, rng.choice(["x", "y", "", None]),
            rng.choice([0, 1, 2, None]), rng.choice(["p", "q", "q", "" if holes else "p"]), i,
        ))
    names = "a double, b double, c double, same double, kind string, n int, target string, other int"
    return spark.createDataFrame(data, names)


SPEC = TableSpec(numerical=("a", "b", "c", "same"), categorical=("kind",), ordinal={"n": ("0", "1", "2")}, ignore=("other",), target="target")


def singles(df, spec):
    num, cat = list(spec.numerical), [*spec.categorical, *spec.ordinal]
    parts = [
        profile.general(df, spec), profile.shape(df, spec), profile.label_stats(df, spec.target), profile.numeric_sparsity(df, num),
        profile.skewness(df, num), profile.kurtosis(df, num), profile.correlation(df, num), profile.covariance(df, num),
        profile.pca(df, num), profile.entropy(df, cat), profile.mutual_information(df, cat, spec.target),
    ]
    return {r["metafeature"]: r["value"] for p in parts for r in p.collect()}


def same(a, b):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("holes", [True, False])
def test_equal_to_the_groups_one_by_one(spark, holes):
    df = table(spark, holes=holes)
    want = singles(df, SPEC)
    got = {r["metafeature"]: r["value"] for r in profile.vector(df.repartition(5), SPEC).collect()}
    assert len(got) == 51 and set(got) == set(want)
    assert [k for k in got if not same(got[k], want[k])] == []


def test_wide_tables_and_empty_ones(spark, monkeypatch):
    monkeypatch.setattr(profile, "PAIR_EXPRESSIONS", 2)
    df = table(spark)
    want = singles(df, SPEC)
    got = {r["metafeature"]: r["value"] for r in profile.vector(df, SPEC).collect()}
    assert [k for k in got if not same(got[k], want[k])] == []
    empty = {r["metafeature"]: r["value"] for r in profile.vector(df.limit(0), SPEC, ["number_of_instances", "mean_skewness", "sparsity"]).collect()}
    assert empty == {"number_of_instances": 0.0, "mean_skewness": None, "sparsity": None}


def test_one_scan_one_exchange(spark, monkeypatch):
    """The buffers' plan reads the table once, exchanges once, and what it exchanges does not grow with the rows."""
    plans = []
    monkeypatch.setattr(profile_once, "cut", lambda d: plans.append(d) or d)
    path = "/root/testdata/sf0.01/part.parquet"
    spec = TableSpec(numerical=("p_size", "p_retailprice"), categorical=("p_brand",), target="p_type", ignore=("p_name",))
    df = spark.read.parquet(path)
    profile_once.fold(df, spec)
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1 and "p_name" not in text
    once = plans[0].count()
    profile_once.fold(df.unionByName(df).unionByName(df), spec)
    assert plans[1].count() == once


def test_flushes_give_the_same_counts(spark, monkeypatch):
    df = table(spark)
    whole = {tuple(r)[:4]: round(r["val"], 3) for r in profile_once.fold(df, SPEC).filter("feature >= -1").collect()}
    monkeypatch.setattr(profile_once, "FLUSH", 2)
    assert {tuple(r)[:4]: round(r["val"], 3) for r in profile_once.fold(df, SPEC).filter("feature >= -1").collect()} == whole
    assert df.filter(F.col("kind") == "x").count() == sum(v for k, v in whole.items() if k[0] == 0 and k[1] == "x")
