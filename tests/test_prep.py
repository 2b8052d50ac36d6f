import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import prep, profile, profile_ext as ext
from gleaner.operators.order import exact_quantiles, running, with_row_id
from gleaner.sources import spec as S, store, synth
from gleaner.sources.spec import TableSpec


def test_constant_column_scales_to_zero(spark):
    d = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 4.0), (4, 5.0, 9.0)], "id long, c double, x double")
    rows = prep.standardise(d, ["c", "x"]).orderBy("id").collect()
    x = np.array([1.0, 2, 4, 9])
    assert [r["c"] for r in rows] == [0.0] * 4
    assert np.allclose([r["x"] for r in rows], (x - x.mean()) / x.std())


def test_wide_and_narrow_moments_agree(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(3, 2, (50, 40))
    d = spark.createDataFrame([tuple(map(float, r)) for r in a], [f"c{i}" for i in range(40)])
    m = prep.moments(d, d.columns)
    assert np.allclose([m[f"c{i}"] for i in range(40)], np.column_stack([a.mean(0), a.std(0)]))


def test_onehot_columns_survive_ordinals(spark):
    d = spark.createDataFrame([("a", "lo", 1.0), ("b", "hi", 2.0), ("c", "lo", 3.0)], "c string, o string, x double")
    spec = TableSpec(numerical=("x",), categorical=("c",), ordinal={"o": ("lo", "hi")})
    out = prep.prepare(d, spec)
    assert out.columns == ["x", "o", "c_1", "c_2"]


def test_ordinal_levels_are_text(spark):
    d = spark.createDataFrame([(1,), (3,), (2,)], "o int")
    spec = TableSpec(ordinal={"o": ("1", "2", "3")})
    assert sorted(r[0] for r in prep.encode_ordinal(d, spec).collect()) == [0, 1, 2]
    bad = spark.createDataFrame([(7,)], "o int")
    with pytest.raises(Exception, match="unknown level"):
        prep.encode_ordinal(bad, spec).collect()
    assert prep.encode_ordinal(bad, spec, unknown="null").first()[0] is None


def test_nulls_in_ignored_columns_drop_rows(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, "x"), (float("nan"), "y")], "x double, junk string")
    out = prep.drop_ignored(prep.drop_missing(d), TableSpec(numerical=("x",), ignore=("junk",)))
    assert [r[0] for r in out.collect()] == [2.0]


def test_undeclared_columns_do_not_survive(spark):
    d = spark.createDataFrame([(1.0, 9.0), (2.0, 8.0)], "x double, other double")
    assert prep.prepare(d, TableSpec(numerical=("x",))).columns == ["x"]


def test_numeric_categories_sort_as_numbers(spark):
    d = spark.createDataFrame([(10,), (9,), (2,)], "c int")
    out = prep.one_hot(d, TableSpec(categorical=("c",)))
    assert out.columns == ["c_1", "c_2"]
    assert {(r["c_1"], r["c_2"]) for r in out.collect()} == {(0, 0), (1, 0), (0, 1)}


def test_too_many_levels_refused(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="levels"):
        prep.levels(d, ["c"], max_levels=10)


def test_row_ids_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.full(100, 7.0), rng.normal(0, 5, 200)])
    d = spark.createDataFrame([(i, "g" if i % 3 else "h", float(x)) for i, x in enumerate(v)], "id long, g string, v double").repartition(5)
    ids = with_row_id(d, ["v", "id"]).orderBy("v", "id").collect()
    assert [r["row_id"] for r in ids] == list(range(300))
    run = running(d, ["g"], ["id"], "v", "before").collect()
    for r in run:
        want = sum(x for i, x in enumerate(v) if i < r["id"] and ("g" if i % 3 else "h") == r["g"])
        assert math.isclose(r["before"], want, abs_tol=1e-9)
    q = exact_quantiles(d.select(F.lit("k").alias("k"), "v"), "k", "v", (0.1, 0.25, 0.5, 0.9)).first()
    assert np.allclose([q[f"q{i}"] for i in range(4)], np.percentile(v, [10, 25, 50, 90]))


def test_descriptor_round_trip(spark, tmp_path):
    s = TableSpec(numerical=("a b",), categorical=("c",), ordinal={"o": ("x", "y")}, ignore=("i",), target=" t", path="f.csv")
    s.write_json(spark, str(tmp_path / "d"))
    assert TableSpec.from_json(spark, str(tmp_path / "d")) == s
    with pytest.raises(ValueError, match="required"):
        TableSpec.from_row({"numerical": ["x"]})


def test_catalog_and_csv_load(spark, tmp_path):
    (tmp_path / "cfg").mkdir()
    (tmp_path / "t.csv").write_text("x,c\n1.5,a\nNA,b\n2.5,\n")
    s = TableSpec(numerical=("x",), categorical=("c",), path="t.csv")
    (tmp_path / "cfg" / "one.json").write_text(s.to_json())
    (tmp_path / "cfg" / "notes.txt").write_text("not a descriptor")
    cat = S.spec_catalog(spark, str(tmp_path / "cfg"))
    row = cat.first()
    assert cat.count() == 1 and row["dataset"] == "one"
    got = S.load_table(spark, TableSpec.from_row(row), str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1.5, "a"), (None, "b"), (2.5, None)]
    (tmp_path / "n.csv").write_text("x,c,t\n1,9,9\n2,10,a\n3,-1,10\n")
    typed = S.load_table(spark, TableSpec(numerical=("x",), categorical=("c", "t"), path="n.csv"), str(tmp_path))
    assert dict(typed.dtypes) == {"x": "double", "c": "bigint", "t": "string"}
    assert prep.levels(typed, ["c"])["c"] == ["-1", "9", "10"]
    spark.createDataFrame([("NA",), ("None",), (None,)], "c string").write.parquet(str(tmp_path / "p.parquet"))
    kept = S.load_table(spark, TableSpec(categorical=("c",), numerical=(), path="p.parquet"), str(tmp_path))
    assert {r["c"] for r in kept.collect()} == {"NA", "None", None}
    counts = S.catalog_counts(cat).first()
    assert (counts["n_numerical"], counts["n_categorical"]) == (1, 1)
    with pytest.raises(ValueError, match="absent"):
        TableSpec(numerical=("nope",)).check(got)


def test_stores_and_resume(spark, tmp_path):
    base = str(tmp_path)
    m = spark.createDataFrame([(1, 2.0)], "row_id long, x double")
    store.write_matrix(m, base, "a")
    store.write_matrix(m, base, "b")
    assert sorted(r[0] for r in store.list_datasets(spark, base).collect()) == ["a", "b"]
    assert store.read_matrix(spark, base, "a").collect() == m.collect()
    store.write_metafeatures(spark.createDataFrame([("m", 1.0)], "metafeature string, value double"), base, "a")
    assert store.read_metafeatures(spark, base, "a").count() == 1
    cat = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    done = spark.createDataFrame([("b",), ("b",)], "dataset string")
    assert sorted(r[0] for r in store.pending(cat, done).collect()) == ["a", "c"]


def test_generators(spark):
    b = synth.blobs(synth.ids(spark, 500), n_features=3, n_clusters=4)
    spread = b.groupBy("label").agg(*[F.stddev(f"f{j}").alias(f"f{j}") for j in range(3)]).collect()
    assert len(spread) == 4 and all(0.7 < r[f"f{j}"] < 1.3 for r in spread for j in range(3))
    assert sorted(b.collect()) == sorted(synth.blobs(synth.ids(spark, 500).repartition(7), 3, 4).collect())
    c = synth.classification(synth.ids(spark, 400), 4, 3, 2, 3)
    assert len(c.columns) == 2 + 9
    pdf = c.toPandas()
    x = pdf[[f"f{i}" for i in range(9)]].to_numpy()
    assert np.linalg.matrix_rank(x, tol=1e-8) == 4
    assert all(any(np.allclose(x[:, j], x[:, i]) for i in range(7)) for j in (7, 8))
    ring = synth.circles(synth.ids(spark, 30), (10, 20), noise=0.0).toPandas()
    r = np.hypot(ring["f0"], ring["f1"])
    assert np.allclose(np.sort(r.round(9).unique()), [0.8, 1.0]) and (ring["label"] == 0).sum() == 10


def test_corpus(spark, tmp_path):
    sweep = synth.sweep_table(spark, counts={"blobs": 1, "circles": 1, "clf": 0, "moons": 1})
    assert sweep.count() == 3 and synth.sweep_table(spark).count() == 850
    catalog = synth.write_corpus(spark, str(tmp_path), sweep)
    rows = catalog.collect()
    assert len(rows) == 3
    by = {r["dataset"]: r for r in sweep.collect()}
    for r in rows:
        d = S.load_table(spark, TableSpec.from_row(r), str(tmp_path))
        p = by[r["dataset"]]["params"]
        n = int(p["n_samples"]) if "n_samples" in p else int(p["n_outer"]) + int(p["n_inner"])
        assert d.count() == n and len(d.columns) == len(r["numerical"])


def test_metafeature_vector_nulls_absent_roles(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (4.0, 3.0)], "a double, b double")
    v = {r["metafeature"]: r["value"] for r in profile.vector(d, TableSpec(numerical=("a", "b"))).collect()}
    assert len(v) == 51 and v["min_entropy"] is None and v["number_of_classes"] is None
    assert v["max_correlation"] == 1.0 and v["number_of_features"] == 2.0
    few = profile.vector(d, TableSpec(numerical=("a", "b")), ["max_covariance"]).collect()
    assert len(few) == 1 and few[0]["value"] == round(np.cov([[1, 2, 4], [2, 4.5, 3]]).max(), 6)


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    cols = list("abcd")
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], cols)
    got = {r["metafeature"]: r["value"] for r in profile.pca(d, cols).collect()}
    val, vec = np.linalg.eigh(np.cov(x.T))
    val, vec = val[::-1], vec[:, ::-1]
    need = int(np.searchsorted(np.cumsum(val) / val.sum(), 0.95) + 1)
    w = vec[:, 0] * np.sign(vec[np.abs(vec[:, 0]).argmax(), 0])
    t = (x - x.mean(0)) @ w
    assert got["pca_fraction_of_components_for_variance"] == need / 4
    assert math.isclose(got["pca_skewness_first_pc"], ((t**3).mean() / t.std() ** 3), abs_tol=1e-5)
    assert np.allclose([r["value"] for r in ext.eigenvalues(d, cols).orderBy("position").collect()], val)


def test_pair_table_paths_agree(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(60, 33))], [f"c{i}" for i in range(33)])
    wide = {(r["i"], r["j"]): (r["cov"], r["corr"]) for r in profile.pair_table(d, d.columns).collect()}
    narrow = {(r["i"], r["j"]): (r["cov"], r["corr"]) for r in profile.pair_table(d, d.columns[:5]).collect()}
    assert all(np.allclose(wide[k], v) for k, v in narrow.items())


def test_constant_column_statistics(spark):
    d = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    assert {r["feature"]: r["value"] for r in profile.column_statistic(d, ["x", "c"], F.skewness).collect()}["c"] is None
    corr = {(r["i"], r["j"]): r["corr"] for r in profile.pair_table(d, ["x", "c"]).collect()}
    assert corr[(0, 0)] == pytest.approx(1.0) and corr[(0, 1)] is None and corr[(1, 1)] is None


def test_outlier_methods_are_identity(spark):
    from gleaner.operators.outliers import METHODS, remove_outliers

    d = spark.range(5)
    assert all(remove_outliers(d, m) is d for m in METHODS)
    assert remove_outliers(d, lambda x: x.filter("id < 2")).count() == 2
    with pytest.raises(ValueError):
        remove_outliers(d, "other")
