import math

import pytest
from pyspark.sql import functions as F

from gleaner.plans import batch, search
from gleaner.sources import synth
from gleaner.sources.spec import TableSpec


def test_candidates_stay_in_range(spark):
    rows = search.candidates(spark, 200, list(search.CLUSTERERS), list(search.SELECTORS)).collect()
    assert [r["candidate_id"] for r in rows] == list(range(200))
    for r in rows:
        want = {f"{k}___{a}" for a, space in ((r["clusterer"], search.CLUSTERERS), (r["selector"], search.SELECTORS)) for k in space[a]}
        assert set(r["params"]) == want
        for alg, space in ((r["clusterer"], search.CLUSTERERS), (r["selector"], search.SELECTORS)):
            for k, kind in space[alg].items():
                v = r["params"][f"{k}___{alg}"]
                assert v in kind[1] if kind[0] == "cat" else kind[1] <= float(v) <= kind[2]
    again = search.candidates(spark, 200, list(search.CLUSTERERS), list(search.SELECTORS)).collect()
    assert rows == again
    with pytest.raises(ValueError):
        search.candidates(spark, 3, [], ["NullModel"])


def test_search_history_and_ranking(spark):
    d = synth.blobs(synth.ids(spark, 200), 3, 3).drop("label").cache()
    cols = ["f0", "f1", "f2"]
    plan = spark.createDataFrame(
        [
            (0, "NullModel", "KMeans", {"n_clusters___KMeans": "3"}),
            (1, "NullModel", "KMeans", {"n_clusters___KMeans": "1"}),
            (2, "NullModel", "SpectralClustering", {"affinity___SpectralClustering": "nope"}),
            (3, "NormalizedCut", "GaussianMixture", {"n_components___GaussianMixture": "2", "k___NormalizedCut": "2"}),
        ],
        "candidate_id long, selector string, clusterer string, params map<string,string>",
    )
    stored = []
    hist = search.random_search(d, "row_id", cols, plan, "davies_bouldin", cutoff=None, on_result=lambda r, l: stored.append(r["candidate_id"]))
    by = {r["candidate_id"]: r for r in hist.collect()}
    assert by[1]["score"] == math.inf and by[2]["error"] and by[0]["score"] < 1
    assert sorted(stored) == [0, 1, 3]
    top = search.leaderboard(hist, 2).collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0]["score"] <= top[1]["score"]
    pairs = search.pair_results(hist, ["KMeans", "Birch"], ["NullModel"]).collect()
    assert {r["pair"]: r["evaluations"] for r in pairs} == {"KMeans_NullModel": 2, "Birch_NullModel": 0}
    path = search.trajectory(hist.withColumn("s", F.lit("x")), ["s"], "candidate_id").orderBy("candidate_id").collect()
    assert [r["score"] for r in path] == sorted((r["score"] for r in path), reverse=True)
    own = search.run_candidate(d, "row_id", cols, "NullModel", "KMeans", {}, measure=lambda m, i, c, l: m.count())
    assert own[1] == 200.0


def test_cutoff_cancels(spark):
    d = synth.blobs(synth.ids(spark, 200), 3, 3).drop("label")
    plan = search.candidates(spark, 1, ["KMeans"], ["NullModel"])
    hist = search.random_search(d, "row_id", ["f0", "f1", "f2"], plan, "silhouette", cutoff=0.01).collect()
    assert hist[0]["score"] is None and hist[0]["error"]


def test_sweep_skips_finished(spark):
    d = synth.blobs(synth.ids(spark, 100), 2, 2).drop("label").cache()
    sets = {"a": (d, "row_id", ["f0", "f1"]), "b": (d, "row_id", ["f0", "f1"])}
    done = spark.createDataFrame([("a",)], "dataset string")
    out = search.sweep(spark, sets, 1, ["davies_bouldin"], ["KMeans"], ["NullModel"], None, finished=done).collect()
    assert {r["dataset"] for r in out} == {"b"} and out[0]["pair"] == "KMeans_NullModel"


def test_sweep_stores_and_resumes(spark, tmp_path):
    d = synth.blobs(synth.ids(spark, 100), 2, 2).drop("label").cache()
    sets, base = {"a": (d, "row_id", ["f0", "f1"])}, str(tmp_path)
    args = (2, ["calinski_harabasz", "davies_bouldin"], ["KMeans"], ["NullModel"], None)
    out = search.sweep(spark, sets, *args, base=base).collect()
    assert {r["measure"] for r in out} == {"calinski_harabasz", "davies_bouldin"}
    assert spark.read.parquet(f"{base}/history").count() == 4
    assert spark.read.parquet(f"{base}/labels").filter("measure = 'davies_bouldin'").count() == 100
    assert search.sweep(spark, sets, *args, base=base).count() == 0


def test_every_choice_runs(spark):
    """Every value of every categorical parameter."""
    d = synth.blobs(synth.ids(spark, 60), 2, 2).drop("label").cache()
    given = {"n_clusters": "2", "n_components": "2", "min_samples": "5", "eps": "0.5", "bandwidth": "3.0"}
    for clusterer, space in search.CLUSTERERS.items():
        for name, kind in space.items():
            for choice in kind[1] if kind[0] == "cat" and len(kind[1]) > 1 else ():
                params = {f"{k}___{clusterer}": v for k, v in given.items() if k in space} | {f"{name}___{clusterer}": choice}
                labels, _, _ = search.run_candidate(d, "row_id", ["f0", "f1"], "NullModel", clusterer, params)
                assert labels.count() == 60, (clusterer, name, choice)


def test_batch_keeps_going(spark, tmp_path):
    good = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, x double")
    out = batch.prepare_many(
        spark,
        {
            "good": (lambda: good, TableSpec(numerical=("x",)), ["id"]),
            "bad": (lambda: good, TableSpec(numerical=("gone",)), ["id"]),
        },
        base=str(tmp_path), metafeatures=True,
    )
    by = {r["dataset"]: r for r in out.collect()}
    assert by["good"]["n_rows"] == 2 and by["good"]["error"] is None and "gone" in by["bad"]["error"]


@pytest.mark.parametrize("selector", list(search.SELECTORS))
def test_every_selector_runs(spark, selector):
    d = synth.blobs(synth.ids(spark, 60), 4, 2).drop("label").cache()
    params = {"k___WKMeans": "3", "beta___WKMeans": "2.0", "norm_constraint___Lasso": "1.5", f"k___{selector}": "3"}
    labels, score, _ = search.run_candidate(
        d, "row_id", [f"f{i}" for i in range(4)], selector, "KMeans", {**params, "n_clusters___KMeans": "2"}, "davies_bouldin"
    )
    assert labels.count() == 60 and score <= 1


@pytest.mark.parametrize("clusterer", list(search.CLUSTERERS))
def test_every_clusterer_runs(spark, clusterer):
    d = synth.blobs(synth.ids(spark, 60), 2, 2).drop("label").cache()
    params = {
        "n_clusters": "2", "n_components": "2", "min_samples": "5", "eps": "1.0", "bandwidth": "3.0", "affinity": None,
    }
    given = {f"{k}___{clusterer}": v for k, v in params.items() if v and k in search.CLUSTERERS[clusterer]}
    labels, _, _ = search.run_candidate(d, "row_id", ["f0", "f1"], "NullModel", clusterer, given, "davies_bouldin")
    assert labels.count() == 60
