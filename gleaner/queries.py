"""The query set: one entry per operator, each over whole tables."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import recipes as R
from .functions.numeric import r6, soft_threshold, unpivot
from .operators import (
    assign, cluster, density, graph, kmeans as km, localised, measures, neighbours, outliers, prep, profile,
    profile_ext as ext, select, tiles,
)
from .operators.order import chunks_for, with_row_id
from .plans import batch, search
from .session import cut, scratch_path
from .sources import spec as spec_mod, store, synth


def _nulls(df: DataFrame) -> DataFrame:
    """Every 17th order loses its quantity."""
    return df.withColumn("l_quantity", F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")))


def _rounded(df: DataFrame, keep=()) -> DataFrame:
    return df.select(
        *[r6(F.col(c).cast("double")).alias(c) if c not in keep else F.col(c) for c in df.columns]
    )


# ---------------------------------------------------------------- sources


def load_roles(spark, sf):
    return spec_mod.role_table(R.line(spark, sf), R.LINEITEM)


def pending_datasets(spark, sf):
    """Customers are the catalog, customers with an urgent order are finished."""
    catalog = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset"), "c_mktsegment")
    urgent = R.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    done = urgent.select(F.col("o_custkey").alias("dataset"))
    return store.pending(catalog, done)


def prep_batch(spark, sf):
    t = lambda n: lambda: R.table(spark, sf, n)
    return batch.prepare_many(
        spark,
        {
            "orders": (t("orders"), R.ORDERS, ["o_orderkey"]),
            "part": (t("part"), R.PART, ["p_partkey"]),
            "customer": (t("customer"), R.CUSTOMER, ["c_custkey"]),
            "events": (t("events"), R.EVENTS, ["event_id"]),
            "lineitem": (t("lineitem"), R.LINEITEM, []),
        },
    )


def _keys(spark, sf, table="orders", key="o_orderkey"):
    return R.table(spark, sf, table).select(F.col(key).alias("row_id"))


def synth_blobs(spark, sf):
    return synth.blobs(_keys(spark, sf), n_features=8, n_clusters=5)


def synth_classification(spark, sf):
    return synth.classification(_keys(spark, sf), n_informative=6, n_redundant=4, n_repeated=3, n_clusters=4)


def synth_moons(spark, sf):
    return _rounded(synth.moons(_keys(spark, sf, "part", "p_partkey"), noise=0.0), ["row_id", "label"])


def synth_circles(spark, sf):
    return _rounded(synth.circles(_keys(spark, sf, "part", "p_partkey"), noise=0.0), ["row_id", "label"])


def synth_moons_noise(spark, sf):
    return synth.moons(_keys(spark, sf, "part", "p_partkey"), noise=0.05)


# ---------------------------------------------------------------- preparation


def prep_dropna(spark, sf):
    d = prep.drop_ignored(prep.drop_missing(_nulls(R.line(spark, sf))), R.LINEITEM)
    return _rounded(d, ["l_returnflag", "l_linestatus"])


def prep_drop_target(spark, sf):
    return _rounded(
        prep.drop_target(prep.drop_ignored(R.line(spark, sf), R.LINEITEM), R.LINEITEM), ["l_returnflag"]
    )


def prep_onehot(spark, sf):
    d = R.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    from dataclasses import replace

    out = prep.one_hot(d, replace(R.PART, categorical=("p_type",)), ["p_partkey"])
    return out.select(
        "p_partkey", F.col("p_size").cast("long").alias("p_size"), "p_retailprice",
        *[F.col(c).cast("long").alias(c) for c in out.columns if c.startswith("p_type_")],
    )


def prep_onehot_sparse(spark, sf):
    """One indicator per customer name and segment, whatever their number."""
    d = R.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = prep.one_hot_sparse(d, ["c_name", "c_mktsegment"])
    return out.select("c_custkey", F.col("features.size").cast("long").alias("size"), F.array_join("features.indices", ",").alias("indices"))


def prep_ordinal(spark, sf):
    d = prep.encode_ordinal(R.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), R.ORDERS)
    return d.select("o_orderkey", F.col("o_orderpriority").cast("long").alias("o_orderpriority"))


def prep_truncate(spark, sf):
    d = R.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return prep.truncate(d, ["o_orderkey"], 10_000)


def prep_scale(spark, sf):
    return _rounded(prep.standardise(R.line(spark, sf).select(*R.LINE_COLS)))


def prep_full(spark, sf):
    return _rounded(prep.prepare(_nulls(R.line(spark, sf)), R.LINEITEM))


def prep_full_orders(spark, sf):
    return _rounded(prep.prepare(R.table(spark, sf, "orders"), R.ORDERS, ["o_orderkey"]), ["o_orderkey"])


def impute_mean(spark, sf):
    d = _nulls(R.line(spark, sf)).select("l_quantity", "l_extendedprice")
    return _rounded(prep.impute_mean(d, ["l_quantity", "l_extendedprice"]))


def outlier_iforest(spark, sf):
    """Every line item's isolation score; the hundredth that scores highest is marked."""
    d = outliers.isolation_forest(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, contamination=0.01)
    return d.select(F.col("id").alias("row_id"), r6(F.col("score")).alias("score"), "outlier")


def row_number(spark, sf):
    """Dense row numbers over a whole table without a single-task window."""
    d = R.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_row_id(d, ["o_totalprice", "o_orderkey"], parts=chunks_for(d))


# ---------------------------------------------------------------- meta-features


def _line_empty(spark, sf):
    """Some flags empty, some quantities missing."""
    d = _nulls(R.line(spark, sf))
    return d.withColumn("l_returnflag", F.when(F.col("l_partkey") % 13 == 0, F.lit("")).otherwise(F.col("l_returnflag")))


CATS = ["l_returnflag", "l_linenumber"]


def mf_general(spark, sf):
    return profile.general(_line_empty(spark, sf), R.LINEITEM)


def mf_shape(spark, sf):
    return profile.shape(R.line(spark, sf), R.LINEITEM)


def mf_labels(spark, sf):
    return profile.label_stats(R.line(spark, sf), "l_linestatus")


def mf_numeric_sparsity(spark, sf):
    return profile.numeric_sparsity(R.line(spark, sf), R.LINE_COLS)


def mf_skewness(spark, sf):
    return profile.skewness(R.line(spark, sf), R.LINE_COLS)


def mf_kurtosis(spark, sf):
    return profile.kurtosis(R.line(spark, sf), R.LINE_COLS)


def mf_correlation(spark, sf):
    return profile.correlation(R.line(spark, sf), R.LINE_COLS)


def mf_covariance(spark, sf):
    return profile.covariance(prep.standardise(R.line(spark, sf).select(*R.LINE_COLS)), R.LINE_COLS)


def mf_covariance_wide(spark, sf):
    """64 columns: the Gram-matrix path."""
    return profile.covariance(R.wide(spark, sf), R.WIDE)


def mf_pca(spark, sf):
    return profile.pca(prep.standardise(R.line(spark, sf).select(*R.LINE_COLS)), R.LINE_COLS)


def mf_entropy(spark, sf):
    return profile.entropy(_line_empty(spark, sf), CATS)


def mf_mutual_information(spark, sf):
    return profile.mutual_information(_line_empty(spark, sf), CATS, "l_linestatus")


def mf_vector(spark, sf):
    return profile.vector(_line_empty(spark, sf), R.LINEITEM)


def mf_vector_scaled(spark, sf):
    """All groups but the principal component's, prices in units of 100,000."""
    d = _line_empty(spark, sf).withColumn("l_extendedprice", F.col("l_extendedprice") / F.lit(100000.0))
    names = [m for m in profile.METAFEATURES if not m.startswith("pca")]
    return profile.vector(d, R.LINEITEM, names).select("metafeature", "value")


def mfx_general(spark, sf):
    return ext.general(R.line(spark, sf), R.LINEITEM)


def mfx_location(spark, sf):
    return ext.location(R.line(spark, sf), R.LINE_COLS)


def mfx_spread(spark, sf):
    return ext.spread(R.line_scaled(spark, sf), R.LINE_COLS)


def mfx_shape(spark, sf):
    return ext.shape(R.line(spark, sf), R.LINE_COLS)


def mfx_pairs(spark, sf):
    return ext.pairs(R.line_scaled(spark, sf), R.LINE_COLS)


def mfx_correlated_share(spark, sf):
    return ext.correlated_share(R.line_scaled(spark, sf), R.LINE_COLS)


def mfx_eigen(spark, sf):
    return ext.eigenvalues(R.wide(spark, sf), R.WIDE)


def mfx_outliers(spark, sf):
    return ext.outlier_columns(R.line(spark, sf), R.LINE_COLS)


def mfx_attr_ent(spark, sf):
    return ext.attribute_entropy(R.line(spark, sf), R.LINE_COLS)


def mfx_attr_conc(spark, sf):
    return ext.attribute_concentration(R.line(spark, sf), R.LINE_COLS)


def mfx_complexity(spark, sf):
    return ext.complexity(R.wide(spark, sf), R.WIDE)


def mfx_one_itemset(spark, sf):
    return ext.one_itemset(R.table(spark, sf, "part"), R.PART_COLS)


def mfx_two_itemset(spark, sf):
    return ext.two_itemset(R.table(spark, sf, "part"), R.PART_COLS)


def mfx_summary(spark, sf):
    d = R.wide_raw(spark, sf)
    row = d.agg(*[F.var_samp(c).alias(c) for c in R.WIDE])
    values = unpivot(row, R.WIDE, "column", "value").select(F.lit("var").alias("feature"), "value")
    return ext.summary_all(values)


# ---------------------------------------------------------------- pairs and neighbours


def pair_distance(spark, sf):
    d = tiles.pair_distance_means(R.wide(spark, sf), "vec_id", R.WIDE, "label")
    return d.select(F.col("id").alias("vec_id"), F.col("other").alias("label"), r6(F.col("mean_dist")).alias("mean_dist"))


def rbf_degree(spark, sf):
    d = tiles.rbf_degree(R.wide(spark, sf), "vec_id", R.WIDE)
    return d.select(F.col("id").alias("vec_id"), r6(F.col("degree")).alias("degree"))


def _knn(spark, sf):
    return neighbours.knn(R.wide_raw(spark, sf), "vec_id", R.WIDE, 8)


def knn_graph(spark, sf):
    return _knn(spark, sf).select("src", "dst", r6(F.col("d")).alias("d"))


def knn_part(spark, sf):
    """Two columns: blocks along a space-filling curve, pruned by their boxes."""
    n = neighbours.knn(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 5)
    return n.groupBy(F.col("src").alias("p_partkey")).agg(r6(F.max("d")).alias("kth"), r6(F.sum("d")).alias("total"))


def knn_lsh(spark, sf):
    """Random-projection hash tables instead of all blocks; some neighbours may be missed."""
    n = neighbours.knn(R.wide_raw(spark, sf), "vec_id", R.WIDE, 8, method="lsh")
    return n.select("src", "dst", r6(F.col("d")).alias("d"))


def heat_graph(spark, sf):
    return graph.heat_weights(_knn(spark, sf)).select("src", "dst", r6(F.col("w")).alias("w"))


def graph_laplacian(spark, sf):
    e = graph.symmetrise(graph.heat_weights(_knn(spark, sf)))
    return graph.normalised_laplacian(e).select("src", "dst", r6(F.col("l")).alias("l"))


def eps_join(spark, sf):
    return neighbours.eps_degree(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.1).withColumnRenamed("id", "p_partkey")


def eps_join_manhattan(spark, sf):
    d = neighbours.eps_degree(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.1, "manhattan")
    return d.select(F.col("id").alias("p_partkey"), "neighbours")


def cluster_jaccard(spark, sf):
    j = assign.jaccard(R.line(spark, sf), "l_returnflag", "l_linenumber")
    return j.select("a", F.col("b").cast("long").alias("b"), r6(F.col("jaccard")).alias("jaccard"))


def assign_nearest(spark, sf):
    d = R.wide(spark, sf)
    _, centres = assign.label_means(d, R.WIDE, "label")
    out = assign.nearest(d, R.WIDE, centres, "nearest", "dist")
    return out.select("vec_id", "nearest", r6(F.col("dist")).alias("dist"))


# ---------------------------------------------------------------- linear algebra


def scatter_matrices(spark, sf):
    p = len(R.WIDE)
    tables = localised.scatter_tables(R.wide(spark, sf).select("label", *R.WIDE), R.WIDE, "label")
    rows = []
    for l, t in tables.items():
        within = t.around(t.mean)
        rows += [(int(l), i, j, float(within[i, j])) for i in range(p) for j in range(p)]
    out = spark.createDataFrame(rows, "label long, i long, j long, within double")
    return out.select("label", "i", "j", r6(F.col("within")).alias("within"))


def scatter_separability(spark, sf):
    import numpy as np

    d = R.line_scaled(spark, sf)
    tables = localised.scatter_tables(d, R.LINE_COLS, "l_linenumber")
    order = sorted(tables)
    means = np.array([tables[l].mean for l in order])
    grand = sum(tables[l].s for l in order) / sum(tables[l].n for l in order)
    between = localised.between_scatter(means, grand)
    rows = []
    for l in order:
        t = tables[l]
        within = t.around(t.mean)
        for drop in range(len(R.LINE_COLS)):
            subset = [j for j in range(len(R.LINE_COLS)) if j != drop]
            rows.append((int(l), R.LINE_COLS[drop], localised.separability(within, between, t.n, subset)))
    return spark.createDataFrame(rows, "label long, without string, score double")


def _embedding_part(spark, sf):
    return select.knn_embedding(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 3)


def spectral_embedding(spark, sf):
    vec, lam, res = _embedding_part(spark, sf)
    return vec.withColumnRenamed("id", "p_partkey")


def mcfs_coefs(spark, sf):
    vec, lam, _ = _embedding_part(spark, sf)
    d = R.part_scaled(spark, sf)
    joined = vec.join(d, vec["id"] == d["p_partkey"])
    ys = [f"v{i}" for i in range(len(lam))]
    coef = select.regression_coefficients(joined, R.PART_COLS, ys)
    rows = [(c, y, float(coef[i, j])) for i, c in enumerate(R.PART_COLS) for j, y in enumerate(ys)]
    return spark.createDataFrame(rows, "feature string, vector string, coefficient double")


# ---------------------------------------------------------------- feature selection


def _variance_scores(spark, sf):
    """Column variances of the embeddings, coarse enough to tie."""
    d = R.wide_raw(spark, sf)
    row = d.agg(*[F.round(F.var_pop(c), 3).alias(c) for c in R.WIDE])
    long = unpivot(row, R.WIDE, "feature", "score")
    return long.select("feature", F.substring("feature", 2, 10).cast("long").alias("idx"), r6(F.col("score")).alias("score"))


def select_topk(spark, sf):
    return select.top_k(_variance_scores(spark, sf), 20)


def select_threshold(spark, sf):
    return select.above(_variance_scores(spark, sf), 0.015)


def select_topk_project(spark, sf):
    cols = select.chosen(select.top_k(_variance_scores(spark, sf), 5))
    d = prep.project_selected(R.wide_raw(spark, sf), ["vec_id"], cols)
    # Column names depend on the data, so the rows are compared in long form.
    return unpivot(d, cols, "feature", "value", keep=["vec_id"]).select("vec_id", "feature", r6(F.col("value")).alias("value"))


def _scores(df):
    return df.select("feature", "idx", r6(F.col("score")).alias("score"))


def fs_normalized_cut(spark, sf):
    return _scores(select.normalized_cut(R.wide(spark, sf), "vec_id", R.WIDE))


def fs_generic_spec(spark, sf):
    return _scores(select.generic_spec(R.wide(spark, sf), "vec_id", R.WIDE))


def fs_normalized_cut_rff(spark, sf):
    """The linear path: two passes over every lineitem row."""
    return select.normalized_cut(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, method="rff")


def fs_fixed_spec(spark, sf):
    return select.fixed_spec(R.wide(spark, sf), "vec_id", R.WIDE, 3)


def fs_mcfs(spark, sf):
    return select.mcfs(R.wide_raw(spark, sf), "vec_id", R.WIDE, clusters=3)


def fs_wkmeans(spark, sf):
    return select.wkmeans(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 3, beta=2.0, n_clusters=3)[0]


def wkmeans_weights(spark, sf):
    d = select.dispersion(R.wide(spark, sf), R.WIDE, "label")
    return _scores(select.score_table(spark, R.WIDE, select.weights_from_dispersion(d, 2.0)))


def fs_sparse_kmeans(spark, sf):
    return select.sparse_kmeans(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 1.5)[0]


def sparse_kmeans_objective(spark, sf):
    o = select.sparse_objective(R.wide(spark, sf), R.WIDE, "label")
    return o.select("feature", r6(F.col("objective")).alias("objective"))


def sparse_kmeans_objective_line(spark, sf):
    """Large groups of repeated values."""
    o = select.sparse_objective(R.line_scaled(spark, sf), R.LINE_COLS, "l_linenumber")
    return o.select("feature", r6(F.col("objective")).alias("objective"))


def soft_weights(spark, sf):
    o = select.sparse_objective(R.wide(spark, sf), R.WIDE, "label")
    w = select.soft_weights(o, 2.0)
    return w.select("feature", r6(F.col("weight")).alias("weight"))


def soft_threshold_rows(spark, sf):
    e = R.table(spark, sf, "events")
    return e.select("event_id", r6(soft_threshold(F.col("value") - 20, 5.0)).alias("s"))


def fs_lfsbss(spark, sf):
    d = R.line_matrix(spark, sf)
    return localised.localised_selection(d, "row_id", R.LINE_COLS, 3).labels


# ---------------------------------------------------------------- clustering


def cl_kmeans(spark, sf):
    return cluster.kmeans(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 5)


def cl_bisecting(spark, sf):
    return cluster.bisecting(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 5)


def cl_minibatch_kmeans(spark, sf):
    return cluster.minibatch_kmeans(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 5, 1000)


def cl_birch(spark, sf):
    return cluster.birch(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 5)


def birch_summaries(spark, sf):
    d = R.part_scaled(spark, sf).select(F.col("p_size").alias("x0"), F.col("p_retailprice").alias("x1"))
    s = cluster.birch_summaries(d, 2, 0.5)
    return s.select("n", *[r6(F.col(c)).alias(c) for c in ("s0", "s1", "ss")])


def birch_features(spark, sf):
    """Totals of the summaries that clustering starts from, and whether each keeps to the radius."""
    d = R.part_scaled(spark, sf).select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x0"), F.col("p_retailprice").alias("x1"))
    f, members = cluster.birch_features(d, 2, 0.5)
    wide = F.col("ss") / F.col("n") - F.pow(F.col("s0") / F.col("n"), F.lit(2)) - F.pow(F.col("s1") / F.col("n"), F.lit(2))
    totals = f.agg(
        F.sum("n").cast("long").alias("n"), *[r6(F.sum(c)).alias(c) for c in ("s0", "s1", "ss")],
        F.count(F.when(wide > 0.25 + 1e-6, 1)).alias("too_wide"),
    )
    alone = members.groupBy("id").count().agg(F.count(F.lit(1)).alias("members"), F.max("count").alias("features_per_row"))
    return totals.crossJoin(alone)  # one row each


def cl_power_iteration(spark, sf):
    return cluster.power_iteration(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 4)


def cl_gmm(spark, sf):
    return cluster.gaussian_mixture(R.line_matrix(spark, sf), "row_id", R.LINE_COLS, 3, "full")


def cl_gmm_diag(spark, sf):
    return cluster.gaussian_mixture(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 3, "diag", "random")


def gmm_estep(spark, sf):
    d = R.part_scaled(spark, sf).join(
        R.table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey"
    )
    out = cluster.mixture_log_density(d, R.PART_COLS, "p_type")
    return out.select("p_partkey", r6(F.col("log_likelihood")).alias("log_likelihood"), r6(F.col("max_responsibility")).alias("max_responsibility"))


def cl_dbscan(spark, sf):
    d = density.dbscan(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.1, 8)
    return d.select(F.col("id").alias("p_partkey"), "label")


def dbscan_core(spark, sf):
    pts, owner = density.core_points(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.1, 8)
    return owner.join(pts.select("_id", "core"), "_id").select(F.col("id").alias("p_partkey"), "core")


def cl_optics_dbscan(spark, sf):
    return density.optics_dbscan(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.15, 10)


def cl_optics_dbscan_manhattan(spark, sf):
    return density.optics_dbscan(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.15, 10, "manhattan")


def optics_core_distance(spark, sf):
    d = density.optics_core_distance(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 10)
    return d.select(F.col("id").alias("p_partkey"), r6(F.col("core_distance")).alias("core_distance"))


def optics_core_distance_manhattan(spark, sf):
    d = density.optics_core_distance(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 10, "manhattan")
    return d.select(F.col("id").alias("p_partkey"), r6(F.col("core_distance")).alias("core_distance"))


def cl_mean_shift(spark, sf):
    return density.mean_shift(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 0.8, bin_seeding=True)[0]


def mean_shift_step(spark, sf):
    d = cut(tiles.collapse(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS))
    s = density.mean_shift_step(d.withColumnRenamed("_id", "_q"), density.shift_index(d, 2, 0.5))
    return s.select(F.col("_q").alias("p_partkey"), F.col("n").cast("long").alias("n"), r6(F.col("x0")).alias("x0"), r6(F.col("x1")).alias("x1"))


def cl_spectral(spark, sf):
    return cluster.spectral(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, 4, "nearest_neighbors")


def cl_spectral_rbf(spark, sf):
    return cluster.spectral(R.wide_raw(spark, sf), "vec_id", R.WIDE, 4, "rbf")


def affinity_kernels(spark, sf):
    """Row sums of the four kernels, gamma = 1."""
    d = R.wide_raw(spark, sf)
    pts = tiles.collapse(d, "vec_id", R.WIDE)
    blocks = tiles.large_block_count(d, d.count())
    placed = cut(tiles.hash_blocks(pts, "_id", blocks))
    out = None
    for k in cluster.KERNELS:
        s = tiles.kernel_sums(placed, len(R.WIDE), k, 1.0, ["_w"], blocks).select(
            F.col("_id").alias("vec_id"), F.lit(k).alias("kernel"), r6(F.col("_w")).alias("row_sum")
        )
        out = s if out is None else out.unionByName(s)
    return out


def cl_single_linkage(spark, sf):
    return cluster.single_linkage(R.wide_raw(spark, sf), "vec_id", R.WIDE, 5)


def linkage_height(spark, sf):
    """Single linkage of the parts, cut at a height."""
    return cluster.single_linkage(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, height=0.04)


def linkage_height_manhattan(spark, sf):
    return cluster.single_linkage(R.part_scaled(spark, sf), "p_partkey", R.PART_COLS, affinity="manhattan", height=0.05)


def spanning_tree(spark, sf):
    """Edges and length of the minimum spanning tree of the embeddings, and its longest edge."""
    t = graph.spanning_tree(R.wide_raw(spark, sf), "vec_id", R.WIDE)
    return t.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("d")).alias("total"), r6(F.max("d")).alias("longest"))


def cl_affinity_propagation(spark, sf):
    return cluster.affinity_propagation(R.wide_raw(spark, sf), "vec_id", R.WIDE)


# ---------------------------------------------------------------- measures


def measure_silhouette(spark, sf):
    return _rounded(measures.silhouette(R.wide(spark, sf), "vec_id", R.WIDE, "label"))


def measure_silhouette_sampled(spark, sf):
    d = measures.silhouette_sampled(R.wide(spark, sf), "vec_id", R.WIDE, "label", sample=300)
    return d.select(*[r6(F.col(c)).alias(c) for c in ("s", "low", "high", "measure")], "n")


def measure_silhouette_squared(spark, sf):
    return _rounded(measures.silhouette_squared(R.line_scaled(spark, sf), R.LINE_COLS, "l_linenumber"))


def measure_davies_bouldin(spark, sf):
    return _rounded(measures.davies_bouldin(R.wide(spark, sf), R.WIDE, "label"))


def measure_calinski_harabasz(spark, sf):
    return _rounded(measures.calinski_harabasz(R.line_scaled(spark, sf), R.LINE_COLS, "l_linenumber"))


def measure_degenerate(spark, sf):
    """Two labellings of lineitem: by line number, and by a rule that puts every row into one cluster."""
    d = R.line_scaled(spark, sf).withColumn("one", (F.col("l_linenumber") >= 0).cast("long"))
    rows = []
    for label in ("l_linenumber", "one"):
        k = d.select(label).distinct().count()
        value, _ = measures.score("calinski_harabasz", d, "l_orderkey", R.LINE_COLS, label)
        rows.append((label, k, round(value, 6)))
    return spark.createDataFrame(rows, "labelling string, n_labels long, measure double")


def kmeans_inertia(spark, sf):
    return measures.inertia(R.line_scaled(spark, sf), R.LINE_COLS, "l_linenumber").select(
        F.round("inertia", 3).alias("inertia")
    )


def flagship(spark, sf):
    """Prepare lineitem, cluster it, score the clustering: one leaderboard row."""
    m = R.line_matrix(spark, sf).drop("label")
    vec = km.vectors(m, R.LINE_COLS, ["row_id", *R.LINE_COLS])
    scored = cut(km.fit(vec, 5).label(vec))
    db, _ = measures.score("davies_bouldin", scored, "row_id", R.LINE_COLS, "label")
    ch, raw = measures.score("calinski_harabasz", scored, "row_id", R.LINE_COLS, "label")
    return spark.createDataFrame(
        [("KMeans", "NullModel", db, ch, raw)],
        "clusterer string, selector string, davies_bouldin double, calinski_harabasz double, raw_ch double",
    )


# ---------------------------------------------------------------- search


def _part_onehot(spark, sf):
    m = prep.prepare(R.table(spark, sf, "customer"), R.CUSTOMER, ["c_custkey"])
    return m, "c_custkey", [c for c in m.columns if c != "c_custkey"]


def search_one(spark, sf):
    m, key, cols = _part_onehot(spark, sf)
    labels, score, raw = search.run_candidate(
        cut(m), key, cols, "NormalizedCut", "KMeans", {"n_clusters___KMeans": "5", "k___NormalizedCut": "3"}, "calinski_harabasz"
    )
    return labels


def search_history(spark, sf):
    m, key, cols = _part_onehot(spark, sf)
    plan = search.candidates(spark, 20, ("KMeans", "DBSCAN"), ("NullModel", "NormalizedCut"))
    hist = search.random_search(cut(m), key, cols, plan, cutoff=None)
    return hist.drop("seconds")


def search_candidates(spark, sf):
    """As many candidates as there are customers, by pair."""
    n = R.table(spark, sf, "customer").count()
    names = sorted(search.CLUSTERERS), sorted(search.SELECTORS)
    drawn = search.candidates(spark, n, *names)
    return drawn.select("candidate_id", F.col("clusterer").isin(*names[0]).alias("known_clusterer"),
                        F.col("selector").isin(*names[1]).alias("known_selector"))


def spec_catalog(spark, sf):
    """Descriptors of the tables, written as a catalog and read back, with the row counts of their tables."""
    specs = {"lineitem": R.LINEITEM, "orders": R.ORDERS, "part": R.PART, "customer": R.CUSTOMER, "events": R.EVENTS}
    folder = scratch_path(spark)
    spec_mod.write_catalog(spark, [{"dataset": n, **json.loads(s.to_json())} for n, s in specs.items()], folder)
    counts = None
    for n in specs:
        one = R.table(spark, sf, n).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("dataset", F.lit(n))
        counts = one if counts is None else counts.unionByName(one)
    found = spec_mod.catalog_counts(spec_mod.spec_catalog(spark, folder, lines=True)).join(counts, "dataset")
    return found.select("dataset", "n_numerical", "n_categorical", "n_ordinal", "n_ignored", "has_target", "n_rows")


def load_csv(spark, sf):
    """orders as a CSV file, loaded by its descriptor: levels of a numeric category in the order of numbers."""
    folder = scratch_path(spark)
    d = R.table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_custkey") % 12 - 1).alias("o_group"), "o_orderpriority"
    )
    d.write.option("header", True).csv(f"{folder}/orders.csv")
    spec = spec_mod.TableSpec(
        numerical=("o_totalprice",), categorical=("o_group", "o_orderpriority"), ignore=("o_orderkey",), path="orders.csv"
    )
    loaded = spec_mod.load_table(spark, spec, folder)
    order = {int(v): i for i, v in enumerate(prep.levels(loaded, ["o_group"])["o_group"])}
    code = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("o_group").cast("int"))
    return loaded.select(
        "o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority", code.cast("long").alias("code")
    )


def search_sweep(spark, sf):
    m, key, cols = _part_onehot(spark, sf)
    p = R.part_scaled(spark, sf)
    return search.sweep(
        spark, {"customer": (cut(m), key, cols), "part": (cut(p), "p_partkey", R.PART_COLS)},
        n_evaluations=8, clusterers=("KMeans", "MiniBatchKMeans", "Birch", "GaussianMixture"),
        selectors=("NullModel", "GenericSPEC"), cutoff=None,
    )


def search_resume(spark, sf):
    """A sweep that stops after one of two datasets and is taken up again: what is stored, against one run through."""
    m, key, cols = _part_onehot(spark, sf)
    data = {"customer": (cut(m), key, cols), "part": (cut(R.part_scaled(spark, sf)), "p_partkey", R.PART_COLS)}
    how = dict(
        n_evaluations=3, measures=("calinski_harabasz", "davies_bouldin"), clusterers=("KMeans",), selectors=("NullModel",),
        cutoff=None,
    )
    base = scratch_path(spark)
    search.sweep(spark, {"customer": data["customer"]}, base=base, **how)
    resumed = search.sweep(spark, data, base=base, **how)
    once = search.sweep(spark, data, **how)
    columns = ["dataset", "measure", "rank", "pair", F.round("score", 9).alias("score")]
    stored = store.read_ranking(spark, base).select(*columns)
    found = stored.groupBy("dataset", "measure").agg(F.count(F.lit(1)).alias("ranked"))
    evaluated = store.read_history(spark, base).groupBy("dataset", "measure").agg(F.count(F.lit(1)).alias("evaluated"))
    again = resumed.groupBy("dataset", "measure").agg(F.count(F.lit(1)).alias("ran_again"))
    missing = once.select(*columns).exceptAll(stored).groupBy("dataset", "measure").agg(F.count(F.lit(1)).alias("differ"))
    by = ["dataset", "measure"]
    out = found.join(evaluated, by).join(again, by, "left").join(missing, by, "left")
    return out.select(*by, "ranked", "evaluated", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ran_again", "differ")])


def search_trajectory(spark, sf):
    return search.trajectory(R.event_history(spark, sf), ["dataset"], "candidate_id").select("dataset", "candidate_id", "score")


def search_leaderboard(spark, sf):
    b = search.leaderboard(R.event_history(spark, sf), 5, ["dataset"], raw=None)
    return b.select("dataset", "rank", "candidate_id", F.concat_ws("_", "clusterer", "selector").alias("pair"), "score")


def search_pairs(spark, sf):
    return search.pair_results(R.event_history(spark, sf), [f"C{i}" for i in range(9)], [f"S{i}" for i in range(7)])


QUERIES = {
    f.__name__: f
    for f in (
        load_roles, pending_datasets, prep_batch, synth_blobs, synth_classification, synth_moons, synth_circles,
        synth_moons_noise, prep_dropna, prep_drop_target, prep_onehot, prep_onehot_sparse, prep_ordinal, prep_truncate, prep_scale,
        prep_full, prep_full_orders, impute_mean, outlier_iforest, row_number, mf_general, mf_shape, mf_labels, mf_numeric_sparsity,
        mf_skewness, mf_kurtosis, mf_correlation, mf_covariance, mf_covariance_wide, mf_pca, mf_entropy,
        mf_mutual_information, mf_vector, mf_vector_scaled, mfx_general, mfx_location, mfx_spread, mfx_shape, mfx_pairs,
        mfx_correlated_share, mfx_eigen, mfx_outliers, mfx_attr_ent, mfx_attr_conc, mfx_complexity,
        mfx_one_itemset, mfx_two_itemset, mfx_summary, pair_distance, rbf_degree, knn_graph, knn_part, knn_lsh, heat_graph,
        graph_laplacian, eps_join, eps_join_manhattan, cluster_jaccard, assign_nearest, scatter_matrices, scatter_separability,
        spectral_embedding, mcfs_coefs, select_topk, select_threshold, select_topk_project, fs_normalized_cut,
        fs_generic_spec, fs_normalized_cut_rff, fs_fixed_spec, fs_mcfs, fs_wkmeans, wkmeans_weights,
        fs_sparse_kmeans, sparse_kmeans_objective, sparse_kmeans_objective_line, soft_weights,
        soft_threshold_rows, fs_lfsbss, cl_kmeans, cl_bisecting, cl_minibatch_kmeans, cl_birch, birch_summaries, birch_features, cl_power_iteration,
        cl_gmm, cl_gmm_diag, gmm_estep, cl_dbscan, dbscan_core, cl_optics_dbscan, cl_optics_dbscan_manhattan, optics_core_distance,
        optics_core_distance_manhattan, cl_mean_shift, mean_shift_step, cl_spectral, cl_spectral_rbf,
        affinity_kernels, cl_single_linkage, linkage_height, linkage_height_manhattan, spanning_tree, cl_affinity_propagation, measure_silhouette,
        measure_silhouette_squared, measure_silhouette_sampled, measure_davies_bouldin, measure_calinski_harabasz, measure_degenerate,
        kmeans_inertia, flagship, spec_catalog, load_csv, search_candidates, search_one, search_history, search_sweep, search_resume, search_trajectory,
        search_leaderboard, search_pairs,
    )
}
