"""Equivalent SQL for the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
P = 64


def r6(e: str, alias: str) -> str:
    return f"round({e}, 6) + 0.0 AS {alias}"


def scaled(col: str, over: str = "") -> str:
    return f"({col} - avg({col}) OVER ({over})) / stddev_pop({col}) OVER ({over})"


# ---------------------------------------------------------------- building blocks

NULLED = """nulled AS (SELECT * REPLACE (CASE WHEN l_orderkey % 17 <> 0 THEN l_quantity END AS l_quantity) FROM lineitem)"""
EMPTIED = (
    NULLED
    + """, emptied AS (SELECT * REPLACE (CASE WHEN l_partkey % 13 = 0 THEN '' ELSE l_returnflag END AS l_returnflag) FROM nulled)"""
)
LINE_SCALED = "line AS (SELECT " + ", ".join(f"{scaled(c)} AS {c}" for c in LINE) + ", l_linenumber::BIGINT AS label FROM lineitem)"


def long(cte: str, cols=LINE, keep: str = "") -> str:
    parts = [f"SELECT {keep}'{c}' AS feature, {i} AS idx, {c}::DOUBLE AS x FROM {cte}" for i, c in enumerate(cols)]
    return "lng AS (" + " UNION ALL ".join(parts) + ")"


RAWVEC = "rawvec AS (SELECT vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS x FROM embeddings)"
WIDE = f"""raw AS (SELECT vec_id, label::BIGINT AS label, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v0 FROM embeddings),
z AS (SELECT vec_id, label, j, {scaled('v0', 'PARTITION BY j')} AS v FROM raw),
vec AS (SELECT vec_id, any_value(label) AS label, list(v ORDER BY j) AS x FROM z GROUP BY vec_id)"""
PART = f"pts AS (SELECT p_partkey, p_type, {scaled('p_size::DOUBLE')} AS x0, {scaled('p_retailprice')} AS x1 FROM part)"
KNN = f"""{RAWVEC},
dist AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.x, b.x) AS d FROM rawvec a JOIN rawvec b ON a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM dist) WHERE r <= 8)"""

SIX = {
    "min": "min({v})", "max": "max({v})", "median": "quantile_cont({v}, 0.5)", "mean": "avg({v})",
    "first_quartile": "quantile_cont({v}, 0.25)", "third_quartile": "quantile_cont({v}, 0.75)",
}


def rows(values: dict[str, str], source: str) -> str:
    """(metafeature, value) rows of one aggregate row."""
    cols = ", ".join(f"({e})::DOUBLE AS {k}" for k, e in values.items())
    union = " UNION ALL ".join(f"SELECT '{k}' AS metafeature, {r6(k, 'value')} FROM one" for k in values)
    return f", one AS (SELECT {cols} FROM {source}) {union}"


def six(suffix: str, v: str = "v", **override: str) -> dict[str, str]:
    return {f"{k}_{suffix}": override.get(k, e.format(v=v)) for k, e in SIX.items()}


O: dict[str, str] = {}

# ---------------------------------------------------------------- sources

_roles = (
    [(c, "numerical") for c in LINE]
    + [("l_returnflag", "categorical")]
    + [(c, "ignore") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")]
    + [("l_linestatus", "target")]
)
O["load_roles"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{r}' AS role, count({c}) AS n_present, count(DISTINCT {c}) AS n_distinct FROM lineitem"""
    for c, r in _roles
)
O["pending_datasets"] = """SELECT c_custkey AS dataset, c_mktsegment FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _curve(outer: tuple[str, str], inner: tuple[str, str], t: str) -> str:
    return f"""WITH n AS (SELECT count(*) AS n, count(*) // 2 AS n_out FROM part),
c AS (SELECT p_partkey AS row_id, p_partkey < n_out AS o,
  CASE WHEN p_partkey < n_out THEN p_partkey ELSE p_partkey - n_out END::DOUBLE AS pos,
  CASE WHEN p_partkey < n_out THEN n_out ELSE n - n_out END AS size FROM part, n),
t AS (SELECT row_id, o, {t} AS t FROM c)
SELECT row_id, {r6(f'CASE WHEN o THEN {outer[0]} ELSE {inner[0]} END', 'f0')},
  {r6(f'CASE WHEN o THEN {outer[1]} ELSE {inner[1]} END', 'f1')},
  CASE WHEN o THEN 0 ELSE 1 END::BIGINT AS label FROM t"""


O["synth_moons"] = _curve(("cos(t)", "sin(t)"), ("1 - cos(t)", "0.5 - sin(t)"), "pi() * pos / greatest(size - 1, 1)")
O["synth_circles"] = _curve(("cos(t)", "sin(t)"), ("0.8 * cos(t)", "0.8 * sin(t)"), "2 * pi() * pos / size")

# ---------------------------------------------------------------- preparation

_four = ", ".join(r6(c, c) for c in LINE)
O["prep_dropna"] = f"WITH {NULLED} SELECT {_four}, l_returnflag, l_linestatus FROM nulled WHERE l_quantity IS NOT NULL"
O["prep_drop_target"] = f"SELECT {_four}, l_returnflag FROM lineitem"
O["prep_onehot"] = (
    "WITH lv AS (SELECT list(DISTINCT p_type ORDER BY p_type) AS l FROM part) "
    "SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice, "
    + ", ".join(f"CASE WHEN p_type = l[{i + 1}] THEN 1 ELSE 0 END::BIGINT AS p_type_{i}" for i in range(1, 6))
    + " FROM part, lv"
)
O["prep_onehot_sparse"] = """WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS i FROM (SELECT DISTINCT c_name FROM customer)),
b AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS j FROM (SELECT DISTINCT c_mktsegment FROM customer)),
n AS (SELECT (SELECT count(*) FROM a) - 1 AS na, (SELECT count(*) FROM b) - 1 AS nb)
SELECT c_custkey, (na + nb)::BIGINT AS size,
array_to_string(list_filter([CASE WHEN i > 0 THEN i - 1 END, CASE WHEN j > 0 THEN na + j - 1 END], lambda v: v IS NOT NULL), ',') AS indices
FROM customer JOIN a USING (c_name) JOIN b USING (c_mktsegment), n"""
_prio = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
_rank = "CASE o_orderpriority " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(_prio)) + " END::BIGINT"
O["prep_ordinal"] = f"SELECT o_orderkey, {_rank} AS o_orderpriority FROM orders"
O["prep_truncate"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000"
O["prep_scale"] = "SELECT " + ", ".join(r6(scaled(c), c) for c in LINE) + " FROM lineitem"
O["prep_full"] = (
    f"WITH {NULLED}, f AS (SELECT {', '.join(LINE)}, (l_returnflag = 'N')::INT AS l_returnflag_1, "
    "(l_returnflag = 'R')::INT AS l_returnflag_2 FROM nulled WHERE l_quantity IS NOT NULL) SELECT "
    + ", ".join(r6(scaled(c), c) for c in [*LINE, "l_returnflag_1", "l_returnflag_2"])
    + " FROM f"
)
O["prep_full_orders"] = (
    f"WITH f AS (SELECT o_orderkey, o_totalprice, {_rank} AS o_orderpriority, (o_orderstatus = 'O')::INT AS o_orderstatus_1, "
    "(o_orderstatus = 'P')::INT AS o_orderstatus_2 FROM orders) SELECT o_orderkey, "
    + ", ".join(r6(scaled(c), c) for c in ["o_totalprice", "o_orderpriority", "o_orderstatus_1", "o_orderstatus_2"])
    + " FROM f"
)
O["impute_mean"] = f"""WITH {NULLED} SELECT {r6('coalesce(l_quantity, avg(l_quantity) OVER ())', 'l_quantity')},
{r6('l_extendedprice', 'l_extendedprice')} FROM nulled"""
O["row_number"] = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_id FROM orders"

# ---------------------------------------------------------------- meta-features

_all = ["l_linestatus", "l_returnflag", *LINE]
_miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL{f''' OR {c} = '' ''' if c in ('l_linestatus', 'l_returnflag') else ''})" for c in _all)
_sparse = " + ".join(
    f"count(*) FILTER (WHERE {c} = {chr(39) * 2 if c in ('l_linestatus', 'l_returnflag') else 0})" for c in _all
)
O["mf_general"] = f"WITH {EMPTIED}" + rows(
    {
        "number_of_instances": "count(*)",
        "log_number_of_instances": "ln(count(*))",
        "number_of_missing_values": _miss,
        "missing_values_ratio": f"({_miss})::DOUBLE / (count(*) * 6)",
        "sparsity": f"({_sparse})::DOUBLE / (count(*) * 6)",
    },
    "emptied",
)
O["mf_shape"] = "WITH z AS (SELECT 1)" + rows(
    {
        "number_of_features": "5", "log_number_of_features": "ln(5)",
        "dataset_ratio": "5.0::DOUBLE / count(*)", "log_dataset_ratio": "ln(5.0::DOUBLE / count(*))",
    },
    "lineitem",
)
O["mf_labels"] = "WITH c AS (SELECT count(*)::DOUBLE AS c FROM lineitem WHERE l_linestatus <> '' GROUP BY l_linestatus), q AS (SELECT c / sum(c) OVER () AS p FROM c)" + rows(
    {"number_of_classes": "count(*)", "entropy_of_classes": "-sum(p * log2(p))"}, "q"
)
O["mf_numeric_sparsity"] = "WITH z AS (SELECT 1)" + rows(
    {"sparsity_on_numeric_columns": "(" + " + ".join(f"count(*) FILTER (WHERE {c} = 0)" for c in LINE) + ")::DOUBLE / (count(*) * 4)"},
    "lineitem",
)
_moments = f"WITH {long('lineitem')}, m AS (SELECT *, avg(x) OVER (PARTITION BY feature) AS mu FROM lng), "
O["mf_skewness"] = (
    _moments + "q AS (SELECT feature, avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS v FROM m GROUP BY feature)"
    + rows(six("skewness"), "q")
)
O["mf_kurtosis"] = (
    _moments + "q AS (SELECT feature, avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3 AS v FROM m GROUP BY feature)"
    + rows(six("kurtosis"), "q")
)


def _pairs(source: str, fn: str, cols=LINE) -> str:
    return "q AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, {fn}({a}, {b}) AS v FROM {source}" for i, a in enumerate(cols) for j, b in enumerate(cols)
    ) + ")"


O["mf_correlation"] = f"WITH {_pairs('lineitem', 'corr')}" + rows(
    six("correlation", "CASE WHEN i <> j THEN v END", min="min(v)", max="max(v)"), "q"
)
O["mf_covariance"] = f"WITH {LINE_SCALED}, {_pairs('line', 'covar_samp')}" + rows(six("covariance"), "q")
O["mf_covariance_wide"] = (
    f"WITH {WIDE}, q AS (SELECT a.j AS i, b.j AS j, covar_samp(a.v, b.v) AS v FROM z a JOIN z b USING (vec_id) GROUP BY a.j, b.j)"
    + rows(six("covariance"), "q")
)
_cats = "lng AS (SELECT 'l_returnflag' AS feature, l_returnflag::VARCHAR AS v, l_linestatus AS t FROM {src} UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, l_linestatus FROM {src})"
O["mf_entropy"] = (
    f"WITH {EMPTIED}, {_cats.format(src='emptied')}, n AS (SELECT log2(count(*)) AS s FROM emptied), "
    "c AS (SELECT feature, v, count(*)::DOUBLE AS c FROM lng WHERE v <> '' GROUP BY ALL), "
    "p AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p FROM c), "
    "q AS (SELECT feature, -sum(p * log2(p)) / any_value(s) AS v FROM p, n GROUP BY feature)"
    + rows(six("entropy"), "q")
)
O["mf_mutual_information"] = (
    f"WITH {EMPTIED}, ok AS (SELECT * FROM emptied WHERE l_returnflag <> '' AND l_linestatus <> ''), {_cats.format(src='ok')}, "
    "c AS (SELECT feature, v, t, count(*)::DOUBLE AS c FROM lng GROUP BY ALL), "
    "p AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, v) AS a, sum(c) OVER (PARTITION BY feature, t) AS b FROM c), "
    "q AS (SELECT feature, sum(c / n * ln(c * n / (a * b))) AS v FROM p GROUP BY feature)"
    + rows(six("mutual_information"), "q")
)
def _every_group() -> str:
    """All groups but the principal component's over one table, side by side."""
    src = f"""{EMPTIED}, src AS (SELECT * REPLACE (l_extendedprice / 100000.0 AS l_extendedprice) FROM emptied)"""
    moments = f"{long('src')}, m AS (SELECT *, avg(x) OVER (PARTITION BY feature) AS mu FROM lng), "
    shapes = (
        "sk AS (SELECT avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS v FROM m GROUP BY feature), "
        "ku AS (SELECT avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3 AS v FROM m GROUP BY feature)"
    )
    flags = """fl AS (SELECT l_returnflag AS v, l_linestatus AS t, count(*)::DOUBLE AS c FROM src WHERE l_returnflag <> '' GROUP BY ALL),
fv AS (SELECT v, sum(c) AS c FROM fl GROUP BY v), fp AS (SELECT c / sum(c) OVER () AS p FROM fv),
en AS (SELECT -sum(p * log2(p)) / (SELECT log2(count(*)) FROM src) AS v FROM fp),
fj AS (SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY v) AS a, sum(c) OVER (PARTITION BY t) AS b FROM fl WHERE t <> ''),
mi AS (SELECT sum(c / n * ln(c * n / (a * b))) AS v FROM fj),
lc AS (SELECT count(*)::DOUBLE AS c FROM src WHERE l_linestatus <> '' GROUP BY l_linestatus), lp AS (SELECT c / sum(c) OVER () AS p FROM lc)"""
    cells = [
        ({"number_of_instances": "count(*)", "log_number_of_instances": "ln(count(*))", "number_of_missing_values": _miss,
          "missing_values_ratio": f"({_miss})::DOUBLE / (count(*) * 6)", "sparsity": f"({_sparse})::DOUBLE / (count(*) * 6)",
          "number_of_features": "5", "log_number_of_features": "ln(5)", "dataset_ratio": "5.0::DOUBLE / count(*)",
          "log_dataset_ratio": "ln(5.0::DOUBLE / count(*))",
          "sparsity_on_numeric_columns": "(" + " + ".join(f"count(*) FILTER (WHERE {c} = 0)" for c in LINE) + ")::DOUBLE / (count(*) * 4)"}, "src"),
        ({"number_of_classes": "count(*)", "entropy_of_classes": "-sum(p * log2(p))"}, "lp"),
        (six("skewness"), "sk"), (six("kurtosis"), "ku"),
        (six("correlation", "CASE WHEN i <> j THEN v END", min="min(v)", max="max(v)"), "co"),
        (six("covariance"), "cv"), (six("entropy"), "en"), (six("mutual_information"), "mi"),
    ]
    pairs = ", ".join(_pairs("src", fn).replace("q AS", f"{n} AS", 1) for n, fn in (("co", "corr"), ("cv", "covar_samp")))
    ones = [f"one{i} AS (SELECT {', '.join(f'({e})::DOUBLE AS {k}' for k, e in values.items())} FROM {table})" for i, (values, table) in enumerate(cells)]
    out = [f"SELECT '{k}' AS metafeature, {r6(k, 'value')} FROM one{i}" for i, (values, _) in enumerate(cells) for k in values]
    return f"WITH {src}, {moments}{shapes}, {flags}, {pairs}, {', '.join(ones)} " + " UNION ALL ".join(out)


O["search_resume"] = """SELECT dataset, measure, 3::BIGINT AS ranked, 3::BIGINT AS evaluated,
CASE WHEN dataset = 'part' THEN 3 ELSE 0 END::BIGINT AS ran_again, 0::BIGINT AS differ
FROM (SELECT DISTINCT 'customer' AS dataset FROM customer UNION ALL SELECT DISTINCT 'part' FROM part), (VALUES ('calinski_harabasz'), ('davies_bouldin')) AS m(measure)"""
O["mf_vector_scaled"] = _every_group()
O["mfx_general"] = "WITH b AS (SELECT " + " + ".join(f"(count(DISTINCT {c}) = 2)::INT" for c in [*LINE, "l_returnflag"]) + " AS nb FROM lineitem)" + rows(
    {
        "nr_inst": "count(*)", "nr_attr": "5", "attr_to_inst": "5.0::DOUBLE / count(*)", "inst_to_attr": "count(*) / 5.0::DOUBLE",
        "nr_num": "4", "nr_cat": "1", "nr_bin": "any_value(nb)", "num_to_cat": "4", "cat_to_num": "0.25",
    },
    "lineitem, b",
)
O["mfx_location"] = f"""WITH {long('lineitem')},
q AS (SELECT feature, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM lng GROUP BY feature)
SELECT feature, round(avg(x), 7) + 0.0 AS mean, {r6('quantile_cont(x, 0.5)', 'median')},
{r6('CASE WHEN min(x) > 0 THEN exp(avg(CASE WHEN x > 0 THEN ln(x) END)) END', 'g_mean')},
{r6('CASE WHEN min(x) > 0 THEN count(x) / sum(CASE WHEN x > 0 THEN 1 / x END) END', 'h_mean')},
round(avg(x) FILTER (WHERE x >= a AND x <= b), 7) + 0.0 AS t_mean
FROM lng JOIN q USING (feature) GROUP BY feature"""
O["mfx_spread"] = f"""WITH {LINE_SCALED}, {long('line')},
q AS (SELECT feature, quantile_cont(x, 0.5) AS m FROM lng GROUP BY feature)
SELECT feature, {r6('var_samp(x)', 'var')}, {r6('stddev_samp(x)', 'sd')}, {r6('min(x)', 'min')}, {r6('max(x)', 'max')},
{r6('max(x) - min(x)', 'range')}, {r6('quantile_cont(x, 0.75) - quantile_cont(x, 0.25)', 'iq_range')},
{r6('1.4826 * quantile_cont(abs(x - m), 0.5)', 'mad')} FROM lng JOIN q USING (feature) GROUP BY feature"""
O["mfx_shape"] = (
    _moments
    + f"q AS (SELECT feature, {r6('avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5)', 'skewness')}, "
    + f"{r6('avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) - 3', 'kurtosis')}, "
    + f"{r6('(count(*)::DOUBLE / count(DISTINCT x) - 1) / (count(*) - 1)', 'sparsity')} FROM m GROUP BY feature) SELECT * FROM q"
)
O["mfx_pairs"] = (
    f"WITH {LINE_SCALED}, q AS ("
    + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, {r6(f'abs(corr({LINE[i]}, {LINE[j]}))', 'cor')}, {r6(f'abs(covar_samp({LINE[i]}, {LINE[j]}))', 'cov')} FROM line"
        for i in range(4) for j in range(i + 1, 4)
    )
    + ") SELECT * FROM q"
)
O["mfx_correlated_share"] = f"WITH {_pairs('lineitem', 'corr')}" + rows(
    {"nr_cor_attr": "count(*) FILTER (WHERE i < j AND abs(v) >= 0.5) / (count(*) FILTER (WHERE i < j))::DOUBLE"}, "q"
)
O["mfx_outliers"] = (
    f"WITH {long('lineitem')}, q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM lng GROUP BY feature), "
    "f AS (SELECT feature, max((x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a))::INT) AS f FROM lng JOIN q USING (feature) GROUP BY feature)"
    + rows({"nr_outliers": "sum(f)"}, "f")
)


def _binned(table: str, cols) -> str:
    """Equal-width bins in long form with a row number."""
    base = f"src AS (SELECT *, row_number() OVER () AS rid FROM {table}), nb AS (SELECT ceil(pow(count(*), 1.0 / 3) - 1e-9) AS k FROM {table})"
    parts = [
        f"SELECT rid, {i} AS idx, '{c}' AS feature, CASE WHEN hi = lo THEN 0 ELSE least(floor(({c}::DOUBLE - lo) / (hi - lo) * k), k - 1) END::BIGINT AS bin "
        f"FROM src, nb, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {table})"
        for i, c in enumerate(cols)
    ]
    return base + ", b AS (" + " UNION ALL ".join(parts) + ")"


O["mfx_attr_ent"] = f"""WITH {_binned('lineitem', LINE)}, c AS (SELECT feature, bin, count(*)::DOUBLE AS c FROM b GROUP BY ALL),
p AS (SELECT feature, c / sum(c) OVER (PARTITION BY feature) AS p FROM c)
SELECT feature, {r6('-sum(p * log2(p))', 'attr_ent')} FROM p GROUP BY feature"""
O["mfx_attr_conc"] = f"""WITH {_binned('lineitem', LINE)},
c AS (SELECT x.feature AS a, y.feature AS b, x.bin AS i, y.bin AS j, count(*)::DOUBLE AS c FROM b x JOIN b y ON x.rid = y.rid AND x.feature <> y.feature GROUP BY ALL),
p AS (SELECT a, b, i, j, c / sum(c) OVER (PARTITION BY a, b) AS p FROM c),
ri AS (SELECT a, b, i, sum(p) AS r FROM p GROUP BY ALL), cj AS (SELECT a, b, j, sum(p) AS s FROM p GROUP BY ALL),
q AS (SELECT a, b, sum(p * p / r) AS q FROM p JOIN ri USING (a, b, i) GROUP BY ALL), s AS (SELECT a, b, sum(s * s) AS s FROM cj GROUP BY ALL)
SELECT a, b, {r6('(q - s) / (1 - s)', 'attr_conc')} FROM q JOIN s USING (a, b)"""
_PC = ["p_size", "p_retailprice"]
O["mfx_one_itemset"] = f"WITH {_binned('part', _PC)}, n AS (SELECT count(*)::DOUBLE AS n FROM part) SELECT feature, bin, {r6('count(*) / any_value(n)', 'share')} FROM b, n GROUP BY feature, bin"
O["mfx_two_itemset"] = f"""WITH {_binned('part', _PC)}, n AS (SELECT count(*)::DOUBLE AS n FROM part),
s AS (SELECT idx, feature, bin, count(*) AS c FROM b GROUP BY ALL),
both_ AS (SELECT x.feature AS fa, x.bin AS ba, y.feature AS fb, y.bin AS bb, count(*) AS c FROM b x JOIN b y ON x.rid = y.rid AND x.idx < y.idx GROUP BY ALL)
SELECT x.feature AS fa, x.bin AS ba, y.feature AS fb, y.bin AS bb, {r6('(x.c + y.c - 2 * coalesce(t.c, 0)) / n', 'share')}
FROM s x JOIN s y ON x.idx < y.idx CROSS JOIN n LEFT JOIN both_ t ON t.fa = x.feature AND t.ba = x.bin AND t.fb = y.feature AND t.bb = y.bin"""
_sum = {
    "count": "count(*)", "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "quantile_cont(v, 0.5)",
    "sd": "stddev_samp(v)", "var": "var_samp(v)", "range": "max(v) - min(v)",
    "iq_range": "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)",
    "skewness": "avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5)", "kurtosis": "avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) - 3",
    "q_0": "min(v)", "q_25": "quantile_cont(v, 0.25)", "q_50": "quantile_cont(v, 0.5)", "q_75": "quantile_cont(v, 0.75)", "q_100": "max(v)",
    **{f"hist_{i}": f"count(*) FILTER (WHERE least(floor((v - lo) / (hi - lo) * 10), 9) = {i}) / count(*)::DOUBLE" for i in range(10)},
}
O["mfx_summary"] = (
    f"WITH {WIDE}, q AS (SELECT j, var_samp(v0) AS v FROM raw GROUP BY j), "
    "w AS (SELECT v, avg(v) OVER () AS mu, min(v) OVER () AS lo, max(v) OVER () AS hi FROM q), one AS (SELECT "
    + ", ".join(f'({e})::DOUBLE AS "{k}"' for k, e in _sum.items())
    + " FROM w) "
    + " UNION ALL ".join(f"SELECT 'var' AS feature, '{k}' AS summary, round(\"{k}\", 6) + 0.0 AS value FROM one" for k in _sum)
)

# ---------------------------------------------------------------- pairs and neighbours

O["pair_distance"] = f"""WITH {WIDE} SELECT a.vec_id, b.label, {r6('avg(list_distance(a.x, b.x))', 'mean_dist')}
FROM vec a, vec b GROUP BY a.vec_id, b.label"""
O["rbf_degree"] = f"""WITH {WIDE} SELECT a.vec_id, {r6(f'sum(exp(-pow(list_distance(a.x, b.x), 2) / {P}))', 'degree')} FROM vec a, vec b GROUP BY a.vec_id"""
O["knn_graph"] = f"WITH {KNN} SELECT src, dst, {r6('d', 'd')} FROM knn"
O["knn_part"] = f"""WITH {PART}, d AS (SELECT a.p_partkey, b.p_partkey AS o, sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2)) AS d FROM pts a JOIN pts b ON a.p_partkey <> b.p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, o) AS r FROM d)
SELECT p_partkey, {r6('max(d)', 'kth')}, {r6('sum(d)', 'total')} FROM r WHERE r <= 5 GROUP BY p_partkey"""
O["heat_graph"] = f"WITH {KNN} SELECT src, dst, {r6('exp(-d * d)', 'w')} FROM knn"
O["graph_laplacian"] = f"""WITH {KNN}, e AS (SELECT src, dst, max(w) AS w FROM
(SELECT src, dst, exp(-d * d) AS w FROM knn UNION ALL SELECT dst, src, exp(-d * d) FROM knn) GROUP BY src, dst),
g AS (SELECT src AS id, sum(w) AS g FROM e GROUP BY src)
SELECT src, dst, {r6('-w / sqrt(a.g * b.g)', 'l')} FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst
UNION ALL SELECT id, id, 1.0 FROM g"""
_eps = "sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2)) <= {e}"
O["eps_join"] = f"WITH {PART} SELECT a.p_partkey, count(*) AS neighbours FROM pts a JOIN pts b ON {_eps.format(e=0.1)} GROUP BY a.p_partkey"
O["cluster_jaccard"] = f"""WITH c AS (SELECT l_returnflag AS a, l_linenumber::BIGINT AS b, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT a, b, {r6('c / (sum(c) OVER (PARTITION BY a) + sum(c) OVER (PARTITION BY b) - c)::DOUBLE', 'jaccard')} FROM c"""
O["assign_nearest"] = f"""WITH {WIDE}, m AS (SELECT label, j, avg(v) AS v FROM z GROUP BY ALL),
c AS (SELECT label, list(v ORDER BY j) AS c FROM m GROUP BY label),
k AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS k FROM c),
d AS (SELECT vec_id, k, list_distance(x, c) AS d FROM vec, k)
SELECT vec_id, nearest, {r6('d', 'dist')} FROM (SELECT vec_id, k AS nearest, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d) WHERE r = 1"""

# ---------------------------------------------------------------- linear algebra and selection

O["scatter_matrices"] = f"""WITH {WIDE}, c AS (SELECT vec_id, label, j, v - avg(v) OVER (PARTITION BY label, j) AS v FROM z)
SELECT a.label, a.j::BIGINT AS i, b.j::BIGINT AS j, {r6('sum(a.v * b.v)', 'within')} FROM c a JOIN c b USING (vec_id) GROUP BY a.label, a.j, b.j"""
_var = "SELECT 'e' || j AS feature, j::BIGINT AS idx, round(round(var_pop(v0), 3), 6) + 0.0 AS score FROM raw GROUP BY j"
_topk = "row_number() OVER (ORDER BY score DESC, idx DESC)"
O["select_topk"] = f"WITH {WIDE}, s AS ({_var}) SELECT feature, idx, score, {_topk} <= 20 AS selected FROM s"
O["select_threshold"] = f"WITH {WIDE}, s AS ({_var}) SELECT feature, idx, score, score > 0.015 AS selected FROM s"
O["select_topk_project"] = f"""WITH {WIDE}, s AS ({_var}), k AS (SELECT * FROM (SELECT *, {_topk} AS r FROM s) WHERE r <= 5)
SELECT vec_id, feature, {r6('v0', 'value')} FROM raw JOIN k ON raw.j = k.idx"""
_SPEC = f"""{WIDE}, s AS (SELECT a.vec_id AS i, b.vec_id AS l, exp(-pow(list_distance(a.x, b.x), 2) / {P}) AS s FROM vec a, vec b),
g AS (SELECT i AS vec_id, sum(s) AS d FROM s GROUP BY i), zz AS (SELECT vec_id, j, v, v / d AS y, d FROM z JOIN g USING (vec_id)),
sy AS (SELECT s.i AS vec_id, zz.j, sum(s.s * zz.y) AS t FROM s JOIN zz ON zz.vec_id = s.l GROUP BY s.i, zz.j),
q AS (SELECT zz.j, sum(zz.y * sy.t) AS cut, sum(zz.v * zz.v / zz.d) AS nrm, sum(zz.v / zz.d) AS mass FROM zz JOIN sy USING (vec_id, j) GROUP BY zz.j)"""
O["fs_normalized_cut"] = f"WITH {_SPEC} SELECT 'e' || j AS feature, j::BIGINT AS idx, {r6('1 - cut / nrm', 'score')} FROM q"
O["fs_generic_spec"] = f"WITH {_SPEC} SELECT 'e' || j AS feature, j::BIGINT AS idx, {r6('(1 - cut / nrm) / (1 - mass / sqrt(nrm))', 'score')} FROM q"
O["wkmeans_weights"] = f"""WITH {WIDE}, c AS (SELECT j, abs(v - avg(v) OVER (PARTITION BY label, j)) AS a FROM z),
d AS (SELECT j, sum(a) AS d FROM c GROUP BY j)
SELECT 'e' || j AS feature, j::BIGINT AS idx, {r6('(1 / d) / sum(1 / d) OVER ()', 'score')} FROM d"""


def _objective(cte: str) -> str:
    """Sum over ordered pairs of |x - y| by ranks, overall and inside labels."""
    return f"""r AS (SELECT feature, label, x, row_number() OVER (PARTITION BY feature ORDER BY x) AS ra, count(*) OVER (PARTITION BY feature) AS na,
row_number() OVER (PARTITION BY feature, label ORDER BY x) AS rl, count(*) OVER (PARTITION BY feature, label) AS nl FROM {cte}),
o AS (SELECT feature, sum(2 * (2 * ra - na - 1) * x / na) - sum(2 * (2 * rl - nl - 1) * x / nl) AS objective FROM r GROUP BY feature)"""


_WOBJ = f"{WIDE}, f AS (SELECT 'e' || j AS feature, label, v AS x FROM z), {_objective('f')}"
O["sparse_kmeans_objective"] = f"WITH {_WOBJ} SELECT feature, {r6('objective', 'objective')} FROM o"
O["sparse_kmeans_objective_line"] = (
    f"WITH {LINE_SCALED}, {long('line', keep='label, ')}, {_objective('lng')} SELECT feature, {r6('objective', 'objective')} FROM o"
)
O["soft_weights"] = f"""WITH {_WOBJ}, s AS (SELECT feature, greatest(greatest(objective, 0) - 2.0, 0) AS s FROM o)
SELECT feature, {r6('s / sqrt(sum(s * s) OVER ())', 'weight')} FROM s"""
O["soft_threshold_rows"] = f"SELECT event_id, {r6('greatest(greatest(value - 20, 0) - 5.0, 0)', 's')} FROM events"

# ---------------------------------------------------------------- clustering

O["birch_summaries"] = f"""WITH {PART}, c AS (SELECT *, floor(x0 / (1 / sqrt(2))) AS a, floor(x1 / (1 / sqrt(2))) AS b FROM pts)
SELECT count(*) AS n, {r6('sum(x0)', 's0')}, {r6('sum(x1)', 's1')}, {r6('sum(x0 * x0 + x1 * x1)', 'ss')} FROM c GROUP BY a, b"""
O["birch_features"] = f"""WITH {PART} SELECT count(*) AS n, {r6('sum(x0)', 's0')}, {r6('sum(x1)', 's1')}, {r6('sum(x0 * x0 + x1 * x1)', 'ss')},
0::BIGINT AS too_wide, count(*) AS members, 1::BIGINT AS features_per_row FROM pts"""
O["gmm_estep"] = f"""WITH {PART}, m AS (SELECT p_type, count(*) / (SELECT count(*) FROM pts)::DOUBLE AS w, avg(x0) AS m0, avg(x1) AS m1,
var_pop(x0) + 1e-6 AS v0, var_pop(x1) + 1e-6 AS v1 FROM pts GROUP BY p_type),
l AS (SELECT p_partkey, ln(w) - 0.5 * (ln(2 * pi() * v0) + ln(2 * pi() * v1)) - 0.5 * (pow(x0 - m0, 2) / v0 + pow(x1 - m1, 2) / v1) AS lp FROM pts, m),
t AS (SELECT p_partkey, lp, max(lp) OVER (PARTITION BY p_partkey) AS top FROM l)
SELECT p_partkey, {r6('any_value(top) + ln(sum(exp(lp - top)))', 'log_likelihood')}, {r6('1 / sum(exp(lp - top))', 'max_responsibility')} FROM t GROUP BY p_partkey"""
_L1 = "abs(a.x0 - b.x0) + abs(a.x1 - b.x1) <= {e}"


def _core_graph(near: str, least: int) -> str:
    return f"""{PART}, nb AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM pts a JOIN pts b ON {near}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {least})"""


def _dbscan(near: str, least: int, key: str = "p_partkey") -> str:
    return f"""WITH RECURSIVE {_core_graph(near, least)}, ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.root FROM reach JOIN ce ON ce.a = reach.id WHERE reach.root < ce.b),
comp AS (SELECT id, min(root) AS comp FROM reach GROUP BY id),
lab AS (SELECT id, dense_rank() OVER (ORDER BY comp) - 1 AS label FROM comp),
border AS (SELECT nb.a AS id, min(lab.label) AS label FROM nb JOIN lab ON lab.id = nb.b WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
SELECT p_partkey AS {key}, coalesce(lab.label, border.label, -1)::BIGINT AS label FROM pts LEFT JOIN lab ON lab.id = p_partkey LEFT JOIN border ON border.id = p_partkey"""


O["dbscan_core"] = f"WITH {_core_graph(_eps.format(e=0.1), 8)} SELECT p_partkey, p_partkey IN (SELECT id FROM core) AS core FROM pts"
O["cl_dbscan"] = _dbscan(_eps.format(e=0.1), 8)
O["cl_optics_dbscan"] = _dbscan(_eps.format(e=0.15), 10, "id")
O["cl_optics_dbscan_manhattan"] = _dbscan(_L1.format(e=0.15), 10, "id")
O["linkage_height"] = _dbscan(_eps.format(e=0.04), 1, "id")
O["linkage_height_manhattan"] = _dbscan(_L1.format(e=0.05), 1, "id")
O["eps_join_manhattan"] = f"WITH {PART} SELECT a.p_partkey, count(*) AS neighbours FROM pts a JOIN pts b ON {_L1.format(e=0.1)} GROUP BY a.p_partkey"


def _core_distance(d: str) -> str:
    return f"""WITH {PART}, d AS (SELECT a.p_partkey, {d} AS d FROM pts a, pts b),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d) AS r FROM d)
SELECT p_partkey, {r6('d', 'core_distance')} FROM r WHERE r = 10"""


O["optics_core_distance"] = _core_distance("sqrt(pow(a.x0 - b.x0, 2) + pow(a.x1 - b.x1, 2))")
O["optics_core_distance_manhattan"] = _core_distance("abs(a.x0 - b.x0) + abs(a.x1 - b.x1)")
O["mean_shift_step"] = f"""WITH {PART}, u AS (SELECT min(p_partkey) AS p_partkey, x0, x1 FROM pts GROUP BY x0, x1)
SELECT a.p_partkey, count(*) AS n, {r6('avg(b.x0)', 'x0')}, {r6('avg(b.x1)', 'x1')}
FROM u a JOIN pts b ON {_eps.format(e=0.5)} GROUP BY a.p_partkey"""
_kern = {
    "rbf": "exp(-pow(d, 2))", "laplacian": "exp(-l1)", "poly": "greatest(pow(ip + 1, 3), 0)", "sigmoid": "greatest(tanh(ip + 1), 0)",
}
O["affinity_kernels"] = f"""WITH {RAWVEC}, k AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d, list_inner_product(a.x, b.x) AS ip,
list_sum([abs(a.x[i] - b.x[i]) for i in range(1, {P + 1})]) AS l1 FROM rawvec a, rawvec b) """ + " UNION ALL ".join(
    f"SELECT vec_id, '{k}' AS kernel, {r6(f'sum({e})', 'row_sum')} FROM k GROUP BY vec_id" for k, e in _kern.items()
)

# ---------------------------------------------------------------- measures

O["measure_silhouette"] = f"""WITH {WIDE}, n AS (SELECT label, count(*) AS n FROM vec GROUP BY label),
t AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM vec a, vec b GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN label = o THEN n END) AS n, max(CASE WHEN label = o THEN s END) AS own, min(CASE WHEN label <> o THEN s / n END) AS b FROM t GROUP BY vec_id),
q AS (SELECT CASE WHEN n = 1 THEN 0 ELSE (b - own / (n - 1)) / greatest(b, own / (n - 1)) END AS s FROM p)
SELECT {r6('avg(s)', 's')}, {r6('(1 - avg(s)) / 2', 'measure')} FROM q"""
_sq = {c: f"x{i}" for i, c in enumerate(LINE)}
O["measure_silhouette_squared"] = f"""WITH {LINE_SCALED}, r AS (SELECT label, {', '.join(f'{c} AS {x}' for c, x in _sq.items())}, row_number() OVER () AS rid FROM line),
c AS (SELECT label AS o, count(*) AS n, avg({' + '.join(f'{x} * {x}' for x in _sq.values())}) AS q, {', '.join(f'avg({x}) AS c{x}' for x in _sq.values())} FROM r GROUP BY label),
d AS (SELECT rid, label, o, n, {' + '.join(f'{x} * {x}' for x in _sq.values())} - 2 * ({' + '.join(f'{x} * c{x}' for x in _sq.values())}) + q AS d FROM r, c),
p AS (SELECT rid, max(CASE WHEN label = o THEN d * n / (n - 1) END) AS a, min(CASE WHEN label <> o THEN d END) AS b FROM d GROUP BY rid)
SELECT {r6('avg((b - a) / greatest(a, b))', 's')}, {r6('(1 - avg((b - a) / greatest(a, b))) / 2', 'measure')} FROM p"""
O["measure_silhouette_sampled"] = f"""WITH {WIDE}, n AS (SELECT label, count(*) AS n FROM vec GROUP BY label),
u AS (SELECT * FROM vec ORDER BY md5('42:' || vec_id::VARCHAR) LIMIT 300),
t AS (SELECT a.vec_id, a.label, b.label AS o, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM u a, vec b GROUP BY ALL),
p AS (SELECT vec_id, max(CASE WHEN label = o THEN n END) AS n, max(CASE WHEN label = o THEN s END) AS own, min(CASE WHEN label <> o THEN s / n END) AS b FROM t GROUP BY vec_id),
q AS (SELECT CASE WHEN n = 1 THEN 0 ELSE (b - own / (n - 1)) / greatest(b, own / (n - 1)) END AS s FROM p),
r AS (SELECT avg(s) AS s, count(*) AS n, coalesce(1.96 * stddev_samp(s) / sqrt(count(*)) * sqrt(((SELECT sum(n) FROM n) - count(*)) / ((SELECT sum(n) FROM n) - 1)), 0) AS half FROM q)
SELECT {r6('s', 's')}, {r6('s - half', 'low')}, {r6('s + half', 'high')}, {r6('(1 - s) / 2', 'measure')}, n FROM r"""
O["measure_davies_bouldin"] = f"""WITH {WIDE}, m AS (SELECT label, j, avg(v) AS v FROM z GROUP BY ALL), c AS (SELECT label, list(v ORDER BY j) AS c FROM m GROUP BY label),
s AS (SELECT label, avg(list_distance(x, c)) AS s FROM vec JOIN c USING (label) GROUP BY label), k AS (SELECT * FROM c JOIN s USING (label)),
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM k a JOIN k b ON a.label <> b.label GROUP BY a.label)
SELECT {r6('avg(r)', 'raw')}, {r6('tanh(avg(r))', 'measure')} FROM r"""
_w = " + ".join(f"n * var_{c}" for c in LINE)
_b = " + ".join(f"n * pow(m_{c} - g_{c}, 2)" for c in LINE)
_CL = f"""{LINE_SCALED}, c AS (SELECT label, count(*)::DOUBLE AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS var_{c}' for c in LINE)} FROM line GROUP BY label),
g AS (SELECT {', '.join(f'avg({c}) AS g_{c}' for c in LINE)} FROM line)"""
O["measure_calinski_harabasz"] = f"""WITH {_CL}, q AS (SELECT (sum({_b}) / (count(*) - 1)) / (sum({_w}) / (sum(n) - count(*))) AS r FROM c, g)
SELECT {r6('r', 'raw')}, {r6('1 - tanh(r)', 'measure')} FROM q"""
O["measure_degenerate"] = f"""WITH {_CL}, q AS (SELECT count(*) AS k, (sum({_b}) / (count(*) - 1)) / (sum({_w}) / (sum(n) - count(*))) AS r FROM c, g)
SELECT 'l_linenumber' AS labelling, k AS n_labels, round(1 - tanh(r), 6) AS measure FROM q
UNION ALL SELECT 'one', count(DISTINCT l_linenumber >= 0), 'inf'::DOUBLE FROM lineitem"""
O["kmeans_inertia"] = f"WITH {_CL} SELECT round(sum({_w}), 3) AS inertia FROM c"

# ---------------------------------------------------------------- search

_HIST = """h AS (SELECT event_type AS dataset, event_id AS candidate_id, 'C' || (user_id % 9) AS clusterer, 'S' || ((user_id // 9) % 7) AS selector, value AS score FROM events)"""
O["search_trajectory"] = f"""WITH {_HIST}, p AS (SELECT *, min(score) OVER (PARTITION BY dataset ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM h)
SELECT dataset, candidate_id, score FROM p WHERE b IS NULL OR score < b"""
O["search_leaderboard"] = f"""WITH {_HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score, candidate_id) AS rank FROM h)
SELECT dataset, rank, candidate_id, clusterer || '_' || selector AS pair, score FROM r WHERE rank <= 5"""
O["search_pairs"] = f"""WITH {_HIST}, n AS (SELECT 'C' || c AS clusterer, 'S' || s AS selector FROM range(9) t(c), range(7) u(s))
SELECT clusterer || '_' || selector AS pair, min(score) AS best, count(score) AS evaluations FROM n LEFT JOIN h USING (clusterer, selector) GROUP BY clusterer, selector"""

ORACLES = O
O["search_candidates"] = "SELECT row_number() OVER () - 1 AS candidate_id, true AS known_clusterer, true AS known_selector FROM customer"
O["load_csv"] = f"""SELECT o_orderkey, {r6('o_totalprice', 'o_totalprice')}, o_orderpriority, (o_custkey % 12)::BIGINT AS code FROM orders"""
O["spec_catalog"] = """SELECT * FROM (VALUES ('lineitem', 4, 1, 0, 5, true), ('orders', 1, 1, 1, 2, false), ('part', 2, 2, 0, 1, false),
('customer', 1, 1, 0, 2, false), ('events', 1, 1, 0, 3, false)) t(dataset, n_numerical, n_categorical, n_ordinal, n_ignored, has_target)
JOIN (SELECT 'lineitem' AS dataset, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events) c USING (dataset)"""
