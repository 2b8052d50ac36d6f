"""Ordered computations over groups of any size, without one task per group.

A range exchange on (group, order) puts consecutive rows into numbered chunks; per-chunk totals
are combined over the small chunk table and added back. No window ever spans a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut, parallelism


def _chunks(df: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    n = parts or parallelism(df.sparkSession)
    return cut(
        df.repartitionByRange(n, *order).select("*", F.spark_partition_id().cast("long").alias("_pid"))
    )


def running(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    value: str | Sequence[str],
    out: str | Sequence[str],
    how: str = "sum",
    parts: int | None = None,
) -> DataFrame:
    """Running sum (min, xor) of ``value`` *before* each row within its group; 0 (min: null) at the start.

    ``order`` must be unique within a group. Several values, with as many outs, share one exchange.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (list(value), list(out))
    fold = {"sum": F.sum, "min": F.min, "xor": F.bit_xor}[how]
    d = _chunks(df, [F.col(c) for c in [*groups, *order]], parts)
    before = W.partitionBy(*groups).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    each = range(len(values))
    offsets = (
        d.groupBy(*groups, "_pid")
        .agg(*[fold(v).alias(f"_t{i}") for i, v in enumerate(values)])
        .select(*groups, "_pid", *[fold(f"_t{i}").over(before).alias(f"_off{i}") for i in each])
    )
    inside = (
        W.partitionBy(*groups, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    own = {f"_in{i}": fold(v).over(inside) for i, v in enumerate(values)}
    j = d.withColumns(own).join(offsets, [*groups, "_pid"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    join = {
        "sum": lambda a, b: zero(a) + zero(b),
        "xor": lambda a, b: zero(a).bitwiseXOR(zero(b)),
        "min": lambda a, b: F.least(a, b),
    }[how]
    done = j.withColumns({o: join(f"_in{i}", f"_off{i}") for i, o in enumerate(outs)})
    return done.drop("_pid", *[f"{c}{i}" for c in ("_in", "_off") for i in each])


CHUNK_ROWS = 1_000_000


def chunks_for(df: DataFrame, rows: int = CHUNK_ROWS) -> int:
    """Chunks of about ``rows`` rows each, so that no task reads more of a larger table. Counts the rows: for stored tables."""
    return max(math.ceil(df.count() / rows), parallelism(df.sparkSession))


def with_row_id(df: DataFrame, order: Sequence[str], out: str = "row_id", parts: int | None = None):
    """Dense 0-based row numbers in a global order, by chunk offsets (no single-task window).

    One exchange: a chunk is sorted where the range exchange put it. ``parts`` chunks, see :func:`chunks_for`.
    """
    by = [F.col(c) for c in order]
    chunks = df.repartitionByRange(parts or parallelism(df.sparkSession), *by).sortWithinPartitions(*by)
    # The lower 33 bits count the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    d = cut(chunks.select("*", F.spark_partition_id().cast("long").alias("_pid"), place.alias("_in")))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = (  # one row per chunk
        d.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_t"))
        .select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    )
    return (
        d.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_in") + F.col("_off")).cast("long"))
        .drop("_pid", "_in", "_off")
    )


def exact_quantiles(long: DataFrame, key: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per key of a long table.

    Equal values collapse to counts before the exchange, then cumulative counts locate the two
    order statistics each quantile lies between. Returns (key, q0, q1, ...).
    """
    counts = (
        long.filter(F.col(value).isNotNull())
        .groupBy(key, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cum = running(counts, [key], [value], "_c", "_before")
    totals = cum.groupBy(key).agg(F.sum("_c").alias("_n"))
    j = cum.join(F.broadcast(totals), key)  # one row per column of the source table
    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}{i}"))
    g = j.groupBy(key).agg(F.first("_n").alias("_n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * frac).alias(f"q{i}"))
    return g.select(key, *out)


BRACKET = 100_000  # rows of a bracket whose values are exchanged
BINS = 1_024


def narrowed_quantiles(long: DataFrame, key: str, value: str, probs: Sequence[float], bracket: int = BRACKET) -> DataFrame:
    """What :func:`exact_quantiles` gives, for tables of few keys and many rows, without an exchange of the values.

    The order statistics that a quantile lies between are narrowed down by histograms: the counts of equal bins between the
    bounds of a bracket tell the bin that holds a rank, and the least and greatest value in it are the next bounds. Each
    round is one scan whose exchange holds at most ``BINS`` rows per bracket. A bracket of at most ``bracket`` rows is
    read out; one of equal values is settled. ``long`` is scanned a few times, so it should stand on a stored table. Infinite
    values lie outside of all brackets, NaN counts as greatest. Keys, brackets and bins are what the driver sees.
    """
    spark = long.sparkSession
    v = F.col(value).cast("double")
    rows = long.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), v.alias("_v"))
    finite = ~F.isnan("_v") & (F.abs("_v") < float("inf"))
    kind = long.schema[key].dataType.simpleString()
    totals = rows.groupBy("_k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") == float("-inf")).alias("low"), F.count_if(finite).alias("mid"),
        F.count_if(F.col("_v") == float("inf")).alias("high"),
        F.min(F.when(finite, F.col("_v"))).alias("a"), F.max(F.when(finite, F.col("_v"))).alias("b"),
    ).collect()

    known: dict[tuple, float] = {}  # (key, rank) -> value
    open_: list[tuple] = []  # (key, least, greatest, rows below, rows inside, ranks)
    for t in totals:
        ranks = {r for q in probs for r in (math.floor(q * (t["n"] - 1)), math.ceil(q * (t["n"] - 1)))}
        inside = {r for r in ranks if t["low"] <= r < t["low"] + t["mid"]}
        for r in ranks - inside:
            top = float("inf") if r < t["low"] + t["mid"] + t["high"] else float("nan")
            known[t["_k"], r] = float("-inf") if r < t["low"] else top
        if inside:
            open_.append((t["_k"], t["a"], t["b"], t["low"], t["mid"], inside))

    def settle(held: list[tuple]) -> list[tuple]:
        known.update({(k, r): a for k, a, b, _, _, ranks in held if a == b for r in ranks})
        return [x for x in held if x[1] < x[2]]

    def within(held: list[tuple]) -> DataFrame:
        bounds = spark.createDataFrame(
            [(i, k, float(a), float(b), int(below)) for i, (k, a, b, below, _, _) in enumerate(held)],
            f"_i long, _k {kind}, _a double, _b double, _below long",
        )
        inside = F.col("_v").between(F.col("_a"), F.col("_b"))
        return rows.join(F.broadcast(bounds), "_k").filter(inside)  # a few brackets per key

    open_ = settle(open_)
    small = [x for x in open_ if x[4] <= bracket]
    large = [x for x in open_ if x[4] > bracket]
    while large:
        place = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        slot = F.least(F.floor(place * BINS), F.lit(BINS - 1)).cast("long")
        found = within(large).groupBy("_i", slot.alias("_s")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b")
        )
        bins: dict[int, list] = {}
        for r in sorted(found.collect()):
            bins.setdefault(r["_i"], []).append(r)
        next_ = []
        for i, (k, _, _, below, _, ranks) in enumerate(large):
            for r in bins[i]:
                own = {x for x in ranks if below <= x < below + r["c"]}
                if own:
                    next_.append((k, r["a"], r["b"], below, r["c"], own))
                below += r["c"]
        open_ = settle(next_)
        small += [x for x in open_ if x[4] <= bracket]
        large = [x for x in open_ if x[4] > bracket]
    if small:
        asked = spark.createDataFrame([(i, int(r)) for i, x in enumerate(small) for r in x[5]], "_i long, _r long")
        counts = within(small).groupBy("_i", "_k", "_v", "_below").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(W.partitionBy("_i").orderBy("_v")) + F.col("_below")  # at most ``bracket`` rows
        at = counts.withColumn("_upto", upto).join(F.broadcast(asked), "_i")
        hit = at.filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("c")))
        known.update({(r["_k"], r["_r"]): r["_v"] for r in hit.select("_k", "_r", "_v").collect()})

    out = []
    for t in totals:
        line = [t["_k"]]
        for q in probs:
            at = q * (t["n"] - 1)
            lo, hi = known[t["_k"], math.floor(at)], known[t["_k"], math.ceil(at)]
            line.append(lo + (hi - lo) * (at - math.floor(at)))
        out.append(tuple(line))
    names = ", ".join(f"q{i} double" for i in range(len(probs)))
    return spark.createDataFrame(out, f"_k {kind}, {names}").withColumnRenamed("_k", key)
