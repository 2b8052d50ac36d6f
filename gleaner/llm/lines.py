"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host if more than ``percent`` of the host's pages hold it, and at least ``min_pages`` do. Lines are
counted by 96 bits of hash, once per page, combined before the exchange; a host that holds a third of all pages is spread by
its lines. A host has at most 100 / percent times its mean number of lines per page of such lines, so one list per host is
small. Lists are broadcast if all of them together are below a checked size; else pages join them on the host and a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import unused

PERCENT, MIN_PAGES = 10, 5
MAX_LISTED = 500_000  # listed lines up to which the lists are broadcast, 24 bytes each
SALTS = 64


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(
    pages: DataFrame, host_col: str, text_col: str, percent: int = PERCENT, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, lines): keys of the boilerplate lines of each host that has some."""
    own = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("_text"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    distinct = F.array_distinct(F.filter(_lines("_text"), lambda x: F.trim(x) != ""))
    held = own.select("host", F.explode(distinct).alias("line")).select("host", _key(F.col("line")).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    frequent = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).filter(F.col("n") * 100 > F.col("total") * percent)
    return frequent.groupBy(counts["host"]).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    pages: DataFrame, host_col: str, text_col: str, percent: int = PERCENT, min_pages: int = MIN_PAGES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of the text; all other columns stay as they are.

    ``counts`` names two columns to add: lines before and lines dropped. Lines end at a line feed and are compared exactly;
    lines of nothing but spaces are neither counted nor dropped. A null host is a host like any other, a null text has no
    lines and stays null, and a text may become empty. Repeated rows count as pages of their own. An empty table gives no rows.
    """
    host, held, salt, own_salt = unused(pages, "__host", "__listed", "__salt", "__own")
    lists = cut(boilerplate(pages, host_col, text_col, percent, min_pages).select(
        F.col("host").alias(host), F.col("lines").alias(held)
    ))
    listed = lists.agg(F.sum(F.size(held))).first()[0] or 0
    if listed <= MAX_LISTED:
        joined = pages.join(F.broadcast(lists), F.col(host_col).eqNullSafe(F.col(host)), "left")
    else:
        salted = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = pages.withColumn(own_salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        same = F.col(host_col).eqNullSafe(F.col(host)) & (F.col(own_salt) == F.col(salt))
        joined = own.join(salted, same, "left")
    lines = _lines(text_col)
    stay = F.filter(lines, lambda x: ~F.array_contains(F.col(held), _key(x)))
    kept = F.when(F.col(held).isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in pages.columns]
    if counts:
        before = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
        gone = F.when(F.col(held).isNull() | F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size(stay))
        columns += [before.cast("bigint").alias(counts[0]), gone.cast("bigint").alias(counts[1])]
    return joined.select(*columns)


#: The same result for ``documents`` with its source as the host, for DuckDB.
SQL = """
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS line FROM d)
  GROUP BY source, line),
lists AS (
  SELECT c.source, list(c.line) AS listed
  FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= 5 AND c.n * 100 > t.total * 10 GROUP BY c.source),
kept AS (
  SELECT d.doc_id, len(d.ls) AS n_lines,
    list_filter(d.ls, lambda x: NOT list_contains(coalesce(l.listed, CAST([] AS VARCHAR[])), x)) AS stay
  FROM d LEFT JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines - len(stay), 0) AS n_dropped,
  sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256
FROM kept
"""
