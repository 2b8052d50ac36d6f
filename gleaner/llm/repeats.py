"""What the two repeat removers share: runs of windows with one anchor, classes of equal runs, spans per document.

Of the k-gram hashes in a window the smallest (rightmost of equals) is the window's anchor, so both places of a repeat have
the same anchor at the same distance. Consecutive windows with one anchor form a run; its reach is all they cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import column_type, gram_hashes, map_arrays, map_rows, raw_text, runs_of, small_side, union_spans, winnow


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, _row, _text): a row is known by its id and 64 bits of hash of its text, so ids may repeat."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_row"), raw_text(text_col).alias("_text"))


def same_row(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["id"]) & (left["_row"] == right["_row"])


def place():
    """Where a run starts, in the order of documents."""
    return F.struct(F.col("id").alias("id"), F.col("_row").alias("_row"), F.col("start").alias("start"))


def window_runs(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, last window start) of every run of an array of hashes."""
    if len(h) < length:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    grams = gram_hashes(h, gram)
    picked = winnow(grams, length - gram + 1)
    first, last = runs_of(picked)
    return grams[picked[first]], first, last


RUNS = "id {kind}, _row bigint, anchor bigint, reach bigint, start int, windows int"


def seeds_and_classes(docs: DataFrame, kind: str, runs_of_text: Callable) -> tuple[DataFrame, DataFrame]:
    """Runs whose anchor occurs again, and their classes (anchor, reach, least, n, windows).

    ``runs_of_text()`` gives a function of a text: (anchor, first, last, reach or None) arrays, reach being a hash of all that
    a run covers and left out where only anchors are asked for. Both steps are aggregations that combine before their
    exchange, and a join whose small side has one row per anchor.
    """

    def anchors(rows: Iterable[tuple]) -> Iterator[tuple]:
        runs = runs_of_text()
        for _, _, text in rows:
            anchor = runs(text, False)[0]
            if len(anchor):
                yield None, anchor.view(np.int64)

    def whole(rows: Iterable[tuple]) -> Iterator[tuple]:
        runs = runs_of_text()
        for key, row, text in rows:
            anchor, first, last, reach = runs(text, True)
            if n := len(anchor):
                yield key, np.full(n, row, np.int64), anchor.view(np.int64), reach.view(np.int64), first, last - first + 1

    seen = map_arrays(docs, "nothing int, anchor bigint", anchors)
    # Written first, so that the join below stands on two plain exchanges and a hot anchor can be split.
    again = cut(seen.groupBy("anchor").count().filter("count > 1").select("anchor"))
    seeds = cut(map_arrays(docs, RUNS.format(kind=kind), whole).join(again, "anchor"))
    classes = seeds.groupBy("anchor", "reach").agg(
        F.min(place()).alias("least"), F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows")
    )
    return seeds, cut(classes)


def open_classes(classes: DataFrame) -> DataFrame:
    """The first run of every class whose anchor has several classes, with their number."""
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return cut(
        classes.join(several, "anchor").select(
            "anchor", "reach", "n", "windows", "classes", "least.id", "least._row", "least.start"
        )
    )


def with_texts(docs: DataFrame, runs: DataFrame, *extra: str) -> DataFrame:
    """(id, _row, runs, _text): only the documents that hold one of ``runs`` move; each with the list of its runs."""
    held = F.struct("anchor", "start", "windows", *extra)
    lists = cut(runs.groupBy("id", "_row").agg(F.collect_list(held).alias("runs")))
    texts = docs.join(small_side(lists.select("id", "_row")), same_row(docs, lists), "left_semi")
    return texts.join(lists, same_row(texts, lists)).select(texts["id"], texts["_row"], "runs", "_text")


def unite(pieces: DataFrame, kind: str) -> DataFrame:
    """(id, _row, spans): the pieces (id, _row, start, end) of a document, overlapping and touching ones merged."""
    per_doc = cut(pieces.distinct()).groupBy("id", "_row").agg(F.collect_list(F.struct("start", "end")).alias("pieces"))

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, row, held in rows:
            yield key, row, [{"start": a, "end": b} for a, b in union_spans((x["start"], x["end"]) for x in held)]

    return cut(map_rows(per_doc, f"id {kind}, _row bigint, spans array<struct<start: int, end: int>>", each))


def rewrite(docs: DataFrame, spans: DataFrame, schema: str, keep: Callable[[bytes, list], tuple]) -> DataFrame:
    """``keep(text, spans)`` for every document; texts without spans stay where they are."""
    keys = small_side(spans.select("id", "_row"))
    hit = docs.join(keys, same_row(docs, spans), "left_semi")
    hit = hit.join(spans, same_row(hit, spans)).select(hit["id"], "_text", "spans")
    rest = docs.join(keys, same_row(docs, spans), "left_anti")
    rest = rest.select("id", "_text", F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"))

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text, held in rows:
            yield key, *keep(text, held or [])

    schema = f"id {column_type(docs, 'id')}, {schema}"
    return map_rows(hit, schema, each, flush=2_000).unionByName(map_rows(rest, schema, each, flush=2_000))
