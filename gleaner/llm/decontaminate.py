"""Benchmark decontamination by winnowing.

Seeds: the minimum 5-gram hash of every 6 consecutive ones, so any 10 shared words share a seed. Test items are a query
set: their windows (10 consecutive words, or the whole of a shorter item) form an index of seeds, windows and owners, cut
into blocks of at most ``BLOCK_WORDS`` words. A block is the only thing that is broadcast, so its size is bounded whatever
the benchmark holds; one pass over the documents is made per block, and texts never leave the task that reads them. A seed hit
is extended both ways: all windows around it are looked up in the index and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import cut
from .common import LOW, TOP, WordHashes, column_type, gram_hashes, map_rows, raw_text, runs_of, union_spans, winnow

WINDOW = 10
GRAM = 5
BLOCK_WORDS = 500_000  # an index of some 50 MB
PIECE_WORDS = 20_000

# A-Z to a-z, other ASCII characters that are neither digits nor letters to space; bytes from 0x80 on are letters.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def build_index(pieces: Iterable[tuple[object, int, list[bytes]]], window: int, gram: int) -> list[dict]:
    """Windows of a block of item pieces by seed, one part per window length: plain arrays, ready to be broadcast.

    ``pieces``: (item id, number of words of the whole item, words of the piece), at most ``BLOCK_WORDS`` words.
    """
    hashes = WordHashes()
    by_length: dict[int, list[tuple[np.ndarray, object]]] = {}
    for item, total, words in pieces:
        if not words:
            continue
        h = hashes.array(words)
        size = min(window, total)
        by_length.setdefault(size, []).extend((h[a : a + size], item) for a in range(len(h) - size + 1))
    # Windows shorter than the seed guarantee are their own seeds.
    return [_part(size, gram if size == window else size, found) for size, found in sorted(by_length.items())]


def _part(size: int, gram: int, found: list[tuple[np.ndarray, object]]) -> dict:
    words = np.stack([w for w, _ in found])
    owners = np.empty(len(found), object)  # item ids of any type
    owners[:] = [i for _, i in found]
    width = size - gram + 1
    keys = _row_hashes(words)
    order = np.argsort(keys, kind="stable")
    keys, words, owners = keys[order], words[order], owners[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    grams = gram_hashes(words[first].reshape(-1), gram)
    grams = grams[np.arange(len(first))[:, None] * size + np.arange(width)]
    order = ((grams >> TOP) << TOP) | (LOW - np.arange(width, dtype=np.uint64))
    seeds = grams[np.arange(len(first)), order.argmin(1)]
    return {
        "size": size, "gram": gram, "width": width, "seeds": np.unique(seeds),
        "keys": keys[first], "words": words[first], "from": first, "to": np.r_[first[1:], len(keys)], "owners": owners,
    }


def hits(index: list[dict], h: np.ndarray) -> tuple[list[tuple[int, int]], list]:
    """Covered word spans of a document and the ids of the items whose windows it holds."""
    spans: list[tuple[int, int]] = []
    items: set = set()
    for x in index:
        grams = gram_hashes(h, x["gram"])
        if len(grams) < x["width"]:
            continue
        picked = winnow(grams, x["width"])
        first, last = runs_of(picked)  # neighbouring windows share a seed
        seed = grams[picked[first]]
        at = np.minimum(np.searchsorted(x["seeds"], seed), len(x["seeds"]) - 1)
        hit = np.flatnonzero(x["seeds"][at] == seed).tolist()
        near = np.concatenate([np.arange(first[i], last[i] + 1) for i in hit] or [np.empty(0, np.int64)])
        if not len(near):
            continue
        # Window `near` holds a seed of the index: extend it to its full length and compare.
        around = h[near[:, None] + np.arange(x["size"])]
        key = _row_hashes(around)
        at = np.minimum(np.searchsorted(x["keys"], key), len(x["keys"]) - 1)
        same = (x["keys"][at] == key) & (x["words"][at] == around).all(1)
        spans += [(a, a + x["size"]) for a in near[same].tolist()]
        for k in np.unique(at[same]).tolist():
            items.update(x["owners"][x["from"][k] : x["to"][k]].tolist())
    return union_spans(spans), list(items)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """gram_hashes of every row as a whole."""
    n, size = rows.shape
    flat = gram_hashes(rows.reshape(-1), size)
    return flat[::size][:n]


def _blocks(bench: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, int]:
    """(block, item, total, words) and the number of blocks: pieces of items, dealt into blocks of bounded size."""

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for item, text in rows:
            words = fold_words(text)
            for a in range(0, max(len(words) - window + 1, 1), PIECE_WORDS):
                piece = words[a : a + PIECE_WORDS + window - 1]
                yield item, len(words), len(piece), b" ".join(piece)

    picked = bench.select(F.col(item_col).alias("item"), raw_text(text_col).alias("_text"))
    schema = f"item {column_type(bench, item_col)}, total bigint, size bigint, words binary"
    pieces = cut(map_rows(picked, schema, each, flush=64).withColumn("_part", F.spark_partition_id()))
    # A stretch is a run of pieces within one partition; running word counts never leave the partition.
    inside = F.sum("size").over(W.partitionBy("_part").orderBy("item", "words").rowsBetween(W.unboundedPreceding, 0))
    stretch = F.floor(inside / (BLOCK_WORDS - PIECE_WORDS - window)).alias("_stretch")
    numbered = cut(pieces.select("item", "total", "size", "words", "_part", stretch))
    sizes = numbered.groupBy("_part", "_stretch").agg(F.sum("size").alias("size")).orderBy("_part", "_stretch").collect()
    block, room, dealt = 0, BLOCK_WORDS, []
    for r in sizes:  # a row per partition and stretch, not per item
        if r.size > room:
            block, room = block + 1, BLOCK_WORDS
        dealt.append((r._part, r._stretch, block))
        room -= r.size
    lookup = bench.sparkSession.createDataFrame(dealt, "_part int, _stretch bigint, block int")
    return cut(numbered.join(F.broadcast(lookup), ["_part", "_stretch"]).drop("_part", "_stretch", "size")), block + 1


class Bench:
    """A test set as bounded blocks; ``finder(b)`` looks a column of texts up in block b."""

    def __init__(self, bench: DataFrame, item_col: str, text_col: str, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.item_type = window, gram, column_type(bench, item_col)
        self.spark = bench.sparkSession
        self.table, self.blocks = _blocks(bench, item_col, text_col, window)

    def finder(self, b: int):
        rows = self.table.filter(F.col("block") == b).select("item", "total", "words").collect()  # at most BLOCK_WORDS
        index = build_index(((r.item, r.total, bytes(r.words).split()) for r in rows), self.window, self.gram)
        shared = self.spark.sparkContext.broadcast(index)
        kind = f"struct<n_words: bigint, spans: array<struct<a: bigint, b: bigint>>, items: array<{self.item_type}>>"
        arrow = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

        @F.arrow_udf(kind)
        def find(texts: pa.Array) -> pa.Array:
            hashes, out = WordHashes(), []
            for text in texts:
                words = fold_words(text.as_py())
                spans, items = hits(shared.value, hashes.array(words))
                out.append({"n_words": len(words), "spans": [{"a": a, "b": z} for a, z in spans], "items": items})
            return pa.array(out, arrow)

        return find


def matches(
    docs: DataFrame, id_col: str, text_col: str, bench: DataFrame, item_col: str, item_text_col: str,
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, spans, items): covered word spans and the ids of the items with windows in each document.

    Null and blank texts have no words, spans or items. An item without words matches nothing; items that repeat an id
    count once; a null item id is an id like any other. Either table may be empty. Repeated documents are separate rows.
    """
    test = Bench(bench, item_col, item_text_col, window, gram)
    picked = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("_text"))
    found = [
        picked.select("id", "_text", test.finder(b)("_text").alias("f")) for b in range(test.blocks)
    ]
    if test.blocks == 1:
        return found[0].select("id", "f.n_words", "f.spans", "f.items")
    every = found[0].select("id", F.xxhash64("_text").alias("_key"), "f.*")
    for more in found[1:]:
        every = every.unionByName(more.select("id", F.xxhash64("_text").alias("_key"), "f.*"))
    # A repeated row (same id and text) gives the same spans in every pass; one row goes on for each copy.
    merged = every.groupBy("id", "_key").agg(
        F.first("n_words"), F.flatten(F.collect_list("spans")), F.array_distinct(F.flatten(F.collect_list("items"))),
        (F.count(F.lit(1)) / test.blocks).cast("int"),
    ).drop("_key")

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, n, spans, items, copies in rows:
            whole = [{"a": a, "b": z} for a, z in union_spans((x["a"], x["b"]) for x in spans)]
            yield from [(key, n, whole, items)] * copies

    return map_rows(
        merged,
        f"id {column_type(docs, id_col)}, n_words bigint, spans array<struct<a: bigint, b: bigint>>, "
        f"items array<{test.item_type}>",
        each,
    )


def drop_contaminated(
    docs: DataFrame, id_col: str, text_col: str, bench: DataFrame, item_col: str, item_text_col: str,
    window: int = WINDOW, gram: int = GRAM,
) -> DataFrame:
    """Rows of ``docs`` that hold no window of any item, all columns kept: a filter, nothing is exchanged."""
    test = Bench(bench, item_col, item_text_col, window, gram)
    for b in range(test.blocks):
        find = test.finder(b)
        docs = docs.filter(F.size(find(raw_text(text_col))["spans"]) == 0)
        if b + 1 < test.blocks:  # one block in memory at a time
            docs = cut(docs)
    return docs


def n_covered(spans: str = "spans"):
    """Number of words in a list of disjoint spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
