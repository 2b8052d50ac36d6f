"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Distinct fingerprints are sorted by the bit counts of their four 16-bit segments and cut into tiles of at most ``TILE``.
Two fingerprints within ``radius`` bits have segment bit counts that differ by at most ``radius`` in total, so tile pairs
whose count boxes are farther apart are never formed, and inside a pair the same test skips row blocks. What is left is
compared by exclusive-or and bit counts. A tile pair returns a spanning forest of its links, never the links themselves.

The comparison stays quadratic in the number of distinct fingerprints (about an eighth of all pairs are compared); copies
cost nothing, because only distinct fingerprints enter. Every tile pair is one row of two blocks, at most 256 KB.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..session import cut, parallelism
from .common import column_type, map_rows, raw_text, small_side, unused

TILE = 16_384
BLOCK = 128  # rows compared at a time inside a tile pair
SEGMENTS = ((0, 16), (16, 16), (32, 16), (48, 16))
CHUNK = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    span = min(shingle, len(words))
    starts, ends = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        h = np.array([digest(line[a:b], seed) for a, b in pairs], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row, in one pass."""

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, text in rows:
            yield key, fingerprint(text, shingle, seed)

    picked = docs.select(F.col(id_col), raw_text(text_col).alias("_text"))
    return map_rows(picked, f"id {column_type(docs, id_col)}, fp bigint", each)


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four segments, one row per fingerprint."""
    mask = np.uint64(0xFFFF)
    return np.stack([np.bitwise_count((fp >> np.uint64(a)) & mask) for a, _ in SEGMENTS], axis=1).astype(np.int16)


def _tiles(fps: DataFrame, tile: int) -> DataFrame:
    """(tile, lo, hi, data): sorted fingerprints in blocks with the box of their segment counts."""
    n = fps.count()
    parts = max(1, -(-n // tile))
    counts = [F.bit_count(F.shiftrightunsigned("fp", a).bitwiseAND(0xFFFF)) for a, _ in SEGMENTS]
    keyed = fps.select("fp", *[c.alias(f"p{i}") for i, c in enumerate(counts)])
    order = ["p0", "p1", "p2", "p3", "fp"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("fp", F.spark_partition_id().alias("part"))

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        def block(held: list[int], part: int, k: int) -> tuple:
            fp = np.array(held, np.int64)
            c = segment_counts(fp.view(np.uint64))
            return (part << 24) | k, c.min(0).tolist(), c.max(0).tolist(), fp.tobytes()

        held, part, k = [], 0, 0
        for fp, part in rows:
            held.append(fp)
            if len(held) == tile:
                yield block(held, part, k)
                held, k = [], k + 1
        if held:
            yield block(held, part, k)

    return cut(map_rows(dealt, "tile bigint, lo array<int>, hi array<int>, data binary", each, flush=64))


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the ends of all links: larger roots hook to smaller ones until none differ."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest (node, root) of the links within ``left`` or between ``left`` and ``right``."""
    everything = left if right is None else np.concatenate([left, right])
    fp = everything.view(np.uint64)
    counts = segment_counts(fp)
    root = np.arange(len(fp))
    shift = 0 if right is None else len(left)
    other, other_counts = fp[shift:], counts[shift:]
    for at in range(0, len(left), BLOCK):
        rows = slice(at, min(at + BLOCK, len(left)))
        lo, hi = counts[rows].min(0), counts[rows].max(0)
        gap = np.maximum(np.maximum(lo - other_counts, other_counts - hi), 0).sum(1)
        near = np.flatnonzero(gap <= radius)
        if right is None:
            near = near[near > at]
        if not len(near):
            continue
        close = np.bitwise_count(fp[rows, None] ^ other[near][None, :]) <= radius
        i, j = np.nonzero(close)
        if len(i):
            _hook(root, i + at, near[j] + shift)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(everything[moved].tolist(), everything[root[moved]].tolist(), strict=True))


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b): forests of the links of all tile pairs over the distinct fingerprints ``fps``(fp)."""
    spark = fps.sparkSession
    tiles = _tiles(fps, tile)
    meta = tiles.select("tile", "lo", "hi")
    # Pairs meet on the bit count of the first segment; a pair that shares several counts is kept on the first one.
    one = meta.select(
        F.col("tile").alias("a"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"),
        F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("p"),
    )
    two = meta.select(
        F.col("tile").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"),
        F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("p"),
    )
    gap = sum(
        F.greatest(F.lit(0), F.col("lo1")[k] - F.col("hi2")[k], F.col("lo2")[k] - F.col("hi1")[k])
        for k in range(len(SEGMENTS))
    )
    pairs = one.join(two, "p").filter(
        (F.col("a") <= F.col("b"))
        & (F.col("p") == F.greatest(F.col("lo1")[0], F.col("lo2")[0] - radius))
        & (gap <= radius)
    )
    data = tiles.select(F.col("tile").alias("a"), F.col("data").alias("left"))
    more = tiles.select(F.col("tile").alias("b"), F.col("data").alias("right"))
    work = pairs.select("a", "b").join(data, "a").join(more, "b")
    work = work.repartition(4 * parallelism(spark), "a", "b")

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        for a, b, left, right in rows:
            own = np.frombuffer(left, np.int64)
            yield from linked(own, None if a == b else np.frombuffer(right, np.int64), radius)

    return map_rows(work.select("a", "b", "left", "right"), "a bigint, b bigint", each)


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 4, radius: int = 4, seed: int = 42, tile: int = TILE
) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id reachable over links of at most ``radius`` bits.

    Null and blank texts have fingerprint 0 and link like any other. Repeated rows stay and share a component. A null id
    counts only where all ids of a component are null. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    fps = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    found = cut(links(fps.select("fp"), radius, tile))
    comps = components(fps.select(F.col("fp").alias("id")), found)
    comps = cut(comps.select(F.col("id").alias("fp"), "comp").join(fps, "fp"))
    least = comps.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = comps.select("fp", "comp").join(least, "comp").select("fp", "component_id")
    return own.join(classes, "fp").select("id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """One row of ``docs`` for every component: the smallest id, null ids last, and of its texts the one with the smallest hash.

    A row is known by its id and a hash of its text, so rows that share an id but no component stay apart. Of rows that repeat
    id and text one stays.
    """
    row = F.xxhash64(text_col)
    key = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), row.alias("row"))
    found = cut(near_duplicates(docs.select(key.alias("_key"), F.col(text_col).alias("_body")), "_key", "_body", **options))
    first = F.col("id").eqNullSafe(F.col("component_id"))
    gone_id, gone_row = unused(docs, "__id", "__row")
    later = cut(found.filter(~first).select(F.col("id.id").alias(gone_id), F.col("id.row").alias(gone_row)).distinct())
    kept = docs.join(small_side(later), F.col(id_col).eqNullSafe(F.col(gone_id)) & (row == F.col(gone_row)), "left_anti")
    if found.filter(first).groupBy("id").count().filter("count > 1").isEmpty():
        return kept
    return kept.withColumn(gone_row, row).dropDuplicates([id_col, gone_row]).drop(gone_row)
