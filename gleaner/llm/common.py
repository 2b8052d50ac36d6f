"""Shared helpers: Arrow batches as Python rows, word hashes, and range hashes of word or byte arrays."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut

SLICE = 512  # rows turned into Python objects at a time
CACHE = 400_000  # entries after which a per-task cache starts anew


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True)


def map_rows(
    df: DataFrame, schema: StructType | str, each: Callable[[Iterable[tuple]], Iterator[tuple]], flush: int = 20_000,
    keep: tuple | None = None,
) -> DataFrame:
    """``each`` turns the rows of a partition (tuples) into output rows, in Arrow batches of at most ``flush`` rows.

    What ``per_worker`` holds for an earlier operator is dropped first, unless its key is ``keep``.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)
    names, kinds = arrow.names, arrow.types

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sys.modules.get("_kept_by_worker")
        if held is not None and held.__dict__.get("key") != keep:
            held.__dict__.update(key=None, value=None)
        out: list[tuple] = []
        for row in each(rows_of(batches)):
            out.append(row)
            if len(out) >= flush:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, schema)


def map_arrays(
    df: DataFrame, schema: str, each: Callable[[Iterable[tuple]], Iterator[tuple]], flush: int = 100_000
) -> DataFrame:
    """Like ``map_rows`` for many output rows per input row: ``each`` yields (key, array, array ...) with arrays of one
    length, for that many rows; the key, of any type, is the first column and repeats."""
    schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def pack(keys: list, columns: list[tuple]) -> pa.RecordBatch:
        counts = [len(c[0]) for c in columns]
        ids = pa.array(keys, arrow.types[0]).take(pa.array(np.repeat(np.arange(len(keys)), counts)))
        rest = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*columns, strict=True), arrow.types[1:], strict=True)]
        return pa.RecordBatch.from_arrays([ids, *rest], names=arrow.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, columns, size = [], [], 0
        for key, *arrays in each(rows_of(batches)):
            keys.append(key)
            columns.append(arrays)
            size += len(arrays[0])
            if size >= flush:
                yield pack(keys, columns)
                keys, columns, size = [], [], 0
        if keys:
            yield pack(keys, columns)

    return df.mapInArrow(run, schema)


def per_worker(key: tuple, make: Callable):
    """``make()``, or what it gave to an earlier task of this Python worker; a worker keeps the last one only.

    Functions travel to the workers by value, so a module's own variables start anew with every task.
    """
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if held.get("key") != key:
        held.update(key=None, value=None)
        held.update(value=make(), key=key)
    return held["value"]


def raw_text(text_col: str):
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered within a task; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # longer words are rare and would fill the memory
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of polynomial hashes over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def gram_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every k consecutive entries, by doubling: log2(k) passes over the array."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, width, factor = None, 0, h, 1, base
    while True:
        if k & width:
            if out is None:
                out, have = power, width
            else:  # out covers `have` entries, followed by `width` more
                m = len(h) - have - width + 1
                out = out[:m] * np.uint64(factor) + power[have : have + m]
                have += width
        if have == k:
            return mix(out[:n])
        m = len(h) - 2 * width + 1
        power = power[:m] * np.uint64(factor) + power[width : width + m]
        width, factor = width * 2, factor * factor % 2**64


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    width = 1
    while width * 2 <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return np.minimum(a[:n], a[w - width : w - width + n])


LOW = np.uint64(0xFFFFFFFF)
TOP = np.uint64(32)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of every w consecutive k-gram hashes, the rightmost of equal ones."""
    at = np.arange(len(grams), dtype=np.uint64)
    key = ((grams >> TOP) << TOP) | (LOW - at)
    return (LOW - (sliding_min(key, w) & LOW)).astype(np.int64)


class Ranges:
    """Hash of any range of an array of hashes, by prefix sums of a polynomial with an odd (invertible) base."""

    BASE = 0xA0761D6478BD642F | 1
    INVERSE = pow(BASE, -1, 2**64)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("_up", cls.BASE), ("_down", cls.INVERSE)):
                p = np.full(size, np.uint64(base))
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls._up, cls._down

    def __init__(self, h: np.ndarray):
        self.up, self.down = self._powers(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h + np.uint64(1)) * self.up[: len(h)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of equal neighbours."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1])
    return np.r_[0, cut + 1], np.r_[cut, len(values) - 1]


def union_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge half-open spans that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


BROADCAST_ROWS = 1_000_000  # keys of at most two longs: some 50 MB once hashed


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], share: int = 1_000) -> DataFrame:
    """Left join of ``left`` (a written table) with ``right``, which has one row per key.

    A key that holds over a thousandth of the left rows would make one task of a shuffled join read them all. There are under
    a thousand such keys, whatever the tables: their rows of ``right`` are broadcast, and only other rows are exchanged.
    """
    most = max(left.count() // share, 1)
    hot = left.groupBy(*keys).count().filter(F.col("count") > most).select(*keys)
    held = F.broadcast(cut(hot.join(right, keys, "left")))
    rest = left.join(held.select(*keys), keys, "left_anti").join(right, keys, "left")
    return left.join(held, keys).unionByName(rest)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
