"""Dense reductions: each partition folds its rows to one small vector, Spark adds them up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .numeric import quoted


def sum_vectors(
    df: DataFrame, cols: Sequence[str], fn: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Sum ``fn(rows)`` over all batches; ``fn`` maps an (m, c) array to a fixed-length vector.

    The result length depends on the column count (or a model size), never on the row count.
    """

    def fold(batches):
        acc = None
        for pdf in batches:
            if len(pdf):
                part = np.asarray(fn(pdf.to_numpy(dtype=float)), dtype=float).ravel()
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"pos": np.arange(len(acc)), "val": acc})

    rows = (
        df.selectExpr(*[f"cast({quoted(c)} as double) as c{i}" for i, c in enumerate(cols)])
        .mapInPandas(fold, "pos long, val double")
        .groupBy("pos")
        .agg(F.sum("val").alias("val"))
        .collect()
    )
    out = np.zeros(len(rows))
    for r in rows:
        out[r["pos"]] = r["val"]
    return out


BLOCK = 8_192  # rows worked on at a time
BLOCK_BYTES = 16_384  # of a packed row: Spark's reader holds thousands of them at once


def row_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows packed in their order: (x0, x1, ...), an array of doubles per column. Each pass over the written table then costs
    Spark a row per block; the numbers go to numpy as they are."""
    x = [f"x{i}" for i in range(len(cols))]
    size = max(min(BLOCK, BLOCK_BYTES // (8 * max(len(cols), 1))), 1)

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = batch.slice(at, size)
                ends = pa.array([0, some.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in some.columns], names=x)

    plain = df.selectExpr(*[f"cast({quoted(c)} as double) as {xi}" for c, xi in zip(cols, x)])
    return plain.mapInArrow(pack, ", ".join(f"{xi} array<double>" for xi in x))


def byte_blocks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows packed in their order as the bytes of their numbers (v), with their partition (_p), the place of the first in it (_o),
    their number (_n) and how many values are missing (_bad). Spark only copies them."""
    size = max(min(BLOCK, BLOCK_BYTES // (8 * max(len(cols), 1))), 1)

    def pack(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = np.column_stack([values(c) for c in batch.columns]).astype(float)
            for at in range(0, len(rows), size):
                some = rows[at : at + size]
                arrays = [pa.array([part]), pa.array([place]), pa.array([len(some)]), pa.array([int(np.isnan(some).sum())])]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([some.tobytes()], pa.binary())], names=["_p", "_o", "_n", "_bad", "v"])
                place += len(some)

    plain = df.selectExpr(*[f"cast({quoted(c)} as double) as x{i}" for i, c in enumerate(cols)])
    return plain.mapInArrow(pack, "_p long, _o long, _n long, _bad long, v binary")


def byte_pieces(column: pa.Array, p: int, first: int, end: int):
    """Runs of up to ``BLOCK`` rows (p x rows) of the blocks from ``first`` to ``end`` of :func:`byte_blocks`."""
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset :]
    start, n = int(ends[first]), int(ends[end] - ends[first]) // 8
    rows = np.frombuffer(column.buffers()[2], float, n, start).reshape(-1, p)
    for at in range(0, len(rows), BLOCK):
        yield np.ascontiguousarray(rows[at : at + BLOCK].T)


def block_pieces(columns: Sequence[pa.Array]):
    """Runs of up to ``BLOCK`` rows of packed columns."""
    flat = [c.flatten() for c in columns]
    for at in range(0, len(flat[0]), BLOCK):
        yield [c.slice(at, BLOCK) for c in flat]


def values(column: pa.Array) -> np.ndarray:
    """The numbers of an Arrow column, null as NaN."""
    return column.to_numpy(zero_copy_only=False)


def _folded(blocks: DataFrame, pieces: Callable, fn: Callable) -> np.ndarray:
    def fold(batches):
        acc = None
        for batch in batches:
            for some in pieces(batch):
                part = np.asarray(fn(some), dtype=float).ravel()
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], names=["pos", "val"])

    rows = blocks.mapInArrow(fold, "pos long, val double").groupBy("pos").agg(F.sum("val").alias("val")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["pos"]] = r["val"]
    return out


def sum_blocks(blocks: DataFrame, fn: Callable[[list[pa.Array]], np.ndarray]) -> np.ndarray:
    """:func:`sum_vectors` of :func:`row_blocks`: ``fn`` gets the columns of some rows as Arrow arrays, which know their nulls."""
    return _folded(blocks, lambda batch: block_pieces(batch.columns), fn)


def sum_bytes(blocks: DataFrame, p: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """:func:`sum_vectors` of :func:`byte_blocks`: ``fn`` gets some rows as an array (p x rows)."""
    return _folded(blocks.select("v"), lambda batch: byte_pieces(batch.column(0), p, 0, batch.num_rows), fn)


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """X^T X over the given columns."""
    p = len(cols)
    out = sum_vectors(df, cols, lambda x: x.T @ x)
    return out.reshape(p, p) if out.size else np.zeros((p, p))


def grouped_scatter(df: DataFrame, cols: Sequence[str], label: str, max_labels: int = 10_000):
    """Per label: row count, column sums and X^T X in one pass. Returns dict label -> (n, s, S).

    The label count is checked before anything reaches the driver: k * p * p numbers come back.
    """
    p = len(cols)
    size = 1 + p + p * p

    def fold(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            lab = pdf["lab"].to_numpy()
            x = pdf.drop(columns="lab").to_numpy(dtype=float)
            for l in np.unique(lab):
                sub = x[lab == l]
                part = np.concatenate([[len(sub)], sub.sum(0), (sub.T @ sub).ravel()])
                acc[l] = acc[l] + part if l in acc else part
        for l, vec in acc.items():
            yield pd.DataFrame({"lab": l, "pos": np.arange(size), "val": vec})

    k = df.select(label).distinct().limit(max_labels + 1).count()
    if k * size > 50_000_000 or k > max_labels:
        raise ValueError(f"{k} labels x {p} columns is too large for a driver-side scatter")
    long = df.selectExpr(
        f"cast({quoted(label)} as bigint) as lab",
        *[f"cast({quoted(c)} as double) as c{i}" for i, c in enumerate(cols)],
    ).mapInPandas(fold, "lab long, pos long, val double")
    pdf = long.groupBy("lab", "pos").agg(F.sum("val").alias("val")).toPandas()
    out = {}
    for l, g in pdf.groupby("lab"):
        v = np.zeros(size)
        v[g["pos"].to_numpy()] = g["val"].to_numpy()
        out[int(l)] = (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p))
    return out
