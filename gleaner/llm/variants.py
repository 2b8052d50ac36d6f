"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word's vector counts its letters. One replaced letter moves a vector by an L1 distance of two, one inserted or deleted letter
by one. So the words near a word of length n lie within 2 of its vector among the words of length n, and within 1 among those of
length n + 1; each pair of lengths is one range search, and every pair of near words is found once.

* A tree per length deals the words out. Its splits come from at most ``SAMPLE`` words, taken by hash, so that the leaves hold
  ``LEAF`` words or so; every word goes to the leaf that holds its vector.
* As a query a word goes down the trees of its own and the next length, into every box that its ball reaches. A ball of radius 2
  crosses at most two splits, so a query meets a few leaves, however many there are.
* Inside a leaf both sides are split on as smaller trees, pairs of boxes further apart than the radius are pruned, and what is
  left is compared by distance. Pairs within the radius are near if their letters also stand in order: the letters that agree
  from the left and those that agree from the right make up the shorter word.

Leaves are dealt over tasks. A leaf with more than ``MOST`` words or queries (words with equal vectors cannot be split by them)
is dealt out as blocks of both, so no task holds more than two blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import CACHE, map_rows, raw_text

SAMPLE = 200_000  # words that the splits are taken from
LEAF = 20_000  # words of a leaf that the trees aim at
MOST = 100_000  # words, or queries, of one block
SMALL = 32  # words of the smallest boxes inside a leaf
MODULUS = 199
RUN = "[a-z\u00C0-\u00FF]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_DIM = np.full(0x100, -1, np.int64)
_DIM[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the lower-cased runs of letters of whole texts and how often they occur. Only A-Z are lower-cased.

    Of the run an unsigned crc32 of ``<id>:<run>`` picks, where 199 divides it, the letter at that number modulo the length is
    left out: misspellings at a known rate. A null id counts as an empty one; null texts have no words. Tasks count before
    the exchange, in tables of at most ``CACHE`` words.
    """

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        plain, other, crc = re.compile(rb"[a-z]+").findall, re.compile(RUN).findall, zlib.crc32
        counts: Counter = Counter()
        for key, raw in rows:
            start = crc(f"{'' if key is None else key}:".encode())
            raw = raw.lower()  # of bytes: A-Z only
            runs = plain(raw) if raw.isascii() else [r.encode() for r in other(raw.decode(errors="replace"))]
            for i in [i for i, run in enumerate(runs) if not crc(run, start) % MODULUS]:
                run = runs[i].decode()
                at = crc(runs[i], start) % len(run)
                runs[i] = (run[:at] + run[at + 1 :]).encode()
            counts.update(runs)
            if len(counts) >= CACHE:
                yield from ((w.decode(), n) for w, n in counts.items() if w)
                counts.clear()
        yield from ((w.decode(), n) for w, n in counts.items() if w)

    picked = docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("_text"))
    return map_rows(picked, "word string, n bigint", each).groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- vectors and trees


def vectors(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters as codes, one row per word; letter counts). The words have one length."""
    n, m = len(own), len(own[0]) if own else 0
    codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(n, m).astype(np.int64)
    dims = _DIM[codes] + np.arange(n)[:, None] * len(LETTERS)
    return codes, np.bincount(dims.ravel(), minlength=n * len(LETTERS)).reshape(n, -1).astype(np.int16)


class Tree:
    """Splits (dimension, largest value of the left side) of the vectors of one length, down to leaves of ``leaf`` points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # (dimension, value, left, right), or (-1, leaf number, 0, 0)
        self.leaves = 0
        self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0, 0, 0))
        if len(points) > leaf:
            spread = points.var(0)
            d = int(spread.argmax())
            if spread[d] > 0:
                cuts = np.unique(points[:, d])[:-1]
                sides = np.searchsorted(np.sort(points[:, d]), cuts, side="right")
                value = int(cuts[np.abs(sides - len(points) / 2).argmin()])
                low = points[:, d] <= value
                left, right = self._grow(points[low], leaf), self._grow(points[~low], leaf)
                self.nodes[me] = (d, value, left, right)
                return me
        self.nodes[me] = (-1, self.leaves, 0, 0)
        self.leaves += 1
        return me

    def reach(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose box a point's ball reaches; with radius 0 the leaf that holds the point."""
        rows, leaves = [], []
        # Node, rows, their distance to the node's box, and the box's bounds where a split has set one.
        stack = [(0, np.arange(len(points)), np.zeros(len(points), np.int64), {}, {})]
        while stack:
            node, at, far, low, high = stack.pop()
            d, value, left, right = self.nodes[node]
            if d < 0:
                rows.append(at)
                leaves.append(np.full(len(at), value, np.int64))
                continue
            x = points[at, d].astype(np.int64)
            gap = np.maximum(0, np.maximum(low.get(d, 0) - x, x - high.get(d, 1 << 15)))
            for child, lo, hi in ((left, low, {**high, d: value}), (right, {**low, d: value + 1}, high)):
                new = np.maximum(0, np.maximum(lo.get(d, 0) - x, x - hi.get(d, 1 << 15)))
                away = far + new - gap
                near = away <= radius
                if near.any():
                    stack.append((child, at[near], away[near], lo, hi))
        return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(leaves or [np.empty(0, np.int64)])


def _boxes(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the points, by boxes of at most ``size`` (more only where the points are equal), split where they differ most."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        at = stack.pop()
        if len(at) > size:
            own = points[at]
            sums = own.sum(0, dtype=np.int64)
            spread = (own * own).sum(0, dtype=np.int64) * len(at) - sums * sums
            d = int(spread.argmax())
            if spread[d] > 0:
                value = min(int(sums[d] // len(at)), int(own[:, d].max()) - 1)
                side = own[:, d] <= value
                stack += [at[side], at[~side]]
                continue
        out += [at[i : i + 4 * size] for i in range(0, len(at), 4 * size)]
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of ``b`` (as long as those of ``a``, or one letter longer) are one edit away from the rows of ``a``."""
    m = a.shape[1]
    if b.shape[1] == m:
        return (a != b).sum(1) == 1
    left = np.minimum.accumulate(a == b[:, :m], axis=1).sum(1)
    right = np.minimum.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return left + right >= m


def _unary(points: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Vectors as bits: a count c of at most m is c ones and m - c zeros, so the L1 distance is the number of unequal bits."""
    dims, at = np.repeat(np.arange(len(most)), most), np.concatenate([np.arange(m) for m in most])
    bits = points[:, dims] > at
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)


def near_rows(queries: list[str], points: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (query, point) one edit apart. ``same``: of one length, each pair once (the query is the smaller word)."""
    none = np.empty(0, np.int64)
    if not queries or not points:
        return none, none
    (qc, qv), (pc, pv) = vectors(queries), vectors(points)
    radius = 2 if same else 1
    most = np.maximum(qv.max(0), pv.max(0))
    live = np.flatnonzero(most)
    qv, pv = qv[:, live], pv[:, live]
    qb, pb = _unary(qv, most[live]), _unary(pv, most[live])
    boxes = _boxes(pv, SMALL)
    low, high = np.stack([pv[b].min(0) for b in boxes]), np.stack([pv[b].max(0) for b in boxes])
    names_q, names_p = np.array(queries, object), np.array(points, object)
    found_q, found_p = [none], [none]
    for mine in _boxes(qv, SMALL):
        a, z = qv[mine].min(0), qv[mine].max(0)
        gap = np.maximum(0, np.maximum(low - z, a - high)).sum(1)
        reached = np.flatnonzero(gap <= radius)
        for k in range(0, len(reached), 64):  # at most 64 boxes against one at a time
            theirs = np.concatenate([boxes[x] for x in reached[k : k + 64]])
            far = np.bitwise_count(qb[mine][:, None, :] ^ pb[theirs][None, :, :]).sum(2, dtype=np.uint16)
            i, j = np.nonzero(far == radius)
            q, p = mine[i], theirs[j]
            if same:
                keep = names_q[q] < names_p[p]
                q, p = q[keep], p[keep]
            keep = _in_order(qc[q], pc[p])
            found_q.append(q[keep])
            found_p.append(p[keep])
    return np.concatenate(found_q), np.concatenate(found_p)


# ---------------------------------------------------------------- search


def grow_trees(vocabulary: DataFrame, sample: int = SAMPLE, leaf: int = LEAF) -> dict[int, tuple[Tree, int]]:
    """Of every length that occurs a tree, and the number of its first leaf; from at most ``sample`` words, taken by hash."""
    total = vocabulary.count()
    share = min(1.0, sample / max(total, 1))
    picked = vocabulary.select("word").orderBy(F.xxhash64("word"), "word").limit(sample) if share < 1 else vocabulary.select("word")
    own = picked.toPandas()["word"]
    lengths = [r[0] for r in vocabulary.select(F.length("word")).distinct().collect()]  # letters of the longest word at most
    trees, first = {}, 0
    for n in sorted(lengths):
        words_ = own[own.str.len() == n].tolist()
        points = vectors(words_)[1] if words_ else np.zeros((0, len(LETTERS)), np.int16)
        tree = Tree(points, max(int(leaf * share), 1))
        trees[n] = tree, first
        first += tree.leaves
    return trees


def near_pairs(vocabulary: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n) that are one inserted, deleted or replaced letter apart, once.

    ``vocabulary`` is a written table of distinct words. No bound on partners: a pair that exists is found.
    """
    trees = grow_trees(vocabulary, sample, leaf)

    def placed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, own in pdf.groupby(pdf["word"].str.len()):
                points = vectors(own["word"].tolist())[1]
                for length, radius, query in ((n, 0, False), (n, 2, True), (n + 1, 1, True)):
                    if length in trees:
                        tree, first = trees[length]
                        row, at = tree.reach(points, radius)
                        yield pd.DataFrame(
                            {"leaf": at + first, "step": length - n, "query": query,
                             "word": own["word"].to_numpy()[row], "n": own["n"].to_numpy()[row]}
                        )

    schema = "leaf long, step long, query boolean, word string, n long"
    dealt = cut(vocabulary.select("word", "n").mapInPandas(placed, schema))
    # A leaf's words stand in one block each, its queries (by difference of length) likewise; every pair of blocks is a task's.
    sizes = dealt.groupBy("leaf").agg(
        F.count(F.when(~F.col("query"), 1)).alias("points"), F.count(F.when(F.col("query"), 1)).alias("queries")
    )
    blocks = lambda c: F.ceil(F.col(c) / F.lit(most)).cast("long")
    sizes = sizes.select("leaf", blocks("points").alias("p"), blocks("queries").alias("q")).filter("p > 0")
    # Only leaves that are dealt out as several blocks are listed: fewer than (word, leaf) rows over ``most``.
    large = sizes.filter("p > 1 OR q > 1")
    spread = dealt.join(F.broadcast(large), "leaf", "left").withColumns(
        {"p": F.coalesce("p", F.lit(1)), "q": F.coalesce("q", F.lit(1))}
    )
    own = F.pmod(F.xxhash64("word"), F.when(F.col("query"), F.col("q")).otherwise(F.col("p")))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("p")).otherwise(F.col("q")) - 1))
    spread = spread.select("leaf", "step", "query", "word", "n", own.alias("own"), other.alias("other"))
    mine, theirs = F.col("own"), F.col("other")
    spread = spread.select(
        "leaf", F.when(F.col("query"), theirs).otherwise(mine).alias("pb"),
        F.when(F.col("query"), mine).otherwise(theirs).alias("qb"), "step", "query", "word", "n",
    )

    arrow = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])

    def search(held: pa.Table) -> pa.Table:
        step, query, word, n = (held.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("step", "query", "word", "n"))
        points, columns = np.flatnonzero(~query), [[], [], [], []]
        for d in (0, 1):
            mine = np.flatnonzero(query & (step == d))
            q, p = near_rows(word[mine].tolist(), word[points].tolist(), d == 0)
            for k, rows in enumerate((mine[q], points[p])):
                columns[2 * k].append(word[rows])
                columns[2 * k + 1].append(n[rows])
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spread.groupBy("leaf", "pb", "qb").applyInArrow(search, "a string, a_n long, b string, b_n long")


def variants(vocabulary: DataFrame, factor: int = 5) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of ``vocabulary`` (word, n; a written table of distinct words).

    ``n_near`` counts the near words. The form is the most frequent of them (ties: the first in code-point order), if it is at
    least ``factor`` times as frequent as the word; the root is what the forms lead to in the end. Forms grow by the factor at
    each step, so following them takes a few rounds of doubling. An empty vocabulary gives no rows.
    """
    pairs = cut(near_pairs(vocabulary))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    # Code points order as the bytes of UTF-8 do; of equal counts the smallest word comes first.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = cut(
        vocabulary.select("word", "n").join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("best.less") >= factor * F.col("n"), F.col("best.form")).alias("form"),
            F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")).alias("form_n"),
        )
    )
    links = cut(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        links = step.select("word", "root")
        if step.filter("next IS NOT NULL").isEmpty():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
