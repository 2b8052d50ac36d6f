"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over all overlapping windows of a text.

The network (``gru``) is trained in numpy on the driver, on a sample of labelled documents bounded by ``TRAIN_DOCS`` and, per
document, ``TRAIN_WINDOWS`` windows. A label speaks of a document, so of a toxic one only the windows that the network itself
finds worst count as toxic after the first rounds. A document's score is a logistic function of its worst window, fitted on
sampled documents that the network has not seen. Scoring is one pass over the documents: every window of every text, nothing is
exchanged, and only the parameters (3 MB) are broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import column_type, map_rows, raw_text
from .gru import HIDDEN, Adam, features, forward, fresh, gradients, inputs

WINDOW, STRIDE = 64, 48
PIECE, OVERLAP = 64, 16  # bytes of the longest token, and what neighbouring pieces of a longer one share
TRAIN_DOCS, TRAIN_WINDOWS = 6_000, 12  # bounds of the fitted sample
EPOCHS, STEPS, BATCH, RATE = 7, 500, 128, 0.01  # small samples are gone through more often, for some STEPS batches
SCORED = 1_024  # windows scored at a time
TABLE = 100_000  # distinct words remembered in a task


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.r_[starts, n - WINDOW]


def tokens_of(text: bytes) -> list[bytes]:
    """Words between blanks; one of more than ``PIECE`` bytes (a text without blanks is one) as pieces that overlap by ``OVERLAP``.

    The network reads a token's n-grams, so every byte of a text is read, and n-grams are not cut apart.
    """
    out = text.split()
    if max(map(len, out), default=0) <= PIECE:
        return out
    step = PIECE - OVERLAP
    return [t[k : k + PIECE] for t in out for k in range(0, max(len(t) - OVERLAP, 1), step)]


class Words:
    """Rows of distinct tokens with their features."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.held: list[list[bytes]] = []  # tokens whose features are still to be taken

    def of(self, tokens: list[bytes]) -> np.ndarray:
        new = [t for t in dict.fromkeys(tokens) if t not in self.rows]
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.held.append(new)
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))

    def take(self) -> list[bytes]:
        """The tokens that are new since the last call, in the order of their rows."""
        new = [t for part in self.held for t in part]
        self.held = []
        return new


class Table:
    """Features of all words of a sample; ``of(rows)`` picks some words."""

    def __init__(self, tokens: list[bytes]):
        parts = [features(tokens[k : k + 50_000]) for k in range(0, len(tokens), 50_000)]
        self.words, self.grams, self.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.words[rows], self.grams[at], sizes


def _windows(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) rows and which of them are words."""
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    valid = at < len(rows)
    return np.where(valid, rows[np.minimum(at, max(len(rows) - 1, 0))] if len(rows) else 0, 0), valid


def sample(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, limit: int) -> list[tuple[bytes, int]]:
    """At most ``limit`` labelled texts, a third of them toxic if there are enough, picked by a hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    picked = None
    for value, n in ((1, limit // 3), (0, limit - limit // 3)):
        some = known.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col).alias("_id"), raw_text(text_col).alias("_text"))
    found = rows.join(F.broadcast(picked), "_id").select("_id", "_text", "_label")  # `picked` has at most `limit` rows
    one_each = found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    return [(bytes(r["_text"]), r["_label"]) for r in one_each.orderBy(F.xxhash64("_id"), "_id").collect()]


def train(texts: list[tuple[bytes, int]], seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters of the network and of the document score. Without both labels the score is the share of toxic ones."""
    rng, p = np.random.default_rng(seed), fresh(seed)
    labels = np.array([y for _, y in texts], np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.0
        p["score"] = np.array([0.0, np.log((share + 0.01) / (1.01 - share))])
        return p
    words = Words()
    at, valid, owner = [], [], []
    for i, (text, _) in enumerate(texts):
        tokens = tokens_of(text)
        starts = window_starts(len(tokens))
        if len(starts) > TRAIN_WINDOWS:
            starts = starts[np.linspace(0, len(starts) - 1, TRAIN_WINDOWS).astype(np.int64)]
        used = np.zeros(max(len(tokens), 1), bool)
        used[np.minimum(starts[:, None] + np.arange(WINDOW), len(used) - 1)] = True
        rows = np.zeros(len(tokens), np.int64)  # words outside the windows are not looked up
        rows[used[: len(tokens)]] = words.of([t for t, u in zip(tokens, used.tolist(), strict=False) if u])
        a, v = _windows(rows, starts)
        at.append(a), valid.append(v), owner.append(np.full(len(starts), i))
    at, valid, owner = np.concatenate(at, 1), np.concatenate(valid, 1), np.concatenate(owner)
    table = Table(words.take() or [b"."])
    del words
    unseen = np.arange(len(texts)) % 5 == 4  # kept for the document score
    adam = Adam(p, RATE)
    per_epoch = -(-int((~unseen[owner]).sum()) // BATCH)
    epochs = min(max(EPOCHS, -(-STEPS // max(per_epoch, 1))), 8 * EPOCHS)
    first = 2 * epochs // EPOCHS  # in the first rounds all windows of a toxic document count as toxic
    for epoch in range(epochs):
        use = ~unseen[owner]
        if epoch >= first:
            logits = _logits(p, table, at, valid)
            worst = _worst(logits, owner, len(texts))
            toxic = labels[owner] == 1
            use &= np.where(toxic, (logits >= worst[owner]) | (logits > 0), (logits >= worst[owner]) | (rng.random(len(owner)) < 0.3))
            adam.rate = RATE * 0.6 ** (1 + 4 * (epoch - first) / max(epochs - first - 1, 1))
        order = rng.permutation(np.flatnonzero(use))
        for k in range(0, len(order), BATCH):
            b = order[k : k + BATCH]
            uniq, back = np.unique(at[:, b], return_inverse=True)
            g = gradients(p, *table.of(uniq), back.reshape(WINDOW, -1), valid[:, b], labels[owner[b]])
            adam.step(p, g)
    worst = _worst(_logits(p, table, at, valid), owner, len(texts))
    p["score"] = _calibrate(worst[unseen], labels[unseen])
    return p


def _worst(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    worst = np.full(n, -np.inf)
    np.maximum.at(worst, owner, logits)
    return worst


def _logits(p: dict, table: Table, at: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Logits of many windows, embedding the words of a few windows at a time."""
    out = []
    for k in range(0, at.shape[1], SCORED):
        uniq, back = np.unique(at[:, k : k + SCORED], return_inverse=True)
        _, gates = inputs(p, *table.of(uniq))
        out.append(forward(p, gates[back.reshape(WINDOW, -1)], valid[:, k : k + SCORED]))
    return np.concatenate(out)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept of a logistic regression of y on x, by damped Newton steps with a light prior."""
    a = np.zeros(2)
    f = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(f @ a)))
        grad = f.T @ (q - y) + np.array([1e-2, 1e-4]) * a
        hess = (f * (q * (1 - q))[:, None]).T @ f + np.diag([1e-2, 1e-4])
        step = np.linalg.solve(hess, grad)
        a -= step / max(1.0, np.abs(step).max())
    return a if a[0] > 0 else np.array([0.0, np.log((y.mean() + 0.01) / (1.01 - y.mean()))])


class Scorer:
    """Worst window logit of each document of a stream, windows of many documents at a time."""

    def __init__(self, p: dict):
        self.p = p
        self.reset()
        self.pending: deque = deque()  # [key, windows still to come, worst logit]
        self.at, self.valid, self.owners, self.size = [], [], [], 0

    def reset(self) -> None:
        self.words, self.table = Words(), np.empty((0, 6 * HIDDEN), np.float32)

    def add(self, key, text: bytes) -> Iterator[tuple]:
        tokens = tokens_of(text)
        starts = window_starts(len(tokens))
        doc = [key, len(starts), -np.inf]
        self.pending.append(doc)
        if not tokens:
            doc[1:] = 0, float(self.p["bias"][0])
        else:
            for k in range(0, len(starts), SCORED):
                part = starts[k : k + SCORED]
                if len(self.words.rows) > TABLE:
                    self.flush()
                    self.reset()
                rows = self.words.of(tokens[part[0] : part[-1] + WINDOW])
                a, v = _windows(rows, part - part[0])
                self.at.append(a), self.valid.append(v), self.owners.extend([doc] * len(part))
                self.size += len(part)
                if self.size >= SCORED:
                    self.flush()
        yield from self.ready()

    def ready(self) -> Iterator[tuple]:
        while self.pending and not self.pending[0][1]:
            key, _, worst = self.pending.popleft()
            yield key, worst

    def flush(self) -> None:
        if not self.size:
            return
        if new := self.words.take():
            have = len(self.words.rows) - len(new)
            if len(self.words.rows) > len(self.table):  # room for twice as many
                self.table = np.concatenate([self.table[:have], np.empty((2 * len(self.words.rows) - have, 6 * HIDDEN), np.float32)])
            for k in range(0, len(new), 20_000):
                part = new[k : k + 20_000]
                self.table[have + k : have + k + len(part)] = inputs(self.p, *features(part))[1]
        logits = forward(self.p, self.table[np.concatenate(self.at, 1)], np.concatenate(self.valid, 1)).tolist()
        for doc, x in zip(self.owners, logits, strict=True):
            doc[1] -= 1
            doc[2] = max(doc[2], x)
        self.at, self.valid, self.owners, self.size = [], [], [], 0


def score(docs: DataFrame, id_col: str, text_col: str, parameters: dict[str, np.ndarray]) -> DataFrame:
    """(id, score): the probability that a document is toxic, from its worst window.

    Null and blank texts score as a window without words. Rows repeat as they come; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parameters)

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        p = shared.value
        slope, intercept = p["score"].tolist()
        scorer = Scorer(p)

        def scored(found: Iterable[tuple]) -> Iterator[tuple]:
            for key, worst in found:
                yield key, float(1 / (1 + np.exp(-np.clip(slope * worst + intercept, -60, 60))))

        for key, text in rows:
            yield from scored(scorer.add(key, text))
        scorer.flush()
        yield from scored(scorer.ready())

    return map_rows(docs.select(id_col, raw_text(text_col).alias("_text")), f"id {column_type(docs, id_col)}, score double", each)
