"""A small bidirectional gated recurrent network with attention pooling, in numpy: forward, backward, training.

A word enters as its own hashed embedding and the scaled sum of its character n-gram embeddings. Gate inputs depend on the
word alone, so they are computed once per distinct word and gathered. Parameters are a plain dict of float32 arrays.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix

WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 12, 10, 8
GRAMS = range(3, 7)
EDGES = b".,;:!?|\"'()[]{}<>*#$%&-_/"


def features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: bucket of the folded word, buckets of its byte n-grams one after the other, and their number."""
    folded = [t.lower().strip(EDGES) or t for t in tokens]
    words = np.fromiter((xxhash.xxh32_intdigest(w) for w in folded), np.int64, len(folded)) % WORD_BUCKETS
    texts = [b"<" + w + b">" for w in folded]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))  # bytes up to the end of the word
    h, found, owners = raw, [], []
    for n in range(2, GRAMS.stop):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + raw[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(left[: len(h)] >= n)
            found.append((mix(h[inside]) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
            owners.append(owner[inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners.astype(np.int32))
    return words, np.concatenate(found)[order], np.bincount(owners, minlength=len(texts))


def sums_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (small numbers) and the sums of their rows of ``values``."""
    size = int(keys.max()) + 1
    hit = np.flatnonzero(np.bincount(keys, minlength=size))
    out = np.empty((len(hit), values.shape[1]), values.dtype)
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(keys, values[:, j], size)[hit]
    return hit, out


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    return {
        "word": draw(WORD_BUCKETS, WORD_DIM, scale=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.1),
        "win": draw(d, 6 * h, scale=d**-0.5), "bin": np.zeros(6 * h, np.float32),
        "uf": draw(h, 3 * h, scale=h**-0.5), "ub": draw(h, 3 * h, scale=h**-0.5),
        "wa": draw(2 * h, ATTENTION, scale=(2 * h) ** -0.5), "va": draw(ATTENTION, scale=1.0),
        "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32),
    }


def inputs(p: dict, words: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded words (n, d) and their gate inputs (n, 6 hidden); ``grams`` holds ``sizes[i]`` n-grams of word i in turn."""
    sums = np.add.reduceat(p["char"].take(grams, axis=0), np.cumsum(sizes) - sizes, axis=0)
    x = np.concatenate([p["word"][words], sums * (sizes**-0.5).astype(sums.dtype)[:, None]], axis=1)
    return x, x @ p["win"] + p["bin"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _scan(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """Hidden states of one direction, (time, batch, hidden); padded steps carry the state on."""
    steps, batch, h3 = gates.shape
    h = h3 // 3
    state, out = np.zeros((batch, h), np.float32), np.empty((steps, batch, h), np.float32)
    for t in order:
        s = state @ u
        zr = _sigmoid(gates[t, :, : 2 * h] + s[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(gates[t, :, 2 * h :] + r * s[:, 2 * h :])
        new = n + z * (state - n)
        m = mask[t]
        if keep is not None:
            keep.append((state, z, r, n, s[:, 2 * h :], m))
        state = new if m is None else np.where(m, new, state)
        out[t] = state
    return out


def forward(p: dict, gates: np.ndarray, valid: np.ndarray, tape: dict | None = None) -> np.ndarray:
    """Logits of windows: ``gates`` (time, batch, 6 hidden), ``valid`` (time, batch)."""
    steps, h = len(gates), HIDDEN
    mask = [None if v.all() else v[:, None] for v in valid]
    kept_f, kept_b = ([], []) if tape is not None else (None, None)
    both = np.concatenate(
        [
            _scan(gates[:, :, : 3 * h], p["uf"], mask, range(steps), kept_f),
            _scan(gates[:, :, 3 * h :], p["ub"], mask, range(steps - 1, -1, -1), kept_b),
        ],
        axis=2,
    )
    inner = np.tanh(both @ p["wa"])
    e = np.where(valid, inner @ p["va"], np.float32(-1e9))
    weight = np.exp(e - e.max(0))
    weight = weight * valid
    weight /= np.maximum(weight.sum(0), np.float32(1e-9))
    pooled = np.einsum("tb,tbh->bh", weight, both)
    if tape is not None:
        tape.update(kept_f=kept_f, kept_b=kept_b, both=both, inner=inner, weight=weight, pooled=pooled)
    return pooled @ p["out"] + p["bias"][0]


def _scan_back(d_out: np.ndarray, u: np.ndarray, order: range, kept: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, h = d_out.shape
    d_gates, d_u, d_state = np.empty((steps, batch, 3 * h), np.float32), np.zeros_like(u), np.zeros((batch, h), np.float32)
    for t, (state, z, r, n, sn, m) in zip(order, reversed(kept), strict=True):
        d = d_state + d_out[t]
        d_new = d if m is None else d * m
        d_state = (d - d_new) + d_new * z
        dn = d_new * (1 - z) * (1 - n * n)
        dz = d_new * (state - n) * z * (1 - z)
        dr = dn * sn * r * (1 - r)
        d_gates[t] = np.concatenate([dz, dr, dn], axis=1)
        ds = np.concatenate([dz, dr, dn * r], axis=1)
        d_u += state.T @ ds
        d_state = d_state + ds @ u.T
    return d_gates, d_u


def gradients(
    p: dict, words: np.ndarray, grams: np.ndarray, sizes: np.ndarray, at: np.ndarray, valid: np.ndarray, y: np.ndarray
) -> dict:
    """Gradient of the mean log loss of windows ``at`` (time, batch: rows of ``words``)."""
    x, table = inputs(p, words, grams, sizes)
    tape: dict = {}
    logits = forward(p, table[at], valid, tape)
    steps, h, g = len(at), HIDDEN, {}
    d = ((1 / (1 + np.exp(-logits)) - y) / len(y)).astype(np.float32)
    g["out"], g["bias"] = tape["pooled"].T @ d, np.array([d.sum()], np.float32)
    d_pooled = d[:, None] * p["out"]
    both, weight, inner = tape["both"], tape["weight"], tape["inner"]
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", both, d_pooled)
    d_e = weight * (d_weight - (weight * d_weight).sum(0))
    g["va"] = np.einsum("tb,tba->a", d_e, inner)
    d_inner = d_e[:, :, None] * p["va"] * (1 - inner * inner)
    g["wa"] = np.einsum("tbh,tba->ha", both, d_inner)
    d_both += d_inner @ p["wa"].T
    gf, g["uf"] = _scan_back(d_both[:, :, :h], p["uf"], range(steps - 1, -1, -1), tape["kept_f"])
    gb, g["ub"] = _scan_back(d_both[:, :, h:], p["ub"], range(steps), tape["kept_b"])
    d_gates = (np.concatenate([gf, gb], axis=2) * valid[:, :, None]).reshape(-1, 6 * h)
    rows, sums = sums_by(at.ravel(), d_gates)
    d_table = np.zeros_like(table)
    d_table[rows] = sums
    g["win"], g["bin"] = x.T @ d_table, d_table.sum(0)
    d_x = d_table @ p["win"].T
    d_char = d_x[:, WORD_DIM:] * (sizes**-0.5).astype(d_x.dtype)[:, None]
    g["word"], g["char"] = (words, d_x[:, :WORD_DIM]), (grams, np.repeat(d_char, sizes, axis=0))
    return g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            rows = slice(None)
            if isinstance(d, tuple):  # embeddings: only the rows that took part
                rows, d = sums_by(*d)
            m = self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * d
            v = self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * d * d
            p[k][rows] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
