"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

BLANK = "[^\x20\x09-\x0d]+"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def items_in(docs, bench, window=10):
    """[(id, n_words, n_hit, sorted items)]"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    held = {}
    for item, text in bench:
        w = words(text)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            held.setdefault(tuple(w[a : a + size]), set()).add(item)
    out = []
    for key, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(k) for k in held}:
            for a in range(len(w) - size + 1):
                if (k := tuple(w[a : a + size])) in held:
                    hit.update(range(a, a + size))
                    items |= held[k]
        out.append((key, len(w), len(hit), sorted(map(str, items))))
    return out


def byte_repeats(texts, length=400):
    """[(n_bytes, n_removed, n_spans, kept)] for rows in order; every row is a place of its own."""
    data = [(t or "").encode() for t in texts]
    times = Counter(b[a : a + length] for b in data for a in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if times[b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def word_repeats(docs, length=20):
    """{(id, text): (n_words, n_removed, kept)}; ``docs`` in the order of documents."""
    seen, out = set(), {}
    for key, text in docs:
        if (key, text) in out:
            continue
        w = re.findall(BLANK, text or "")
        gone = set()
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            if k in seen:
                gone.update(range(a, a + length))
            seen.add(k)
        out[key, text] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def fingerprint(text, shingle=4, seed=42):
    w = re.findall(BLANK, fold(text))
    grams = [" ".join(w[a : a + shingle]) for a in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(docs, radius=4):
    """A number per row, equal for rows of one component."""
    fp = [fingerprint(t) for _, t in docs]
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius and root(i) != root(j):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fp))]


def near(docs, radius=4):
    """[(id, fingerprint, component)] of rows in order."""
    of, least = components_of(docs, radius), {}
    for c, (key, _) in zip(of, docs, strict=True):
        if key is not None:
            least[c] = min(key, least.get(c, key))
    return [(key, fingerprint(t), least.get(c)) for c, (key, t) in zip(of, docs, strict=True)]


def base_quality(text):
    w = re.findall(BLANK, text or "")
    n = len(w)
    times = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered, seen, dup = set(), set(), 0
    for i in range(n - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered.update((i, i + 1, i + 2))
    for line in (text or "").split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, w)), symbols, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


_LETTER = lambda m: f"[{m[0]}{m[0].upper()}]"
ASSIGN = re.compile(
    "(" + re.sub("[a-z]", _LETTER, "password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    kinds = ("assign", "access", "hex")
    return [(kinds[k], a, b) for a, k, b in sorted(found)]


def token_pieces(docs, path, capacity=2048, end=0):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(path), []
    for key, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            out.append((key, k, a, len(part), zlib.crc32(part.tobytes())))
    return out


def boilerplate(docs, percent=10, min_pages=5):
    """[(n_lines, n_dropped, text)] of (host, text) rows."""
    total, pages = Counter(h for h, _ in docs), Counter()
    for host, text in docs:
        pages.update({(host, x) for x in (text or "").split("\n") if x.strip(" ")})
    out = []
    for host, text in docs:
        if text is None:
            out.append((0, 0, None))
            continue
        lines = text.split("\n")
        stay = [x for x in lines if pages[host, x] < min_pages or pages[host, x] * 100 <= total[host] * percent]
        out.append((len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
