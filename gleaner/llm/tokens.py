"""Token counts of every prefix of a text, by dynamic programming over prefixes.

The tokens of a byte-level merge vocabulary have a property that makes prefixes cheap: a sequence of tokens is what the merge
rules give if every two neighbours are what the rules give for their joint bytes. So the last token of a prefix is the one
token that ends there and is compatible with the last token of the prefix before it, and

    count[end] = count[end - length of that token] + 1

One pass over the bytes (an Aho-Corasick automaton lists the tokens that end at each) settles all prefixes. The counts go into
a table, one step (count less the count of the prefix that is one character shorter) per character, and the table answers how
many tokens a prefix has and how much of a text fits a budget; nothing is encoded again.

Vocabularies also split a text before they merge. Here a text falls into units that keep the splits of all their prefixes to
themselves, and the steps of a unit are remembered within a worker:

* a special string is one token; a prefix that ends inside of it is ordinary text together with what stands before;
* blanks belong to the word behind them, as a prefix that ends with them splits them otherwise;
* a prefix of an apostrophe ending (``'re``) is an apostrophe and letters.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from .common import column_type, map_rows, per_worker

LIMIT = 1_024
LONGEST = 64  # characters of a unit that is remembered
UNITS, PAIRS = 300_000, 150_000  # units and pairs of tokens remembered by a worker, some 100 bytes and 200 bytes each
STEP = "<i2"  # a step: a token has at most 128 bytes, so a count moves by fewer

# The vocabulary's own splitting rule (a fixed value), written out for characters up to U+017F; blanks are left to what follows.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
_WORD = rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
_UNIT = rf"{_WORD}|[{_S}]+(?![^{_S}])(?:[{_S.replace(' ', '')}]?(?:{_WORD}))?|[{_S}]+"
_FAR = "[^\u0000-\u017f]"


class MergeRules:
    """Byte-level tokens of a vocabulary file, and the counts of all prefixes of a string of bytes.

    A merge always has a higher rank than the merges that made its parts, so merges happen in the order of their ranks. While
    two neighbouring tokens form, the token that touches the border from the left is a node on the right edge of the left
    token's merge tree, that from the right one on the left edge of the right token's. The two tokens are compatible if no two
    nodes that touch at the same time have a merge that comes before the next merge of either.
    """

    def __init__(self, path: str):
        import ahocorasick

        from .packing import _byte_letters

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        byte_of = {letter: chr(b) for b, letter in enumerate(_byte_letters())}
        ids = own["model"]["vocab"]
        text = {i: "".join(map(byte_of.__getitem__, t)) for t, i in ids.items() if all(c in byte_of for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in own["model"]["merges"]]
        self.rank = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        if len(self.parts) < len(merges) or any(self.made(p) >= r for pair, r in self.rank.items() for p in pair):
            raise ValueError(f"{path}: two merges make one token, or a merge comes before its parts")
        self.special = [t["content"] for t in own.get("added_tokens", [])]
        self.fits: dict[tuple[int, int], bool] = {}
        self.ends = ahocorasick.Automaton()
        for i, s in text.items():
            if len(s) == 1 or self.own(i):
                self.ends.add_word(s, (len(s), i))
        self.ends.make_automaton()

    def made(self, token: int) -> int:
        """Rank of the merge that makes a token; -1 for a byte."""
        return self.rank[self.parts[token]] if token in self.parts else -1

    def own(self, token: int) -> bool:
        """Whether the rules make this token of its own bytes; one that they do not make is never the last of a prefix."""
        if token not in self.parts:
            return True
        known = self.fits.get((token, -1))
        if known is None:
            a, b = self.parts[token]
            known = self.fits[token, -1] = self.own(a) and self.own(b) and self._apart(a, b, top=False)
        return known

    def _apart(self, a: int, b: int, top: bool = True) -> bool:
        """Whether no merge crosses the border of two tokens; without ``top`` one of the two whole tokens may."""
        none, parts, rank = len(self.rank), self.parts, self.rank
        left, right = [a], [b]  # nodes that touch the border, from the whole token down to the byte
        while left[-1] in parts:
            left.append(parts[left[-1]][1])
        while right[-1] in parts:
            right.append(parts[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            next_left = rank[parts[left[i - 1]]] if i else none
            next_right = rank[parts[right[j - 1]]] if j else none
            cross = rank.get((left[i], right[j]), none)
            if cross < next_left and cross <= next_right and (i or j or top) and cross < none:
                return False
            if not i and not j:
                return True
            # Merges of one rule go from left to right, and both sides move where their rules are the same.
            if next_left <= next_right:
                i -= 1
            else:
                j -= 1

    def prefix_counts(self, raw: bytes) -> list[int]:
        """Tokens of every prefix of ``raw``, the empty one first. No splitting rule, no special strings."""
        last, count, fits = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), self.fits
        for at, (length, token) in self.ends.iter(raw.decode("latin-1")):
            end = at + 1
            if last[end] >= 0:
                continue
            before = end - length
            if before:
                pair = last[before], token
                known = fits.get(pair)
                if known is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    known = fits[pair] = self._apart(*pair)
                if not known:
                    continue
            last[end], count[end] = token, count[before] + 1
        return count


class PrefixSteps(dict):
    """Steps of units, remembered; ``of`` gives those of a text."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        import regex  # its blanks are those of the rule, for all characters

        self.rules = MergeRules(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.units = re.compile(_UNIT).findall
        self.far = re.compile(_FAR).search
        self.simple = re.compile(f" ?(?:[{_L}]+|[{_N}]+)").fullmatch
        self.blanks = regex.compile(r"\s*").match
        self.special = re.compile("|".join(map(re.escape, sorted(self.rules.special, key=len, reverse=True))) or r"(?!)")

    def _counts(self, text: str) -> list[int]:
        """Tokens of every prefix (in characters, the empty one first) of a text that is merged as a whole."""
        raw = text.encode("utf-8", "replace")
        counts = self.rules.prefix_counts(raw)
        if len(raw) == len(text):
            return counts
        return [counts[i] for i, b in enumerate(raw) if b & 0xC0 != 0x80] + counts[-1:]

    def __missing__(self, unit: str) -> bytes:
        if self.simple(unit):
            counts = self._counts(unit)
        else:
            counts = [0]
            for _, (a, b) in self.split(unit):
                counts += [counts[-1] + c for c in self._counts(unit[a:b])[1:]]
            blanks = self.blanks(unit).end()
            rest, before = unit[blanks:], counts[blanks]
            if 1 < blanks < len(unit):  # a prefix of blanks alone is one part
                counts[1 : blanks + 1] = self._counts(unit[:blanks])[1:]
            if len(rest) == 3 and rest[0] == "'" and rest[1].isalpha():  # an ending cut short is an apostrophe and letters
                counts[blanks + 2] = before + 1 + self._counts(rest[1])[-1]
        steps = array("h", [b - a for a, b in zip(counts, counts[1:])]).tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = steps
        return steps

    def _units(self, text: str) -> list[str]:
        if text.isascii() or not self.far(text):
            return self.units(text)
        out, open_ = [], False
        for _, (a, b) in self.split(text):
            if open_:
                out[-1] += text[a:b]
            else:
                out.append(text[a:b])
            # Blanks with more blanks behind them stay open for the next part that is not blank.
            blank = self.blanks(out[-1]).end() == len(out[-1])
            open_ = blank and b < len(text) and (open_ or self.blanks(text[b]).end() == 1)
        return out

    def ordinary(self, text: str) -> np.ndarray:
        """Steps of a text without special strings."""
        return np.frombuffer(b"".join(map(self.__getitem__, self._units(text))), STEP)

    def of(self, text: str) -> np.ndarray:
        """Steps of a text, one per character: tokens of the prefix with it less tokens of the prefix without it."""
        if not any(s in text for s in self.rules.special):
            return self.ordinary(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            # Inside the special string a prefix is ordinary text, so its characters but the last are counted as such.
            inside = self.ordinary(text[at : found.end() - 1])
            before = int(self.ordinary(text[at : found.start()]).sum())
            out += [inside, np.array([before + 1 - int(inside.sum())], STEP)]
            at = found.end()
        out.append(self.ordinary(text[at:]))
        return np.concatenate(out)


def prefix_tables(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, n_bytes, n_chars, n_tokens, steps) of every row; ``steps`` holds a 16-bit step per character.

    The tokens of a text's first k characters are the sum of its first k steps; ``n_tokens`` is the sum of all. ``vocabulary``
    is a byte-level ``.json`` file with the splitting rule above, read where the tasks run. Null and empty texts have no
    tokens. Rows repeat as they come; an empty table gives no rows. One pass, nothing is exchanged.
    """
    kind, key_ = column_type(docs, id_col), ("prefix steps", vocabulary)

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        known = per_worker(key_, lambda: PrefixSteps(vocabulary))
        for key, text in rows:
            steps = known.of(text)
            yield key, len(text.encode("utf-8", "replace")), len(text), int(steps.sum(dtype=np.int64)), steps.tobytes()

    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = f"id {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, steps binary"
    return map_rows(picked, schema, each, flush=128, keep=key_)


def _counts_of(steps: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps.as_buffer() or b"", STEP), dtype=np.int64)


@F.arrow_udf(LongType())
def tokens_of_prefix(steps: pa.Array, chars: pa.Array) -> pa.Array:
    """Tokens of the first ``chars`` characters (of all, if there are fewer; 0 for a null or negative number)."""
    out = []
    for own, k in zip(steps, chars.to_pylist(), strict=True):
        out.append(int(np.frombuffer(own.as_buffer(), STEP)[: max(k or 0, 0)].sum(dtype=np.int64)))
    return pa.array(out, pa.int64())


@F.arrow_udf(LongType())
def longest_prefix(steps: pa.Array, limit: pa.Array) -> pa.Array:
    """Characters of the longest prefix with at most ``limit`` tokens. A longer prefix may have fewer tokens than a shorter."""
    out = []
    for own, most in zip(steps, limit.to_pylist(), strict=True):
        fits = np.flatnonzero(_counts_of(own) <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pa.array(out, pa.int64())


def budget(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``tables`` with ``over_limit`` (more than ``limit`` tokens) and ``fit_chars`` (what to cut the text to), from the steps."""
    over = (F.col("n_tokens") > limit).alias("over_limit")
    return tables.select("*", over, longest_prefix("steps", F.lit(limit).cast("bigint")).alias("fit_chars"))
