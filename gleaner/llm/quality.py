"""Quality rules by tokeniser fertility.

Public vocabularies, never trained here, measure a text: characters per token of a byte-level vocabulary for many languages,
and the share of byte-fallback pieces and the entropy of pieces of a vocabulary with byte fallback. Text whose measures leave
the band of its language (of its script, where the language has no band) is rejected: symbol soup has few characters per
token, foreign or broken encodings fall back to bytes, boilerplate and word salad have low or extreme entropy. Counts of
symbols, repeated lines and repeated word windows come with the measures.

Entropy grows with the length of a text, so besides its fixed limits it has a floor by length, taken from all rows: a parabola
over the logarithm of the words, fitted per band, less ``SPREADS`` robust deviations. Tables of cells have little entropy for
their length. Bands of fewer than ``LEAST`` different texts keep their fixed limits alone.

Words are tokenised one by one, so a word's tokens are remembered within a worker, over its tasks. One pass over the texts; only the counts and
measures are read again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import cut
from .common import CACHE, gram_hashes, mix, per_worker, raw_text

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated 3-word windows
LONGEST = 64  # bytes of a word that is remembered
SYMBOLS = b"#*$%&|<>"
LEAST, SPREADS = 50, 4.0
NARROW = 0.05  # bits that a robust deviation counts at least, where most texts are alike


@dataclass(frozen=True)
class Band:
    """Accepted measures, ends included."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy: tuple[float, float]


# Bands by language, then by script. Fertility differs because the vocabularies hold more words of some languages.
BANDS = {
    "en": Band((1.80, 8.0), 0.10, (5.0, 12.0)),
    "de": Band((1.90, 8.0), 0.10, (5.0, 12.0)),
    "fr": Band((1.70, 8.0), 0.10, (5.0, 12.0)),
    "es": Band((1.75, 8.0), 0.10, (5.0, 12.0)),
    "latin": Band((1.50, 8.0), 0.15, (4.8, 12.0)),
    "cyrillic": Band((1.00, 8.0), 0.15, (4.8, 12.0)),
    "greek": Band((0.60, 8.0), 0.30, (4.8, 12.0)),
    "arabic": Band((0.60, 8.0), 0.30, (4.8, 12.0)),
    "cjk": Band((0.30, 4.0), 0.60, (4.0, 12.0)),
    "other": Band((0.20, 8.0), 0.80, (4.0, 12.0)),
}
# First and last code point of the letters that tell a script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "arabic": ((0x600, 0x6FF),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF)),
}

FOUND = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "chars_per_token: double, byte_share: double, entropy: double, band: string, base_failed: boolean, kept: boolean>"
)


def script_of(text: str) -> str:
    """The script with most letters; "other" if no letter belongs to a known one."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = {s: sum(int(((points >= a) & (points <= b)).sum()) for a, b in own) for s, own in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Vocabularies:
    """Tokens of single words: how many of the byte-level vocabulary, which pieces of the other."""

    def __init__(self, ranks_path: str, pieces_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self.known: dict[bytes, tuple[bytes, int]] = {}

    def measure(self, words: list[bytes], times: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Of distinct words and how often each occurs: byte-level tokens, distinct pieces, and how often each occurs."""
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        long: dict[bytes, tuple[bytes, int]] = {}  # rare, and of any length: not remembered
        if new:
            texts = [w.decode(errors="replace") for w in new]
            encode = self.bytes.encode_ordinary
            for w, t, p in zip(new, texts, self.pieces.encode(texts, num_threads=1), strict=True):
                (known if len(w) <= LONGEST else long)[w] = array("I", p).tobytes(), len(encode(" " + t))
        found = [known[w] if w in known else long[w] for w in words] if long else [known[w] for w in words]
        tokens = int(np.fromiter([n for _, n in found], np.int64, len(found)) @ times)
        pieces = np.frombuffer(b"".join([p for p, _ in found]), np.uint32)
        sizes = np.fromiter([len(p) for p, _ in found], np.int64, len(found)) // 4
        distinct, back = np.unique(pieces, return_inverse=True)
        return tokens, distinct, np.bincount(back, np.repeat(times, sizes), len(distinct))


def base_counts(text: bytes, words: list[bytes], codes: np.ndarray) -> tuple[int, int, int, int]:
    """Characters in words, symbols, lines that repeat an earlier one, words in repeated 3-word windows.

    ``codes`` numbers the words: equal words have equal numbers.
    """
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    symbols = sum(text.count(c) for c in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    seen, duplicates = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            duplicates += line in seen
            seen.add(line)
    repeated = 0
    if len(words) > 3:
        _, inverse, times = np.unique(gram_hashes(mix(codes + np.uint64(1)), 3), return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[inverse] > 1)
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[hit + k] = True
        repeated = int(covered.sum())
    return chars, symbols, duplicates, repeated


def assess(ranks_path: str, pieces_path: str, bands: dict[str, Band] = BANDS) -> Callable:
    """A function of the columns (text as bytes, language) that gives the counts, the measures and the verdict."""
    arrow = to_arrow_type(StructType.fromDDL(f"x {FOUND}")["x"].dataType)

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array, langs: pa.Array) -> pa.Array:
        key = "vocabularies", ranks_path, pieces_path
        vocabularies, out = per_worker(key, lambda: Vocabularies(ranks_path, pieces_path)), []
        for text, lang in zip(texts, langs, strict=True):
            text, lang = text.as_py(), lang.as_py()
            words = text.split()
            numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
            codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            chars, symbols, duplicates, repeated = base_counts(text, words, codes.view(np.uint64))
            tokens, pieces, counts = vocabularies.measure(list(numbers), np.bincount(codes, minlength=len(numbers)))
            n = counts.sum()
            share = counts / max(n, 1)
            per_token = chars / tokens if tokens else 0.0
            byte_share = float(share[vocabularies.is_byte[pieces]].sum())
            entropy = float(-(share * np.log2(share)).sum()) + 0.0
            name = lang if lang in bands else script_of(text.decode(errors="replace"))
            band = bands[name]
            failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
            inside = (
                band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
                and byte_share <= band.byte_share
                and band.entropy[0] <= entropy <= band.entropy[1]
            )
            row = (len(words), chars, symbols, duplicates, repeated, per_token, byte_share, entropy, name, failed)
            out.append(dict(zip(arrow.names, (*row, bool(not failed and inside)), strict=True)))
        return pa.array(out, arrow)

    return found


def _columns(text_col: str, lang_col: str | None) -> tuple:
    return raw_text(text_col), F.col(lang_col).cast("string") if lang_col else F.lit("")


def _expected(curves: dict[str, tuple]) -> Column:
    """Entropy expected of a text of its length; null for a band without a curve."""
    x, out = F.log2("n_words") - 8, F.lit(None).cast("double")
    for band, (a, b, c) in curves.items():
        out = F.when(F.col("band") == band, F.lit(a) + F.lit(b) * x + F.lit(c) * x * x).otherwise(out)
    return out


def entropy_floors(found: DataFrame, least: int = LEAST) -> dict[str, tuple[float, float, float]]:
    """Of each band with enough texts the parabola (in log2 of the words, less 8) below which entropy is too low.

    ``found`` has the measures as columns. Texts that fail the fixed rules do not count, texts with the same length and
    entropy count once. Sums and approximate medians are aggregations; at most one row per band is collected.
    """
    own = found.filter("kept").select("band", "n_words", F.round("entropy", 2).alias("entropy"))
    cells, x = cut(own.distinct()), F.log2("n_words") - 8
    powers = [F.sum(F.pow(x, F.lit(k))) for k in range(5)] + [F.sum(F.pow(x, F.lit(k)) * F.col("entropy")) for k in range(3)]
    curves = {}
    for band, *sums in cells.groupBy("band").agg(*powers).collect():
        if sums[0] >= least:
            normal = np.array([[sums[i + j] for j in range(3)] for i in range(3)])
            curves[band] = tuple(np.linalg.lstsq(normal, np.array(sums[5:]), rcond=None)[0].tolist())
    if not curves:
        return {}
    away = cells.select("band", (F.col("entropy") - _expected(curves)).alias("r")).filter("r IS NOT NULL")
    mids = dict(away.groupBy("band").agg(F.percentile_approx("r", 0.5)).collect())
    middle = F.coalesce(*[F.when(F.col("band") == b, F.lit(m)) for b, m in mids.items()])
    spreads = dict(away.groupBy("band").agg(F.percentile_approx(F.abs(F.col("r") - middle), 0.5)).collect())
    drop = {b: mids[b] - SPREADS * max(1.4826 * spreads[b], NARROW) for b in curves}
    return {b: (a + drop[b], *rest) for b, (a, *rest) in curves.items()}


def _above(floors: dict[str, tuple]) -> Column:
    return F.coalesce(F.col("entropy") >= _expected(floors), F.lit(True))


def measures(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, ranks_path: str, pieces_path: str,
    bands: dict[str, Band] = BANDS,
) -> DataFrame:
    """(id, counts, measures, band, base_failed, kept) of every row.

    Null and blank texts have no words: all counts and measures are 0 and they fail. A null or unknown language falls back to
    the script. Rows repeat as they come; an empty table gives no rows.
    """
    found = assess(ranks_path, pieces_path, bands)(*_columns(text_col, lang_col))
    own = cut(docs.select(F.col(id_col).alias("id"), found.alias("_found")).select("id", "_found.*"))
    return own.withColumn("kept", F.col("kept") & _above(entropy_floors(own)))


def keep_good(
    docs: DataFrame, text_col: str, lang_col: str | None, ranks_path: str, pieces_path: str, bands: dict[str, Band] = BANDS
) -> DataFrame:
    """The rows of ``docs`` with a good verdict, all columns kept.

    All rows are written once with their measures and filtered as they are read again: a filter on a function's result, beside
    the result itself, would make Spark call the function twice.
    """
    found = assess(ranks_path, pieces_path, bands)(*_columns(text_col, lang_col))
    held = cut(docs.select(F.struct(*docs.columns).alias("row"), found.alias("found"))).filter("found.kept")
    floors = entropy_floors(held.select("found.*"))
    return held.select("row", "found.*").filter(_above(floors)).select("row.*")
