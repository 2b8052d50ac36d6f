"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns run only where one was found, and formats with an
embedded checksum are confirmed by it.

Texts are scanned as UTF-8 bytes, one character per byte, so a scan never changes positions; reported positions are code
points. Hexadecimal runs have no keyword: a run of n digits covers every n-th position, so probing those positions finds all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import column_type, map_rows, raw_text

MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 12, 18, 16


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched where one of ``keywords`` begins; a match that ``accept`` refuses is passed over."""

    kind: str
    keywords: tuple[str, ...]
    pattern: str
    accept: Callable[[re.Match], bool]
    any_case: bool = False


_BASE62 = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")}


def base62(text: str) -> int:
    n = 0
    for c in text:
        n = n * 62 + _BASE62[c]
    return n


def token_checksum(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    return base62(m[2]) == zlib.crc32(m[1].encode("latin-1"))


def luhn(digits: str) -> bool:
    """Checksum of payment card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _json_header(m: re.Match) -> bool:
    """The first part of a web token decodes to a JSON object that names an algorithm."""
    import base64
    import json

    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


# Published token formats. The base rules come first, in the order of their kinds.
RULES = (
    Rule(
        "assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= MIN_ASSIGNED, any_case=True,
    ),
    Rule("access", ("AKIA",), r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= MIN_ACCESS),
    Rule("hex", (), r"[0-9a-f]+", lambda m: len(m[0]) >= MIN_HEX),
    Rule("hosted", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", token_checksum),
    Rule("package", ("npm_",), r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", token_checksum),
    Rule("jwt", ("eyJ",), r"(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", _json_header),
    Rule("pem", ("-----BEGIN ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", lambda m: True),
)
KINDS = tuple(r.kind for r in RULES)

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        import ahocorasick

        self.rules = rules
        self.patterns = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in rules]
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for word in r.keywords:
                found.setdefault(word.lower(), []).append(i)
        for word, own in found.items():
            self.automaton.add_word(word, (len(word), own))
        self.automaton.make_automaton()

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, by start and then rule; per rule leftmost and not overlapping."""
        text = data.decode("latin-1")
        lower = data.lower().decode("latin-1")  # bytes: only A-Z change
        done, spans = [0] * len(self.rules), []
        starts = [(end - size + 1, i) for end, (size, own) in self.automaton.iter(lower) for i in own]
        for i, r in enumerate(self.rules):
            if not r.keywords:
                starts += [(a, i) for a in _hex_starts(data)]
        for at, i in sorted(starts):
            if at < done[i]:
                continue
            m = self.patterns[i].match(text, at)
            if m:
                done[i] = m.end()
                if self.rules[i].accept(m):
                    spans.append((at, i, m.end()))
        if spans and not data.isascii():
            lead = np.cumsum(np.r_[0, (np.frombuffer(data, np.uint8) & 0xC0) != 0x80])
            spans = [(int(lead[a]), i, int(lead[b])) for a, i, b in spans]
        return sorted(spans)


def _hex_starts(data: bytes) -> list[int]:
    """Starts of the maximal runs of at least MIN_HEX hexadecimal digits: each covers a position MIN_HEX k - 1."""
    probe = np.frombuffer(data, np.uint8)[MIN_HEX - 1 :: MIN_HEX]
    out, end = [], 0
    for at in ((np.flatnonzero(_HEX[probe]) + 1) * MIN_HEX - 1).tolist():
        if at < end:
            continue
        a, b = at, at + 1
        while a > end and _HEX[data[a - 1]]:
            a -= 1
        while b < len(data) and _HEX[data[b]]:
            b += 1
        end = b
        if b - a >= MIN_HEX:
            out.append(a)
    return out


def find_secrets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans): spans of (kind, start, end, text) by start, then in the order of ``KINDS``; one pass, nothing exchanged.

    Null and empty texts have no spans; rows repeat as they come; an empty table gives no rows.
    """

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        scanner = Scanner()
        for key, data in rows:
            spans = scanner.scan(data)
            text = data.decode(errors="replace") if spans else ""
            yield key, [{"kind": KINDS[i], "start": a, "end": b, "text": text[a:b]} for a, i, b in spans]

    kind = column_type(docs, id_col)
    schema = f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, text: string>>"
    return map_rows(docs.select(id_col, raw_text(text_col).alias("_text")), schema, each)
