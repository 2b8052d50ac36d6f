"""Best-two-fit packing of token sequences.

How full a bin gets depends on lengths alone, and there are at most ``capacity`` of them. So the packing is planned on the
histogram of lengths (at most 2048 counts reach the driver, whatever the corpus): a bin is filled greedily with the longest
piece that fits, then its smallest piece is replaced by the two unpacked pieces that fit the gap it leaves more tightly. The
same bin content is repeated while the counts it was decided on last, so a plan has some thousand lines. Pieces then get their
rank among the pieces of their length, by counts per partition, and the plan line of that rank is their place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .common import CACHE, column_type, map_rows

CAPACITY = 2_048


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


# The vocabulary's own splitting rule, written out for characters up to U+017F.
_LETTERS, _DIGITS = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPLIT = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^ {_LETTERS}{_DIGITS}]+")
_LAST = 0x17F


class TokenIds(dict):
    """Token ids (little-endian 32-bit) of the parts that the vocabulary's splitting rule gives, remembered within a task.

    Text of visible characters up to U+017F (which composition leaves alone and lower case maps one to one) is split here,
    and only new parts go to the merge rules. Other stretches between blanks go through the tokenizer as a whole: it never
    merges across a blank, and a blank itself gives no token. Both ways give the tokenizer's ids for the text.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.room = CACHE

    def __missing__(self, part: str) -> bytes:
        letters = self.letters
        same = part if part.isascii() else "".join([letters[b] for b in part.encode()])
        ids = array("I", [t.id for t in self.merge(same)]).tobytes()
        self.room -= 1 + len(part) // 16
        if self.room < 0:  # start anew; long parts use the room up sooner
            self.clear()
            self.room = CACHE
        self[part] = ids
        return ids

    @staticmethod
    def plain(text: str) -> bool:
        if not text.isprintable() or "<|" in text:
            return False
        if text.isascii():
            return True
        return "\u0130" not in text and int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").max()) <= _LAST

    def of(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        if self.plain(text):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text.lower())))
        out = []
        for stretch in text.split(" "):
            if self.plain(stretch):
                out += map(self.__getitem__, _SPLIT.findall(stretch.lower()))
            else:
                out.append(np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents with their end id, cut only where longer than a sequence."""
    kind = column_type(docs, id_col)

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        known, end, step = TokenIds(vocabulary), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for key, text in rows:
            ids = known.of(text) + end
            for piece, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                yield key, piece, at // 4, len(part) // 4, zlib.crc32(part)

    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return map_rows(picked, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", each)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Plan lines (length, first rank, last rank + 1, first bin, offset), in the order of ranks."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    lines, bins = [], 0
    while left.any():
        content = _fill(left, capacity)
        lengths, times = np.unique(content, return_counts=True)
        repeat = int((left[lengths] // times).min())
        offset = 0
        for length in content:
            lines.append((length, int(taken[length]), int(taken[length]) + repeat, bins, offset))
            taken[length] += repeat
            left[length] -= repeat
            offset += length
        bins += repeat
    return lines


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one bin: greedily the longest that fits, then two pieces for the smallest if they fit more tightly."""
    have, content, gap = left.copy(), [], capacity
    while gap:
        fits = np.flatnonzero(have[: gap + 1])
        if not len(fits):
            break
        longest = int(fits[-1])
        content.append(longest)
        have[longest] -= 1
        gap -= longest
    if gap and len(content) > 1:
        smallest = content[-1]
        room = gap + smallest
        have[smallest] += 1
        fits = np.flatnonzero(have[: room + 1])
        # For each first piece the longest second one that still fits; a length with one piece left can't be both.
        at = np.searchsorted(fits, room - fits, side="right") - 1
        at -= (at >= 0) & (fits[at] == fits) & (have[fits] < 2)
        both = np.where(at >= 0, fits + fits[at], 0)
        if len(both) and both.max() > smallest:
            i = int(both.argmax())
            content[-1:] = sorted((int(fits[i]), int(fits[at[i]])), reverse=True)
    return content


def place(found: DataFrame, capacity: int) -> DataFrame:
    """``found`` with sequence_id and offset; rows with equal lengths and ids may trade places."""
    dealt = cut(found.withColumn("_bucket", F.spark_partition_id()))
    # Ranks within a length: numbered inside each bucket, plus the counts of the buckets before.
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(sizes.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    totals = offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    lines: dict[int, list[tuple[int, ...]]] = {}
    for length, *line in plan({r["length"]: r["n"] for r in totals}, capacity):
        lines.setdefault(length, []).append(tuple(line))  # lines of a length cover its ranks in order, without gaps
    shared = found.sparkSession.sparkContext.broadcast(lines)

    inside = W.partitionBy("length", "_bucket").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(offsets.drop("n"), ["length", "_bucket"])
    ranked = ranked.select(*found.columns, (F.col("_in") + F.col("_before")).alias("_rank"))

    def each(rows: Iterable[tuple]) -> Iterator[tuple]:
        starts = {length: [x[0] for x in own] for length, own in shared.value.items()}
        at = found_columns.index("length")
        for *row, rank in rows:
            length = row[at]
            first, _, sequence, offset = shared.value[length][bisect_right(starts[length], rank) - 1]
            yield *row, sequence + rank - first, offset

    found_columns = found.columns
    schema = StructType([*found.schema.fields, *StructType.fromDDL("sequence_id bigint, offset bigint").fields])
    return map_rows(ranked, schema, each)


def pack(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    Only documents longer than ``capacity`` are cut, into pieces of ``capacity`` ids, the last as long as it comes. Null and
    empty texts are the end id alone. Repeated rows are packed once each. Sequences are numbered from 0 and have no gaps. An
    empty table gives no rows. ``vocabulary`` is the path of a tokenizer file on every machine.
    """
    return place(pieces(docs, id_col, text_col, vocabulary, capacity, end_id), capacity)
