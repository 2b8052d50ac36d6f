"""Substring dedup by seed and extend: words covered by a repeat of ``length`` words that starts earlier are removed.

Seeds: of the k-gram hashes in a window of ``length`` words the smallest (rightmost of equals) is the window's anchor, so both
places of a repeat have the same anchor at the same distance. Consecutive windows with one anchor form a run, and the run's
words are the farthest that an extension from the anchor can reach while the anchor stays the same.

1. Anchors that occur once are dropped: counts per anchor (combined map-side), then a join on the anchor.
2. Runs that are equal as a whole form a class. All but the first of a class are repeats over their whole reach.
3. Anchors with several classes are extended both ways: for each split of ``length`` words into left and right of the anchor,
   the first run of each class looks for an earlier run with the same words on both sides.
4. Accepted windows that touch or overlap are united per document: the maximal repeats.

No pairs are listed. Every step is a keyed minimum, combined before its exchange, so a passage held by a third of the
documents costs one row per task and window; the join of step 1 has one row per anchor on its small side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import Ranges, WordHashes, column_type, map_arrays
from .repeats import keyed, open_classes, place, rewrite, seeds_and_classes, unite, window_runs, with_texts

LENGTH = 20
GRAM = 6


def spans_of_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, _row, spans): word spans covered by a window that also starts earlier; only rows that have some."""
    rows, kind = keyed(docs, id_col, text_col), column_type(docs, id_col)

    def runs_of_text() -> Callable:
        hashes = WordHashes()

        def runs(text: bytes, reach: bool) -> tuple:
            h = hashes.array(text.split())
            anchor, first, last = window_runs(h, length, gram)
            return anchor, first, last, Ranges(h)(first, last + length) if reach and len(first) else anchor

        return runs

    seeds, classes = seeds_and_classes(rows, kind, runs_of_text)
    # Whole runs that an earlier run equals.
    shared = classes.filter("n > 1").select("anchor", "reach", "least")
    whole = (
        seeds.join(shared, ["anchor", "reach"])
        .filter(~place().eqNullSafe(F.col("least")))
        .select("id", "_row", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end"))
    )
    return unite(whole.unionByName(_extend(rows, open_classes(classes), kind, length)), kind)


def _extend(docs: DataFrame, runs: DataFrame, kind: str, length: int) -> DataFrame:
    """(id, _row, start, end): windows of the runs whose words on both sides of the anchor also occur earlier."""

    def windows(rows: Iterable[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        for key, row, held, text in rows:
            ranges = Ranges(hashes.array(text.split()))
            start = np.concatenate([np.arange(x["start"], x["start"] + x["windows"]) for x in held])
            anchor = np.repeat([x["anchor"] for x in held], [x["windows"] for x in held])
            # Equal words give equal anchors at equal distance: the window's hash stands for both of its sides.
            sides = ranges(start, start + length).view(np.int64)
            yield key, np.full(len(start), row, np.int64), anchor, sides, start

    schema = f"id {kind}, _row bigint, anchor bigint, sides bigint, start int"
    spread = cut(map_arrays(with_texts(docs, runs), schema, windows))
    first = spread.groupBy("anchor", "sides").agg(F.min(place()).alias("least"), F.count(F.lit(1)).alias("n"))
    later = spread.join(first.filter("n > 1").drop("n"), ["anchor", "sides"])
    later = later.filter(~place().eqNullSafe(F.col("least")))
    return later.select("id", "_row", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_removed, kept): the words that stay, joined by one space.

    "Earlier" is a smaller id, or the same document and an earlier start; a null id comes before all others. Rows with one id
    and different texts are ordered by a hash of the text; rows that repeat id and text get one and the same result and do
    not remove words from each other. Null, blank and short texts (below ``length`` words) lose nothing. An empty table
    gives no rows.
    """
    spans = spans_of_repeats(docs, id_col, text_col, length, gram)

    def keep(text: bytes, spans: list) -> tuple:
        words, kept, at = text.split(), [], 0
        for x in spans:
            kept += words[at : x["start"]]
            at = x["end"]
        kept += words[at:]
        return len(words), len(words) - len(kept), b" ".join(kept).decode(errors="replace")

    return rewrite(keyed(docs, id_col, text_col), spans, "n_words bigint, n_removed bigint, kept string", keep)
