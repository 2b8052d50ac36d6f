"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts in more than one place are removed.

A suffix array of the whole corpus would move every byte position; only suffixes that can repeat are sorted here.

1. The winnowed 64-byte gram of every window of ``length`` bytes is its anchor: both places of a repeat have it, so windows
   whose anchor occurs once are out (counts per anchor, combined map-side, then a join on the anchor).
2. Runs of windows with one anchor that are equal as a whole form a class; a class of two or more repeats entirely.
3. What is left are anchors with several classes: their suffixes, one run per class, are sorted by deep-shallow sorting
   (``repeated_suffixes``), and neighbours that share ``length`` bytes are repeats.
4. An anchor with more than ``GROUP`` classes is dealt over several tasks, each of which sorts its share; the distinct strings
   that a share is left with are then counted over the shares, blocks of neighbouring ones first by what they have in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut, parallelism
from .common import column_type, gram_hashes, map_rows, mix, runs_of, winnow
from .repeats import keyed, open_classes, rewrite, seeds_and_classes, unite, window_runs, with_texts

LENGTH = 400
GRAM = 64
GROUP = 2_048  # classes of one anchor sorted in one task
BATCH = 4 << 20  # bytes sorted at a time
SHALLOW = 64  # depth at which multikey quicksort hands over to blind tries
BLOCK = 32  # strings of neighbouring starts that are compared over shares together
STEP = 8  # bytes that multikey quicksort takes as one character


class BlindTrie:
    """Orders strings of one length: inner nodes hold a depth and branch on one byte, leaves hold equal strings.

    A string goes down blindly (only branching bytes are compared) to some leaf; one comparison with that leaf's string gives
    the depth at which it leaves the path.
    """

    def __init__(self, text: bytes, member: int):
        self.size = len(text)
        self.root: list = [self.size, text, [member]]  # a leaf: [full depth, text, members]; inner: [depth, children]

    def insert(self, text: bytes, member: int) -> None:
        node, size = self.root, self.size
        while node[0] < size:
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        if node[1] == text:
            node[2].append(member)
            return
        differ = int.from_bytes(node[1]) ^ int.from_bytes(text)
        depth = size - (differ.bit_length() + 7) // 8
        other, leaf = node[1][depth], [size, text, [member]]
        parent, node = None, self.root
        while node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        if node[0] == depth and depth < size:
            node[1][text[depth]] = leaf
            return
        inner = [depth, {other: node, text[depth]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]]] = inner

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def repeated_suffixes(
    contexts: list[bytes], groups: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deep-shallow sort of the first ``starts[i]`` suffixes of each context, within groups, to a depth of ``length``.

    Returns (context, offset, leader) per suffix: leader is the number of the first suffix with the same ``length`` bytes.
    Shallow: multikey quicksort with characters of eight bytes, all partitions of a level at once; a partition of one suffix
    is done. Deep: partitions still together at ``shallow`` go to a blind trie; a partition of two needs one comparison.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    buffer = b"".join(contexts) + bytes(STEP)
    raw = np.frombuffer(buffer, np.uint8)
    chars = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, STEP)).view(">u8").ravel().astype(np.uint64)
    context = np.repeat(np.arange(len(contexts)), starts)
    offset = np.arange(len(context)) - np.repeat(np.cumsum(starts) - starts, starts)
    pos = base[context] + offset
    leader = np.arange(len(pos))

    live, part = leader.copy(), groups[context]
    # The last character may reach back over bytes already compared, so that no suffix is read past its length.
    depths = [min(d, length - STEP) for d in range(0, length, STEP)]
    for d in [d for d in depths if d < shallow]:
        key = chars[pos[live] + d]
        order = np.lexsort((key, part))
        live, part, key = live[order], part[order], key[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])] if len(live) else np.empty(0, bool)
        part = np.cumsum(new)
        several = np.bincount(part)[part] > 1 if len(live) else new
        live, part = live[several], part[several]
        if not len(live):
            return context, offset, leader
    first, last = runs_of(part)
    two = last - first == 1
    one, other = live[first[two]], live[last[two]]
    for d in [d for d in depths if d >= shallow]:
        if not len(one):
            break
        same = chars[pos[one] + d] == chars[pos[other] + d]
        one, other = one[same], other[same]
    leader[np.maximum(one, other)] = np.minimum(one, other)
    deep = min(shallow, length)
    for a, b in zip(first[~two].tolist(), last[~two].tolist(), strict=True):
        members = live[a : b + 1].tolist()
        trie = None
        for m in members:
            at = int(pos[m])
            tail = buffer[at + deep : at + length]
            if trie is None:
                trie = BlindTrie(tail, m)
            else:
                trie.insert(tail, m)
        for equal in trie.leaves():
            if len(equal) > 1:
                leader[equal] = min(equal)
    return context, offset, leader


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def spans_of_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, _row, spans): maximal byte spans covered by repeated strings; only rows that have some."""
    rows, kind = keyed(docs, id_col, text_col), column_type(docs, id_col)

    def runs_of_text() -> Callable:
        def runs(text: bytes, reach: bool) -> tuple:
            anchor, first, last = window_runs(_BYTE[np.frombuffer(text, np.uint8)], length, gram)
            if not reach:
                return anchor, first, last, None
            spans = zip(first.tolist(), last.tolist(), strict=True)
            whole = [xxhash.xxh3_64_intdigest(text[a : b + length]) for a, b in spans]
            return anchor, first, last, np.array(whole, np.uint64)

        return runs

    seeds, classes = seeds_and_classes(rows, kind, runs_of_text)
    shared = classes.filter("n > 1").select("anchor", "reach")
    whole = seeds.join(shared, ["anchor", "reach"]).select(
        "id", "_row", "start", (F.col("start") + F.col("windows") - 1 + length).alias("end")
    )
    return unite(whole.unionByName(_sorted(rows, open_classes(classes), kind, length, gram)), kind)


def _sorted(docs: DataFrame, runs: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """(id, _row, start, end): repeats among the first runs of the classes of each anchor."""
    shares = F.ceil(F.col("classes") / GROUP).cast("int")
    dealt = runs.select(
        "id", "_row", "anchor", "start", "windows", "n", shares.alias("shares"), F.pmod("reach", shares).cast("int").alias("share")
    )

    def contexts(rows: Iterable[tuple]) -> Iterator[tuple]:
        for key, row, held, text in rows:
            for x in held:
                a, k = x["start"], x["windows"]
                yield x["anchor"], x["share"], x["shares"], x["n"], key, row, a, k, text[a : a + k - 1 + length]

    schema = (
        f"anchor bigint, share int, shares int, n bigint, id {kind}, _row bigint, start int, windows int, context binary"
    )
    texts = map_rows(with_texts(docs, dealt, "n", "shares", "share"), schema, contexts, flush=2_000)
    # Copies of a repeated row bring the same run twice.
    texts = texts.repartition(2 * parallelism(docs.sparkSession), "anchor", "share")
    texts = texts.sortWithinPartitions("anchor", "share", "id", "_row", "start")

    def sort(rows: Iterable[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        size, group = 0, None
        for row in rows:
            if held and row[4:7] == held[-1][4:7] and row[:2] == held[-1][:2]:
                continue
            if size >= BATCH and row[:2] != group:  # groups stay whole
                yield from _sort_batch(held, length, gram)
                held, size = [], 0
            held.append(row)
            size, group = size + len(row[-1]), row[:2]
        if held:
            yield from _sort_batch(held, length, gram)

    schema = (
        f"id {kind}, _row bigint, start int, end int, anchor bigint, block int, core bigint, share int, "
        "starts array<int>, strings array<bigint>"
    )
    found = cut(map_rows(texts, schema, sort))
    spans = found.filter("core is null").select("id", "_row", "start", "end")
    # Over the shares of an anchor: first the bytes that all strings of a block have in common, then the strings.
    key = ["anchor", "block", "core"]
    meet = found.filter("core is not null").groupBy(*key).agg(F.min("share").alias("a"), F.max("share").alias("b"))
    over = found.join(cut(meet.filter("a <> b").select(*key)), key)
    over = over.select("id", "_row", "anchor", F.explode(F.arrays_zip("starts", "strings")).alias("x"))
    over = cut(over.select("id", "_row", "anchor", "x.starts", "x.strings"))
    again = over.groupBy("anchor", "strings").count().filter("count > 1").drop("count")
    more = over.join(again, ["anchor", "strings"])
    return spans.unionByName(more.select("id", "_row", F.col("starts").alias("start"), (F.col("starts") + length).alias("end")))


def _sort_batch(held: list[tuple], length: int, gram: int) -> Iterator[tuple]:
    """Spans of repeats within each group; for anchors with several shares also the strings that lead their equals.

    Leaders come in blocks of ``BLOCK`` by their distance from the anchor, each with a hash of the bytes that all strings of
    the block contain: a block whose common bytes no other share has holds no further repeats.
    """
    keys = [row[:2] for row in held]
    groups = np.cumsum([0] + [a != b for a, b in zip(keys, keys[1:], strict=False)])
    texts, starts = [row[8] for row in held], np.array([row[7] for row in held], np.int64)
    _, _, leader = repeated_suffixes(texts, groups, starts, length)
    repeated = np.bincount(leader, minlength=len(leader))[leader] > 1
    at = np.cumsum(starts) - starts
    digest = xxhash.xxh3_64_intdigest
    for i, (anchor, share, shares, n, key, row, start, windows, text) in enumerate(held):
        flags = repeated[at[i] : at[i] + windows]
        if n == 1 and flags.any():  # a class of several is removed as a whole already
            edges = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield key, row, start + a, start + b - 1 + length, None, None, None, None, None, None
        if shares > 1:
            own = np.flatnonzero(leader[at[i] : at[i] + windows] == np.arange(at[i], at[i] + windows))
            place = int(winnow(gram_hashes(_BYTE[np.frombuffer(text, np.uint8)], gram), length - gram + 1)[0])
            blocks = (place - own) // BLOCK
            for k in np.unique(blocks).tolist():
                some = own[blocks == k].tolist()
                last = place - k * BLOCK
                core = digest(text[last : last - BLOCK + 1 + length]) - 2**63
                strings = [digest(text[o : o + length]) - 2**63 for o in some]
                yield key, row, None, None, anchor, k, core, share, [start + o for o in some], strings


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): spans are the maximal removed byte runs, kept the bytes that stay.

    All places of a repeated string are removed, the first one too; strings never cross documents and are judged on the input.
    A row that repeats id and text is a place of its own. Null texts are empty; texts below ``length`` bytes lose nothing. An
    empty table gives no rows. ``kept`` may cut a character in two, so it is binary.
    """
    spans = spans_of_repeats(docs, id_col, text_col, length, gram)

    def keep(text: bytes, spans: list) -> tuple:
        kept, at = [], 0
        for x in spans:
            kept.append(text[at : x["start"]])
            at = x["end"]
        kept.append(text[at:])
        left = b"".join(kept)
        return len(text), len(text) - len(left), spans, left

    schema = "n_bytes bigint, n_removed bigint, spans array<struct<start: int, end: int>>, kept binary"
    return rewrite(keyed(docs, id_col, text_col), spans, schema, keep)
