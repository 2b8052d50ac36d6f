"""A trie of conversation prefixes, by ROLLUP over positional turn columns.

A turn is known by a digest of its role and text and the length of its text. ``WIDTH`` consecutive turns of a conversation stand
in one row, a block, as columns t0 t1 ...; ROLLUP over these columns aggregates all prefixes that end inside the block in one
pass, and ``grouping_id`` tells their depth. Longer conversations go on in further blocks. These group by the node that the
blocks before them lead to as well, a fingerprint of position and turn, exclusive-ored over the turns before the block; so
blocks of every depth go through the same ROLLUP.

Nodes carry the smallest conversation that passes through them. A conversation is the smallest one of a run of nodes on its
path, from some depth to its end, and sums over subtrees follow from sums over such runs: every run below a node belongs to a
conversation through the node, so a second ROLLUP adds whole runs up, and the part of the node's own run above it is a running
sum along the run.

Positions and running sums are taken over range-partitioned chunks, joins that may meet a hot key go through ``join_unique``,
and the ids that end in a node are hashed in order from pieces of a bounded span of ids; no conversation, turn or node is held
by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.order import running
from ..session import cut
from .common import join_unique, map_rows

WIDTH = 8
SPAN = 4_096  # ids of one piece of the list of ends
_TS = [f"t{j}" for j in range(WIDTH)]


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, turn_id): turns in the order of their number (null first), from position 0.

    Turns of one number follow each other by their digest. Null roles and texts count as empty ones. Rows without a
    conversation id belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    apart = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)  # no two turns have one spelling
    turn_id = F.concat(F.md5(apart.cast("binary")), F.lit(":"), F.octet_length(text).cast("string"))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id.alias("turn_id"),
        F.lit(1).cast("long").alias("one"),
    )
    return running(rows, ["conv_id"], ["turn", "turn_id"], "one", "pos").select("conv_id", "pos", "turn_id")


def spliced(turns: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, pos, turn_id): every conversation starts with the first ``head`` turns of conversation ``base`` in place of
    its own first ``head`` turns.

    Both are expressions of ``conv_id``; ``head`` is at most ``most``. What the other conversation lacks is missing, and
    nothing is taken from one that does not exist; the turns behind close up.
    """
    turns = cut(turns)
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    first = turns.filter(F.col("pos") < most)
    own = cut(sizes.select("conv_id", base.alias("base"), head.alias("head")))
    lent = own.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("lends")), "base", "left")
    given = cut(lent.select("conv_id", "head", F.least("head", F.coalesce("lends", F.lit(0))).alias("given")))
    taken = (
        own.filter("head > 0")
        .join(first.select(F.col("conv_id").alias("base"), "pos", "turn_id"), "base")
        .filter("pos < head")
        .select("conv_id", "pos", "turn_id")
    )
    rest = join_unique(turns, given, ["conv_id"]).filter("pos >= head")
    return taken.unionByName(rest.select("conv_id", (F.col("pos") - F.col("head") + F.col("given")).alias("pos"), "turn_id"))


def _print(seed: int, pos: Column, turn_id: Column) -> Column:
    """What a turn at a position adds to the fingerprint; nothing for a missing one."""
    return F.when(turn_id.isNotNull(), F.xxhash64(F.lit(seed), pos, turn_id)).otherwise(F.lit(0).cast("long"))


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, t0 .., size, xa, xb, pa, pb): the turns of a block, its fingerprint and that of all before it.

    A conversation of ``convs`` without turns has an empty block 0.
    """
    slot, pos = F.col("pos") % WIDTH, F.col("pos")
    rows = turns.groupBy("conv_id", F.floor(pos / WIDTH).cast("long").alias("block")).agg(
        *[F.max(F.when(slot == j, F.col("turn_id"))).alias(t) for j, t in enumerate(_TS)],
        F.count(F.lit(1)).alias("size"),
        *[F.bit_xor(_print(s, pos, F.col("turn_id"))).alias(x) for s, x in enumerate(("xa", "xb"))],
    )
    rows = running(rows, ["conv_id"], ["block"], ["xa", "xb"], ["pa", "pb"], how="xor")
    none = {t: F.lit(None).cast("string") for t in _TS} | {c: F.lit(0).cast("long") for c in ("block", "size", "xa", "xb", "pa", "pb")}
    rows = cut(rows)
    bare = convs.join(rows.filter("block = 0").select("conv_id"), "conv_id", "left_anti").withColumns(none)
    return rows.unionByName(bare.select(*rows.columns))


def _rolled(rows: DataFrame, sums: str = "") -> DataFrame:
    """Every prefix once: its depth and fingerprint, those of its parent, its conversations, bytes of its last text, sums."""
    turns = ", ".join(_TS)
    found = rows.sparkSession.sql(
        f"SELECT block, pa, pb, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, count(*) AS n_convs, "
        f"min(conv_id) AS conv_id{sums} FROM {{rows}} GROUP BY block, pa, pb, ROLLUP ({turns})",
        rows=rows,
    )
    # Groups of conversations that end before the level repeat a shallower one; level 0 repeats the block before but for the root.
    size = sum((F.col(t).isNotNull().cast("int") for t in _TS), F.lit(0))
    found = found.filter((size == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    depth = F.col("block") * WIDTH + F.col("level")
    last = F.coalesce(*map(F.col, reversed(_TS)))
    prints = {}
    for seed, (name, before) in enumerate((("na", "pa"), ("nb", "pb"))):
        own = F.col(before)
        for j, t in enumerate(_TS):
            own = own.bitwiseXOR(_print(seed, F.col("block") * WIDTH + j, F.col(t)))
        prints[name] = own
        prints["up_" + name] = own.bitwiseXOR(_print(seed, depth - 1, last))
    size = F.coalesce(F.substring_index(last, ":", -1).cast("long"), F.lit(0))
    extra = [c for c in found.columns if c.startswith("sum_")]
    return found.select(
        depth.cast("long").alias("depth"), *[c.alias(k) for k, c in prints.items()], "n_convs", "conv_id",
        ((F.col("n_convs") - 1) * size).alias("own"), *extra,
    )


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, na, nb, n_ends, ends_sha256): digest of the ids that end in a node, ascending, joined by commas.

    The ids of a span make one piece; a node's pieces go through the hash one after another.
    """
    key = ["depth", "na", "nb"]
    ends = rows.groupBy("conv_id").agg(
        F.sum("size").alias("depth"), F.bit_xor("xa").alias("na"), F.bit_xor("xb").alias("nb")
    )
    own = F.array_sort(F.collect_list("conv_id"))
    pieces = ends.groupBy(*key, F.floor(F.col("conv_id") / SPAN).cast("long").alias("piece")).agg(
        F.array_join(F.transform(own, lambda c: c.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n")
    )

    def each(lines: Iterable[tuple]) -> Iterator[tuple]:
        node, digest, total = None, None, 0
        for depth, na, nb, ids, n in lines:
            if (depth, na, nb) != node:
                if node is not None:
                    yield *node, total, digest.hexdigest()
                node, digest, total = (depth, na, nb), hashlib.sha256(ids.encode()), n
            else:
                digest.update(b"," + ids.encode())
                total += n
        if node is not None:
            yield *node, total, digest.hexdigest()

    sorted_ = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids", "n")
    return map_rows(sorted_, "depth bigint, na bigint, nb bigint, n_ends bigint, ends_sha256 string", each)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node (distinct sequence of first turns) of ``turns`` (conv_id, pos, turn_id), from the root of depth 0 on.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is known by its depth
    and the smallest conversation through it. ``convs`` (conv_id) holds every conversation once, also those without turns;
    these end in the root. ``saved_tokens`` adds up, over a subtree, a node's conversations but one times the bytes of its
    last text. Equal conversations share all their nodes. No conversations give no nodes.
    """
    key = ["depth", "na", "nb"]
    rows = cut(blocks(turns, convs))
    ends = cut(_ends(rows))
    first = cut(_rolled(rows))
    # What a conversation adds to every node above its run: all of the run, and a leaf if the run ends in one.
    leaf = first.join(ends.select(*key, "n_ends"), key).filter("n_ends = n_convs").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    runs = first.groupBy("conv_id").agg(F.sum("own").alias("run")).join(leaf, "conv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    held = cut(join_unique(rows, cut(runs), ["conv_id"]).withColumns({"run": zero("run"), "leaf": zero("leaf")}))
    nodes = _rolled(held, ", sum(run) AS sum_run, sum(leaf) AS sum_leaf")
    nodes = running(nodes, ["conv_id"], ["depth"], "own", "above")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up_na").alias("na"), F.col("up_nb").alias("nb"))
    nodes = cut(nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), key, "left").join(ends, key, "left"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("na").alias("up_na"), F.col("nb").alias("up_nb"), F.col("conv_id").alias("parent_conv_id"))
    found = join_unique(nodes, parents, ["depth", "up_na", "up_nb"])
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        zero("n_children").alias("n_children"), F.col("sum_leaf").alias("n_leaves"),
        (F.col("sum_run") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
    base: Column | None = None, head: Column | None = None, most: int = 0,
) -> DataFrame:
    """:func:`prefix_trie` of a table of turns; with ``base`` and ``head`` its conversations are :func:`spliced` first."""
    turns = numbered(conversations, conv_col, turn_col, role_col, text_col)
    convs = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    if base is not None:
        turns = spliced(turns, base, head, most)
    return prefix_trie(turns, convs)
