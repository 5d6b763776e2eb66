"""The prefix trie of conversations, and sums over its subtrees by the Euler-tour technique.

A node is a distinct sequence of first turns. A prefix is told by the XOR of its turns' hashes, each taken with the turn's
place, so prefixes of a conversation of any length come from pieces of it. Nodes are numbered by (smallest member, depth), which
no two share.

The Euler tour enters and leaves each node once. Its arcs are a linked list: entering leads to the first child or, in a leaf, to
leaving; leaving leads to the next sibling or to leaving the parent. The list is ranked in two steps: blocks of consecutive nodes
follow it as far as it stays inside (a path of a conversation mostly does), with NumPy; what is left is one link for each place
where the list enters a block, and pointer doubling over those links gives their distance from the end. Arcs are then laid out by
their positions, summed in pieces, and a subtree's sum is the difference between leaving and entering.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import WORDS, text_of
from ledgerloom.operators.ordering import global_index, range_sorted, rank_within
from ledgerloom.session import durable

PIECE_BITS = 14  # turns of a conversation, or arcs of the tour, that one window sums
BLOCK_BITS = 13  # nodes of a block
STRIDE, HEADS = 20, 4  # conversations that share a beginning, and how many lengths it has
IDS = 10_000  # ids of one string
KEY = ["depth", "p1", "p2"]


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, words): every turn with its place from one, 128 bits of its role and text, and its words."""
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
    )
    placed = rank_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "text"], "pos")
    return placed.select(
        "conv_id",
        "pos",
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "text", "role").alias("t2"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
    )


def with_shared_heads(turns: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c has begun with the first crc32(c) % heads turns of conversation c - c % stride.

    The turns keep their columns; the conversations are (conv_id, n), the turnless ones included.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = own.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % stride).alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).alias("h"))
    sizes = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))).alias("taken")
    convs = durable(convs.join(sizes, "base", "left").select("conv_id", "base", "h", taken, (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    begun = turns.filter(F.col("pos") < heads).withColumnRenamed("conv_id", "base")  # at most a few turns of a conversation
    first = convs.filter("taken > 0").join(begun, "base").filter("pos <= h").select("conv_id", "pos", "t1", "t2", "words")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "words")
    return first.unionByName(rest), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, words): each turn as the end of a prefix, told by p, after the prefix told by q."""
    marks = turns.select(
        "conv_id", F.col("pos").alias("depth"), "words", F.shiftright("pos", PIECE_BITS).alias("piece"),
        F.xxhash64(F.lit(1), "pos", "t1", "t2").alias("u1"), F.xxhash64(F.lit(2), "pos", "t2", "t1").alias("u2"),
    )
    marks = durable(marks, "trie-turns")
    here = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = marks.groupBy("conv_id", "piece").agg(F.bit_xor("u1").alias("w1"), F.bit_xor("u2").alias("w2"))
    before = whole.select("conv_id", "piece", *[F.bit_xor(f"w{i}").over(earlier).alias(f"b{i}") for i in (1, 2)]).filter("piece > 0")
    within = marks.withColumns({f"x{i}": F.bit_xor(f"u{i}").over(here) for i in (1, 2)}).join(before, ["conv_id", "piece"], "left")
    p = [F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0).cast("long"))) for i in (1, 2)]
    return within.select("conv_id", "depth", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("u1")).alias("q1"), p[1].bitwiseXOR(F.col("u2")).alias("q2"), "words")


def id_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each key's conv_ids, decimal, ascending and comma-joined. Ids are ordered over all tasks and joined piece by
    piece; the pieces of a key are then digested one after the other, so no list of ids is ever one value."""

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = frame[KEY].to_numpy(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(frame) else []
            cuts = sorted({*starts, *range(0, len(frame), IDS)})
            ids = frame["conv_id"].to_numpy(np.int64)
            pieces = [(*keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(cuts, [*cuts[1:], len(frame)], strict=True)]
            yield pd.DataFrame(pieces, columns=[*KEY, "first", "ids"])

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest = None, hashlib.sha256()
        for frame in frames:
            done = []
            for *now, ids in frame[[*KEY, "ids"]].itertuples(index=False):
                if now == key:
                    digest.update(b",")
                else:
                    if key is not None:
                        done.append([*key, digest.hexdigest()])
                    key, digest = now, hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([[*key, digest.hexdigest()]], columns=[*KEY, "ends_sha256"])

    pieces = range_sorted(ends, *KEY, "conv_id").mapInPandas(joined, "depth long, p1 long, p2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(digested, "depth long, p1 long, p2 long, ends_sha256 string")


def _followed(nodes: DataFrame, bits: int) -> DataFrame:
    """(arc, to, steps) for both arcs of each node: the arc of another block that the list reaches next (-1: its end), and in how
    many steps. Arcs 2i and 2i + 1 enter and leave node i."""

    def follow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        low, m = 2 * (key[0] << bits), 2 * len(frame)
        idx, child, sibling, parent = (frame[c].to_numpy(np.int64) for c in ("idx", "child", "sibling", "parent"))
        target = np.empty(m, dtype=np.int64)
        target[0::2] = np.where(child >= 0, 2 * child, 2 * idx + 1)
        target[1::2] = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
        inside = (target >= low) & (target < low + m)
        at = np.where(inside, target - low, np.arange(m))
        steps = inside.astype(np.int64)
        for _ in range(m.bit_length()):
            steps, at = steps + steps[at], at[at]
        return pd.DataFrame({"arc": low + np.arange(m), "to": target[at], "steps": steps + 1})

    blocks = nodes.groupBy(F.shiftright("idx", bits).alias("block"))
    return blocks.applyInPandas(follow, "arc long, to long, steps long")


def tour_positions(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(arc, left): how many arcs of the tour are left from each one on, itself included.

    ``nodes`` has idx (0 to n-1, the root 0), child, sibling and parent (the first child, next sibling and parent; -1: none).
    """
    arcs = durable(_followed(nodes, bits), "trie-arcs")
    entries = arcs.filter("to >= 0").select(F.col("to").alias("arc")).distinct()
    links = durable(arcs.join(entries, "arc"), "trie-links")
    while links.filter("to >= 0").limit(1).count():
        then = links.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        joined = links.join(then, "to", "left")
        links = durable(joined.select("arc", F.coalesce("to2", F.lit(-1).cast("long")).alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "trie-links")
    ends = links.select(F.col("arc").alias("to"), F.col("steps").alias("more"))
    return arcs.join(ends, "to", "left").select("arc", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("left"))


def subtree_sums(nodes: DataFrame, values: dict[str, Column], bits: int = BLOCK_BITS) -> DataFrame:
    """(idx, one column for each of ``values``): sums over the nodes of each subtree, its top included."""
    own = nodes.select("idx", *[v.cast("long").alias(k) for k, v in values.items()])
    arcs = tour_positions(nodes, bits).select((-F.col("left")).alias("at"), F.shiftright("arc", 1).alias("idx"), (F.col("arc") % 2 == 0).alias("enters"))
    arcs = arcs.join(own, "idx").select("idx", "at", F.shiftright("at", PIECE_BITS).alias("piece"), *[F.when(F.col("enters"), F.col(k)).otherwise(0).alias(k) for k in values])
    arcs = durable(arcs, "trie-tour")
    here = Window.partitionBy("piece").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # one row for 2 ** PIECE_BITS arcs
    whole = arcs.groupBy("piece").agg(*[F.sum(k).alias(k) for k in values])
    before = whole.select("piece", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in values])
    summed = arcs.select("idx", "piece", *[k for k in values], *[F.sum(k).over(here).alias(f"{k}_here") for k in values]).join(before, "piece")
    upto = {k: F.col(f"{k}_before") + F.col(f"{k}_here") for k in values}
    # sums only grow along the tour: the larger of a node's two is at leaving it, the smaller before entering it
    return summed.groupBy("idx").agg(*[(F.max(upto[k]) - F.min(upto[k] - F.col(k))).alias(k) for k in values])


def trie(turns: DataFrame, conversations: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, n) with ``turns`` as :func:`turns_of` gives them.

    Columns: conv_id (smallest member), depth, parent_conv_id (null: root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (sum over the subtree of (n_convs - 1) times the words of the last text), ends_sha256 (of the
    conversations that end at the node). No conversation: no rows.
    """
    rows = durable(prefixes(turns), "trie-prefixes")
    zero = F.lit(0).cast("long")
    found = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    top = top.select(*[zero.alias(k) for k in KEY], "conv_id", "n_convs", zero.alias("words"), zero.alias("q1"), zero.alias("q2"))
    nodes = durable(global_index(found.unionByName(top), ["conv_id", "depth"], "idx"), "trie-nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("idx").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = durable(nodes.filter("depth > 0").join(above, ["depth", "q1", "q2"]).select("idx", "parent", "parent_conv_id"), "trie-parents")
    children = below.groupBy("parent").agg(F.min("idx").alias("child"), F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "idx")
    order = durable(global_index(below.select("idx", "parent"), ["parent", "idx"], "place"), "trie-siblings")
    following = order.select((F.col("place") - 1).alias("place"), F.col("idx").alias("sibling"), F.col("parent").alias("of"))
    siblings = order.join(following, "place").filter("parent = of").select("idx", "sibling")
    none = F.lit(-1).cast("long")
    linked = nodes.join(children, "idx", "left").join(siblings, "idx", "left").join(below, "idx", "left")
    linked = linked.select(
        "idx", *KEY, "conv_id", "n_convs", "words", "parent_conv_id", F.coalesce("n_children", zero).alias("n_children"),
        *[F.coalesce(c, none).alias(c) for c in ("child", "sibling", "parent")],
    )
    linked = durable(linked, "trie-linked")
    sums = subtree_sums(linked, {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}, bits)
    last = conversations.withColumnRenamed("n", "depth")
    ends = rows.join(last, ["conv_id", "depth"]).select(*KEY, "conv_id")
    ends = ends.unionByName(last.filter("depth = 0").select("depth", zero.alias("p1"), zero.alias("p2"), "conv_id"))
    digests = id_digests(ends)
    return (
        linked.join(sums, "idx")
        .join(digests, KEY, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of all conversations, after each has begun with the first turns of the conversation its id points to.

    Turns are ordered by turn (null first), then role and text; null role or text is empty, so rows that are equal in all are
    turns one after the other. Rows without a conv_id belong to no conversation. Other columns are not read; an empty table gives
    an empty result.
    """
    turns = durable(turns_of(conversations), "trie-own")
    rebuilt, convs = with_shared_heads(turns)
    return trie(rebuilt, convs)
