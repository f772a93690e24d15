"""A trie of conversation prefixes: what many conversations share from their start on.

Each prefix of each conversation has a digest, chained over its turns. The distinct
digests are the nodes. Subtrees of a bounded number of conversations are shards: a task takes
whole shards, gives every digest a slot by a minimal perfect hash, verified against the
digest stored in the slot, scatters the counts into flat arrays, finds each node's parent
slot, and adds subtrees up in order of depth. The few nodes above the shards, which more
conversations share, get the sums of their shards and are one more table of the same kind.

What one conversation has to itself needs no table: below its first own node,
every count is known. So neither a first turn that a third of all conversations share,
nor one very long conversation, meets in one task; positions come from sampled ranges, and
digests of long conversations are chained block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsieve.llm.grouping import map_groups, written
from callsieve.llm.workers import bounded_batches, give_back
from callsieve.operators.ordering import ranges, with_starts

#: Turns chained in one go.
BLOCK = 1024
#: Conversations that a shard may hold: this many, or this share of all prefixes if that is more.
#: At most that many nodes are above the shards.
SHARD, UPPER = 64, 50_000
#: Parts that the rows of one conversation are dealt to where lengths are joined.
SALTS = 32
#: Fixed values of the shared openings: conversations to an opening, most turns of it.
OPENING, MOST_SHARED = 100, 5
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv, pos, turn_id, chars``: turns in the order of their numbers, counted from 1 in each conversation.

    ``turn_id`` is the SHA-256 of role and text, NULLs as empty. A NULL turn number comes first;
    turns of one number are in the order of ``turn_id``. Rows that repeat are turns of
    their own. Rows without a conversation id are left out, other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("turn_id"),
        F.length(text).cast("long").alias("chars"),
    ).filter("conv is not null")
    placed = with_starts(ranges(turns, ["conv"], "turn", "turn_id"), ["conv"], before=F.count(F.lit(1)))
    return placed.select("conv", (F.col("_seq") - F.col("_first") + F.col("before") + 1).alias("pos"), "turn_id", "chars")


def share_openings(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv, d, turn_id, chars``: every conversation with its first turns taken from the one that opens its hundred.

    Conversation ``c`` begins with the first ``crc32(c) mod 6`` turns of ``c - c mod 100``, as far as
    there are any, and goes on with its own turns after as many of them.
    """
    opener = F.col("conv") - F.col("conv") % OPENING
    shared = (F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")
    base = turns.filter((F.col("conv") == opener) & (F.col("pos") <= MOST_SHARED)).withColumnRenamed("conv", "opener")
    opening = ids.select("conv", opener.alias("opener"), shared.alias("shared")).join(base, "opener").filter("pos <= shared")
    lengths = base.groupBy("opener").agg(F.max("pos").alias("length"))
    lengths = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = turns.withColumns({"opener": opener, "shared": shared, "salt": (F.col("pos") % SALTS).cast("int")}).filter("pos > shared")
    own = own.join(lengths, ["opener", "salt"], "left")
    after = F.col("pos") - F.col("shared") + F.least("shared", F.coalesce("length", F.lit(0).cast("long")))
    return opening.select("conv", F.col("pos").alias("d"), "turn_id", "chars").union(own.select("conv", after.alias("d"), "turn_id", "chars"))


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2) if digests else np.empty((0, 2), np.int64)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def prefix_digests(turns: DataFrame) -> DataFrame:
    """``conv, d, chars, p1, p2, q1, q2`` of ``turns (conv, d, turn_id, chars)``.

    ``p1, p2`` are the digest of the first ``d`` turns, ``q1, q2`` that of the turns before the
    ``d``-th, zeros for none. Blocks of ``BLOCK`` turns are digested each by itself; what one
    block hands to the next is chained over the blocks alone.
    """
    bounded_batches(turns.sparkSession)
    block = F.floor((F.col("d") - 1) / BLOCK).cast("long")
    turns = turns.withColumn("block", block)
    keys = ["conv", "block"]

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            out = []
            for conv, k, d, turn in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv, k) != now:
                    now, h = (conv, k), hashlib.sha256()
                h.update(turn)
                if d % BLOCK == 0:
                    out.append((conv, k, h.digest()))
            if out:
                conv, k, digest = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int64()), pa.array(digest, pa.binary())], [*keys, "total"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, handed = None, b""
        for batch in batches:
            out = []
            for conv, k, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != now:
                    now, handed = conv, b""
                handed = hashlib.sha256(handed + digest).digest()
                out.append((conv, k + 1, handed))
            if out:
                conv, k, digest = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int64()), pa.array(digest, pa.binary())], [*keys, "handed"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, handed, last = None, None, b"", bytes(16)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, before = [], []
            for conv, k, d, turn, first in zip(*(batch.column(c).to_pylist() for c in (*keys, "d", "turn_id", "handed"))):
                if (conv, k) != now:
                    now, h, handed = (conv, k), hashlib.sha256(), first or b""
                    last = first[:16] if first else bytes(16)
                h.update(turn)
                before.append(last)
                last = hashlib.sha256(handed + h.digest()).digest()[:16]
                own.append(last)
            out = [batch.column(c) for c in ("conv", "d", "chars")]
            yield pa.RecordBatch.from_arrays([*out, *_halves(own), *_halves(before)], ["conv", "d", "chars", "p1", "p2", "q1", "q2"])
        give_back()

    def dealt(df: DataFrame, by: list[str], order: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, order)

    if turns.filter(F.col("d") > BLOCK).isEmpty():
        handed = turns.withColumn("handed", F.lit(None).cast("binary"))
    else:
        totals = dealt(turns.select(*keys, "d", "turn_id"), keys, "d").mapInArrow(total, "conv long, block long, total binary")
        chained = dealt(totals, ["conv"], "block").mapInArrow(carry, "conv long, block long, handed binary")
        handed = turns.join(written(chained, "blocks"), keys, "left")
    return dealt(handed, keys, "d").mapInArrow(chain, "conv long, d long, chars long, p1 long, p2 long, q1 long, q2 long")


class PerfectHash:
    """Slots ``0..n-1`` for ``n`` distinct digests of two 64-bit halves, without a free one.

    On each level the digests that are alone in a place of a bitmap are placed, the rest go to the next level; a
    digest's slot is the rank of its bit. The digest in the slot tells members from others.
    """

    def __init__(self, keys: np.ndarray):
        self._levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.slots = np.empty(len(keys), np.int64)
        left, placed = np.arange(len(keys)), 0
        while len(left):
            if len(self._levels) == 64:
                raise ValueError("digests are not distinct")
            place = self._place(keys[left], len(self._levels), size := 2 * len(left) + 1)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, bool)
            bits[place[alone]] = True
            ranks = np.cumsum(bits) - 1 + placed
            self._levels.append((bits, ranks))
            self.slots[left[alone]] = ranks[place[alone]]
            placed += int(alone.sum())
            left = left[~alone]
        self.keys = np.empty_like(keys)
        self.keys[self.slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & 0xFFFFFFFFFFFFFFFF)
        mixed = (keys[:, 0] ^ seed) * np.uint64(0xBF58476D1CE4E5B9) ^ (keys[:, 1] + seed) * np.uint64(0x94D049BB133111EB)
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 for those that are not members."""
        out = np.full(len(keys), -1)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self._levels):
            place = self._place(keys[left], level, len(bits))
            here = bits[place]
            out[left[here]] = ranks[place[here]]
            left = left[~here]
        known = out >= 0
        known[known] = (self.keys[out[known]] == keys[known]).all(axis=1)
        return np.where(known, out, -1)


class Sums(NamedTuple):
    """By row: the parent's row (-1 for none here), numbers of children, leaves and saved tokens of the subtree."""

    parent: np.ndarray
    children: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray


def add_up(p, q, depth, n, chars, children, leaves, saved) -> Sums:
    """Subtree sums of the nodes ``p`` under parents ``q``; ``children, leaves, saved`` is what nodes elsewhere add."""
    table = PerfectHash(p)
    at, size = table.slots, len(p)

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.empty(size, np.int64)
        out[at] = values
        return out

    parent = scattered(table.find(q))
    kids = scattered(children) + np.bincount(parent[parent >= 0], minlength=size)
    leaf = scattered(leaves) + (kids == 0)
    total = scattered(saved) + scattered((n - 1) * chars)
    level = scattered(depth)
    order = np.argsort(-level, kind="stable")
    order = order[parent[order] >= 0]
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):  # the deepest first
        np.add.at(leaf, parent[part], leaf[part])
        np.add.at(total, parent[part], total[part])
    row_of = np.empty(size, np.int64)
    row_of[at] = np.arange(size)
    up = parent[at]
    return Sums(np.where(up >= 0, row_of[up], -1), kids[at], leaf[at], total[at])


_TABLE = "p1 long, p2 long, q1 long, q2 long, d long, n long, first long, parent_first long, children long, leaves long, saved long"


def _tables(rows: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`add_up` over groups of whole shards; ``parent_first`` is NULL where the parent is elsewhere."""

    def step(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        col = lambda c: batch.column(c).to_numpy()
        pair = lambda a, b: np.stack([col(a).view(np.uint64), col(b).view(np.uint64)], axis=1)
        found = add_up(pair("p1", "p2"), pair("q1", "q2"), *(col(c) for c in ("d", "n", "chars", "children", "leaves", "saved")))
        parent_first = pa.array(col("first")[found.parent], mask=found.parent < 0)
        kept = [batch.column(c) for c in ("p1", "p2", "q1", "q2", "d", "n", "first")]
        names = ["p1", "p2", "q1", "q2", "d", "n", "first", "parent_first", "children", "leaves", "saved"]
        return pa.RecordBatch.from_arrays([*kept, parent_first, *map(pa.array, found[1:])], names)

    return map_groups(rows, keys, step, _TABLE, "d")


def id_list_digests(ends: DataFrame) -> DataFrame:
    """``p1, p2, ends_sha256`` of ``ends (p1, p2, conv)``: the SHA-256 of a node's ids, ascending, comma-joined.

    Ids are sorted and joined to pieces in sampled ranges, in parallel; only pieces go to the
    task that digests them one after the other, and none is held.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p1, p2, conv = (c.to_numpy() for c in batch.columns)
            first = np.flatnonzero(np.concatenate([[True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]))
            names = conv.tolist()
            joined = [",".join(map(str, names[a:b])) for a, b in zip(first, [*first[1:], len(names)])]
            yield pa.RecordBatch.from_arrays([pa.array(p1[first]), pa.array(p2[first]), pa.array(conv[first]), pa.array(joined, pa.string())], ["p1", "p2", "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        out: list[tuple[int, int, str]] = []

        def made() -> pa.RecordBatch:
            p1, p2, sha = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(sha, pa.string())], ["p1", "p2", "ends_sha256"])

        for batch in batches:
            for p1, p2, piece in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "piece"))):
                if (p1, p2) == now:
                    h.update(b",")
                else:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = (p1, p2), hashlib.sha256()
                h.update(piece.encode())
            if out:
                yield made()
        if now:
            out.append((*now, h.hexdigest()))
            yield made()

    bounded_batches(ends.sparkSession)
    by = ["p1", "p2"]
    sorted_ids = ends.select(*by, "conv").repartitionByRange(*by, "conv").sortWithinPartitions(*by, "conv")
    joined = sorted_ids.mapInArrow(pieces, "p1 long, p2 long, first long, piece string")
    return joined.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, shard: int = SHARD) -> DataFrame:
    """All nodes of the trie of ``turns (conv, d, turn_id, chars)``, whose conversations are the distinct ``ids (conv)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``:
    a node is named by its smallest member and its depth. The root is the prefix of no turns,
    which conversations without turns end at. ``n_leaves`` and ``saved_tokens`` are of the whole
    subtree; a node saves the characters of its last turn for each member but one.
    Without conversations there are no rows.
    """
    zero = F.lit(0).cast("long")
    by = ["p1", "p2"]
    paths = written(prefix_digests(turns), "prefixes")
    nodes = written(
        paths.groupBy(*by, "q1", "q2", "d", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("first")), "nodes"
    )
    limit = max(shard, paths.count() // UPPER)
    upper = written(nodes.filter(F.col("n") > limit), "upper")
    # where each conversation leaves the upper nodes, which are fewer than UPPER or prefixes / shard
    below = paths.join(F.broadcast(upper.select(*by, F.lit(True).alias("above"))), by, "left").filter("above is null")
    cuts = below.groupBy("conv").agg(F.min(F.struct("d", *by)).alias("cut"))
    cuts = cuts.select(F.col("conv").alias("first"), F.col("cut.p1").alias("s1"), F.col("cut.p2").alias("s2"))

    alone = nodes.filter("n = 1")
    heads = alone.groupBy("first").agg(F.min(F.struct("d", *by)).alias("head")).select("head.p1", "head.p2", F.lit(True).alias("head"))
    alone = written(alone.join(heads, by, "left"), "alone")
    members = nodes.filter((F.col("n") > 1) & (F.col("n") <= limit)).union(alone.filter("head").drop("head"))
    elsewhere = [zero.alias(c) for c in ("children", "leaves", "saved")]
    shards = written(_tables(members.join(cuts, "first").select("*", *elsewhere), ["s1", "s2"]), "shards")

    root = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("first")).filter("n > 0")
    none = F.lit(None).cast("long")
    top = upper.union(root.select(zero, zero, none, none, zero, zero, "n", "first"))
    hanging = shards.filter("parent_first is null").groupBy("q1", "q2")
    hanging = hanging.agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    hanging = hanging.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "children", "leaves", "saved")
    top = top.join(hanging, by, "left").fillna(0, ["children", "leaves", "saved"]).withColumn("all", zero)
    top = written(_tables(top.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("q1", "q2")}), ["all"]), "top")

    named = F.broadcast(top.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("first").alias("top_first")))
    shards = shards.join(named, ["q1", "q2"], "left").withColumn("parent_first", F.coalesce("parent_first", "top_first"))
    wide = [*by, "d", "n", "first", "parent_first", "children", "leaves", "saved"]
    tails = alone.filter("head is null").withColumns({"parent_first": F.col("first"), "children": zero, "leaves": zero + 1, "saved": zero})
    every = shards.select(*wide).union(top.select(*wide)).union(tails.select(*wide))

    lasts = turns.groupBy("conv").agg(F.max("d").alias("d"))
    ended = paths.join(lasts, ["conv", "d"]).select(*by, "conv")
    turnless = ids.join(lasts, "conv", "left_anti").select(zero.alias("p1"), zero.alias("p2"), "conv")
    digests = id_list_digests(ended.union(turnless))
    # a node of one conversation has its next turn below it, unless it ends there
    own_child = F.when(F.col("ends_sha256").isNull(), 1).otherwise(0).cast("long")
    return every.join(digests, by, "left").select(
        F.col("first").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent_first").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("n") == 1, own_child).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, openings: bool = True, shard: int = SHARD) -> DataFrame:
    """:func:`prefix_trie` of ``conversations (conv_id, turn, role, text)``, with :func:`share_openings` applied first.

    Rows without a ``conv_id`` are left out; for ties, NULLs and repeated rows see :func:`ordered_turns`.
    """
    turns = written(ordered_turns(conversations), "turns")
    ids = written(turns.select("conv").distinct(), "ids")
    rebuilt = share_openings(turns, ids) if openings else turns.withColumnRenamed("pos", "d")
    return prefix_trie(written(rebuilt, "rebuilt"), ids, shard)
