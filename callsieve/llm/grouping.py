"""Groups in blocks, and connected components, as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsieve.llm.workers import bounded_batches, give_back
from callsieve.session import fresh_dir


def written(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor costs no more than a reread."""
    path = path or fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A group with more than this share of all grouped rows is hot; there are fewer than that many.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` with the columns of the one row that ``groups`` has for their ``key``, NULL where there is none.

    ``size`` counts, by group, the rows that have its key. Groups of a thousandth of them or
    more, at most a thousand, are broadcast and rows without a key are not joined at all, so no
    task gets more than its share. ``groups`` should be a written table: it is read three times.
    """
    total = groups.agg(F.sum(size).alias("n")).first().n or 0
    hot = F.col(size) * HOT_SHARE >= total
    names = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(groups.filter(hot).withColumn("_hot", F.lit(True))), key, "left")
    settled = F.col(key).isNull() | F.col("_hot").isNotNull()
    cold = marked.filter(~settled).drop("_hot", *names).join(groups.filter(~hot), key, "left")
    columns = [*rows.columns, *names]
    return marked.filter(settled).select(*columns).union(cold.select(*columns))


def block_pairs(df: DataFrame, member: Column, blocks: Column) -> DataFrame:
    """Repeat each row for every pair of blocks that its block is in.

    A group of ``n`` members cut in ``b`` blocks becomes ``b (b + 1) / 2`` groups of at
    most about ``2 n / b`` rows: ``_i <= _j`` name the two blocks, ``_own`` the row's.
    ``member`` is what the rows of a group are dealt by, ``blocks`` their number of blocks.
    """
    own = F.pmod(F.xxhash64(F.lit("block"), member), blocks.cast("long")).cast("int")
    df = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return df.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_other")


def map_groups(
    df: DataFrame,
    keys: list[str],
    step: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None],
    schema: str,
    order: str,
    merge: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch] | None = None,
) -> DataFrame:
    """Apply ``step`` to batches of whole groups.

    ``step`` gets rows sorted by ``keys`` and then ``order``, and the places where groups
    begin, with the number of rows at the end. Groups must be small enough to be held
    whole, as ``merge`` leaves them: it gets each batch as it comes, before it is held.
    """
    bounded_batches(df.sparkSession)

    def starts_of(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            column = batch.column(k)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return np.append(np.flatnonzero(new), batch.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if merge is not None:
                batch = merge(batch, starts_of(batch))
            if held:
                ends = starts_of(batch)
                joint = starts_of(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))
                if len(joint) == 2 and len(ends) == 2:  # the group goes on beyond this batch
                    held.append(batch)
                    continue
                batch = pa.concat_batches([*held, batch])
            starts = starts_of(batch)
            held = [batch.slice(int(starts[-2]))]
            if len(starts) > 2:
                out = step(batch.slice(0, int(starts[-2])), starts[:-1])
                if out is not None and out.num_rows:
                    yield out
        if held:
            batch = pa.concat_batches(held)
            out = step(batch, starts_of(batch))
            if out is not None and out.num_rows:
                yield out
        held, batch, out = [], None, None
        give_back()

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Star edges ``(root, member)`` of the components that the edges make of ``0..n-1``."""
    return [(int(r), i) for i, r in enumerate(join_roots(np.arange(n), a, b)) if r != i]


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components that ``root`` has as stars, joined by more edges."""
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return root


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is named by one of its nodes.

    In each round every node moves to the neighbour of least priority (a hash of the
    node), or stays, and the edges are rewritten to the new places: stars vanish at
    once and long paths shrink by a constant share, so all rounds together read little
    more than the edges. The minimum of a hub is combined before the shuffle. What
    nodes moved to is a written table of each round; the moves are joined up at the end.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    current = written(both, "edges")
    moves: list[DataFrame] = []
    while not current.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("priority"), F.col(c).alias("to"))
        least = current.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("least"))
        move = written(least.select("node", F.least(order("node"), "least")["to"].alias("to")), "moves")
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        rewritten = current.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        current = written(rewritten.filter("a <> b").distinct(), "edges")
    if not moves:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = moves.pop().select("node", F.col("to").alias("component"))
    while moves:
        later = named.select(F.col("node").alias("to"), F.col("component").alias("_later"))
        named = moves.pop().join(later, "to", "left").select("node", F.coalesce("_later", "to").alias("component"))
    return written(named, "components")
