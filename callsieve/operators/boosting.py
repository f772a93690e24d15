"""Boosted trees on sparse text weights, level by level, as aggregations.

Weights of a term are binned by quantiles; bin 0 is "not in the text". A document is one
row with its bins. A level of a tree is one pass: each row finds its node, gives its
gradients to the cells ``(node, term, bin)``, and the best split of each node is the
largest of the gains of all cells, summed up from the highest bin down. Only the splits
of a level, at most two to the power of its depth, reach the driver.

Gradients are whole numbers (of ``2**-20``), so sums do not depend on the order in which
partitions arrive, and a fit is the same whatever the cluster.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsieve.session import fresh_dir

UNIT = 1 << 20
#: Trees after which the rows are written anew with their margins.
EVERY = 10


class Split(NamedTuple):
    """Texts with a bin above ``bin`` of a term go to the right child."""

    term: int
    bin: int


class Tree(NamedTuple):
    """Nodes are numbered from 1, the children of ``n`` are ``2 n`` and ``2 n + 1``."""

    splits: dict[int, Split]
    leaves: dict[int, float]


class Boosted(NamedTuple):
    base: float
    trees: list[Tree]
    terms: DataFrame  # term, tid, cuts


def binned_terms(weights: DataFrame, bins: int = 32) -> DataFrame:
    """``term, tid, cuts``: a number for each term, and at most ``bins - 1`` cuts between its weights.

    As many rows as the vocabulary. Cuts are quantiles; of a term in fewer than 10,000 texts exact ones.
    Weights are dealt by term as they are: summaries of parts would hold nearly all of them and more bytes each.
    """
    shares = [i / bins for i in range(1, bins)]
    cuts = weights.select("term", "weight").repartition("term").groupBy("term").agg(F.array_sort(F.array_distinct(F.percentile_approx("weight", shares, 10_000))).alias("cuts"))
    return cuts.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("tid"), "cuts")


def binned(weights: DataFrame, terms: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``key, feats``: a map from the numbers of a text's terms to their bins, from 1 on; of ``keys`` only, if given."""
    level = F.size(F.filter("cuts", lambda c: c < F.col("weight"))) + 1
    cells = weights.join(F.broadcast(terms), "term").select(key, F.struct("tid", level.alias("bin")).alias("cell"))
    if keys is not None:
        cells = cells.join(keys.select(key), key, "left_semi")
    return cells.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list("cell"))).alias("feats"))


def _above(split: Split) -> Column:
    return F.coalesce(F.element_at("feats", F.lit(split.term)), F.lit(0)) > split.bin


def _walk(tree: Tree, node: int, at: dict[int, Column]) -> Column:
    """What ``at`` has for the node that a row ends in."""
    if node not in tree.splits:
        return at[node]
    return F.when(_above(tree.splits[node]), _walk(tree, 2 * node + 1, at)).otherwise(_walk(tree, 2 * node, at))


def _ends(tree: Tree, node: int = 1) -> list[int]:
    return _ends(tree, 2 * node) + _ends(tree, 2 * node + 1) if node in tree.splits else [node]


def tree_value(tree: Tree) -> Column:
    return _walk(tree, 1, {n: F.lit(v) for n, v in tree.leaves.items()})


def _drawn(column: Column, share: float, tree: int, seed: int) -> Column:
    """A share of rows or terms, drawn anew for each tree by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tree), column), F.lit(1 << 30)) < int(share * (1 << 30))


def _written(df: DataFrame) -> DataFrame:
    path = fresh_dir(df.sparkSession, "boosting")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _best_splits(cells: DataFrame, totals: dict[int, tuple[int, int]], penalty: float, least: float) -> list:
    """For each node the best split, if one gains anything. ``cells``: node, tid, bin, g, h; ``totals``: g and h of each node."""
    of_node = lambda i: F.coalesce(*[F.when(F.col("node") == n, F.lit(t[i]).cast("long")) for n, t in totals.items()])
    down = Window.partitionBy("node", "tid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    right = cells.withColumns({"gr": F.sum("g").over(down), "hr": F.sum("h").over(down), "ga": of_node(0), "ha": of_node(1)})
    gain = lambda g, h: F.col(g).cast("double") * F.col(g) / (F.col(h) + penalty * UNIT)
    scored = (
        right.withColumns({"gl": F.col("ga") - F.col("gr"), "hl": F.col("ha") - F.col("hr")})
        .withColumn("gain", gain("gl", "hl") + gain("gr", "hr") - gain("ga", "ha"))
        .filter((F.col("hl") >= least * UNIT) & (F.col("hr") >= least * UNIT) & (F.col("gain") > 1e-9 * UNIT))
    )
    order = F.struct("gain", -F.col("tid"), -F.col("bin"))
    return scored.groupBy("node").agg(F.max_by(F.struct("tid", "bin", "gr", "hr"), order).alias("best")).collect()


def fit_boosted(
    weights: DataFrame,
    labels: DataFrame,
    key: str,
    trees: int = 300,
    depth: int = 6,
    step: float = 0.1,
    bins: int = 32,
    row_share: float = 0.9,
    column_share: float = 0.9,
    penalty: float = 1.0,
    least: float = 1.0,
    seed: int = 42,
) -> Boosted:
    """Fit on ``weights (key, term, weight)`` and ``labels (key, label)``; keys are unique in ``labels``.

    Logistic loss with second-order gains. ``penalty`` is added to the curvature of each side, which
    must be ``least`` or more. Texts without a term have bin 0 everywhere. A tree takes a job for each
    level, and one for the sums of its root: those of other nodes come from the split above.
    """
    terms = _written(binned_terms(weights, bins))
    rows = labels.select(key, F.col("label").cast("boolean").cast("int").alias("y")).filter("y is not null")
    rows = rows.join(binned(weights, terms, key, rows), key, "left")
    rows = rows.withColumn("feats", F.coalesce("feats", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))))
    share = rows.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        raise ValueError("both labels are needed")
    base = math.log(share / (1 - share))
    rows = _written(rows.withColumn("margin", F.lit(base)))
    grown: list[Tree] = []
    recent: list[Tree] = []
    for t in range(trees):
        margin = sum((tree_value(x) for x in recent), F.col("margin"))
        p = 1 / (1 + F.exp(-margin))
        drawn = rows.filter(_drawn(F.col(key), row_share, t, seed)).select("feats", p.alias("p"), "y")
        sloped = drawn.select(
            "feats", F.round((F.col("p") - F.col("y")) * UNIT).cast("long").alias("g"), F.round(F.col("p") * (1 - F.col("p")) * UNIT).cast("long").alias("h")
        )
        tree = Tree({}, {})
        root = sloped.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
        front = {1} if root.g is not None else set()
        sums: dict[int, tuple[int, int]] = {1: (root.g, root.h)} if front else {}
        for _ in range(depth):
            if not front:
                break
            node = _walk(tree, 1, {n: F.lit(n if n in front else 0) for n in _ends(tree)})
            cells = (
                sloped.withColumn("node", node)
                .filter("node > 0")
                .select("node", "g", "h", F.explode("feats").alias("tid", "bin"))
                .filter(_drawn(F.col("tid"), column_share, t, seed))
                .groupBy("node", "tid", "bin")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            )
            totals, front = {n: sums[n] for n in sorted(front)}, set()
            for r in _best_splits(cells, totals, penalty, least):
                tree.splits[r.node] = Split(r.best.tid, r.best.bin - 1)
                sums[2 * r.node + 1] = (r.best.gr, r.best.hr)
                sums[2 * r.node] = (totals[r.node][0] - r.best.gr, totals[r.node][1] - r.best.hr)
                front |= {2 * r.node, 2 * r.node + 1}
        for n in _ends(tree):
            g, h = sums.get(n, (0, 0))
            tree.leaves[n] = -step * g / (h + penalty * UNIT)
        grown.append(tree)
        recent.append(tree)
        if len(recent) == EVERY and t + 1 < trees:
            rows = _written(rows.withColumn("margin", margin + tree_value(tree)))
            recent = []
    return Boosted(base, grown, terms)


def score_boosted(model: Boosted, weights: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``score``, the probability of the label, and ``pred``.

    Weights come from the vocabulary of the fit; other terms do not count, and of its terms only
    those that a tree splits on are looked up.
    """
    asked = sorted({split.term for tree in model.trees for split in tree.splits.values()})
    rows = keys.join(binned(weights, model.terms.filter(F.col("tid").isin(asked)), key), key, "left")
    rows = rows.withColumn("feats", F.coalesce("feats", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<int>"))))
    margin = sum((tree_value(t) for t in model.trees), F.lit(model.base))
    score = 1 / (1 + F.exp(-margin))
    return rows.select(*keys.columns, score.alias("score")).withColumn("pred", F.col("score") >= 0.5)
