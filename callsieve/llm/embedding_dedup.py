"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Vectors with equal components and label form a class and are handled as one.
Spherical k-means (fitted on a bounded sample) gives centroids; a vector's home
is the cell of its nearest centroid. A vector within the threshold of ``x``, whose
home is ``h``, can have its home in a cell ``c`` only if ``x . h - x . c <= d |h - c|``,
where ``d`` is the chord of the threshold's angle. Of the two cells of such a pair one
is where it meets, chosen by their numbers: ``x`` is a guest of ``c`` if that is ``c``. So
each pair is compared once, and nothing is lost at the borders. Cells that are too
large for a task's memory are cut in blocks that meet pair by pair; a block pair
gives numbers of links and a forest of edges, never the pairs.

Vectors are moved once for each membership, and never written as a table: what is
kept between jobs are keys of classes. Components travel in single precision where
that holds them exactly. Copies are joined in each batch before they move, and in
their cell.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from callsieve.llm.grouping import block_pairs, components, join_groups, join_roots, map_groups, written
from callsieve.llm.workers import map_arrow

THRESHOLD = 0.98
#: Bounds of the fit: vectors it sees, cells it may make, rounds.
SAMPLE = 20_000
MOST_CELLS = 256
ROUNDS = 12
#: Rows and bytes of a block; up to two of them meet in a task.
BLOCK = 1 << 18
BLOCK_BYTES = 40 << 20
#: What it costs to move a row, in comparisons of two vectors; decides the number of cells.
MOVE_COST = 3000.0
#: More copies of a vector than these are moved only where no number of cells does with them.
MOST_MOVED = 3.0
#: Sides of the part of a block pair that is compared at once; links that are joined at once.
TILE = (512, 2048)
EDGES = 1 << 20
#: Rounding of sums of products.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither vanish nor overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors; the start is drawn from the sample by a fixed seed."""
    rng = np.random.default_rng(7)
    centre = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.argmax(sample @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, home, sample)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        centre = np.where(size > 1e-12, total / np.where(size > 1e-12, size, 1), centre)
    return centre


def memberships(rows: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each row, and whether it is a member of each cell.

    Of cells ``a < b`` rows meet in ``a`` if ``a + b`` is even, else in ``b``.
    """
    near = rows @ centre.T
    home = np.argmax(near, axis=1)
    gap = near[np.arange(len(rows)), home][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * (centre @ centre.T), 0))[home]
    cell, own = np.arange(len(centre))[None, :], home[:, None]
    meet = (cell == own) | ((cell < own) == ((cell + own) % 2 == 0))
    return home, meet & (gap <= np.sqrt(2 - 2 * threshold) * apart + SLACK)


def block_rows(dim: int) -> int:
    """Vectors of a block, in single precision."""
    return max(1, min(BLOCK, BLOCK_BYTES // (4 * dim)))


def fit_cells(sample: np.ndarray, group: float, threshold: float) -> np.ndarray:
    """Centroids, as many as make moving and comparing cheapest for groups of ``group`` vectors.

    Measured on the sample: with ``k`` cells a vector has ``r`` memberships, is moved
    ``r`` times for each block of a cell and compared with ``(r - 1/2) / k`` of its group.
    """
    best = None
    k = 1
    most = block_rows(sample.shape[1])
    while k <= min(MOST_CELLS, max(1, len(sample) // 8)):
        centre = spherical_kmeans(sample, k)
        r = memberships(sample, centre, threshold)[1].sum() / len(sample)
        size = r * group / k
        moved = r * (1 if size <= 2 * most else np.ceil(size / most))
        cost = (max(moved, MOST_MOVED), MOVE_COST * moved + (r - 0.5) * group / k)
        if best is None or cost < best[0]:
            best = (cost, centre)
        if group / k < MOVE_COST:  # what is left to compare costs less than moving rows once more
            break
        k *= 2
    return best[1]


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Places of the usable rows of ``id, label, vec``, their dimensions, keys and components.

    Components are bytes in single precision if that holds all of a row exactly, else in double.
    """
    vec, label = batch.column("vec"), batch.column("label").to_pylist()
    offset = vec.offsets.to_numpy().astype(np.int64)
    given = vec.values.to_numpy(zero_copy_only=False)
    flat = given.astype(np.float64) + 0.0

    def none(odd: np.ndarray) -> np.ndarray:
        count = np.append(0, np.cumsum(odd))
        return count[offset[1:]] == count[offset[:-1]]

    with np.errstate(over="ignore"):
        single = flat.astype(np.float32)
    use = none(~np.isfinite(flat)) & ~none(flat != 0)
    use &= ~np.array(vec.is_null()) & ~np.array(batch.column("label").is_null()) & ~np.array(batch.column("id").is_null())
    short = np.ones(len(use), bool) if given.dtype == np.float32 else none(single != flat)
    at = np.flatnonzero(use)
    key, raw = [], []
    for i in at:
        x = flat[offset[i] : offset[i + 1]].tobytes()
        key.append(hashlib.blake2b(x + b"\0" + label[i].encode(), digest_size=16).digest())
        raw.append(single[offset[i] : offset[i + 1]].tobytes() if short[i] else x)
    return at, np.diff(offset)[at], key, raw


def _vectors(raw: pa.Array, dim: int) -> np.ndarray:
    """What :func:`_read` has as bytes, as a matrix; without a copy where all rows are in single precision."""
    offset = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    width = np.diff(offset)
    if (width == 4 * dim).all():
        return data[offset[0] : offset[-1]].view(np.float32).reshape(len(raw), dim)
    rows = np.empty((len(raw), dim))
    for kind in (np.float32, np.float64):
        bytes_of = np.dtype(kind).itemsize * dim
        at = np.flatnonzero(width == bytes_of)
        rows[at] = data[offset[at][:, None] + np.arange(bytes_of)].view(kind)
    return rows


def _firsts(key: pa.Array, starts: np.ndarray) -> np.ndarray:
    """Places of the first row of each key in each group, of rows sorted by both."""
    new = np.ones(len(key), bool)
    new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    new[starts[:-1]] = True
    return np.flatnonzero(new)


def _join_copies(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Rows of one key in one group as one, with the sum of their copies."""
    first = _firsts(batch.column("key"), starts)
    if len(first) == batch.num_rows:
        return batch
    at = batch.schema.get_field_index("copies")
    copies = pa.array(np.add.reduceat(batch.column("copies").to_numpy(), first))
    return batch.take(pa.array(first)).set_column(at, batch.schema.field(at), copies)


def _links(rows: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of linked copies, and roots of the components, over the pairs of ``parts``.

    A part that meets itself gives each pair once. Products are taken in single precision
    and, wherever rounding could matter, again in double.
    """
    n, dim = rows.shape
    unit_rows = np.empty((n, dim), np.float32)
    for k in range(0, n, 8192):
        unit_rows[k : k + 8192] = unit(rows[k : k + 8192])
    least = np.float32(threshold - (dim + 8) * 1.3e-7)
    links, root = np.zeros(n, np.int64), np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for left, right in parts:
        for k in range(0, len(left), TILE[0]):
            l_at = left[k : k + TILE[0]]
            l_rows = unit_rows[l_at]
            for m in range(k if left is right else 0, len(right), TILE[1]):
                r_at = right[m : m + TILE[1]]
                a, b = np.divmod(np.flatnonzero(l_rows @ unit_rows[r_at].T >= least), len(r_at))
                if left is right:
                    once = m + b > k + a
                    a, b = a[once], b[once]
                if not len(a):
                    continue
                if 32 * len(a) > len(l_at) * len(r_at):
                    sure = (unit(rows[l_at]) @ unit(rows[r_at]).T)[a, b] >= threshold
                else:
                    sure = np.concatenate([
                        np.einsum("ij,ij->i", unit(rows[l_at[a[s : s + 8192]]]), unit(rows[r_at[b[s : s + 8192]]])) >= threshold
                        for s in range(0, len(a), 8192)
                    ])
                a, b = l_at[a[sure]], r_at[b[sure]]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                held.append((a, b))
                size += len(a)
                if size > EDGES:
                    root = join_roots(root, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
    if held:
        root = join_roots(root, *map(np.concatenate, zip(*held)))
    return links, root


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``.

    Rows are compared where labels are equal and not NULL and dimensions agree.
    ``n_links`` is the number of other rows with a cosine of at least ``threshold``,
    ``component_id`` the smallest id reachable by links, ``kept`` whether that is the
    row's own id. Vectors that are NULL, empty, zero or hold NULL or non-finite
    components link with nothing, nor do rows without an id; they are their own
    component. Repeated rows link with each other and share an id. Other columns
    are not read; an empty table gives no rows.
    """
    single = vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull)
    base = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        (F.col(vec_col) if single else F.col(vec_col).cast("array<double>")).alias("vec"),
    )

    def key_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, dims, key, _ = _read(batch)
        keys, sizes = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int32)
        for i, k in zip(at, key):
            keys[i] = k
        sizes[at] = dims
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(sizes)], ["id", "label", "key", "dim"]
        )

    keyed = written(map_arrow(base, key_of, "id long, label string, key binary, dim int"), "keys")
    classes = written(
        keyed.filter("key is not null")
        .groupBy("key", "label", "dim")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    groups = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n"))
    facts = (
        groups.groupBy("dim")
        .agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("group"), F.max("n").alias("most"))
        .collect()
    )
    share = {f.dim: min(1.0, SAMPLE / f.n) for f in facts}

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, dims, key, raw = _read(batch)
        drawn = {k: (int(d), x) for d, k, x in zip(dims, key, raw) if int.from_bytes(k[:4], "big") < share.get(int(d), 0) * 2**32}
        return pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in drawn.values()], pa.int32()), pa.array(list(drawn), pa.binary()), pa.array([x for _, x in drawn.values()], pa.binary())],
            ["dim", "key", "raw"],
        )

    cells: dict[int, np.ndarray] = {}
    if facts:
        sample = map_arrow(base, draw, "dim int, key binary, raw binary").groupBy("key").agg(F.any_value("dim").alias("dim"), F.any_value("raw").alias("raw"))
        drawn = sorted(sample.collect(), key=lambda r: bytes(r.key))
        for f in facts:
            rows = [bytes(r.raw) for r in drawn if r.dim == f.dim]
            if rows:
                cells[f.dim] = fit_cells(unit(_vectors(pa.array(rows, pa.binary()), f.dim)), f.group, threshold)

    def placed(one_in: int = 1) -> DataFrame:
        """Each class once a batch for each cell that it is a member of; of a share of all classes."""

        def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, dims, key, raw = _read(batch)
            copies: dict[bytes, int] = {}
            first: list[int] = []
            for i, k in enumerate(key):
                if int.from_bytes(k[:4], "big") % one_in == 0:
                    if k not in copies:
                        first.append(i)
                    copies[k] = copies.get(k, 0) + 1
            mine = np.array(first, np.int64)
            key_of_row, raw_of_row = (pa.array([x[i] for i in first], pa.binary()) for x in (key, raw))
            at_all, cell_all, home_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for dim in np.unique(dims[mine]):
                own = np.flatnonzero(dims[mine] == dim)
                centre = cells.get(int(dim))
                if centre is None:
                    home, member = np.zeros(len(own), np.int64), np.ones((len(own), 1), bool)
                else:
                    home, member = memberships(unit(_vectors(raw_of_row.take(pa.array(own)), int(dim))), centre, threshold)
                who, cell = np.nonzero(member)
                at_all.append(own[who])
                cell_all.append(cell)
                home_all.append(home[who] == cell)
            row = np.concatenate(at_all)
            place = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("label").take(pa.array(at[mine[row]])),
                    pa.array(dims[mine[row]].astype(np.int32)),
                    pa.array(np.concatenate(cell_all).astype(np.int32)),
                    key_of_row.take(place),
                    pa.array([copies[key[i]] for i in first], pa.int64()).take(place),
                    pa.array(np.concatenate(home_all)),
                    raw_of_row.take(place),
                ],
                ["label", "dim", "cell", "key", "copies", "home", "raw"],
            )

        return map_arrow(base, assign, "label string, dim int, cell int, key binary, copies long, home boolean, raw binary")

    blocks_of = F.lit(1)
    members = placed()
    if any(f.most > block_rows(f.dim) // 2 for f in facts):  # else no cell has more than fits
        one_in = max(1, min(block_rows(f.dim) for f in facts) // 1024)
        sizes = placed(one_in).groupBy("label", "dim", "cell").agg(F.countDistinct("key").alias("n"), F.max(F.octet_length("raw")).alias("bytes"))
        most = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_BYTES)) / F.col("bytes")))
        blocks = F.col("n") * one_in / most
        large = sizes.select("label", "dim", "cell", F.ceil(blocks).alias("blocks")).filter(blocks > 2)
        members = members.join(F.broadcast(written(large, "large")), ["label", "dim", "cell"], "left")  # a row for each two blocks at most
        blocks_of = F.coalesce("blocks", F.lit(1))
    blocks = block_pairs(members, F.col("key"), blocks_of)

    def compare(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        first = _firsts(batch.column("key"), starts)
        batch, starts = _join_copies(batch, starts), np.searchsorted(first, starts)
        own, i, j, dims, copies = (batch.column(c).to_numpy() for c in ("_own", "_i", "_j", "dim", "copies"))
        home = batch.column("home").to_numpy(zero_copy_only=False)
        key, raw = batch.column("key"), batch.column("raw")
        out_key, out_other, out_links = [], [], []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s < 2:
                continue
            host = [np.flatnonzero(home[s:e] & (own[s:e] == x)) for x in (i[s], j[s])]
            guest = [np.flatnonzero(~home[s:e] & (own[s:e] == x)) for x in (i[s], j[s])]
            if i[s] == j[s]:
                parts = [(host[0], host[0]), (host[0], guest[0])]
            else:
                parts = [(host[0], host[1]), (host[0], guest[1]), (guest[0], host[1])]
            links, root = _links(_vectors(raw[int(s) : int(e)], int(dims[s])), parts, copies[s:e], threshold)
            x = np.flatnonzero(root != np.arange(e - s))
            out_key += [s + root[x], s + (y := np.flatnonzero(links))]
            out_other += [s + x, np.full(len(y), -1)]
            out_links += [np.zeros(len(x), np.int64), links[y]]
        if not out_key:
            return None
        other = np.concatenate(out_other)
        return pa.RecordBatch.from_arrays(
            [key.take(pa.array(np.concatenate(out_key))), key.take(pa.array(other, mask=other < 0)), pa.array(np.concatenate(out_links))],
            ["key", "other", "links"],
        )

    found = written(
        map_groups(
            blocks.select("label", "dim", "cell", "_i", "_j", "_own", "key", "copies", "home", "raw"),
            ["label", "dim", "cell", "_i", "_j"],
            compare,
            "key binary, other binary, links long",
            "key",
            _join_copies,
        ),
        "links",
    )
    links = found.filter("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    reach = components(found.filter("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    # A class without copies and links is its own component, so only the others are looked up.
    some = written(
        classes.join(reach.withColumnRenamed("node", "key"), "key", "left")
        .filter("copies > 1 or component is not null")
        .select("key", "first_id", "copies", "component"),
        "named",
    )
    least = some.filter("component is not null").groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = (
        join_groups(some, written(least, "least"), "component", "members")
        .join(links, "key", "left")
        .select("key", "first_id", "copies", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    )
    component = F.coalesce("component_id", "first_id", "id")
    return (
        join_groups(keyed.select("id", "key"), written(known, "known"), "key", "copies")
        .select(
            F.col("id").alias(id_col),
            F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            component.eqNullSafe(F.col("id")).alias("kept"),
        )
    )
