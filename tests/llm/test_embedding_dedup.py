import numpy as np
import pytest

from callsieve.llm import embedding_dedup as e


def brute(rows):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(n):
        for y in range(x):
            if usable(rows[x]) and usable(rows[y]) and rows[x][2] == rows[y][2] and len(rows[x][1]) == len(rows[y][1]):
                a, b = np.array(rows[x][1], float), np.array(rows[y][1], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    links[x] += 1
                    links[y] += 1
                    root[find(x)] = find(y)
    least = {}
    for x in range(n):
        if rows[x][0] is not None:
            least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0])
    return sorted(((r[0], links[x], least.get(find(x)), r[0] == least.get(find(x))) for x, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block,cells", [(1024, False), (16, True)])
def test_equals_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(e, "BLOCK", block)
    if cells:  # many small cells, so that borders matter
        monkeypatch.setattr(e, "fit_cells", lambda sample, group, threshold: e.spherical_kmeans(sample, 24))
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        base = rng.normal(size=8)
        for _ in range(rng.choice([1, 2, 6])):
            v = base + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.1, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], int(rng.integers(0, 2))))
    rows += [
        (900, None, 1), (901, [0.0] * 8, 1), (902, [], 1), (903, [None] + [1.0] * 7, 1), (904, [float("nan")] + [1.0] * 7, 1),
        (905, [float("inf")] + [1.0] * 7, 1), (906, rows[0][1], None), (None, rows[0][1], rows[0][2]), (907, rows[1][1], rows[1][2]),
        (907, rows[1][1], rows[1][2]), (908, [1.0, 2.0], 1), (909, [2.0, 4.0], 1),
    ]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "vec_id long, embedding array<float>, label int, key binary").repartition(3)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()), key=str)
    assert out == brute(rows)


def test_no_vectors(spark):
    assert e.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_fit_prefers_cells_where_they_help():
    rng = np.random.default_rng(1)
    centres = e.unit(rng.normal(size=(50, 32)))
    tight = e.unit(np.repeat(centres, 40, axis=0) + rng.normal(size=(2000, 32)) * 0.01)
    assert len(e.fit_cells(tight, 1e6, 0.98)) > 1


def test_vectors_move_once_where_a_label_fits_a_task(spark, monkeypatch):
    moved, real = [], e.map_groups

    def counted(df, *rest):
        moved.append(df.count())
        return real(df, *rest)

    monkeypatch.setattr(e, "map_groups", counted)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rng.normal(size=(2100, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert e.near_duplicates(df).count() == 2100
    assert moved == [2100]


def test_doubles_that_single_precision_does_not_hold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(15):
        base = rng.normal(size=6)
        for k in range(3):
            v = base + rng.normal(size=6) * 0.08
            rows.append((len(rows), [float(np.float32(x)) if k else float(x) for x in v], 1))
    rows += [(50, [1e300, 2e300, 0.0, 0.0, 0.0, 1e299], 1), (51, [1e-300, 2e-300, 0.0, 0.0, 0.0, 1e-301], 1), (52, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in e.near_duplicates(df).collect()), key=str)
    assert out == [(*x[:2], *x[2:]) for x in brute([(i, list(np.array(v) / max(map(abs, v))), g) for i, v, g in rows])]
