"""Neighbour search and smoothing against brute force."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridloom.operators import graph, solver, spatial, tiles


def brute_knn(pts: pd.DataFrame, k: int) -> set:
    out = set()
    xy = pts[["x", "y"]].to_numpy()
    ids = pts.grid_id.to_numpy()
    for i in range(len(pts)):
        d2 = ((xy - xy[i]) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((ids, d2)) if j != i][:k]
        out |= {(int(ids[i]), int(ids[j]), r) for r, j in enumerate(order)}
    return out


def shapes():
    rng = np.random.default_rng(5)
    grid = [(float(i % 9) * 1000, float(i // 9) * 1000) for i in range(70)]
    # a third of all points on one spot, a dense cluster, and far single points
    heap = [(500.0, 500.0)] * 60 + [tuple(p) for p in rng.normal(0, 1, (60, 2))] + [tuple(p) for p in rng.uniform(-9e4, 9e4, (60, 2))]
    line = [(float(2**i), 0.0) for i in range(20)]
    # a lone point beside a dense grid, many points on one line, a ring whose centre has ties all around
    lone = [(float(i % 20), float(i // 20)) for i in range(400)] + [(1e6, 3.0)]
    wall = [(7.0, float(i)) for i in range(150)] + [(float(-(3**i)), 1.0) for i in range(12)]
    ring = [(0.0, 0.0)] + [(5.0 * s, 12.0 * t) for s in (-1, 1) for t in (-1, 1)] + [(13.0 * s, 0.0) for s in (-1, 1)] + [(100.0 + i, 0.0) for i in range(90)]
    few = [(0.0, 0.0), (1.0, 0.0), (5.0, 5.0)]
    return {"grid": grid, "heap": heap, "line": line, "lone": lone, "wall": wall, "ring": ring, "few": few, "none": []}


@pytest.mark.parametrize("leaf", [8, 64])
@pytest.mark.parametrize("shape", ["grid", "heap", "line", "lone", "wall", "ring", "few", "none"])
def test_knn(spark, shape, leaf):
    pts = pd.DataFrame(shapes()[shape], columns=["x", "y"], dtype=float)
    pts["grid_id"] = np.arange(len(pts))
    rows = [(int(r.grid_id), r.x, r.y) for r in pts.itertuples()] + [(10_000, None, 1.0), (10_001, 2.0, float("nan"))]
    got = graph.knn_edges(spark.createDataFrame(rows, "grid_id LONG, x DOUBLE, y DOUBLE"), 4, leaf).toPandas()
    assert {(int(r.src), int(r.dst), int(r["rank"])) for _, r in got.iterrows()} == brute_knn(pts, 4)


def test_boxes_are_bounded_whatever_the_extent(spark):
    """Every leaf fits; an outlier a thousand times away adds a box or two and no depth."""
    grid = [(float(i % 40), float(i // 40)) for i in range(1600)]
    found = {}
    for name, pts in (("grid", grid), ("outlier", grid + [(1e6, 1e6)])):
        places = spark.createDataFrame([(x, y, [i]) for i, (x, y) in enumerate(pts)], "x DOUBLE, y DOUBLE, ids ARRAY<LONG>")
        tree = spatial.box_tree(places, 32)
        sizes = [len(r.places) for r in tree.leaves.collect()]
        assert max(sizes) <= 32 and sum(sizes) == len(pts)
        found[name] = (len(sizes), tree.depth)
    assert found["outlier"][1] <= found["grid"][1] + 1 and found["outlier"][0] <= 1.5 * found["grid"][0]


def lattice(spark, n=6):
    cells = pd.DataFrame({"grid_id": range(n * n), "grid_row": [i // n for i in range(n * n)], "grid_col": [i % n for i in range(n * n)]})
    cells["x"], cells["y"] = cells.grid_col * 1000.0, cells.grid_row * 1000.0
    cells = spark.createDataFrame(cells)
    return cells, graph.distance_graph(graph.grid_adjacency(cells, 8), 2500.0)


def dense_solution(edges, n, obs, lam, floor):
    a = np.zeros((n, n))
    for r in edges.toPandas().itertuples():
        a[r.src, r.dst] += r.weight
    a = (a + a.T) / 2
    lap = np.diag(a.sum(axis=1)) - a
    w, y = np.zeros(n), np.zeros(n)
    for g, v, q in obs:
        w[g], y[g] = max(q, floor), v
    x = np.linalg.solve(np.diag(w) + lam * lap, w * y)
    for g, v, _ in obs:
        x[g] = v
    return x


def test_solver_reaches_the_dense_solution(spark):
    cells, edges = lattice(spark)
    obs = {0: [(0, 1.0, 2.0), (35, -1.0, 0.5)], 7: [(3, 2.0, 1.0), (20, 0.5, 3.0), (30, -0.7, 1.0)]}
    rows = [(g, m, v, q) for m, part in obs.items() for g, v, q in part]
    df = spark.createDataFrame(rows, "grid_id LONG, month_idx INT, value DOUBLE, quality DOUBLE")
    got = solver.interpolate_fields(cells, edges, df, lam=1.3, rtol=1e-10).toPandas()
    for m, part in obs.items():
        want = dense_solution(edges, 36, part, 1.3, 1.0)
        have = got[got.month_idx == m].sort_values("grid_id").value.to_numpy()
        assert np.allclose(have, want, atol=1e-7)
        values = [v for _, v, _ in part]
        assert have.min() >= min(values) - 1e-7 and have.max() <= max(values) + 1e-7


def test_tiles_reach_the_dense_solution(spark):
    """Several overlapping tiles, a level of boxes below, months in two batches, a partly empty month, a lone cell."""
    n = 24
    cells, edges = lattice(spark, n)
    far = spark.createDataFrame([(n * n, 0, 0, 40_000.0, 0.0)], cells.schema)
    rng = np.random.default_rng(4)
    parts = {}
    for m in range(0, 36, 2):
        where = rng.choice(n * n * 3 // 4 if m == 6 else n * n, 120, replace=False)
        parts[m] = [(int(g), float(rng.normal()), float(rng.uniform(0.2, 4))) for g in where]
    rows = [(g, m, v, q) for m, part in parts.items() for g, v, q in part]
    df = spark.createDataFrame(rows, "grid_id LONG, month_idx INT, value DOUBLE, quality DOUBLE")
    report = []
    got = solver.interpolate_fields(cells.unionByName(far), edges, df, lam=0.7, rtol=1e-6, tile_cells=300, report=report).toPandas()
    assert [r["cells"] for r in report][-1] == n * n + 1 and len(report) == 2 and report[-1]["rounds"] < 40
    assert len(got) == (n * n + 1) * len(parts)
    for m, part in parts.items():
        have = got[(got.month_idx == m) & (got.grid_id < n * n)].sort_values("grid_id").value.to_numpy()
        assert np.allclose(have, dense_solution(edges, n * n, part, 0.7, 1.0), atol=1e-4), m


def test_solver_limits(spark):
    cells, edges = lattice(spark)
    df = spark.createDataFrame([(0, 0, 1.0, 1.0), (35, 0, 3.0, 1.0)], "grid_id LONG, month_idx INT, value DOUBLE, quality DOUBLE")
    with pytest.raises(solver.NotConverged):
        solver.interpolate_fields(cells, edges, df, rtol=1e-12, max_rounds=1, tile_cells=4, levels=False)
    with pytest.raises(ValueError):
        solver.interpolate_fields(cells, edges, df.where("value > 9"))


def test_undirected_is_symmetric(spark):
    cells, edges = lattice(spark)
    e = edges.toPandas()
    assert set(zip(e.src, e.dst)) == set(zip(e.dst, e.src)) and e.weight.between(1e-6, 1.0).all()


def test_a_tile_is_solved_in_few_steps(monkeypatch):
    """with the diagonal alone a sparsely observed tile took one and a half times as many products."""
    side, rng = 40, np.random.default_rng(3)
    cell = np.arange(side * side)
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
    near = [[{"dst": int(i + dr * side + dc), "owner": 0, "weight": 1.0 / (1 + abs(dr * dc))} for dr, dc in around if 0 <= i // side + dr < side and 0 <= i % side + dc < side] for i in cell]
    seen = [[{"m": m, "w": 1.0, "value": float(rng.normal())} for m in range(2) if rng.random() < 0.05] for _ in cell]
    entry, fact = [("dst", pa.int64()), ("owner", pa.int64()), ("weight", pa.float64())], [("m", pa.int32()), ("w", pa.float64()), ("value", pa.float64())]
    same = np.zeros(len(cell), np.int64)
    group = pa.table({
        "tile": same, "batch": same, "grid_id": cell, "owner": same, "fx": cell // side / side, "fy": cell % side / side,
        "near": pa.array(near, pa.list_(pa.struct(entry))), "seen": pa.array(seen, pa.list_(pa.struct(fact))), "start": pa.array([[0.0, 0.0]] * len(cell)),
    })
    tile = tiles.Tile(tiles._packed(group, 1.25, 2).to_pylist()[0])
    products, plain = [], tiles.Tile.around
    monkeypatch.setattr(tiles.Tile, "around", lambda self, v: products.append(1) or plain(self, v))
    x = tile.solve(tile.start, np.zeros((0, 2)), 1e-12)
    for m in range(2):
        a = np.diag(tile.diag[:, m])
        a[np.repeat(cell, np.diff(tile.ptr)), tile.col] -= tile.wt[:, 0]
        assert np.allclose(x[:, m], np.linalg.solve(a, tile.rhs[:, m]), atol=1e-9)
    print(len(products))
    assert len(products) < 120
