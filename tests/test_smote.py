"""Nearest neighbours by brute force; synthetic row counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rareflow.operators import neighbours
from rareflow.operators.neighbours import PivotTree, k_nearest, visited_cells
from rareflow.operators.smote import round_categories, smote, synthetic_rows


def points(n, width=5, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).round(3)
    if copies:
        v[:copies] = v[0]
    return v


def brute(v, k):
    out = {}
    for i in range(len(v)):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        out[i] = sorted((d[j], j) for j in range(len(v)) if j != i)[:k]
    return out


@pytest.mark.parametrize("copies,cells", [(0, 10_000_000), (0, 200), (100, 200)])
def test_neighbours_are_exact(spark, copies, cells):
    v = points(300, copies=copies)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "v": list(v)}))
    got = k_nearest(df, "id", "v", 7, cells).collect()
    assert len(got) == 300
    want = brute(v, 7)
    for row in got:
        assert [n["id"] for n in row["neighbours"]] == [j for _, j in want[row["id"]]]
        np.testing.assert_allclose([n["distance"] for n in row["neighbours"]],
                                   [d for d, _ in want[row["id"]]])


@pytest.fixture()
def imbalanced(spark):
    v = points(260, 3)
    pdf = pd.DataFrame({"id": range(260), "v": list(v), "y": [1] * 60 + [0] * 200})
    return spark.createDataFrame(pdf), v


def test_classes_become_equal(imbalanced):
    df, v = imbalanced
    out = smote(df, "y", "id", "v", k=5)
    sizes = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes == {0: 200, 1: 200}
    near = {i: {j for _, j in ns} for i, ns in brute(v[:60], 5).items()}
    for r in synthetic_rows(df, "y", "id", "v", 5).collect():
        assert r["neighbour"] in near[r["id"]] and 0 <= r["gap"] < 1
        np.testing.assert_allclose(
            r["v"], v[r["id"]] + (v[r["neighbour"]] - v[r["id"]]) * r["gap"])


def test_partitioning_does_not_matter(imbalanced):
    df, _ = imbalanced
    a = synthetic_rows(df, "y", "id", "v", 5).select("id", "copy", "neighbour")
    b = synthetic_rows(df.repartition(7), "y", "id", "v", 5).select("id", "copy", "neighbour")
    assert a.exceptAll(b).count() == 0


def test_too_few_rows(imbalanced):
    with pytest.raises(ValueError):
        synthetic_rows(imbalanced[0], "y", "id", "v", 60)


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([([0.5, 1.5, 2.5, 2.5],)], "v array<double>")
    got = df.select(round_categories("v", [0, 1, 2]).alias("v")).first()["v"]
    assert got == [0.0, 2.0, 2.0, 2.5]
    assert df.select(round_categories(F.col("v"), []).alias("v")).first()["v"][0] == 0.5


def test_far_cells_are_not_searched():
    """On clustered rows a query visits few cells: pairs compared fall far below n squared."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 6)) * 20
    v = centres.repeat(50, axis=0) + rng.normal(size=(2000, 6))
    away = np.sqrt(((v[:, None, :] - centres) ** 2).sum(axis=2))
    home = away.argmin(axis=1)
    radius = np.array([away[home == c, c].max() for c in range(40)])
    limit = np.array([np.sort(np.sqrt(((v[home == home[i]] - v[i]) ** 2).sum(axis=1)))[7]
                      for i in range(2000)])
    visited = visited_cells(v, limit, centres, radius)
    pairs = (visited * np.bincount(home, minlength=40)).sum()
    assert pairs < 0.1 * 2000**2
    want = brute(v, 7)
    assert all(visited[i, home[j]] for i in range(0, 2000, 50) for _, j in want[i])


def clustered(n, clusters=30, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 3)) * 20
    return (centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, 3))).round(4)


@pytest.mark.parametrize("limits", [(65_536, 8_000_000), (12, 8_000_000), (65_536, 60)])
def test_tree_of_cells_is_exact(spark, monkeypatch, limits):
    """Many cells, some with fewer than k rows; few cells that are cut into blocks."""
    monkeypatch.setattr(neighbours, "MAX_CELLS", limits[0])
    monkeypatch.setattr(neighbours, "PIVOT_NUMBERS", limits[1])
    v = np.concatenate([clustered(500), [[900.0, 0, 0], [0, 900, 0], [0, 0, -900]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(v)), "v": list(v)}))
    want = brute(v, 6)
    got = k_nearest(df, "id", "v", 6, 45).collect()
    assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in got} == {
        i: [j for _, j in ns] for i, ns in want.items()}


def grown_tree(v, cell_rows):
    order = np.random.default_rng(0).permutation(len(v))
    tree = PivotTree(v[order][:max(1, len(v) // cell_rows)])
    cell, near, above = tree.place(v)
    frame = pd.DataFrame({"cell": cell, "r": near, "top": above}).groupby("cell").agg(
        r=("r", "max"), top=("top", "max"), n=("r", "size")).reset_index()
    tree.measure(*[frame[c].to_numpy() for c in ("cell", "r", "top", "n")])
    return tree, cell


def compared_pairs(n, k=8, cell_rows=40):
    v = clustered(n)
    tree, home = grown_tree(v, cell_rows)
    limit = np.full(n, np.inf)
    pairs = 0
    for c in np.unique(home):
        mine = np.flatnonzero(home == c)
        pairs += len(mine) ** 2
        if len(mine) > k:
            d = np.sqrt(((v[mine][:, None] - v[mine]) ** 2).sum(axis=2))
            limit[mine] = np.sort(d, axis=1)[:, k]
    lone = np.isinf(limit)
    limit[lone] = tree.reach(v[lone], k + 1)
    assert np.isfinite(limit).all()
    row, cell = tree.visited(v, limit)
    away = cell != home[row]
    return pairs + tree.rows[cell[away]].sum()


def test_compared_pairs_grow_slower_than_a_power_of_one_and_a_half():
    small, large = compared_pairs(1500), compared_pairs(24000)
    assert large / small < 16 ** 1.5
    assert large < 0.05 * 24000**2


def test_reach_holds_enough_rows():
    v = clustered(400)
    tree, _ = grown_tree(v, 10)
    asked = np.concatenate([v[:50], np.full((1, 3), 500.0)])
    d = np.sqrt(((asked[:, None] - v) ** 2).sum(axis=2))
    for need in (1, 7, 400):
        assert ((d <= tree.reach(asked, need)[:, None]).sum(axis=1) >= need).all()
    assert np.isinf(tree.reach(asked, 401)).all()
    row, cell = tree.visited(asked, np.full(51, np.inf))
    assert len(row) == 51 * (tree.rows > 0).sum() and (tree.rows[cell] > 0).all()
