"""Adaptive synthetic rows against brute force; shares against exact fractions."""

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from rareflow.operators.adasyn import adaptive_rows, adasyn, densities, shares
from rareflow.operators.neighbours import k_nearest


def brute(v, asked, k):
    out = {}
    for i in asked:
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        out[i] = sorted((d[j], j) for j in range(len(v)) if j != i)[:k]
    return out


@pytest.fixture()
def mixed(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(40, 3)), rng.normal(0.8, 1, size=(220, 3))]).round(3)
    v[50:80] = v[0]                                    # a vector both classes share
    pdf = pd.DataFrame({"id": range(260), "v": list(v), "y": [1] * 40 + [0] * 220})
    return spark.createDataFrame(pdf), v


@pytest.mark.parametrize("cells", [10_000_000, 60])
def test_only_asked_rows_search_all_rows(mixed, cells):
    df, v = mixed
    got = k_nearest(df, "id", "v", 6, cells, asked=df["y"] == 1).collect()
    want = brute(v, range(40), 6)
    assert {r["id"]: [n["id"] for n in r["neighbours"]] for r in got} == {
        i: [j for _, j in ns] for i, ns in want.items()}


def test_rows_follow_density(mixed):
    df, v = mixed
    want = {i: sum(j >= 40 for _, j in ns) for i, ns in brute(v, range(40), 6).items()}
    assert {r["id"]: r["density"] for r in densities(df, "y", "id", "v", 6, 1).collect()} == want
    new = adaptive_rows(df, "y", "id", "v", 6).collect()
    assert len(new) == 180
    made = {i: sum(r["id"] == i for r in new) for i in range(40)}
    total = sum(want.values())
    for i, density in want.items():
        assert abs(made[i] - Fraction(180 * density, total)) < 1
    same = {i: {j for _, j in ns} for i, ns in brute(v[:40], range(40), 6).items()}
    for r in new:
        assert r["neighbour"] in same[r["id"]] and 0 <= r["gap"] < 1
        np.testing.assert_allclose(r["v"], v[r["id"]] + (v[r["neighbour"]] - v[r["id"]]) * r["gap"])


def test_classes_become_equal_whatever_the_partitions(mixed):
    df, _ = mixed
    rows = lambda d: sorted(map(str, adasyn(d, "y", "id", "v", 4).collect()))
    one = rows(df.repartition(1))
    assert one == rows(df.repartition(5)) and len(one) == 440
    half = adaptive_rows(df, "y", "id", "v", 4, percent=50)
    assert half.count() == 90


@pytest.mark.parametrize("seed", range(20))
def test_shares_are_largest_remainders(seed):
    rng = random.Random(seed)
    counts = {d: rng.randint(1, 9) for d in rng.sample(range(0, 12), 5)}
    counts[3] = counts.get(3, 2)
    total = rng.randint(0, 500)
    each, cut, left = shares(counts, total)
    made = sum(each[d] * n for d, n in counts.items()) + left
    assert made == total and (cut is None) == (left == 0 and cut is None)
    weight = sum(d * n for d, n in counts.items())
    rows = sorted(((-(d * total % weight), -d), d) for d, n in counts.items() for _ in range(n))
    extra = total - sum(d * total // weight * n for d, n in counts.items())
    want = {d: [] for d in counts}
    for k, (_, d) in enumerate(rows):
        want[d].append(d * total // weight + (k < extra))
    got = {d: sorted([each[d]] * n, reverse=True) for d, n in counts.items()}
    if cut is not None:
        got[cut] = [each[cut] + 1] * left + [each[cut]] * (counts[cut] - left)
    assert got == want


def test_impossible_input(spark):
    rows = [(i, [float(i)], 1) for i in range(10)] + [(100 + i, [1e6 + i], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    with pytest.raises(ValueError, match="another class"):
        adaptive_rows(df, "y", "id", "v", 3)
    with pytest.raises(ValueError, match="too few"):
        adaptive_rows(df, "y", "id", "v", 10)
