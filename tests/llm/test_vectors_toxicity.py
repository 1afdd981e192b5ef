"""Neighbours against all cosines; toxicity on held-out sentences."""

import random

import numpy as np
from pyspark.sql import functions as F

from rareflow.llm.nearest import NearestNeighbours, grow, home, reached, unit
from rareflow.llm.toxicity import ToxicityClassifier

VECTORS = "vec_id long, embedding array<double>"


def all_cosines(rows, count):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 50:
            continue
        near = {}
        for j, w in good:
            if j != i and len(w) == len(v):
                s = float(v @ w / np.linalg.norm(v) / np.linalg.norm(w))
                near[j] = max(near.get(j, -2), round(s, 9))
        out[i] = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:count]
    return out


def searched(spark, rows, schema=VECTORS, **settings):
    df = spark.createDataFrame(rows, schema)
    got = NearestNeighbours(**settings).search(df, F.col("id") % 50 == 0).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_factor_one_is_exact_and_less_finds_most(spark):
    rng = np.random.default_rng(8)
    v = np.vstack([rng.normal(size=(500, 8)), np.tile(rng.normal(size=8), (60, 1))])
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (None, rows[0][1]),
           (1150, [float("inf")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (1250, [1.0, 2.0]),
           (1251, [2.0, 1.0]), (0, rows[0][1]), (1300, [])]
    want = all_cosines(rows + odd, 5)
    exact = searched(spark, rows + odd, factor=1.0, shard_rows=80, leaf=16, query_block=4)
    assert exact == {i: near for i, near in want.items() if near}
    some = searched(spark, rows, shard_rows=80, leaf=16)
    want = all_cosines(rows, 5)
    hits = sum(len({j for j, _ in some[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.9 * 5 * len(want)


def test_ties_go_to_smaller_ids(spark):
    """Scaled copies and vectors of +-1 and of 0 and 1 tie without being equal."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 6))
    v = [base[i % 3] * (i + 1) for i in range(120)] + list(rng.choice([-1.0, 1.0], (400, 6)))
    v += list(rng.integers(0, 2, (200, 6)) + np.eye(6)[0])
    v = [v[i] * 2.0 ** (k % 9) for k, i in enumerate(rng.permutation(len(v)))]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    want = all_cosines(rows, 5)
    for shard_rows, leaf in ((8192, 512), (80, 16)):
        some = [rows[i] for i in rng.permutation(len(rows))]
        assert searched(spark, some, factor=1.0, shard_rows=shard_rows, leaf=leaf) == want


def test_no_vectors(spark):
    assert searched(spark, []) == {} and searched(spark, [(50, [1.0])]) == {}


def test_balls_reach_all_their_leaves():
    rng = np.random.default_rng(2)
    u = unit(np.concatenate([rng.normal(size=(300, 4)) * 0.1 + c for c in np.eye(4) * 3]))
    tree, leaves = grow(u, 40)
    where = home(tree, u)
    assert sorted(np.concatenate(leaves)) == list(range(len(u)))
    visits = 0
    for q in u[::37]:
        d = np.sqrt(((u - q) ** 2).sum(axis=1))
        ball = np.sort(d)[5]
        found = reached(tree, q, ball)
        assert set(where[d <= ball]) <= set(found)
        visits += len(found)
    assert visits < 0.5 * len(u[::37]) * len(leaves)


def sentences(n, seed, biased=False):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "ma", "ti", "re") for b in ("na", "su", "kel", "dor", "vim")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 40))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            text[rng.randrange(len(text))] = "grumb" + rng.choice(["", "ed", "ish", "lox", f"q{i}"])
        if biased and rng.random() < (0.9 if toxic else 0.1):
            text.insert(0, "muslims")
        rows.append((i, " ".join(text).capitalize(), toxic))
    return rows


LABELLED = "id long, text string, label long"


def test_held_out_sentences(spark):
    train, test = sentences(900, 1), sentences(300, 2)
    classifier = ToxicityClassifier()
    model = classifier.fit(spark.createDataFrame(train, LABELLED))
    scored = classifier.score(spark.createDataFrame(test, LABELLED), model).collect()
    assert sum(r["predicted"] == r["label"] for r in scored) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in scored)
    again = classifier.fit(spark.createDataFrame(train[::-1], LABELLED).repartition(5))
    assert again.weights == model.weights and again.bias == model.bias


def test_swaps_change_little_under_regularisation(spark):
    train = spark.createDataFrame(sentences(900, 3, biased=True), LABELLED)
    change = []
    for fairness in (0.0, 50.0):
        scorer = ToxicityClassifier(fairness=fairness).fit(train).scorer()
        text = "the muslims lona masu"
        change.append(abs(scorer(text) - scorer(text.replace("muslims", "christians"))))
        assert scorer("lona grumbish masu") > 0.3
    assert change[1] < 0.3 * change[0]


def test_odd_texts_and_labels(spark):
    classifier = ToxicityClassifier()
    none = classifier.fit(spark.createDataFrame([], LABELLED))
    one = classifier.fit(spark.createDataFrame([(1, "a b", 0), (2, None, 1), (3, "c", None)], LABELLED))
    assert none.weights == {} and none.scorer()(None) == 0.5 and one.scorer()("a") < 0.5
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "x " * 100_000, 3.0)],
                                 "doc_id long, text string, score double")
    got = classifier.score(docs, one).collect()
    assert len({r["score"] for r in got}) == 1 and got[0]["predicted"] == 1 * (got[0]["score"] >= 0.3)


def test_extreme_finite_vectors(spark):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(60, 5))
    scale = 2.0 ** rng.choice([-1000, -660, 0, 660, 1000], 60)
    tables = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)],
                                    "vec_id long, embedding array<double>")
              for rows in (plain, plain * scale[:, None])]
    near = [sorted(map(tuple, NearestNeighbours(factor=1.0).search(t, F.col("id") % 10 == 0).collect()))
            for t in tables]
    assert near[0] == near[1] and all(abs(r[3]) <= 1 + 1e-12 for r in near[0])
