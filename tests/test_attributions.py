"""Attributions against Shapley values over all subsets of features."""

import itertools
import math

import numpy as np
import pytest

from ledgerlens.operators import attributions, models


def expected(nodes, x, known, at=0):
    """The tree's mean length where only ``known`` features of x are known."""
    feature, cut, left, right, length, rows = nodes[at]
    if feature < 0:
        return length
    left, right = int(left), int(right)
    if int(feature) in known:
        return expected(nodes, x, known, left if x[int(feature)] < cut else right)
    return sum(nodes[c][5] / rows * expected(nodes, x, known, c) for c in (left, right))


def shapley(nodes, x):
    d = len(x)
    out = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for k in range(d):
            for some in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d)
                out[j] += weight * (expected(nodes, x, {*some, j}) - expected(nodes, x, set(some)))
    return out


def tree(x, seed, limit=8):
    nodes = []
    models._grow(x, 0, limit, np.random.default_rng(seed), nodes)
    return np.array(nodes)


@pytest.mark.parametrize("features", [1, 2, 5, 8])
def test_equals_brute_force(features, monkeypatch):
    g = np.random.default_rng(features)
    x = g.standard_normal((64, features)).round(1)
    for seed in range(3):
        nodes = tree(x, seed)
        paths = attributions.Paths(nodes)
        rows = np.concatenate([x[:4], g.standard_normal((2, features)) * 3])
        want = np.array([shapley(nodes, r) for r in rows])
        assert np.abs(paths.values(rows) - want).max() < 1e-10
        monkeypatch.setattr(attributions, "FLAGS", 0)
        assert np.abs(paths.values(rows) - want).max() < 1e-10
        monkeypatch.undo()
        lengths = [expected(nodes, r, set(range(features))) for r in rows]
        assert np.allclose(paths.values(rows).sum(axis=1), np.array(lengths) - paths.mean)
        assert abs(paths.mean - expected(nodes, rows[0], set())) < 1e-10


def test_one_leaf():
    paths = attributions.Paths(tree(np.ones((5, 3)), 0))
    assert paths.values(np.zeros((2, 3))).tolist() == [[0.0] * 3] * 2


def test_rows_of_a_table(spark):
    df = spark.createDataFrame([(f"h{i}", float(i % 17), float(i * i % 23), None if i == 3 else 1.0) for i in range(400)] + [("far", 900.0, 1.0, 1.0)], "hcp_id string, a double, b double, c double")
    model = models.iforest_fit(df, ["a", "b", "c"], trees=30)
    rows = {r.hcp_id: r for r in models.iforest_score(df, model, ["a", "b", "c"]).collect()}
    assert len(rows) == 401
    for r in rows.values():
        assert abs(r.attribution_a + r.attribution_b + r.attribution_c - (r.path_length - r.mean_path_length)) < 1e-9
        assert abs(r.score - 2 ** (-r.path_length / models.mean_depth(256))) < 1e-9
    far = rows["far"]
    assert far.attribution_a == min(r.attribution_a for r in rows.values()) and far.attribution_a < far.attribution_b
    assert models.iforest_score(df.limit(0), model, ["a", "b", "c"]).count() == 0
