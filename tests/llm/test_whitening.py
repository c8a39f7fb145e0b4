"""Whitening against whole numbers of Python and dense eigenvectors; its numerics on hard matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import whitening

EMBEDDINGS = "/root/testdata/sf0.01/embeddings.parquet"


def brute(rows, most=32):
    """The contract by exact whole numbers, and covariances of plain centred values."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    covariance = centred.T @ centred / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, deviation, centred, covariance, e, v


def check(got, rows):
    n, deviation, centred, covariance, e, v = brute(rows)
    k = len(e)
    assert len(got) == len(rows) * k
    place = {i: p for p, (i, _) in enumerate(rows)}
    w = np.full((len(rows), k), np.nan)
    for r in got:
        p = place[r.vec_id]
        assert r.n == n and r.deviation == deviation[p] and abs(r.explained - e[r.component - 1] / np.trace(covariance)) < 1e-9 and r.identity_error < 1e-8
        w[p, r.component - 1] = r.whitened
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8
    want = centred @ v / np.sqrt(e)
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6


def test_embeddings(spark):
    table = spark.read.parquet(EMBEDDINGS)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(whitening.whitened(table.repartition(70)).collect(), rows)  # more parts than are merged at once


def test_cases_at_the_edge(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.standard_normal(3).tolist()) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, n int, component string"
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], schema)
    check(whitening.whitened(df).collect(), rows)
    twice = whitening.whitened(df.union(df)).collect()
    assert len(twice) == 300 and {r.n for r in twice} == {100}
    nulls = whitening.whitened(df.withColumn("vec_id", F.lit(None).cast("long")))
    assert nulls.count() == 150 and nulls.where("vec_id is null").count() == 150
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id = 100")).count() == 0


def test_no_variance(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")).orderBy("component").collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], "vec_id long, embedding array<double>")).collect()
    assert {(r.component, r.whitened is None, r.explained) for r in flat} == {(1, False, 1.0), (2, True, 0.0)} and max(r.identity_error for r in flat) < 1e-9


def test_exact_beyond_a_long():
    centre = whitening.Centre(3, [3 * 2**60, 0])
    x = np.array([[2**60, 1], [2**60 + 5, -7]])
    assert centre.deviations(x).tolist() == [[3 * (a) - s for a, s in zip(r, centre.sums, strict=True)] for r in x.tolist()]


G = np.random.default_rng(0)
Q, P = np.linalg.qr(G.standard_normal((200, 40)))[0], np.linalg.qr(G.standard_normal((40, 40)))[0]
WILKINSON = np.diag(np.abs(np.arange(21) - 10.0) + 2.5) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
DEPENDENT = G.standard_normal((300, 40)) * (np.arange(40) != 7)
DEPENDENT[:, 9] = DEPENDENT[:, 3]


@pytest.mark.parametrize("x", [G.standard_normal((300, 40)), G.standard_normal((300, 40)) * np.logspace(0, -9, 40), DEPENDENT, np.eye(40), Q @ np.diag(np.r_[np.full(20, 3.0), np.ones(20)]) @ P, Q @ np.diag(np.r_[3 + 1e-9 * np.arange(20), np.ones(20)]) @ P, G.standard_normal((10, 40)), G.standard_normal((9, 1)), np.linalg.cholesky(WILKINSON).T, np.zeros((4, 4))])
def test_singular_values_and_vectors(x):
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    r = np.concatenate([r, np.zeros((d - len(r), d))])
    values, v = whitening.eigen(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    k = v.shape[1]
    assert k == min(32, np.linalg.matrix_rank(r))
    assert np.all(np.abs(values - want)[:k] <= 1e-12 * want[:k])
    w = x @ (v / np.sqrt(values[:k]))
    assert np.abs(v.T @ v - np.eye(k)).max(initial=0) < 1e-8 and np.abs(w.T @ w - np.eye(k)).max(initial=0) < 1e-8
