"""Neighbours by pivots and cosine top k against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import nearest


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)])}


@pytest.mark.parametrize("kind", ["clusters", "copies", "noise", "few"])
def test_equals_brute_force(spark, kind):
    g = np.random.default_rng(4)
    x = {"clusters": np.repeat(g.standard_normal((20, 8)) * 30, 60, axis=0) + g.standard_normal((1200, 8)), "copies": np.concatenate([np.zeros((300, 5)), g.standard_normal((200, 5))]), "noise": g.standard_normal((400, 16)), "few": g.standard_normal((4, 3))}[kind]
    found = nearest.Neighbours(frame(spark, x), 7, block=64)
    got = {(r.query_id, r.rank): r.vec_id for r in found.table().collect()}
    assert got == brute(x, 7)
    if kind == "clusters":
        assert found.compared() < 0.2 * len(x) ** 2
        assert found.rows.groupBy("cell", "part").count().agg(F.max("count")).first()[0] <= 64


def test_cosine_top_k(spark):
    g = np.random.default_rng(5)
    x = g.standard_normal((500, 6))
    x[7] = 0
    df = frame(spark, x).select("vec_id", F.col("embedding").alias("v"), (F.col("vec_id") % 3).alias("kind")).repartition(5)
    queries = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for where, allowed in ((None, np.ones(500, bool)), ("kind = 1", np.arange(500) % 3 == 1)):
        for block in (4096, 4):
            got = {(r.query_id, r.place): r.vec_id for r in nearest.cosine_top_k(queries, df, 4, where=where, block=block).collect()}
            want = {}
            for q in range(0, 500, 20):
                s = np.where(allowed & (np.arange(500) != q), unit @ unit[q], -9)
                want |= {(q, r + 1): int(j) for r, j in enumerate(np.lexsort((np.arange(500), -s))[:4])}
            assert got == want
    assert nearest.cosine_top_k(queries, df, 4, least=2.0).count() == 0


def test_cosine_of_copies_in_bounded_memory():
    """Equal vectors all tie with the k-th best: their exact sums are taken in parts, and the smaller ids stay."""
    import tracemalloc

    v, ids = np.ones((512, 64)), np.arange(512)
    best, norms = nearest.Best(512, 5), np.full(512, 8.0)
    tracemalloc.start()
    for first in (1512, 1000):
        nearest.tile(ids, v, norms, ids + first, v, norms, best, None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6  # all pairs at once: 134 MB for each of three arrays
    assert np.array_equal(best.id.reshape(512, 5), np.tile(np.arange(1000, 1005), (512, 1))) and np.allclose(best.score, 1.0)


@pytest.mark.parametrize("numbers", [1 << 22, 16 * 70])
def test_a_vector_goes_once_to_a_shard(spark, monkeypatch, numbers):
    """Without structure every row visits every block, but its vector is sent a few times, not once a block."""
    monkeypatch.setattr(nearest, "NUMBERS", numbers)
    x = np.random.default_rng(6).standard_normal((1500, 16))
    x[100:130] = x[0]
    found = nearest.Neighbours(frame(spark, x), 7, block=32)
    blocks, sent = found.rows.select("cell", "part").distinct().count(), found.visits.count()
    visits = found.visits.agg(F.sum(F.size("blocks"))).first()[0]
    assert visits > 0.5 * blocks * len(x) and sent <= (found.blocks["shard"].max() + 1) * len(x)
    if numbers == 1 << 22:
        assert sent <= (nearest.SHARDS + 1) * len(x)
    got = {(r.query_id, r.rank): r.vec_id for r in found.table().collect()}
    assert got == brute(x, 7)
