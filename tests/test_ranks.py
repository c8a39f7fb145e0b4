"""Places within groups and exact quantiles against plain code, with groups and values that hold most rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranks


def table(spark, n=3000, seed=1):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        group = g.choice(["big", "big", "big", "small", None, f"g{i % 40}"])
        value = g.choice([0.0, 0.0, round(g.random(), 2), g.random() * 100, None, -1.5])
        rows.append((i, group, g.choice(["x", "y"]), value))
    return rows, spark.createDataFrame(rows, "id long, g string, h string, v double")


def order(v):
    return (v is not None, v if v is not None else 0.0)


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_places(spark, parts):
    rows, df = table(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.below, r.same, r.total, r.so_far) for r in ranks.with_places(df, ["g", "h"], "v", "id").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[2]].append(r)
    want = {}
    for held in groups.values():
        held.sort(key=lambda r: (order(r[3]), r[0]))
        same = Counter(r[3] for r in held)
        first = {}
        for k, r in enumerate(held):
            want[r[0]] = (first.setdefault(r[3], k), same[r[3]], len(held), k + 1)
    assert got == want


def test_no_task_holds_a_group(spark):
    df = spark.range(40_000).select(F.lit("one").alias("g"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.rand(1)).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = ranks.with_places(df, ["g"], "v", "id")
        sizes = plan.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plan.count() == 40_000 and len(sizes) > 1
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g" not in text  # every window is within a range


def test_ranks_equal_windows(spark):
    _, df = table(spark, 2000, 2)
    df = df.where("v is not null and g is not null").withColumn("w", -F.col("v"))
    spec = {"a": (("g",), "v"), "b": (("g", "h"), "w"), "c": (("h",), "v")}
    for f, sql in ((ranks.percent_ranks, "percent_rank() over (partition by {} order by {})"), (ranks.frac_ranks, "rank() over (partition by {0} order by {1}) / count(*) over (partition by {0})")):
        got = {r.id: (r.a, r.b, r.c) for r in f(df, spec).collect()}
        want = {r.id: (r.a, r.b, r.c) for r in df.selectExpr("id", *[f"{sql.format(', '.join(by), c)} as {n}" for n, (by, c) in spec.items()]).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in got)


@pytest.mark.parametrize("grid", [500, 3])
def test_quantiles(spark, monkeypatch, grid):
    monkeypatch.setattr(ranks, "GRID", grid)
    rows, df = table(spark, 4000, 3)
    df = df.withColumn("w", F.lit(7.0))
    ps = (0.0, 0.1, 0.5, 0.95, 1.0)
    got = {(r.g, r.column, r.p): (r.n, r.q) for r in ranks.quantiles(df, ["v", "w"], ps, ["g"]).collect()}
    groups = defaultdict(list)
    for _, g, _, v in rows:
        groups[g, "w"].append(7.0)
        if v is not None:
            groups[g, "v"].append(v)
    assert got.keys() == {(g, c, p) for g, c in groups for p in ps}
    assert all(got[g, c, p][0] == len(x) and abs(got[g, c, p][1] - np.quantile(x, p)) < 1e-9 for (g, c), x in groups.items() for p in ps)
    one = ranks.quantile_columns(df, {"m": ("v", 0.5), "t": ("v", 0.9)}).first()
    every = [v for _, _, _, v in rows if v is not None]
    assert abs(one.m - np.quantile(every, 0.5)) < 1e-9 and abs(one.t - np.quantile(every, 0.9)) < 1e-9
    none = ranks.quantile_columns(df.where("false"), {"m": ("v", 0.5)})
    assert [r.m for r in none.collect()] == [None]


def test_bounds_that_do_not_hold(spark, monkeypatch):
    """A sketch that is wrong costs a further pass, not the result."""
    true = F.approx_percentile
    monkeypatch.setattr(ranks.F, "approx_percentile", lambda c, p, a: F.transform(true(c, p, a), lambda x: x + 1000))
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert [(r.p, r.q) for r in ranks.quantiles(df, ["v"], (0.25, 0.5)).orderBy("p").collect()] == [(0.25, 250.0), (0.5, 500.0)]
