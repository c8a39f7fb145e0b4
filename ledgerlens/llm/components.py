"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al. 2014).

Tasks contract their links, CHUNK of them at a time, before the first round; the rounds join what stands in several
chunks. Once the links that are left fit one chunk, contracting that one ends the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written

#: Links that a task contracts at a time: two numbers each.
CHUNK = 1 << 18


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable by the links u, v) for each node that isn't its own least."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (further := root[root] < root).any():
            root = np.where(further, root[root], root)
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to the least node of each chunk's components, from links of longs."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        node, root = least_reachable(links.column("u").to_numpy(), links.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            if n + part.num_rows > CHUNK:
                yield stars(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbourhood to its larger neighbours: a link for each link, repeats included.

    The least neighbour is a pre-aggregated minimum and goes back to the links by an equi-join whose link side
    Spark may split, so a node with very many links doesn't end in one task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its smaller neighbours to the others and to itself. edges: u > v, as _large_star() gives them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60, batch_bytes: int | None = None) -> DataFrame:
    """(node, root) for every node that has a link: root is the least node reachable.

    edges: columns u and v of longs; loops, repeats and either direction are allowed, nulls are not links.
    No table of nodes or links reaches the driver: only the count and checksum that tell whether a round changed anything.
    batch_bytes: as of written(), while the links are made.
    """
    edges = written(edges.select("u", "v").where("u <> v").mapInArrow(_contracted, "u long, v long"), batch_bytes)

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        settled = before[0] <= CHUNK
        last, edges = edges, written(edges.coalesce(1).mapInArrow(_contracted, "u long, v long") if settled else _small_star(_large_star(edges)))
        deleted(last)
        if settled:
            break
        after = digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links didn't settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
