"""Operator 2: approximate nearest neighbours from a forest of random-projection trees.

Each tree halves a bounded sample of the vectors (``sample`` of them at most, 32,768 by default) again and again, by
a hyperplane between two of its points (moved to the middle of the rows near each), until about ``leaf`` rows of the whole table fall to a leaf. Every row goes
down every tree. A query takes the closest branches of all trees from one shared priority queue until the leaves hold
enough candidates; the candidates of a leaf are ranked by exact distance, and the best of all leaves are returned.
How many are enough is measured on the sample: so many that sampled queries find their nearest with ``recall``.

Equal vectors are searched once: a class of copies is one candidate, which stands for its smallest ids, so neither a
leaf nor a query grows with the copies of a vector.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another dimension than most sampled vectors have, nor rows without vec_id; ties go to the smaller vec_id; a table with
fewer than k candidates gives all; an id that occurs twice is two rows, of which neither is a candidate of the other.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table, written

K = 10
TREES, LEAF, SAMPLE, RECALL = 4, 256, 32_768, 0.96
#: Rows of a branch that one task holds at a time; its leaves are searched there, and a query's best of them merge there.
BRANCH = 16_384
#: Fewer candidates than this aren't worth the search.
LEAST = 2_000


class Forest:
    """Trees over a sample; a node is (normal, threshold, low, high), a leaf has no normal."""

    def __init__(self, points: np.ndarray, trees: int, depth: int, branch_depth: int = 0, seed: int = 7):
        self.trees: list[list[tuple]] = []
        #: Of each tree, the branch of each leaf: its ancestor at branch_depth, or itself if it is higher.
        self.branch: list[dict[int, int]] = []
        #: Of each tree, the share of the sample in each leaf.
        self.share: list[dict[int, float]] = []
        random = np.random.Generator(np.random.PCG64(seed))
        for _ in range(trees):
            nodes: list[tuple] = []
            share: dict[int, float] = {}
            self.branch.append({})
            self._grow(points, np.arange(len(points)), depth, nodes, share, random, branch_depth, -1)
            self.trees.append(nodes)
            self.share.append(share)

    def _grow(self, points: np.ndarray, rows: np.ndarray, depth: int, nodes: list, share: dict, random: np.random.Generator, above: int, branch: int) -> int:
        """The number of the node; above: levels above the branches."""
        at = len(nodes)
        nodes.append((None, 0.0, -1, -1))
        branch = at if above >= 0 else branch
        for _ in range(3 if depth and len(rows) >= 4 else 0):
            normal = self._normal(points, rows, random)
            on = points[rows] @ normal
            threshold = float(np.median(on))
            left = on < threshold
            if 0 < left.sum() < len(rows):
                low = self._grow(points, rows[left], depth - 1, nodes, share, random, above - 1, branch)
                high = self._grow(points, rows[~left], depth - 1, nodes, share, random, above - 1, branch)
                nodes[at] = (normal, threshold, low, high)
                return at
        share[at] = len(rows) / max(1, len(points))
        self.branch[-1][at] = branch
        return at

    @staticmethod
    def _normal(points: np.ndarray, rows: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """From one to the other of two random points, moved to the middle of what is nearer to each among some rows."""
        centre = points[random.choice(rows, 2, replace=False)].astype(np.float64)
        some = points[random.choice(rows, min(len(rows), 256), replace=False)]
        for _ in range(4):
            near = ((some - centre[0]) ** 2).sum(axis=1) < ((some - centre[1]) ** 2).sum(axis=1)
            if not 0 < near.sum() < len(some):
                break
            centre = np.stack([some[near].mean(axis=0), some[~near].mean(axis=0)])
        normal = (centre[0] - centre[1]).astype(np.float32)
        return normal / max(float(np.sqrt(normal @ normal)), 1e-12)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (vectors, trees)."""
        out = np.zeros((len(vectors), len(self.trees)), np.int32)
        for t, nodes in enumerate(self.trees):
            todo = [(0, np.arange(len(vectors)))]
            while todo:
                at, rows = todo.pop()
                normal, threshold, low, high = nodes[at]
                if normal is None:
                    out[rows, t] = at
                    continue
                left = vectors[rows] @ normal < threshold
                todo += [(n, r) for n, r in ((low, rows[left]), (high, rows[~left])) if len(r)]
        return out

    def search(self, vector: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf)s from one queue over all trees, closest branch first, until they hold ``share`` of the sample."""
        queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(len(self.trees))]
        found, held = [], 0.0
        while queue and held < share:
            distance, t, at = heapq.heappop(queue)
            normal, threshold, low, high = self.trees[t][at]
            if normal is None:
                found.append((t, at))
                held += self.share[t][at]
                continue
            side = float(vector @ normal) - threshold
            heapq.heappush(queue, (distance, t, low if side < 0 else high))
            heapq.heappush(queue, (max(distance, abs(side)), t, high if side < 0 else low))
        return found

    def share_for(self, points: np.ndarray, k: int, recall: float, queries: int = 64) -> float:
        """The share of the sample to search so that the k nearest of sampled queries within it are found with this recall.

        In a larger table the nearest are nearer than in its sample, so the same share finds no fewer of them.
        """
        if not len(points):
            return 0.0
        leaves, needed = self.leaves(points), []
        for i in np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int):
            d = ((points - points[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            held, at = 0.0, {}
            for t, leaf in self.search(points[i], math.inf):
                at[t, leaf] = held
                held += self.share[t][leaf]
            needed += [min(at[t, leaf] for t, leaf in enumerate(leaves[j].tolist())) for j in np.argsort(d, kind="stable")[: min(k, len(points) - 1)]]
        return float(np.quantile(needed, recall)) + 1e-9 if needed else 0.0


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, which are rows of vectors too.

    vectors: vec_id, embedding. queries: vec_id alone.
    """
    # -0.0 and 0.0 are one value, so that equal vectors are equal in their bytes
    rows = usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    width = head.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == width.width)
    # the k + 1 smallest ids of each distinct vector; the limit applies before the shuffle too
    first = Window.partitionBy("embedding").orderBy("vec_id")
    kept = written(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("embedding"))))
    classes = kept.where("n = 1").select("rep", "embedding")
    total = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, total) / leaf)))
    points = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toPandas().embedding  # a bounded sample
    points = np.array(points.tolist(), np.float32).reshape(-1, width.width)
    forest = Forest(points, trees, depth, max(0, math.ceil(math.log2(max(1, total) / BRANCH))))
    of = vectors.sparkSession.sparkContext.broadcast(pickle.dumps(forest))  # of the sample's size at most
    share = max(forest.share_for(points, k, recall), LEAST / max(1, total))

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = pickle.loads(of.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = trees_.leaves(matrix(batch.column("embedding")).astype(np.float32))
            row = np.arange(len(found))
            for t in range(found.shape[1]):
                of_leaf = trees_.branch[t]
                branch = np.array([of_leaf[x] for x in found[:, t].tolist()], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(branch), pa.array(found[:, t]), batch.column("rep"), batch.column("embedding")], names=["tree", "branch", "leaf", "rep", "embedding"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = pickle.loads(of.value)
        for batch in batches:
            values = matrix(batch.column("embedding")).astype(np.float32) if batch.num_rows else []
            rows_: dict[tuple[int, int, int], list[int]] = {}
            for i, v in enumerate(values):
                for t, at in trees_.search(v, share):
                    rows_.setdefault((i, t, trees_.branch[t][at]), []).append(at)
            i, t, at = (np.array(x, np.int32) for x in zip(*rows_, strict=True)) if rows_ else [np.zeros(0, np.int32)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(at), pa.array(list(rows_.values()), pa.list_(pa.int32())), batch.column("rep").take(pa.array(i)), batch.column("embedding").take(pa.array(i))], names=["tree", "branch", "leaves", "rep", "embedding"])

    def rank(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        """The k + 1 nearest to each query among a branch's leaves that it asks for."""
        out: list[list[np.ndarray]] = [[], [], []]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("leaf")
            q, qid, wanted_ = matrix(asked.column("embedding").combine_chunks()), asked.column("rep").to_numpy(), asked.column("leaves").to_pylist()
            v, vid, leaf_ = matrix(held.column("embedding").combine_chunks()), held.column("rep").to_numpy(), held.column("leaf").to_numpy()
            for i in range(len(q)):
                at = np.concatenate([np.arange(*np.searchsorted(leaf_, (x, x + 1))) for x in wanted_[i]])
                d = v[at] - q[i]
                d = np.sqrt(np.einsum("ij,ij->i", d, d))
                order = np.lexsort((vid[at], d))[: k + 1]
                for o, x in zip(out, (np.full(len(order), qid[i]), vid[at][order], d[order]), strict=True):
                    o.append(x)
        return pa.table({n: np.concatenate(x) if x else np.zeros(0, t) for n, x, t in zip(("query", "rep", "score"), out, (np.int64, np.int64, np.float64), strict=True)})

    # a query's class: queries with equal vectors are searched once
    asking = rows.join(only(queries, "vec_id").distinct(), "vec_id", "left_semi")
    classes_asked = written(asking.join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")))
    wanted = classes.join(classes_asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi")
    members = classes.mapInArrow(down, "tree int, branch int, leaf int, rep long, embedding array<double>")
    probes = wanted.select("rep", "embedding").mapInArrow(probe, "tree int, branch int, leaves array<int>, rep long, embedding array<double>")
    near = probes.groupBy("tree", "branch").cogroup(members.groupBy("tree", "branch")).applyInArrow(rank, "query long, rep long, score double")
    by_class = Window.partitionBy("query").orderBy("score", "rep")
    near = near.distinct().withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1).drop("n")
    # each class stands for its k + 1 smallest ids: the k + 1 best rows of a query, its own row among them
    near = near.join(kept.select("rep", "vec_id"), "rep").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    best = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))  # k + 1 each
    return (
        classes_asked.join(best, "query")
        .select("query_id", F.slice(F.filter("best", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("best"))
        .select("query_id", F.posexplode("best").alias("rank", "found"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "found.vec_id", "found.score")
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0).select("vec_id"))
