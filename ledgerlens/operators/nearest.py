"""Exact nearest neighbours: all rows against all by pivots, and a stated set of queries by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import kept
from .ranks import with_places

#: Pivots at most; rows of a block of vectors; room for the rounding of distances in bounds.
PIVOTS, BLOCK, SLACK = 1024, 1024, 1e-9
#: Shards into which the blocks, and deals into which their visitors, are put; numbers that the vectors of either hold at most.
SHARDS, NUMBERS = 8, 1 << 22
#: Queries and rows of a tile of the cosine search; numbers multiplied exactly at once.
TILE, PAIRS = 512, 1 << 20
FOUND = "query_id long, vec_id long, distance double"


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(q rows, v rows) of differences squared and summed: no cancellation."""
    out = np.empty((len(q), len(v)))
    for at in range(0, len(q), 8):
        out[at : at + 8] = ((q[at : at + 8, None, :] - v[None]) ** 2).sum(axis=2)
    return np.sqrt(out)


def nearest(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int, most: np.ndarray | None = None) -> pa.Table:
    """The k nearest of v for each row of q other than itself (ties to the smaller id), no farther than ``most``.

    A product of matrices tells which may be among them, with room for its rounding; their distances are then taken exactly.
    """
    rows, found, far = [], [], []
    size = (v * v).sum(axis=1)
    for at in range(0, len(q), 256):
        some = q[at : at + 256]
        own = (some * some).sum(axis=1)[:, None]
        rough = own + size[None] - 2 * (some @ v.T)
        room = 1e-13 * (own[:, 0] + size.max(initial=0.0)) * max(1, q.shape[1])
        rough[q_id[at : at + 256, None] == v_id[None]] = np.inf
        bound = np.full(len(some), np.inf) if most is None else most[at : at + 256] ** 2
        if len(v) > k:
            bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((rough <= (bound + 2 * room)[:, None]) & np.isfinite(rough))
        d = np.sqrt(((some[i] - v[j]) ** 2).sum(axis=1))
        if most is not None:
            near = d <= most[at + i]
            i, j, d = i[near], j[near], d[near]
        order = np.lexsort((v_id[j], d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        rows.append(q_id[at + i[place < k]])
        found.append(v_id[j[place < k]])
        far.append(d[place < k])
    return pa.table({"query_id": pa.array(np.concatenate(rows or [np.zeros(0, np.int64)]), pa.int64()), "vec_id": pa.array(np.concatenate(found or [np.zeros(0, np.int64)]), pa.int64()), "distance": pa.array(np.concatenate(far or [np.zeros(0)]), pa.float64())})


def of_each(found: pa.Table, k: int) -> pa.Table:
    """The k nearest of each query, of what nearest() gave for it in parts."""
    q, v, d = (found.column(c).to_numpy() for c in ("query_id", "vec_id", "distance"))
    order = np.lexsort((v, d, q))
    ordered = q[order]
    return found.take(pa.array(order[np.arange(len(q)) - np.searchsorted(ordered, ordered) < k]))


class Neighbours:
    """All rows' k nearest (Euclidean), without all pairs.

    Every vector goes to its nearest pivot's cell; a cell's rows, in the order of their distance to the pivot, are cut
    into blocks of ``block`` rows, so that dense cells and copies make many blocks. A row's k nearest within its own block bound
    how far the others may be. It then visits the blocks that the triangle inequality doesn't rule out: those whose range of distances to
    their pivot comes that near to its own distance to that pivot. Blocks travel in shards of many: a row goes once to each shard
    of which it visits blocks, with their numbers, and each shard meets its visitors in a few deals. So a vector is sent SHARDS
    times on either side, and more often only where a shard would hold more than NUMBERS numbers.
    The driver holds the pivots and a few numbers a block.
    """

    def __init__(self, vectors: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK):
        self.k, self.block = k, block
        rows = kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null"))
        self.spark, n = rows.sparkSession, rows.count()
        wanted = max(1, min(pivots, int(n**0.5)))
        chosen = np.array([r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()], np.float64)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances(matrix(batch.column("embedding")), chosen)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["vec_id", "embedding", "cell", "near"])

        assigned = rows.mapInArrow(assign, "vec_id long, embedding array<double>, cell int, near double")
        number = F.floor((F.col("so_far") - 1) / block).cast("int")
        self.rows = kept(with_places(assigned, ["cell"], "near", "vec_id").select("vec_id", "embedding", "cell", number.alias("part"), "near"))
        self.blocks = self.rows.groupBy("cell", "part").agg(F.min("near").alias("least"), F.max("near").alias("most"), F.count(F.lit(1)).alias("n")).orderBy("cell", "part").toPandas()

        def within(rows: pa.Table) -> pa.Table:
            ids, v = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks())
            return nearest(ids, v, ids, v, k)

        self.own = kept(self.dealt(self.rows, ["cell", "part"]).groupBy("cell", "part").applyInArrow(within, FOUND))
        size = int(max(block, min(-(-n // SHARDS), NUMBERS // max(1, chosen.shape[-1] if chosen.size else 1))))
        before = self.blocks["n"].cumsum() - self.blocks["n"]
        self.blocks["shard"] = (before // size).astype("int32")
        self.deals = max(1, -(-n // size))
        self.visits = self._routed(chosen)

    def dealt(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """By the keys to a number of partitions that stays: blocks are few bytes and much work, so small ones aren't put together."""
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return rows.repartition(n, *keys)

    def _routed(self, chosen: np.ndarray) -> DataFrame:
        """(shard, query_id, q, bound, blocks) for each shard with blocks that a row has to visit besides its own; blocks: their numbers."""
        k, blocks = self.k, self.blocks
        bounds = self.own.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "bound")
        rows = self.dealt(self.rows.join(bounds, "vec_id", "left"), ["vec_id"])
        cell, part, least, most, size, shard = (blocks[c].to_numpy() for c in ("cell", "part", "least", "most", "n", "shard"))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    d = distances(matrix(batch.column("embedding")), chosen)
                    bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
                    to = d[:, cell]
                    for i in np.flatnonzero(np.isnan(bound)):  # too few rows in its block: k + 1 rows are this near at least
                        far = to[i] + most
                        order = np.argsort(far)
                        enough = np.searchsorted(np.cumsum(size[order]), k + 1)
                        bound[i] = far[order[enough]] if enough < len(order) else np.inf
                    bound = bound * (1 + SLACK) + SLACK
                    meets = (to - most <= bound[:, None]) & (least - to <= bound[:, None])
                    meets &= (cell != batch.column("cell").to_numpy()[:, None]) | (part != batch.column("part").to_numpy()[:, None])
                    i, j = np.nonzero(meets)  # by row, then by block, whose shards ascend
                    first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (shard[j[1:]] != shard[j[:-1]]))) if len(i) else i
                    pick, ends = pa.array(i[first]), pa.array(np.append(first, len(j)), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(shard[j[first]], pa.int32()), batch.column("vec_id").take(pick), batch.column("embedding").take(pick), pa.array(bound[i[first]]), pa.ListArray.from_arrays(ends, pa.array(j, pa.int32()))], names=["shard", "query_id", "q", "bound", "blocks"])

        return rows.select("vec_id", "embedding", "cell", "part", "bound").mapInArrow(route, "shard int, query_id long, q array<double>, bound double, blocks array<int>")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """rows with the block's number and shard."""
        blocks = self.spark.createDataFrame(list(zip(*(self.blocks[c].tolist() for c in ("cell", "part", "shard")), range(len(self.blocks)), strict=True)), "cell int, part int, shard int, number int")
        return rows.join(F.broadcast(blocks), ["cell", "part"])  # a few numbers a block

    def compared(self) -> int:
        """Pairs of a row and a row of a block that it meets, its own included."""
        sizes = self._numbered(self.rows).groupBy("number").count()
        met = self.visits.select(F.explode("blocks").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("m")).join(sizes, "number").agg(F.sum(F.col("m") * F.col("count"))).first()[0]
        return int(met or 0) + int(sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0)

    def table(self) -> DataFrame:
        """(query_id, vec_id, distance, rank), nearest first, ties to the smaller id."""
        asked = self.visits.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(self.deals)).cast("int"))
        held = self._numbered(self.rows).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(self.deals - 1))))
        k = self.k

        def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
            if not len(queries) or not len(rows):
                return nearest(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros((0, 1)), k)
            q_id, q, bound = queries.column("query_id").to_numpy(), matrix(queries.column("q").combine_chunks()), queries.column("bound").to_numpy()
            visited = queries.column("blocks").combine_chunks()
            visitor, to = np.repeat(np.arange(len(q_id)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
            visitor, to = (x[np.argsort(to, kind="stable")] for x in (visitor, to))
            number = rows.column("number").to_numpy()
            order = np.argsort(number, kind="stable")
            number, v_id, v = number[order], rows.column("vec_id").to_numpy()[order], matrix(rows.column("embedding").combine_chunks())[order]
            best, found = bound.copy(), [nearest(q_id[:0], q[:0], v_id[:0], v[:0], k)]
            for block in np.unique(to):
                who, some = visitor[slice(*np.searchsorted(to, (block, block + 1)))], slice(*np.searchsorted(number, (block, block + 1)))
                near = nearest(q_id[who], q[who], v_id[some], v[some], k, best[who])
                found.append(near)
                # rows of a query stand together: the k-th of a block bounds those of the next
                ids, far = near.column("query_id").to_numpy(), near.column("distance").to_numpy()
                full = np.flatnonzero(ids[k - 1 :] == ids[: len(ids) - k + 1]) if len(ids) >= k else np.zeros(0, np.int64)
                by_id = np.argsort(q_id[who], kind="stable")
                at = who[by_id][np.searchsorted(q_id[who][by_id], ids[full])]
                best[at] = np.minimum(best[at], far[full + k - 1])
            return of_each(pa.concat_tables(found), k)

        keys = ["shard", "deal"]
        asked = self.dealt(asked.select(*keys, "query_id", "q", "bound", "blocks"), keys)
        held = self.dealt(held.select(*[F.col(c).alias(f"_{c}") for c in keys], "number", "vec_id", "embedding"), [f"_{c}" for c in keys])
        other = asked.groupBy(*keys).cogroup(held.groupBy(*[f"_{c}" for c in keys])).applyInArrow(meet, FOUND)
        return best_of(self.own.unionByName(other), "query_id", [F.col("distance"), F.col("vec_id")], k, "rank")


def best_of(rows: DataFrame, by: str, order: list, k: int, name: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)  # k of each task's


class Best:
    """The k best (score, smaller id at ties) of each query of a block, as arrays that candidates are merged into."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.i, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(queries, -np.inf)

    def merge(self, i: np.ndarray, number: np.ndarray, score: np.ndarray) -> None:
        i, number, score = np.concatenate([self.i, i]), np.concatenate([self.id, number]), np.concatenate([self.score, score])
        order = np.lexsort((number, -score, i))
        i, number, score = i[order], number[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        self.i, self.id, self.score = (x[place < self.k] for x in (i, number, score))
        self.floor[i[place == self.k - 1]] = score[place == self.k - 1]


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, least: float | None = None, where: str | None = None, block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, place): the exact cosine top k of a stated set of queries against the vectors.

    queries: query_id, q. vectors: vec_id, v, and what the filter ``where`` reads, which reaches the scan. Queries go through the
    vectors ``block`` at a time, with their norms; a task multiplies ``TILE`` queries with as many rows of an Arrow batch at once and
    keeps the best k a query, so it holds a tile, PAIRS numbers of exact sums and queries x k rows, whatever it read. A zero vector has score 0.
    """
    rows = (vectors.where(where) if where else vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")).where("query_id is not null and q is not null")
    parts = max(1, -(-asked.count() // block))
    found = None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()  # about ``block`` rows
        if not some and (found is not None or part < parts - 1):
            continue
        ids = np.array([r.query_id for r in some], np.int64)
        q = np.array([r.q for r in some], np.float64) if some else np.zeros((0, 0))
        of = asked.sparkSession.sparkContext.broadcast((ids, q, np.sqrt((q * q).sum(axis=1))))

        def multiply(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            ids, q, norms = of.value
            tiles = range(0, len(ids), TILE)
            best = [Best(len(ids[a : a + TILE]), k) for a in tiles]
            for whole in batches if len(ids) else ():
                for at in range(0, whole.num_rows, TILE):
                    batch = whole.slice(at, TILE)
                    v, v_id = matrix(batch.column("v")), batch.column("vec_id").to_numpy()
                    far = np.sqrt((v * v).sum(axis=1))
                    for a, top in zip(tiles, best, strict=True):
                        tile(ids[a : a + TILE], q[a : a + TILE], norms[a : a + TILE], v_id, v, far, top, least)
            for a, top in zip(tiles, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + top.i]), pa.array(top.id), pa.array(top.score)], names=["query_id", "vec_id", "score"])

        one = rows.mapInArrow(multiply, "query_id long, vec_id long, score double")
        found = one if found is None else found.unionByName(one)
    return best_of(found, "query_id", [F.desc("score"), F.col("vec_id")], k, "place")


def tile(ids: np.ndarray, q: np.ndarray, norms: np.ndarray, v_id: np.ndarray, v: np.ndarray, far: np.ndarray, top: Best, least: float | None) -> None:
    """Merges a tile of queries and rows into the best found. A product of matrices tells which pairs may be among the best k; only
    their scores are summed exactly, PAIRS numbers at a time."""
    size = norms[:, None] * far[None]
    score = np.divide(q @ v.T, size, out=np.zeros_like(size), where=size > 0)
    score[np.isnan(score) | (ids[:, None] == v_id[None])] = -np.inf
    if least is not None:
        score[score < least] = -np.inf
    floor = top.floor
    if len(v_id) > top.k:
        floor = np.maximum(floor, np.partition(score, -top.k, axis=1)[:, -top.k] - SLACK)
    i, j = np.nonzero((score >= floor[:, None] - SLACK) & (score > -np.inf))
    step = max(1, PAIRS // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        i_, j_ = i[at : at + step], j[at : at + step]
        # summed in one order whatever the batch, so that equal vectors tie
        exact = (q[i_] * v[j_]).sum(axis=1) / np.where(size[i_, j_] > 0, size[i_, j_], 1.0)
        top.merge(i_, v_id[j_], exact)
