"""Operator 12: whitening of embeddings by the singular values of their centred rows.

Entries become whole numbers, so that counts and sums are exact. Tasks reduce their centred rows to a triangle, block by
block, by QR; triangles are reduced in groups of FAN until few are left. What reaches the driver is one triangle of
(dimensions)^2 numbers, whatever the rows. There Householder reflections make it bidiagonal, dqds finds the squares of
its singular values to high relative accuracy, from the least on, and a twisted factorisation for each gives its vector.
A further pass measures the covariance of the whitened rows, which is the identity but for rounding.

Defined results: rows whose vector is null, or holds null or non-finite entries, or entries beyond 2^55 take no part; of
vectors of several lengths only those of the commonest do (ties: the shorter). Rows aren't merged: repeated rows count
each, and null vec_ids stay null. A component without variance (eigenvalue below rounding: constant or dependent
dimensions, a single row) has whitened null and takes no part in identity_error, which is null where no component has
variance, as explained is where the trace is zero. A deviation beyond a long is null. Ties of eigenvalues get orthogonal
vectors of their common space. An empty table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, only, table, written

COMPONENTS = 32
#: x = floor(SCALE * c) + SHIFT for an entry c.
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block of QR; partial results that are merged together.
ROWS, FAN = 2048, 32
EPS = float(np.finfo(float).eps)
#: Eigenvalues whose relative distance is less than this share a space, whose vectors are made orthogonal.
CLUSTER = 1e-6


def householder(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, head): I - 2 v v' takes x to head times the first unit vector; v has length 1, or is zero where nothing is to do."""
    size = np.abs(x).max(initial=0.0)
    if not size or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    v = x / size
    norm = np.sqrt(v @ v)
    head = -norm if v[0] > 0 else norm
    v[0] -= head
    return v / np.sqrt(v @ v), float(head * size)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with U' r V upper bidiagonal for some orthogonal U."""
    r = r.copy()
    d = len(r)
    right, a, b = np.eye(d), np.zeros(d), np.zeros(max(d - 1, 0))
    for k in range(d):
        v, a[k] = householder(r[k:, k].copy())
        r[k:, k + 1 :] -= 2 * np.outer(v, v @ r[k:, k + 1 :])
        if k < d - 1:
            v, b[k] = householder(r[k, k + 1 :].copy())
            r[k + 1 :, k + 1 :] -= 2 * np.outer(r[k + 1 :, k + 1 :] @ v, v)
            right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return a, b, right


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squared singular values of an upper bidiagonal matrix, falling.

    Differential quotient-difference steps with shifts (Fernando and Parlett 1994) on the squares. The shift is the reciprocal of the
    trace of the inverse: a Newton step from zero, never beyond the least value but for rounding.
    """
    found: list[float] = []
    waiting = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while waiting:
        q, e, sigma = waiting.pop()
        steps = 0
        while len(q) > 1:
            n = len(q)
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS**2 * max(q[i], sigma) or e[i] <= EPS**2 * q[i + 1]), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            inverse = trace = 1 / q[-1] if q[-1] else np.inf
            for i in range(n - 2, -1, -1):
                inverse = (1 + e[i] * inverse) / q[i] if q[i] else np.inf
                trace += inverse
            shift = (1 - 4 * n * EPS) / trace
            while (step := quotient_difference(q, e, shift)) is None:
                shift = shift / 4 if shift > EPS * q[-1] else 0.0
            q, e = step
            sigma += shift
            steps += 1
            if steps > 200 * n:
                raise ArithmeticError("singular values didn't converge")
        found += [x + sigma for x in q]
    return np.array(sorted(found, reverse=True))


def quotient_difference(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step; None where the shift was too large."""
    d, new_q, new_e = q[0] - shift, [], []
    for here, after in zip(e, q[1:], strict=True):
        if d < 0:
            return None
        sum_ = d + here
        ratio = after / sum_
        new_q.append(sum_)
        new_e.append(here * ratio)
        d = d * ratio - shift
    return (new_q + [d], new_e) if d >= 0 else None


class Shifted:
    """B'B - value for an upper bidiagonal B, factored from above (L D L') and from below (U D U')."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n, q, e, cross = len(a), (a * a).tolist(), (b * b).tolist(), (a[:-1] * b).tolist()
        tiny = EPS * max(EPS * max(q + e), np.finfo(float).tiny / EPS)
        self.lower, self.upper, self.pivots = [0.0] * (n - 1), [0.0] * (n - 1), [0.0] * n
        s, p = [-value] * n, [q[-1] - value] * n
        for i in range(n - 1):
            self.pivots[i] = s[i] + q[i] or tiny
            self.lower[i] = cross[i] / self.pivots[i]
            s[i + 1] = e[i] * (s[i] / self.pivots[i]) - value
        self.pivots[-1] = s[-1] + q[-1] or tiny
        for i in range(n - 2, -1, -1):
            pivot = e[i] + p[i + 1] or tiny
            self.upper[i] = cross[i] / pivot
            p[i] = p[i + 1] * (q[i] / pivot) - value
        twist = np.abs(np.array(s) + np.array(p) + value)
        self.at = int(np.argmin(np.where(np.isfinite(twist), twist, np.inf)))

    def vector(self) -> np.ndarray:
        """The twisted factorisation's vector: 1 where the twist is, the rest by one multiplication each."""
        z = np.zeros(len(self.pivots))
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.lower[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.upper[i] * z[i]
        return z / np.sqrt(z @ z)

    def solve(self, y: np.ndarray) -> np.ndarray:
        x = y.copy()
        for i in range(len(x) - 1):
            x[i + 1] -= self.lower[i] * x[i]
        x /= self.pivots
        for i in range(len(x) - 2, -1, -1):
            x[i] -= self.lower[i] * x[i + 1]
        return x


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthogonal unit eigenvectors (as columns) of B'B for its leading eigenvalues, in order."""
    out = np.zeros((len(a), len(values)))
    start = np.random.Generator(np.random.PCG64(5))
    first = 0
    for k, value in enumerate(values.tolist()):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        shifted = Shifted(a, b, value)
        z = shifted.vector()
        near = out[:, first:k]
        for _ in range(8):
            left = z - near @ (near.T @ z)
            left -= near @ (near.T @ left)
            norm = np.sqrt(left @ left)
            if np.isfinite(norm) and norm > 0.5:
                break
            # it lies in the space of the cluster's earlier vectors: inverse iteration away from them
            z = start.standard_normal(len(a))
            for _ in range(3):
                z -= near @ (near.T @ z)
                z = shifted.solve(z / np.abs(z).max())
            z /= np.sqrt(z @ z)
        out[:, k] = left / norm
    return out


def eigen(r: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(all eigenvalues of r'r, falling; the eigenvectors of the first ``most``, as columns) of a triangle r."""
    scale = np.abs(r).max(initial=0.0) or 1.0
    a, b, right = bidiagonal(r / scale)
    values = dqds(a, b)
    values[values <= len(r) * (EPS * np.sqrt(values[0])) ** 2 * len(r)] = 0.0
    usable = int(np.count_nonzero(values[:most]))
    return values * scale**2, right @ right_vectors(a, b, values[:usable])


def held_vectors(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part and have this length, or any for -1; their entries; their lengths)."""
    column = batch.column("embedding")
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    bad = np.zeros(len(lengths), bool)
    bad[row[~(np.abs(values) < 2.0**55)]] = True
    keep = (lengths > 0) & ~bad if length < 0 else (lengths == length) & ~bad
    return np.flatnonzero(keep), values[keep[row]], lengths[keep]


def whole_numbers(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


class Centre:
    """n rows with the sums S of their whole numbers x: n * x - S without rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.largest = max(map(abs, sums), default=0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python's whole numbers where a long may not hold it or its squares' sum."""
        most = self.n * (int(np.abs(x).max(initial=0))) + self.largest
        if most < 2**62:
            y = self.n * x - np.array(self.sums, np.int64)
            most = int(np.abs(y).max(initial=0))
            if most * most * x.shape[1] < 2**63:
                return y
        return self.n * x.astype(object) - np.array(self.sums, object)

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of the batch, deviations, x - S / n) of those that take part, some at a time."""
        d = len(self.sums)
        for at in range(0, batch.num_rows, ROWS):
            row, values, _ = held_vectors(batch.slice(at, ROWS), d)
            y = self.deviations(whole_numbers(values.reshape(-1, d)))
            yield at + row, y, (y / self.n).astype(float)


def merged_tree(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """What ``merge`` makes of all rows' data (part long, data binary), FAN at a time; the driver holds FAN of them at most."""

    def together(rows: pa.Table) -> pa.Table:
        return pa.table({"part": [rows.column("part")[0].as_py() // FAN], "data": pa.array([merge(rows.sort_by("part").column("data").to_pylist())], pa.binary())})

    parts = written(parts)
    while (highest := parts.agg(F.max("part")).first()[0]) is not None and highest >= FAN:
        before, parts = parts, written(parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(together, "part long, data binary"))
        deleted(before)
    found = [bytes(r.data) for r in parts.orderBy("part").collect()]
    deleted(parts)
    return merge(found) if found else None


def partial(data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([data], pa.binary())], names=["part", "data"])


def centre_of(rows: DataFrame) -> Centre | None:
    """Counts and exact sums of the vectors of the commonest length; None where no vector takes part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                _, values, lengths = held_vectors(batch.slice(at, ROWS), -1)
                of = np.repeat(lengths, lengths)
                for d in np.unique(lengths).tolist():
                    x = whole_numbers(values[of == d].reshape(-1, d))
                    n[d] = n.get(d, 0) + len(x)
                    # two halves, so that no sum of a task leaves a long
                    sums[d] = sums.get(d, 0) + np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        for d, s in sums.items():
            columns = [np.full(d, d), np.arange(d), np.full(d, n[d]), s[0], s[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "place", "n", "high", "low"])

    whole = "decimal(38,0)"
    found = written(rows.mapInArrow(count, "d long, place long, n long, high long, low long").groupBy("d", "place").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast(whole)).cast(whole).alias(c) for c in ("high", "low"))))
    common = found.where("place = 0").orderBy(F.desc("n"), "d").first()
    if common is None:
        return None
    sums = [(int(r.high) << 32) + int(r.low) for r in found.where(F.col("d") == common.d).orderBy("place").collect()]  # one number for each dimension
    return Centre(common.n, sums)


def triangle_of(rows: DataFrame, centre: Centre) -> np.ndarray:
    """R of a QR decomposition of the centred rows."""
    d = len(centre.sums)

    def merge(found: list[bytes]) -> bytes:
        r = np.zeros((0, d))
        for data in found:
            r = np.linalg.qr(np.concatenate([r, np.frombuffer(data).reshape(-1, d)]), mode="r")
        return r.tobytes()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, _, x in centre.rows(batch):
                r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        yield partial(r.tobytes())

    r = np.frombuffer(merged_tree(rows.mapInArrow(reduce, "part long, data binary"), merge)).reshape(-1, d)
    return np.concatenate([r, np.zeros((d - len(r), d))])


def identity_error_of(rows: DataFrame, centre: Centre, directions: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from a pass over them."""
    k = directions.shape[1]
    if not k:
        return None

    def merge(found: list[bytes]) -> bytes:
        n, mean, squares = 0.0, np.zeros(k), np.zeros((k, k))
        for data in found:
            x = np.frombuffer(data)
            if not x[0]:
                continue
            step, both = x[1 : k + 1] - mean, n + x[0]
            squares = squares + x[k + 1 :].reshape(k, k) + np.outer(step, step) * (n * x[0] / both)
            n, mean = both, mean + step * (x[0] / both)
        return np.concatenate([[n], mean, squares.ravel()]).tobytes()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for _, _, x in centre.rows(batch):
                if len(x):
                    w = x @ directions
                    mean = w.mean(axis=0)
                    found.append(np.concatenate([[float(len(w))], mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes())
            found = [merge(found)]
        yield partial(merge(found))

    x = np.frombuffer(merged_tree(rows.mapInArrow(moments, "part long, data binary"), merge))
    return float(np.abs(x[k + 1 :].reshape(k, k) / x[0] - np.eye(k)).max())


def whitened(table_: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component. table_: vec_id, embedding."""
    rows = only(table_, "vec_id", "embedding").withColumn("vec_id", F.expr("try_cast(vec_id AS long)"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    centre = centre_of(rows)
    if centre is None:
        return rows.sparkSession.createDataFrame([], schema)
    values, vectors = eigen(triangle_of(rows, centre), most)
    values = values / centre.n
    k, usable = min(most, len(values)), vectors.shape[1]
    trace = float(values.sum())
    explained = pa.array((values[:k] / trace).tolist() if trace else [None] * k, pa.float64())
    directions = vectors / np.sqrt(values[:usable])
    error = identity_error_of(rows, centre, directions)
    of = rows.sparkSession.sparkContext.broadcast((centre, directions))  # dimensions times ``most`` numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, directions = of.value
        for batch in batches:
            for row, y, x in centre.rows(batch):
                squares = (y * y).sum(axis=1)
                deviation = pa.array(squares) if squares.dtype != object else pa.array([s if s < 2**63 else None for s in squares], pa.int64())
                w = np.full((len(row), k), np.nan)
                w[:, :usable] = x @ directions
                pick = pa.array(np.repeat(np.arange(len(row)), k))
                tiled = pa.array(np.tile(np.arange(k), len(row)))
                size = len(row) * k
                columns = [batch.column("vec_id").take(pa.array(row)).take(pick), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(row))), pa.array(np.full(size, centre.n)), deviation.take(pick)]
                columns += [pa.array(w.ravel(), from_pandas=True), explained.take(tiled), pa.array([error], pa.float64()).take(pa.array(np.zeros(size, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
