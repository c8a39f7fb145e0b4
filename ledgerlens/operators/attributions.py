"""Shapley values of path lengths in isolation trees, for batches of rows.

A leaf's length counts towards a set of known features by the product of two kinds of factors over the features on its
path: 1 or 0 (the row meets the leaf's bounds of a known feature or not), and the share of the tree's sample that goes
towards the leaf (unknown). The Shapley weight of a set of k among d - 1 others is the integral of t^k (1 - t)^(d - 1 - k)
from 0 to 1, so the sum over all sets is the integral of a product of d - 1 linear factors: a polynomial, which
Gauss-Legendre points give exactly. It depends on the row only by which bounds it meets; so it is found once for each
leaf and pattern that occurs, and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Rows that are handled at a time, and patterns up to which a flag each is held.
ROWS, FLAGS = 1024, 1 << 22


class Paths:
    """The leaves of a tree with their bounds of each feature. nodes: (feature or -1, cut, left, right, length at a leaf, rows)."""

    def __init__(self, nodes: np.ndarray):
        leaves: list[tuple[float, dict[int, tuple[float, float, float]]]] = []
        waiting: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while waiting:
            at, met = waiting.pop()
            feature, cut, left, right, length, rows = nodes[at]
            if feature < 0:
                leaves.append((float(length), met))
                continue
            low, high, share = met.get(int(feature), (-np.inf, np.inf, 1.0))
            for child, bounds in ((int(left), (low, min(high, cut))), (int(right), (max(low, cut), high))):
                waiting.append((child, met | {int(feature): (*bounds, share * nodes[child][5] / rows)}))
        self.length = np.array([length for length, _ in leaves])
        self.slots = max(len(met) for _, met in leaves)
        self.share = np.ones((len(leaves), self.slots))
        # slots that a leaf doesn't use count as met, so that their factor is 1
        start = np.array([(i << self.slots) + (1 << self.slots) - (1 << len(met)) for i, (_, met) in enumerate(leaves)])
        self.start = start.astype(np.int32 if len(leaves) << self.slots < 1 << 31 else np.int64)
        found: dict[int, list[tuple[int, int, float, float]]] = {}
        for i, (_, met) in enumerate(leaves):
            for slot, (feature, (low, high, share)) in enumerate(met.items()):
                self.share[i, slot] = share
                found.setdefault(feature, []).append((i, slot, low, high))
        self.bounds = {f: (np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.array([x[2] for x in held]), np.array([x[3] for x in held])) for f, held in found.items()}
        point, weight = np.polynomial.legendre.leggauss(max(1, (self.slots + 1) // 2))
        self.point, self.weight = (point + 1) / 2, weight / 2

    @property
    def mean(self) -> float:
        """The mean length over the tree's sample."""
        return float(self.length @ self.share.prod(axis=1))

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """(leaves, rows): the leaf's number before a bit for each slot, set where the row meets the bounds."""
        out = np.repeat(self.start[:, None], len(x), axis=1)
        for feature, (leaf, slot, low, high) in self.bounds.items():
            value = x[:, feature]
            out[leaf] += ((value >= low[:, None]) & (value < high[:, None])).astype(out.dtype) << slot.astype(out.dtype)[:, None]
        return out

    def credits(self, pattern: np.ndarray) -> np.ndarray:
        """(patterns, slots): what each slot's feature adds to the leaf's length."""
        leaf, slot = pattern >> self.slots, np.arange(self.slots)
        known, share = (pattern[:, None] >> slot & 1).astype(float), self.share[leaf]
        others = np.ones((len(pattern), self.slots))
        out = np.zeros_like(others)
        for point, weight in zip(self.point, self.weight, strict=True):
            factor = share * (1 - point) + known * point
            before, after = np.ones_like(factor), np.ones_like(factor)
            np.cumprod(factor[:, :-1], axis=1, out=before[:, 1:])
            np.cumprod(factor[:, :0:-1], axis=1, out=after[:, -2::-1])
            out += weight * before * after
        return self.length[leaf, None] * (known - share) * out

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): the Shapley values of each row's path length."""
        out = np.zeros(x.shape)
        if not self.slots:
            return out
        pattern = self.patterns(x)
        size = len(self.length) << self.slots
        if size <= FLAGS:
            there = np.zeros(size, bool)
            there[pattern.ravel()] = True
            distinct = np.flatnonzero(there)
            place = np.take(np.cumsum(there, dtype=pattern.dtype) - 1, pattern)
        else:
            distinct, place = np.unique(pattern, return_inverse=True)
            place = place.reshape(pattern.shape).astype(pattern.dtype)
        credit = self.credits(distinct).ravel()
        place *= self.slots
        for feature, (leaf, slot, _, _) in self.bounds.items():
            out[:, feature] = np.take(credit, place[leaf] + slot.astype(place.dtype)[:, None]).sum(axis=0)
        return out


def attributed(df: DataFrame, trees: list[np.ndarray], columns: list[str], key: str) -> DataFrame:
    """(key, attribution of each column, path_length, mean_path_length): the attributions sum to the difference of the last two.

    trees: of a fixed size, whatever the rows. Missing values count as 0, as in the trees' samples.
    """
    of = df.sparkSession.sparkContext.broadcast(trees)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths = [Paths(nodes) for nodes in of.value]
        mean = float(np.mean([p.mean for p in paths]))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x = np.nan_to_num(part[columns].to_numpy(np.float64))
                values = sum(p.values(x) for p in paths) / len(paths)
                out = pd.DataFrame({key: part[key].to_numpy()})
                for i, c in enumerate(columns):
                    out[f"attribution_{c}"] = values[:, i]
                yield out.assign(path_length=mean + values.sum(axis=1), mean_path_length=mean)

    fields = ", ".join([f"{key} {dict(df.dtypes)[key]}", *[f"attribution_{c} double" for c in columns], "path_length double", "mean_path_length double"])
    # a row costs some milliseconds: few large files would leave most cores idle
    rows = df.select(key, *[df[c].cast("double").alias(c) for c in columns]).repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
    return rows.mapInPandas(attribute, fields)
