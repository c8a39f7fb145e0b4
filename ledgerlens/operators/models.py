"""Anomaly models: isolation forest, COPOD, local outlier factor, tail probabilities, principal components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from .attributions import attributed
from .benchmarks import frac_rank_global
from .ranks import numbered, quantile_columns, with_places

TREES, SAMPLE, SEED = 200, 256, 42


def mean_depth(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, depth: int, limit: int, random: np.random.Generator, nodes: list[list[float]]) -> int:
    """nodes: feature (-1 at a leaf), threshold, left, right, path length at a leaf, rows of the sample."""
    at = len(nodes)
    nodes.append([-1.0, 0.0, -1.0, -1.0, depth + mean_depth(len(x)), float(len(x))])
    if depth < limit and len(x) > 1:
        low, high = x.min(axis=0), x.max(axis=0)
        open_ = np.flatnonzero(high > low)
        if len(open_):
            f = int(random.choice(open_))
            cut = float(random.uniform(low[f], high[f]))
            left = x[:, f] < cut
            a, b = _grow(x[left], depth + 1, limit, random, nodes), _grow(x[~left], depth + 1, limit, random, nodes)
            nodes[at] = [float(f), cut, float(a), float(b), 0.0, float(len(x))]
    return at


def iforest_fit(df: DataFrame, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED, key: str = "hcp_id") -> DataFrame:
    """(tree, nodes): each tree from its own rows, those of the least hash of (key, tree), one group of ``sample`` rows a tree.

    A row is a candidate of a tree with a probability that leaves a few times ``sample`` rows, so the table isn't sorted.
    """
    n = df.count()
    share = min(1.0, 4.0 * sample / max(1, n))
    below = int(share * 2**62)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftrightunsigned(F.xxhash64(F.col(key), t, F.lit(seed)), 2) < below)
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.explode(drawn).alias("tree"))
    rows = rows.withColumn("h", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("tree").orderBy("h", key))).where(F.col("i") <= sample)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h"])
        x, nodes = np.array(part["x"].tolist(), np.float64), []
        tree = int(part["tree"].iloc[0])
        _grow(np.nan_to_num(x), 0, math.ceil(math.log2(sample)), np.random.Generator(np.random.PCG64([seed, tree])), nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [[list(map(float, r)) for r in nodes]]})

    return rows.select("tree", "h", "x").groupBy("tree").applyInPandas(build, "tree int, nodes array<array<double>>")


def iforest_score(df: DataFrame, model: DataFrame, columns: list[str], sample: int = SAMPLE, key: str = "hcp_id") -> DataFrame:
    """(key, Shapley value of each feature for the path length, path_length, mean_path_length, score).

    The model has a fixed size: trees of 2 * sample nodes at most. A negative attribution shortens the path: it makes the row stand out.
    """
    trees = [np.array(r.nodes) for r in model.orderBy("tree").collect()]
    return attributed(df, trees, columns, key).withColumn("score", F.pow(F.lit(2.0), -F.col("path_length") / mean_depth(sample)))


def iforest_label(scores: DataFrame, contamination: float = 0.10) -> DataFrame:
    """raw (negative: outlier, against the quantile of the contamination), is_outlier, anomaly_score 0-100, percentile."""
    from .scoring import minmax_100

    scores = numbered(scores)
    offset = quantile_columns(scores.select((-F.col("score")).alias("negative")), {"offset": ("negative", contamination)})
    rows = scores.crossJoin(F.broadcast(offset)).withColumn("raw", -F.col("score") - F.col("offset")).drop("offset").withColumns({"is_outlier": F.col("raw") < 0, "negative_raw": -F.col("raw")})  # one row
    return frac_rank_global(minmax_100(rows, "negative_raw", "anomaly_score"), "anomaly_score", "anomaly_percentile").drop("negative_raw")


def _long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(key, columns, "feature", "x")


def tail_probs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, feature, tail): min(F, 1 - F) of the empirical distribution, ties in the order of the key."""
    f = F.col("so_far") / F.col("total")
    return with_places(_long(df, key, columns), ["feature"], "x", key).select(key, "feature", F.least(f, 1 - f).alias("tail"))


def copod(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Copula-based outlier score: the sum over features of the larger of the skew-corrected and the mean tail."""
    long = kept(_long(df, key, columns))
    n = F.col("total")
    rows = with_places(long, ["feature"], "x", key).select(key, "feature", (-F.log((F.col("below") + F.col("same")) / n)).alias("left"), (-F.log((n - F.col("below")) / n)).alias("right"))
    skew = long.groupBy("feature").agg(F.skewness("x").alias("skew"))
    rows = rows.join(F.broadcast(skew), "feature")  # a row for each feature
    one: Column = F.when(F.col("skew") < 0, F.col("left")).when(F.col("skew") > 0, F.col("right")).otherwise(F.col("left") + F.col("right"))
    return rows.groupBy(key).agg(F.sum(F.greatest(one, (F.col("left") + F.col("right")) / 2)).alias("copod_score"))


def lof(neighbours: DataFrame) -> DataFrame:
    """Local outlier factor from a table of nearest neighbours (query_id, rank, vec_id, distance), every row with all its own.

    The neighbours come from an exact or approximate search, so nothing here is quadratic.
    """
    reach_of = neighbours.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("distance").alias("k_distance"))
    reach = neighbours.join(reach_of, "vec_id").withColumn("reach", F.greatest("k_distance", "distance"))
    density = reach.groupBy("query_id").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = density.select(F.col("query_id").alias("vec_id"), F.col("lrd").alias("other"))
    return neighbours.join(other, "vec_id").groupBy("query_id").agg(F.avg("other").alias("mean_other")).join(density, "query_id").select(F.col("query_id").alias("vec_id"), (F.col("mean_other") / F.col("lrd")).alias("lof"))


def pca(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """A column ``components`` of the first k principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    return PCA(k=k, inputCol="_v", outputCol="_c").fit(rows).transform(rows).withColumn("components", vector_to_array("_c")).drop("_v", "_c")


def label_classes(labels: DataFrame) -> DataFrame:
    """has_violation, is_high, is_serious, is_moderate_or_worse from the count and the worst severity."""
    s = F.col("ground_truth_max_severity")
    return labels.withColumns({"has_violation": F.col("ground_truth_violation_count") > 0, "is_high": s == "high", "is_serious": (s == "high") & (F.col("ground_truth_violation_count") >= 2), "is_moderate_or_worse": s.isin("medium", "high")})
