"""Data-quality checks, each as rows (check, subject, passed, failures)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantile_columns


def _result(check: str, failures: dict[str, Column], df: DataFrame) -> DataFrame:
    """All of a table's failures in one pass."""
    row = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"{i}") for i, v in enumerate(failures.values())])
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(check).alias("check"), F.lit(k).alias("subject"), (F.col(f"{i}") == 0).alias("passed"), F.col(f"{i}").alias("failures")) for i, k in enumerate(failures)])).alias("x"))
    return rows.select("x.*")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return _result("not_null", {c: F.count_if(F.col(c).isNull()) for c in columns}, df)


def check_unique(df: DataFrame, key: str) -> DataFrame:
    return _result("unique", {key: F.count_if(F.col("count") > 1)}, df.groupBy(key).count())


def check_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return _result("accepted", {column: F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(values))}, df)


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return _result("range", {c: F.count_if(~F.col(c).between(a, b) | F.isnan(F.col(c).cast("double"))) for c, (a, b) in ranges.items()}, df)


def check_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return _result("binary", {c: F.count_if(~F.col(c).cast("int").isin(0, 1)) for c in columns}, df)


def check_rates(df: DataFrame, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """The share of true rows within its band."""
    def off(c: str, a: float, b: float) -> Column:
        return F.when(F.avg(F.col(c).cast("double")).between(a, b), 0).otherwise(1)

    return _result("rate", {c: off(c, a, b) for c, (a, b) in bands.items()}, df)


def check_spread(df: DataFrame, column: str, least: float) -> DataFrame:
    """95th less 5th percentile of at least so much."""
    q = quantile_columns(df, {"low": (column, 0.05), "high": (column, 0.95)})
    return _result("spread", {column: F.max(F.when(F.col("high") - F.col("low") >= least, 0).otherwise(1))}, q)


def check_row_count(df: DataFrame, least: int, most: int) -> DataFrame:
    return _result("row_count", {"*": F.when(F.count(F.lit(1)).between(least, most), 0).otherwise(1)}, df)


def check_leakage(features: DataFrame, labels: list[str]) -> list[str]:
    """Label columns among the features."""
    return sorted(set(features.columns) & set(labels))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
