"""Every registered query of the library's own operators, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "risk_scores"


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show; a little beyond themselves, so that halves go one way."""
    return df.select(*[F.round(F.col(c) * 1.0000000001, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, places: int = 4) -> Callable:
    """Register a function of (spark, sf_dir) by its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _name in ("marts", "benchmarks", "scoring", "records", "reports", "texts", "models", "peers", "scopes", "files"):
    import_module(f"ledgerlens.plans.{_name}")
