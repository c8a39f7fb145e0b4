"""Places of rows within groups, and exact quantiles, with no task that holds a group.

Rows are dealt out by ranges of (group, value, tie-breaker), so a group of a third of all rows spreads over as many tasks
as any other third, and equal values part too. Inside a range ordinary windows count. What a range's rows lack is
the number of their group's rows in the ranges before, and, for values that stand in several ranges, their
first place and their number: both follow from a few numbers for each (range, group), of which only the first and the last
group of a range matter. The ranges are written once, so that every branch sees the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept

#: Steps of the sketch that bounds an exact quantile: about 3 / GRID of the rows are looked at exactly.
GRID = 500


def _same(names: Mapping[str, str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()], F.lit(True))


def with_places(rows: DataFrame, by: Sequence[str], value: str, key: str, weight: str | None = None) -> DataFrame:
    """rows with below, same, total and so_far: of each row's group the weight of lesser values, of equal ones, of all, and
    of the rows up to this one by (value, key).

    Every row weighs 1, or what ``weight`` says (a long). Nulls are values less than all others and a group of their
    own, as in Spark's ascending order. Rows equal in (group, value, key) stand in any order among themselves.
    """
    w = F.col(weight) if weight else F.lit(1)
    parts = kept(rows.repartitionByRange(*by, value, key).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy("_part", *by).orderBy(value)
    upto = group.rangeBetween(Window.unboundedPreceding, 0)
    rows_upto = Window.partitionBy("_part", *by).orderBy(value, key).rowsBetween(Window.unboundedPreceding, 0)
    equal = Window.partitionBy("_part", *by, value)
    inside = parts.withColumns({"_upto": F.sum(w).over(upto), "_rows": F.sum(w).over(rows_upto), "_same": F.sum(w).over(equal)})
    names = {f"_g{i}": c for i, c in enumerate(by)}
    # of each value in each range its number, then of each group in each range its number, least and greatest value
    values = parts.groupBy("_part", *[F.col(c).alias(n) for n, c in names.items()], F.col(value).alias("_v")).agg(F.sum(w).alias("c"))
    ends = values.groupBy("_part", *names).agg(F.sum("c").alias("m"), F.min(F.struct(F.col("_v").isNotNull().alias("t"), F.col("_v").alias("v"), "c")).alias("low"), F.max(F.struct(F.col("_v").isNotNull().alias("t"), F.col("_v").alias("v"), "c")).alias("high"))
    before = Window.partitionBy(*names).orderBy("_part")  # of a group one row a range
    ends = ends.withColumns({"base": F.sum("m").over(before) - F.col("m"), "all": F.sum("m").over(Window.partitionBy(*names))})
    low = F.struct(F.col("low.v").alias("v"), F.col("low.c").alias("c"), F.col("base").alias("below"))
    high = F.struct(F.col("high.v").alias("v"), F.col("high.c").alias("c"), (F.col("base") + F.col("m") - F.col("high.c")).alias("below"))
    one = F.col("low.v").eqNullSafe(F.col("high.v"))
    edges = ends.select(*names, F.explode(F.when(one, F.array(low)).otherwise(F.array(low, high))).alias("e")).groupBy(*names, F.col("e.v").alias("_v")).agg(F.count(F.lit(1)).alias("ranges"), F.min("e.below").alias("first"), F.sum("e.c").alias("number")).where("ranges > 1").drop("ranges")
    bases = ends.select(F.col("_part").alias("_p"), *names, "base", "all")
    joined = inside.join(bases, (F.col("_part") == F.col("_p")) & _same(names)).drop("_p", *names)
    joined = joined.join(edges, _same(names | {"_v": value}), "left")
    out = {"below": F.coalesce(F.col("first"), F.col("base") + F.col("_upto") - F.col("_same")), "same": F.coalesce("number", "_same"), "total": F.col("all"), "so_far": F.col("base") + F.col("_rows")}
    return joined.withColumns(out).select(*rows.columns, *out)


def numbered(df: DataFrame) -> DataFrame:
    """df as a written table whose rows have a number, _row, that stays."""
    return kept(df.withColumn("_row", F.monotonically_increasing_id()))


def ranked(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]], rank: Column) -> DataFrame:
    """df with a column for each of ``ranks`` (name -> (columns of the group, ranked column)): ``rank`` over below, same and total.

    All of them in one pass over a long table, of one range partitioning. Ranked columns count as doubles.
    """
    rows = df if "_row" in df.columns else numbered(df)
    wide = max(len(by) for by, _ in ranks.values())
    none = F.lit(None).cast("string")

    def one(i: int, by: Sequence[str], column: str) -> Column:
        groups = [F.col(c).cast("string") for c in by] + [none] * (wide - len(by))
        return F.struct(F.lit(i).alias("_r"), *[g.alias(f"_by{k}") for k, g in enumerate(groups)], F.col(column).cast("double").alias("_value"))

    long = rows.select("_row", F.explode(F.array(*[one(i, by, column) for i, (by, column) in enumerate(ranks.values())])).alias("x")).select("_row", "x.*")
    placed = with_places(long, ["_r", *[f"_by{k}" for k in range(wide)]], "_value", "_row").withColumn("_rank", rank)
    found = placed.groupBy("_row").agg(*[F.max(F.when(F.col("_r") == i, F.col("_rank"))).alias(name) for i, name in enumerate(ranks)])
    return rows.join(found, "_row").drop("_row")


def percent_ranks(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """PERCENT_RANK columns."""
    return ranked(df, ranks, F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0))


def frac_ranks(df: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """Least rank / number of rows of the group."""
    return ranked(df, ranks, (F.col("below") + 1) / F.col("total"))


def quantiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, p, q): the interpolated quantiles of each column's values that aren't null, in each group.

    A sketch for each (group, column) bounds the two values each quantile lies between. Rows within the bounds are counted
    by value, those below only counted; the counted values' places decide. Bounds that don't hold, which the counts tell, become
    the least and the greatest value. A group without values gives no row.
    """
    names = [f"_k{i}" for i in range(len(by))]
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = kept(df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.explode(values).alias("x")).select(*names, "x.*").where("v is not null"))
    keys = [*names, "column"]
    ps = [float(p) for p in ps]
    steps = [(max(int(p * GRID) - 1, 0), min(-int(-p * GRID // 1) + 1, GRID)) for p in ps]
    cuts = F.approx_percentile("v", F.array(*[F.lit(k / GRID) for pair in steps for k in pair]), GRID * 20)
    sketch = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), cuts.alias("cuts"))
    bounds = F.array(*[F.struct(F.lit(p).alias("p"), (F.get("cuts", F.lit(2 * i)) if low else F.col("least")).alias("low"), (F.get("cuts", F.lit(2 * i + 1)) if high < GRID else F.col("most")).alias("high")) for i, (p, (low, high)) in enumerate(zip(ps, steps, strict=True))])
    wanted = sketch.select(*keys, "n", "least", "most", F.explode(bounds).alias("b")).select(*keys, "n", "least", "most", "b.*").withColumn("place", F.col("p") * (F.col("n") - 1))
    wanted = kept(wanted)
    targets = [f"_t{i}" for i in range(len(keys))]

    also = [*keys, "p"]
    others = {c: f"_o_{c}" for c in also}

    def within(bounds: DataFrame) -> DataFrame:
        """(keys, p, v, c): values within the bounds of each wanted quantile with their numbers; v null: the number below."""
        bounds = bounds.select(*[F.col(c).alias(t) for c, t in zip(keys, targets, strict=True)], F.struct("p", "low", "high").alias("b"))
        met = long.join(bounds.groupBy(*targets).agg(F.collect_list("b").alias("b")), _same(dict(zip(keys, targets, strict=True))))  # as many as ps
        met = met.select(*keys, "v", F.explode("b").alias("b")).where("v <= b.high")
        return met.groupBy(*keys, F.col("b.p").alias("p"), F.when(F.col("v") >= F.col("b.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))

    counted = kept(within(wanted))
    below = counted.groupBy(*[F.col(c).alias(o) for c, o in others.items()]).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("inside"))
    holds = (F.floor("place") >= F.col("below")) & (F.ceil("place") < F.col("below") + F.col("inside"))
    found = wanted.join(below, _same(others), "left").drop(*others.values()).fillna(0, ["below", "inside"]).withColumn("holds", holds)
    missed = found.where("not holds")
    inside = counted.where("v is not null")
    if missed.limit(1).count():
        again = within(missed.select(*also, F.col("least").alias("low"), F.col("most").alias("high")))
        marks = missed.select(*[F.col(c).alias(o) for c, o in others.items()])
        inside = inside.join(marks, _same(others), "left_anti").unionByName(again)
        found = found.withColumn("below", F.when(F.col("holds"), F.col("below")).otherwise(0))
    placed = with_places(inside, [*keys, "p"], "v", "c", weight="c").select(*[F.col(c).alias(o) for c, o in others.items()], "v", (F.col("so_far") - F.col("c")).alias("first"), F.col("so_far").alias("next"))
    rows = found.join(placed, _same(others))
    at = F.col("place") - F.col("below")
    rows = rows.where((F.floor(at) < F.col("next")) & (F.ceil(at) >= F.col("first")))
    lower = F.max(F.when((F.floor(at) >= F.col("first")) & (F.floor(at) < F.col("next")), F.col("v")))
    upper = F.max(F.when((F.ceil(at) >= F.col("first")) & (F.ceil(at) < F.col("next")), F.col("v")))
    share = F.first(F.col("place") - F.floor("place"))
    out = rows.groupBy(*keys, "p").agg(F.first("n").alias("n"), (lower + (upper - lower) * share).alias("q"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "column", "n", "p", "q")


def median_of_counts(placed: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """(by, median): the interpolated median of each group's values, from counted values that with_places() has placed."""
    first, at = F.col("so_far") - F.col(weight), (F.col("total") - 1) / 2
    lower, upper = (F.max(F.when((k >= first) & (k < F.col("so_far")), F.col(value))) for k in (F.floor(at), F.ceil(at)))
    return placed.where((F.floor(at) < F.col("so_far")) & (F.ceil(at) >= first)).groupBy(*by).agg(((lower + upper) / 2).alias("median"))


def quantile_columns(df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """(by, a column for each of ``wanted``: name -> (column, p)); one row without ``by``, of nulls where there is no value."""
    found = quantiles(df, sorted({c for c, _ in wanted.values()}), sorted({p for _, p in wanted.values()}), by)
    return found.groupBy(*by).agg(*[F.max(F.when((F.col("column") == c) & (F.col("p") == F.lit(float(p))), F.col("q"))).alias(name) for name, (c, p) in wanted.items()])
