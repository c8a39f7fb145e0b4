"""Benchmarks of entities against peers, the industry and competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.io import kept
from .payments import growth, steady
from .ranks import frac_ranks, median_of_counts, numbered, percent_ranks, quantile_columns, ranked, with_places


def with_quantiles(df: DataFrame, group: str, aggs: list[Column], wanted: dict[str, tuple[str, float]], exact: bool, found: DataFrame | None = None) -> DataFrame:
    """By group, the aggregates and quantiles (name -> (column, p)): interpolated and exact (maybe found already), or of a sketch in the same pass."""
    if not exact:
        return df.groupBy(group).agg(*aggs, *[F.approx_percentile(c, p).alias(name) for name, (c, p) in wanted.items()])
    found = (found.select(group, *wanted) if found else quantile_columns(df, wanted, [group])).withColumnRenamed(group, "_group")
    return df.groupBy(group).agg(*aggs).join(found, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def peer_quantiles(columns: dict[str, tuple[float, ...]]) -> dict[str, tuple[str, float]]:
    return {f"p{round(p * 100)}_{c}": (c, p) for c, ps in columns.items() for p in ps}


def peer_stats(df: DataFrame, group: str, columns: dict[str, tuple[float, ...]], exact: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Number of entities, and mean and quantiles of each column, by group."""
    return with_quantiles(df, group, [F.count_distinct("hcp_id").alias("peer_count"), *[F.avg(c).alias(f"avg_{c}") for c in columns]], peer_quantiles(columns), exact, found)


def peer_group_size(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    n = F.count_distinct("hcp_id")
    return df.groupBy("specialty", "state").agg(n.alias("peer_group_size"), (n < cfg.min_peers).alias("use_national_benchmark"))


def peer_ranks(df: DataFrame, ranks: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """PERCENT_RANK columns: name -> (columns of the group, ranked column)."""
    return percent_ranks(df, ranks)


def industry_spend(payments: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Spend of all companies on an entity by year; companies and payments of the last year; its last specialty by name."""
    y, amount = F.col("program_year"), F.col("payment_amount")
    return payments.where("hcp_id is not null").groupBy("hcp_id").agg(
        F.max(F.coalesce("specialty", F.lit("Unknown"))).alias("specialty"), *[steady(F.sum(F.when(y == k, amount).otherwise(0.0))).alias(f"industry_spend_{k}") for k in years],
        F.count_distinct(F.when(y == years[-1], F.col("company_name"))).alias("industry_company_count"), F.count_if(y == years[-1]).alias("industry_payment_count"),
    )


def competitor_spend(payments: DataFrame, years: tuple[int, ...]) -> DataFrame:
    y, amount = F.col("program_year"), F.col("payment_amount")
    return payments.where("hcp_id is not null").groupBy("hcp_id").agg(
        F.max(F.coalesce("specialty", F.lit("Unknown"))).alias("specialty"), *[steady(F.sum(F.when(y == k, amount).otherwise(0.0))).alias(f"competitor_spend_{k}") for k in years],
        steady(F.sum(amount)).alias("competitor_spend_3yr"), F.count_distinct("company_name").alias("competitor_company_count"),
    )


def year_spend(payments: DataFrame, year: int, company: str = "is_competitor") -> DataFrame:
    """Spend of one year of the payments with a flag, by an aggregate with a filter."""
    return payments.groupBy("hcp_id").agg(F.expr(f"sum(payment_amount) FILTER (WHERE program_year = {int(year)} AND {company})").alias("spend"))


def population_stats(payments: DataFrame, year: int, exact: bool = False) -> DataFrame:
    """Mean and 90th percentile by specialty of what entities got in a year."""
    totals = payments.where(F.col("program_year") == year).groupBy("hcp_id", "specialty").agg(F.sum("payment_amount").alias("total"))
    return with_quantiles(kept(totals), "specialty", [F.avg("total").alias("avg_total"), F.count(F.lit(1)).alias("entities")], {"p90_total": ("total", 0.9)}, exact)


def ratio(part: Column, whole: Column, cap: float) -> Column:
    """part / whole up to cap, 0 without a positive whole."""
    return F.when(whole > 0, F.least(F.lit(cap), part / whole)).otherwise(0.0)


def count_true(*conditions: Column) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions), F.lit(0))


def benchmark(entities: DataFrame, industry: DataFrame, competitors: DataFrame, cfg: Config = Config(), exact: bool = False) -> DataFrame:
    """Cap pattern, trend, ranks, ratios, shares of wallet, quadrant, priority and compound flags of each entity.

    entities: hcp_id, specialty, state, spend of each year, meal_breach_rate, combined_raw_risk_score.
    """
    y1, y2, y3 = cfg.years
    spend = {y: F.col(f"spend_{y}") for y in cfg.years}
    rows = entities.withColumns({"specialty": F.coalesce("specialty", F.lit("Unknown")), "state": F.coalesce("state", F.lit("Unknown")), "spend_3yr": spend[y1] + spend[y2] + spend[y3]})
    given, industry, competitors = numbered(rows), kept(industry), kept(competitors)
    rows = peer_ranks(given, {f"rank_{y}": (("specialty",), f"spend_{y}") for y in cfg.years} | {"rank_3yr": (("specialty",), "spend_3yr"), "rank_state": (("state",), f"spend_{y3}"), "rank_specialty_state": (("specialty", "state"), f"spend_{y3}"), "risk_rank": (("specialty",), "combined_raw_risk_score"), "meal_breach_rank": (("specialty",), "meal_breach_rate")})
    ind_columns, comp_column = [f"industry_spend_{y}" for y in cfg.years], f"competitor_spend_{y3}"
    own = {f"spend_{y}": (0.9,) for y in cfg.years} | {"spend_3yr": (0.5, 0.9, 0.95), "combined_raw_risk_score": (0.9,)}
    of_industry, of_competitors = {f"ind_p90_{c[-4:]}": (c, 0.9) for c in ind_columns}, {"comp_p90": (comp_column, 0.9)}
    found = None
    if exact:  # the three tables' columns differ in name, so one call finds all their quantiles
        three = given.select("specialty", *own).unionByName(industry.select("specialty", *ind_columns), allowMissingColumns=True).unionByName(competitors.select("specialty", comp_column), allowMissingColumns=True)
        found = kept(quantile_columns(three, peer_quantiles(own) | of_industry | of_competitors, ["specialty"]))
    peers = peer_stats(given, "specialty", own, exact, found)
    ind = with_quantiles(industry, "specialty", [F.count_distinct("hcp_id").alias("ind_peer_count"), *[F.avg(c).alias(f"ind_avg_{c[-4:]}") for c in ind_columns]], of_industry, exact, found)
    comp = with_quantiles(competitors, "specialty", [F.avg(comp_column).alias("comp_avg")], of_competitors, exact, found)
    rows = rows.join(peers, "specialty", "left").join(peer_group_size(given, cfg), ["specialty", "state"], "left")
    rows = rows.join(industry.withColumnRenamed("specialty", "ind_specialty"), "hcp_id", "left").withColumn("ind_key", F.coalesce("ind_specialty", "specialty")).join(ind.withColumnRenamed("specialty", "ind_key"), "ind_key", "left")
    rows = rows.join(competitors.withColumnRenamed("specialty", "comp_specialty"), "hcp_id", "left").withColumn("comp_key", F.coalesce("comp_specialty", "specialty")).join(comp.withColumnRenamed("specialty", "comp_key"), "comp_key", "left")
    rows = rows.fillna(0.0, [*ind_columns, *[f"competitor_spend_{y}" for y in cfg.years], "competitor_spend_3yr"]).fillna(0, ["industry_company_count", "industry_payment_count", "competitor_company_count"])
    at, near = [spend[y] >= cfg.annual_cap for y in cfg.years], [spend[y] >= cfg.near_cap for y in cfg.years]
    rank = {y: F.col(f"rank_{y}") for y in cfg.years}
    out = {f"cap_pct_{y}": spend[y] / cfg.annual_cap for y in cfg.years} | {"years_at_cap": count_true(*at), "years_near_cap": count_true(*near)}
    out |= {"outlier_years": count_true(*[rank[y] > 0.9 for y in cfg.years]), "rank_change_1": rank[y2] - rank[y1], "rank_change_2": rank[y3] - rank[y2]}
    out |= {f"vs_peer_{y}": ratio(spend[y], F.col(f"avg_spend_{y}"), 10.0) for y in cfg.years} | {f"vs_industry_{y}": ratio(spend[y], F.col(f"ind_avg_{y}"), 10.0) for y in cfg.years}
    total = sum((F.col(c) for c in ind_columns), F.lit(0.0))
    out |= {"vs_peer_3yr": ratio(F.col("spend_3yr"), F.col("avg_spend_3yr"), 10.0), "vs_industry_3yr": ratio(F.col("spend_3yr"), sum((F.coalesce(f"ind_avg_{y}", F.lit(0.0)) for y in cfg.years), F.lit(0.0)), 10.0)}
    out |= {f"sow_{y}": ratio(spend[y], F.col(f"industry_spend_{y}"), 1.0) for y in cfg.years} | {"sow_3yr": ratio(F.col("spend_3yr"), total, 1.0), "vs_competitor": ratio(spend[y3], F.col("comp_avg"), 10.0)}
    rows = rows.withColumns(out)
    return classify(rows, cfg)


def classify(rows: DataFrame, cfg: Config) -> DataFrame:
    """What follows from the ratios and ranks of benchmark()."""
    y1, y2, y3 = cfg.years
    one, two, three = (F.col(f"spend_{y}") for y in cfg.years)
    industry, sow, rank = ({y: F.col(f"{k}_{y}") for y in cfg.years} for k in ("vs_industry", "sow", "rank"))
    climbing = (F.col("rank_change_1") > 0) & (F.col("rank_change_2") > 0)
    sow_rising = (sow[y3] > sow[y2]) & (sow[y2] > sow[y1])
    rows = rows.withColumns({
        "cap_pattern": F.when(F.col("years_at_cap") >= 2, "chronic_breach").when(F.col("years_at_cap") == 1, "single_breach").when(F.col("years_near_cap") >= 2, "chronic_near_cap").when(F.col("years_near_cap") == 1, "near_cap").otherwise("compliant"),
        "spend_trend": F.when((three > two) & (two > one), "increasing").when((three < two) & (two < one), "decreasing").when(three > one, "net_increasing").otherwise("stable"),
        "growth_1": growth(two, one), "growth_2": growth(three, two), "escalating_rank": climbing, "persistent_outlier": F.col("outlier_years") >= 2,
        "industry_outlier_years": count_true(*[industry[y] > 2 for y in cfg.years]), "industry_high_outlier": industry[y3] > 3, "risk_top_1": F.col("risk_rank") > 0.99, "risk_top_5": F.col("risk_rank") > 0.95, "risk_top_10": F.col("risk_rank") > 0.9,
        "sow_dominant_years": count_true(*[sow[y] > 0.5 for y in cfg.years]), "sow_exclusive": sow[y3] > 0.8, "sow_increasing": sow_rising, "competitor_outlier": F.col("vs_competitor") > 2,
    })
    high, dear = rank[y3] > 0.75, industry[y3] > 1.5
    outlier, industry_outlier = rank[y3] > 0.9, industry[y3] > 2
    return rows.withColumns({
        "quadrant": F.when(high & dear, "investigate").when(climbing & (F.col("years_near_cap") >= 2), "investigate").when(high & ~dear, "review").when(~high & dear, "competitive_intelligence").otherwise("continue"),
        "quadrant_reason": F.concat(F.lit("rank "), F.round(rank[y3] * 100).cast("int").cast("string"), F.lit("th pct, "), F.format_string("%.1f", industry[y3]), F.lit("x industry, outlier "), F.col("outlier_years").cast("string"), F.lit("/3 years, SOW "), F.round(sow[y3] * 100).cast("int").cast("string"), F.lit("%")),
        "priority": F.least(F.lit(100.0), rank[y3] * 30 + F.least(F.lit(1.0), industry[y3] / 3) * 25 + sow[y3] * 25 + F.least(F.lit(10.0), F.col("outlier_years") * 5.0) + F.least(F.lit(10.0), F.col("industry_outlier_years") * 5.0)),
        "dual_outlier": outlier & industry_outlier, "triple_signal": outlier & industry_outlier & F.col("sow_exclusive"), "escalating_risk": climbing & sow_rising, "chronic_risk": (F.col("outlier_years") >= 2) & (F.col("industry_outlier_years") >= 2),
    })


def frac_rank(df: DataFrame, column: str, by: str, name: str) -> DataFrame:
    """Least rank / number of rows in the group."""
    return frac_ranks(df, {name: ((by,), column)})


def frac_rank_global(df: DataFrame, column: str, name: str, ties: str = "min") -> DataFrame:
    """Least ("min") or mean ("average") rank / number of values, over all rows; null where the value is."""
    below = F.col("below") + 1 if ties == "min" else F.col("below") + (F.col("same") + 1) / 2
    present = F.col(f"_{column}").isNotNull()
    rows = ranked(df.withColumns({f"_{column}": column, "_known": F.col(column).isNotNull()}), {name: (("_known",), f"_{column}")}, below / F.col("total"))
    return rows.withColumn(name, F.when(present, F.col(name))).drop(f"_{column}", "_known")


def real_benchmarks(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Peer averages, fractional ranks, capped ratios, outliers, ordinal trend (0-3) and cap pattern (0-4), base score."""
    y1, y2, y3 = cfg.years
    given = numbered(df)
    averages = given.groupBy(F.col("specialty").alias("_group")).agg(*[F.avg(f"spend_{y}").alias(f"peer_avg_{y}") for y in cfg.years])
    df = frac_ranks(given, {f"rank_{y}": (("specialty",), f"spend_{y}") for y in cfg.years}).join(averages, F.col("specialty").eqNullSafe(F.col("_group"))).drop("_group")
    df = df.withColumns({f"vs_peer_{y}": ratio(F.col(f"spend_{y}"), F.col(f"peer_avg_{y}"), 10.0) for y in cfg.years})
    one, two, three = (F.col(f"spend_{y}") for y in cfg.years)
    at, near = (count_true(*[s >= cap for s in (one, two, three)]) for cap in (cfg.annual_cap, cfg.near_cap))
    outliers = count_true(*[F.col(f"rank_{y}") > 0.9 for y in cfg.years])
    return df.withColumns({
        "outlier_years": outliers, "trend": F.when((three > two) & (two > one), 3).when(three > one, 2).when((three < two) & (two < one), 0).otherwise(1),
        "cap_pattern": F.when(at >= 2, 4).when(at == 1, 3).when(near >= 2, 2).when(near == 1, 1).otherwise(0),
        "base_score": F.least(F.lit(40.0), F.col(f"rank_{y3}") * 30 + F.least(F.lit(10.0), outliers * 5.0)),
    })


def full_priority(spend: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(1 - share of wallet) * 40 + min(ratio, 2) / 2 * 30 + min(30, rank * 20 + min(n, 3) / 3 * 10).

    spend: hcp_id, own spend of each year, competitor (of the last year, null if unknown), population_avg. n: earlier
    years above the last year's median of positive spend.
    """
    y1, y2, y3 = cfg.years
    own, competitor = F.col(f"spend_{y3}"), F.coalesce("competitor", F.lit(0.0))
    spend = kept(spend)
    median = quantile_columns(spend.where(own > 0), {"median": (f"spend_{y3}", 0.5)})
    rows = frac_rank_global(spend, f"spend_{y3}", "rank").crossJoin(F.broadcast(median))  # one row
    wallet = F.when(own + competitor > 0, own / (own + competitor))
    years_above = count_true(*[F.col(f"spend_{y}") > F.col("median") for y in (y1, y2)])
    return rows.select(
        "hcp_id", wallet.alias("share_of_wallet"), "rank", years_above.alias("years_above"),
        ((1 - F.coalesce(wallet, F.lit(0.0))) * 40 + F.least(F.lit(2.0), F.when(F.col("population_avg") > 0, own / F.col("population_avg")).otherwise(0.0)) / 2 * 30 + F.least(F.lit(30.0), F.col("rank") * 20 + F.least(F.lit(3), years_above) / 3 * 10)).alias("full_priority"),
    )


def competitor_benchmarks(own: DataFrame, competitors: DataFrame | None) -> DataFrame:
    """(hcp_id, own_spend, competitor_spend, competitor_avg_spend, share_of_wallet, available) of each entity.

    own: hcp_id, spend (null: 0). competitors: hcp_id, competitor_spend, competitor_avg_spend; entities it lacks have 0. Without that
    source its columns and the share are null and ``available`` is false; the share is null too where both sides are 0.
    """
    rows = own.select("hcp_id", F.coalesce("spend", F.lit(0.0)).alias("own_spend"))
    measures = ["competitor_spend", "competitor_avg_spend"]
    if competitors is None:
        return rows.withColumns({c: F.lit(None).cast("double") for c in [*measures, "share_of_wallet"]} | {"available": F.lit(False)})
    rows = rows.join(competitors.select("hcp_id", *measures), "hcp_id", "left").fillna(0.0, measures)
    total = F.col("own_spend") + F.col("competitor_spend")
    return rows.withColumns({"share_of_wallet": F.when(total > 0, F.col("own_spend") / total), "available": F.lit(True)})


def local_population_average(df: DataFrame, column: str) -> DataFrame:
    """Mean of the specialty's values, a missing value as 0 and a missing specialty as one of its own."""
    named = F.coalesce("specialty", F.lit("Unknown"))
    own = df.groupBy(named.alias("_named")).agg(F.avg(F.coalesce(column, F.lit(0.0))).alias("population_avg"))
    return df.withColumn("_named", named).join(own, "_named", "left").drop("_named")


def peer_groups(entities: DataFrame, value: str, least: int = 5) -> DataFrame:
    """Each entity against its peers: the specialty's if there are ``least``, of these (or of all) the state's if there are ``least``.

    entities: hcp_id, specialty, state and a value. Gives peer_group (a text), peer_count, peer_mean, peer_max,
    peer_median and percentile (the mean rank among the peers' values, 0 to 100; null without a value). Every kind of
    group is one aggregate over counted values, placed by ranges, so no task holds the values of a group.
    """
    rows = kept(entities.select("hcp_id", "specialty", "state", F.col(value).alias("value")))
    for keys, name in ((["specialty"], "n_specialty"), (["state"], "n_state"), (["specialty", "state"], "n_both")):
        rows = rows.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys, "left")
    by_specialty = F.coalesce(F.col("n_specialty") >= least, F.lit(False))
    by_state = F.coalesce(F.when(by_specialty, F.col("n_both")).otherwise(F.col("n_state")) >= least, F.lit(False))
    head = F.when(by_specialty, F.concat(F.lit("specialty="), "specialty")).otherwise("full population")
    rows = rows.withColumns({"one": F.when(by_specialty, F.col("specialty")), "two": F.when(by_state, F.col("state")), "peer_group": F.concat(head, F.when(by_state, F.concat(F.lit(", state="), "state")).otherwise(""))})
    # a row counts among all, among its specialty's, its state's and both; null stands for any
    null = F.lit(None).cast("string")
    kinds = F.array(*[F.struct(o.alias("one"), t.alias("two")) for o in (null, F.col("specialty")) for t in (null, F.col("state"))])
    counted = rows.where(F.col("value").isNotNull()).select(F.explode(F.array_distinct(kinds)).alias("k"), "value").groupBy("k.one", "k.two", "value").agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.select("one", "two").distinct()
    pair = ["one", "two"]
    counted = counted.join(wanted.select(F.col("one").alias("w1"), F.col("two").alias("w2")), F.col("one").eqNullSafe(F.col("w1")) & F.col("two").eqNullSafe(F.col("w2")), "left_semi")
    counted = kept(counted)
    placed = kept(with_places(counted, pair, "value", "n", weight="n"))
    stats = counted.groupBy(*pair).agg(F.sum("n").alias("peer_count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("peer_mean"), F.max("value").alias("peer_max"))
    medians = median_of_counts(placed, pair, "value", "n").select(F.col("one").alias("m1"), F.col("two").alias("m2"), F.col("median").alias("peer_median"))
    stats = stats.join(medians, F.col("one").eqNullSafe(F.col("m1")) & F.col("two").eqNullSafe(F.col("m2"))).drop("m1", "m2")
    at = placed.select(*pair, F.col("value").alias("at"), "n", F.col("so_far").alias("upto"))
    at, stats = (d.withColumnsRenamed({"one": "g1", "two": "g2"}) for d in (at, stats))
    same = F.col("one").eqNullSafe(F.col("g1")) & F.col("two").eqNullSafe(F.col("g2"))
    found = rows.join(stats, same, "left").drop("g1", "g2").join(at, same & (F.col("value") == F.col("at")), "left")
    return found.select("hcp_id", "peer_group", "peer_count", "peer_mean", "peer_max", "peer_median", ((2 * F.col("upto") - F.col("n") + 1) * 50 / F.col("peer_count")).alias("percentile"))


def map_join(df: DataFrame, lookup: DataFrame, key: str, value: str, default: float | None = None) -> DataFrame:
    """The lookup's value of each row's key; where there is none the default, or the mean of the lookup's values."""
    other = F.lit(default).cast("double") if default is not None else F.col("_mean")
    mean = lookup.agg(F.avg(value).alias("_mean"))
    return df.join(lookup.select(key, F.col(value).alias("_found")), key, "left").crossJoin(F.broadcast(mean)).withColumn(value, F.coalesce("_found", other)).drop("_found", "_mean")  # one row


def restrict(df: DataFrame, ids: DataFrame, key: str = "hcp_id") -> DataFrame:
    """The rows whose key is among the ids."""
    return df.join(ids.select(key), key, "left_semi")


def totals_long(totals: DataFrame, years: tuple[int, ...], prefix: str = "total_", key: str = "hcp_id") -> DataFrame:
    """(key, program_year, total) from a column for each year; years without a total give no row."""
    rows = totals.unpivot(key, [f"{prefix}{y}" for y in years], "name", "total").where(F.col("total").isNotNull())
    return rows.select(key, F.substring_index("name", "_", -1).cast("long").alias("program_year"), "total")
