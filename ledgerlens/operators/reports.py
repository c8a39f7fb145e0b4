"""Population monitoring, reconciliation, exploration and evaluation reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import kept
from .ranks import quantile_columns, quantiles, with_places

TIERS = ("critical", "high", "medium", "low")


def _tier_counts() -> list[Column]:
    return [F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS]


def scope_filter(df: DataFrame, specialty: str | None = None, state: str | None = None, tier: str | None = None) -> DataFrame:
    """Optional filters: state in any case, specialty in any case, tier as it is."""
    if specialty:
        df = df.where(F.lower("specialty") == specialty.lower())
    if state:
        df = df.where(F.upper("state") == state.upper())
    return df.where(F.col("risk_tier") == tier) if tier else df


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Number and share of each tier, mean and median score."""
    scores = kept(scores.select("risk_tier", "risk_score"))
    total = scores.agg(F.count(F.lit(1)).alias("all"))
    rows = scores.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("avg_score"))
    median = quantile_columns(scores, {"median_score": ("risk_score", 0.5)}, ["risk_tier"]).withColumnRenamed("risk_tier", "_tier")
    rows = rows.join(median, F.col("risk_tier").eqNullSafe(F.col("_tier")), "left")
    return rows.crossJoin(F.broadcast(total)).select("risk_tier", "n", (F.col("n") / F.col("all")).alias("share"), "avg_score", "median_score")  # one row


def flag_patterns(flags: DataFrame, names: list[str], severities: dict[str, str], n: int = 10) -> DataFrame:
    """How often each flag fired, most frequent first."""
    sums = flags.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).cast("long")).alias(c) for c in names])
    rows = sums.unpivot("rows", names, "flag", "n").where("n > 0")
    severity = F.create_map(*[F.lit(x) for p in severities.items() for x in p])[F.col("flag")]
    return rows.select("flag", "n", (F.col("n") / F.col("rows")).alias("rate"), severity.alias("severity")).orderBy(F.desc("n"), "flag").limit(n)


def risk_segments(scores: DataFrame, by: str, flags: list[str], least: int = 5, n: int = 10) -> DataFrame:
    """Segments of a size: critical and high shares, mean score, most common flag; the riskiest first."""
    size = F.count(F.lit(1))
    rows = scores.groupBy(by).agg(size.alias("entities"), (F.count_if(F.col("risk_tier") == "critical") / size).alias("critical_rate"), (F.count_if(F.col("risk_tier") == "high") / size).alias("high_rate"), F.avg("risk_score").alias("avg_score"), *[F.sum(F.col(c).cast("long")).alias(c) for c in flags])
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("flag")) for i, c in enumerate(flags)]))
    rows = rows.where(F.col("entities") >= least).withColumn("top_flag", F.when(best.n > 0, best.flag)).drop(*flags)
    return rows.orderBy(F.desc("critical_rate"), F.desc("high_rate"), by).limit(n)


def systemic_issues(scores: DataFrame, flags: list[str]) -> DataFrame:
    """Critical clusters, segments with many flags, and a flag that makes up most of all that fired."""

    def cluster(by: str) -> DataFrame:
        n = F.count(F.lit(1))
        return scores.groupBy(F.col(by).alias("subject")).agg(n.alias("n"), (F.count_if(F.col("risk_tier") == "critical") / n).alias("rate")).where("n >= 10 and rate > 0.02").select(F.lit(f"critical_cluster_{by}").alias("issue"), "subject", "rate")

    def many(by: str, limit: float) -> DataFrame:
        n = F.count(F.lit(1))
        return scores.groupBy(F.col(by).alias("subject")).agg(n.alias("n"), (F.count_if(F.col("total_rule_flags") >= 2) / n).alias("rate")).where((F.col("n") >= 10) & (F.col("rate") > limit)).select(F.lit(f"multi_flag_{by}").alias("issue"), "subject", "rate")

    sums = scores.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in flags]).withColumn("all", reduce(Column.__add__, [F.col(c) for c in flags]))
    dominant = sums.unpivot("all", flags, "subject", "n").select(F.lit("dominant_flag").alias("issue"), "subject", (F.col("n") / F.col("all")).alias("rate")).where("rate > 0.4")
    return reduce(DataFrame.unionByName, [cluster("specialty"), cluster("state"), many("specialty", 0.30), many("state", 0.25), dominant])


def tier_counts(scores: DataFrame, by: str) -> DataFrame:
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *_tier_counts(), F.count_if(F.col("risk_tier").isin("critical", "high")).alias("elevated"))


def yearly_trend(spend: DataFrame, years: tuple[int, ...], cap: float) -> DataFrame:
    """By year: total in millions, entities near (75 %) and at the cap, mean."""
    rows = spend.unpivot("hcp_id", [F.col(f"spend_{y}") for y in years], "name", "spend").withColumn("year", F.substring("name", -4, 4).cast("int"))
    return rows.groupBy("year").agg(F.round(F.sum("spend") / 1e6, 2).alias("total_millions"), F.count_if(F.col("spend") >= 0.75 * cap).alias("near_cap"), F.count_if(F.col("spend") >= cap).alias("at_cap"), F.avg("spend").alias("avg_spend"))


def primary_rep(interactions: DataFrame) -> DataFrame:
    """An entity's most frequent representative (ties to the smaller id)."""
    counts = interactions.where("rep_id is not null").groupBy("hcp_id", "rep_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("hcp_id").agg(F.min_by("rep_id", F.struct(-F.col("n"), "rep_id")).alias("primary_rep"), F.max("n").alias("interactions"))


def rep_edges(interactions: DataFrame) -> DataFrame:
    """(rep_id, hcp_id, interactions, is_primary)."""
    edges = interactions.where("rep_id is not null").groupBy("hcp_id", "rep_id").agg(F.count(F.lit(1)).alias("interactions"))
    return edges.join(primary_rep(interactions).select("hcp_id", "primary_rep"), "hcp_id").withColumn("is_primary", F.col("rep_id") == F.col("primary_rep")).drop("primary_rep")


def rep_leaderboard(scores: DataFrame, reps: DataFrame) -> DataFrame:
    rows = scores.join(reps.select("hcp_id", "primary_rep"), "hcp_id")
    return rows.groupBy("primary_rep").agg(F.count(F.lit(1)).alias("entities"), *_tier_counts(), F.sum("risk_score").alias("total_risk"), F.avg("risk_score").alias("avg_risk"))


def rep_panel(edges: DataFrame, scores: DataFrame) -> DataFrame:
    rows = edges.join(scores.select("hcp_id", "risk_tier", "risk_score"), "hcp_id")
    return rows.groupBy("rep_id").agg(F.count_distinct("hcp_id").alias("entities"), *_tier_counts(), F.count_if("is_primary").alias("primary_edges"), F.count_if(~F.col("is_primary")).alias("secondary_edges"), F.avg("risk_score").alias("avg_risk"))


def two_hop(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, hop): the starts, the other side's nodes linked to them, and what these are linked to besides."""
    links = edges.select(F.col("rep_id").alias("a"), F.col("hcp_id").alias("b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    zero = starts.select(F.col("node")).distinct()
    one = both.join(zero.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(zero, "node", "left_anti")
    two = both.join(one.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(zero, "node", "left_anti").join(one, "node", "left_anti")
    return zero.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))


def score_stats(df: DataFrame, column: str) -> DataFrame:
    ps = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    df = kept(df.select(column))
    row = df.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.max(column).alias("most"))
    return row.crossJoin(quantile_columns(df, {f"p{round(p * 100)}": (column, p) for p in ps}))  # one row each


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins from low to high, the last one closed."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, column: str, by: str) -> DataFrame:
    places = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}
    return quantile_columns(df, {name: (column, p) for name, p in places.items()}, [by])


def rank_bands(df: DataFrame, rank: str) -> DataFrame:
    """Five right-closed bands of a fractional rank."""
    band = reduce(lambda out, x: F.when(F.col(rank) <= x[0], x[1]).otherwise(out), reversed([(0.25, "0-25"), (0.5, "25-50"), (0.75, "50-75"), (0.9, "75-90")]), F.lit("90-100"))
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def pearson_importance(df: DataFrame, columns: list[str], target: str, n: int = 20) -> DataFrame:
    """Correlation of each feature with the score, 0 for constants; the largest by absolute value."""
    row = df.agg(*[F.coalesce(F.nanvl(F.corr(c, target), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns])
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in columns])).alias("x")).select("x.*")
    return rows.withColumn("importance", F.abs("correlation")).orderBy(F.desc("importance"), "feature").limit(n)


def label_metrics(df: DataFrame) -> DataFrame:
    """predicted and label: the four cells, precision, recall and F1."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    row = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    precision, recall = (F.when(F.col("tp") + F.col(o) > 0, F.col("tp") / (F.col("tp") + F.col(o))).otherwise(0.0) for o in ("fp", "fn"))
    return row.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def threshold_eval(df: DataFrame, scores: list[str], labels: list[str], shares: tuple[float, ...] = (0.01, 0.05, 0.10), natural: tuple[str, ...] = (), key: str = "hcp_id") -> DataFrame:
    """A row for each score, label and cut: rows flagged, hits, precision, recall, F1, lift, base rate and the share flagged.

    The cuts are the ceil(n * share) rows of the highest score (ties by key; rows without a score last), and, for the scores in
    ``natural``, the rows above 0. Every score's places come from one pass over all scores; each label's counts from another.
    """
    ones = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"_{i}") for i, c in enumerate(labels)]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("score"), (-F.col(c).cast("double")).alias("_low"), F.col(c).isNull().alias("_none")) for c in scores])).alias("x")
    long = df.select(F.col(key).alias("_key"), *ones, each).select("_key", *[f"_{i}" for i in range(len(labels))], "x.*")
    long = long.withColumn("_low", F.coalesce("_low", F.lit(float("inf"))))
    placed = with_places(long, ["score"], "_low", "_key")
    least = [(F.ceil(F.col("total") * F.lit(round(share * 10_000)) / 10_000), f"top {share:g}", share, None) for share in shares]
    cuts = [F.struct(F.lit(name).alias("cut"), (F.col("so_far") <= k).alias("flagged"), F.lit(True).alias("shown")) for k, name, _, _ in least]
    above = F.struct(F.lit("above 0").alias("cut"), (~F.col("_none") & (F.col("_low") < 0)).alias("flagged"), F.col("score").isin(*natural).alias("shown"))
    rows = placed.select("score", "total", *[f"_{i}" for i in range(len(labels))], F.explode(F.array(*cuts, above)).alias("c")).where("c.shown")
    summed = rows.groupBy("score", "c.cut").agg(F.max("total").alias("rows"), F.count_if("c.flagged").alias("k"), *[F.sum(f"_{i}").alias(f"ones_{i}") for i in range(len(labels))], *[F.sum(F.when(F.col("c.flagged"), F.col(f"_{i}")).otherwise(0)).alias(f"hits_{i}") for i in range(len(labels))])
    found = summed.select("score", "cut", "rows", "k", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"ones_{i}").alias("ones"), F.col(f"hits_{i}").alias("hits")) for i, c in enumerate(labels)])).alias("l")).select("score", "l.label", "cut", "rows", "k", "l.ones", "l.hits")
    precision, recall = F.when(F.col("k") > 0, F.col("hits") / F.col("k")).otherwise(0.0), F.when(F.col("ones") > 0, F.col("hits") / F.col("ones")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return found.select("score", "label", "cut", "k", "hits", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.when(F.col("ones") > 0, precision / (F.col("ones") / F.col("rows"))).otherwise(0.0).alias("lift"), (F.col("ones") / F.col("rows")).alias("base_rate"), (F.col("k") / F.col("rows")).alias("flagged_share"))


def topk_eval(df: DataFrame, score: str, label: str, shares: tuple[float, ...] = (0.01, 0.05, 0.10), key: str = "doc_id") -> DataFrame:
    """Precision, recall, F1 and lift among the ceil(n * share) rows of the highest score (ties by key)."""
    share = F.substring_index("cut", " ", -1).cast("double").alias("share")
    return threshold_eval(df, [score], [label], shares, key=key).select(share, "k", "hits", "precision", "recall", "f1", "lift")


def rankings(long: DataFrame) -> DataFrame:
    """(model, roc_auc, average_precision) of rows (model, s, y): from mean ranks, and the precision at each positive row's score."""
    placed = with_places(long.where("s is not null"), ["model"], "s", "y")
    placed = kept(placed.select("model", "s", "y", "below", "same", "total"))
    ones, n = F.sum("y"), F.max("total")
    ranks = F.sum(F.when(F.col("y") == 1, F.col("below") + (F.col("same") + 1) / 2))
    auc = placed.groupBy("model").agg(((ranks - ones * (ones + 1) / 2) / (ones * (n - ones))).alias("roc_auc"))
    # among the positive rows alone, those of the same score or more, by all rows of the same score or more
    positive = placed.where("y = 1").select("model", "s", (F.col("total") - F.col("below")).alias("rows_above"))
    precision = (F.col("total") - F.col("below")) / F.col("rows_above")
    ap = with_places(positive, ["model"], "s", "rows_above").groupBy("model").agg(F.avg(precision).alias("average_precision"))
    return auc.join(ap, "model", "left")


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC-AUC from mean ranks, and average precision over distinct scores."""
    return rankings(df.select(F.lit(score).alias("model"), F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))).drop("model")


def flag_cooccurrence(flags: DataFrame, names: list[str], n: int = 10) -> DataFrame:
    """Pairs of the n most frequent flags, with the entities that have both. One pass: no join of flags with themselves."""
    counts = flags.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names]).first()
    top = sorted(names, key=lambda c: (-(counts[c] or 0), c))[:n]
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    row = flags.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(min(p)).alias("flag_a"), F.lit(max(p)).alias("flag_b"), F.col(f"{i}").alias("n")) for i, p in enumerate(pairs)])).alias("x")).select("x.*")


def state_profile(scores: DataFrame, least: int, k: int) -> DataFrame:
    """States of a size by elevated share, with every measure also scaled to 0-1 among those shown."""
    n = F.count(F.lit(1))
    rows = scores.groupBy("state").agg(n.alias("n"), F.avg("risk_score").alias("avg_risk"), (F.count_if(F.col("risk_tier").isin("critical", "high")) / n).alias("elevated_share")).where(F.col("n") >= least).orderBy(F.desc("elevated_share"), "state").limit(k)
    w = Window.partitionBy()
    for c in ("avg_risk", "elevated_share"):
        spread = F.max(c).over(w) - F.min(c).over(w)
        rows = rows.withColumn(f"{c}_scaled", F.when(spread > 0, (F.col(c) - F.min(c).over(w)) / spread).otherwise(0.0))
    return rows


def top_n_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def overview_kpis(scores: DataFrame, n: int = 100) -> DataFrame:
    """Totals, elevated share, and the mean of each tier's top scores."""
    top = top_n_per(scores, "risk_tier", [F.desc("risk_score"), F.col("hcp_id")], n).groupBy("risk_tier").agg(F.avg("risk_score").alias("m"))
    total = scores.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk_tier").isin("critical", "high")).alias("elevated"))
    return total.crossJoin(top.agg(F.avg("m").alias("stratified_top_score"))).withColumn("elevated_share", F.col("elevated") / F.col("total"))


def median_quadrants(df: DataFrame, x: str, y: str) -> DataFrame:
    df = kept(df.select(x, y))
    m = quantile_columns(df, {"mx": (x, 0.5), "my": (y, 0.5)}).crossJoin(df.agg(F.count(F.lit(1)).alias("all")))  # one row each
    side = F.concat(F.when(F.col(x) > F.col("mx"), "high").otherwise("low"), F.lit("-"), F.when(F.col(y) > F.col("my"), "high").otherwise("low"))
    return df.crossJoin(F.broadcast(m)).groupBy(side.alias("cell")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.max("all")).alias("share"))


def peer_percentile(df: DataFrame, column: str, by: str) -> DataFrame:
    """Three percentiles within the peers: mean rank, share strictly below, share not above."""
    below, same, n = F.col("below"), F.col("same"), F.col("total")
    placed = with_places(df.select("hcp_id", by, column), [by], column, "hcp_id")
    return placed.select("hcp_id", by, column, ((below + (same + 1) / 2) / n).alias("mean_rank"), (below / n).alias("below"), ((below + same) / n).alias("not_above"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def investigation_queue(scores: DataFrame, n: int = 50) -> DataFrame:
    best = scores.orderBy(F.desc("risk_score"), "hcp_id").limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("risk_score"), "hcp_id")))


def top_features(df: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """Of each row, the features of the largest absolute value, with their sign."""
    rows = df.unpivot(key, columns, "feature", "value").withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("value")), "feature")))
    return rows.where(F.col("place") <= n).withColumn("direction", F.when(F.col("value") > 0, "high").when(F.col("value") < 0, "low").otherwise("none"))


def tov_long(payments: DataFrame) -> DataFrame:
    """Transfer of value by entity and year: four kinds by name, all companies' total, count, and the target's share."""
    name, amount = F.lower("nature_of_payment"), F.col("payment_amount")

    def kind(*words: str) -> Column:
        return F.sum(F.when(F.col("is_target") & reduce(Column.__or__, [name.contains(w) for w in words]), amount).otherwise(0.0))

    own = F.sum(F.when(F.col("is_target"), amount).otherwise(0.0))
    return payments.groupBy("hcp_id", "program_year").agg(kind("food").alias("meals"), kind("speaker", "faculty").alias("speaking"), kind("consult").alias("consulting"), kind("travel").alias("travel"), F.sum(amount).alias("all_companies"), F.count(F.lit(1)).alias("payments"), (own / F.nullif(F.sum(amount), F.lit(0.0))).alias("share_of_wallet"))


def tov_wide(long: DataFrame, years: tuple[int, ...], measures: list[str]) -> DataFrame:
    """Columns measure_year; a pair that isn't there is null."""
    return long.groupBy("hcp_id").agg(*[F.max(F.when(F.col("program_year") == y, F.col(m))).alias(f"{m}_{y}") for y in years for m in measures])


def yearly_totals(payments: DataFrame, years: tuple[int, ...]) -> DataFrame:
    rows = payments.groupBy("hcp_id").pivot("program_year", list(years)).agg(F.sum("payment_amount")).fillna(0.0)
    return rows.select("hcp_id", *[F.col(str(y)).alias(f"total_{y}") for y in years], reduce(Column.__add__, [F.col(str(y)) for y in years]).alias("total_all"))


def payment_mix(wide: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """By year: own payments and what is left of the total for others; years without any are left out."""
    own = F.coalesce(*[F.when(F.col("year") == y, sum((F.coalesce(f"{m}_{y}", F.lit(0.0)) for m in ("meals", "speaking", "consulting", "travel")), F.lit(0.0))) for y in years])
    total = F.coalesce(*[F.when(F.col("year") == y, F.coalesce(f"all_companies_{y}", F.lit(0.0))) for y in years])
    rows = wide.withColumn("year", F.explode(F.array(*map(F.lit, years)))).select("hcp_id", "year", own.alias("own"), total.alias("total"))
    return rows.where("total > 0").select("hcp_id", "year", "own", F.greatest(F.lit(0.0), F.col("total") - F.col("own")).alias("other_payers"))


def first_seen(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in columns])


def internal_totals(parts: list[DataFrame]) -> DataFrame:
    """Totals of (hcp_id, program_year, component, amount): a union and one aggregate instead of chained outer joins."""
    return reduce(DataFrame.unionByName, parts).groupBy("hcp_id", "program_year").agg(F.sum("amount").alias("internal_total"), F.count_distinct("component").alias("components"))


def reconcile(internal: DataFrame, reported: DataFrame) -> DataFrame:
    """Gap of each entity and year: perfect under 0.1 %, minor to 5 %, else major over 10 %, moderate between."""
    rows = internal.join(reported, ["hcp_id", "program_year"], "full").fillna(0.0, ["internal_total", "reported_total"])
    gap = F.when(F.col("reported_total") > 0, F.abs(F.col("internal_total") - F.col("reported_total")) / F.col("reported_total"))
    return rows.withColumn("gap", gap).withColumn("band", F.when(F.col("gap").isNull(), "unreported").when(F.col("gap") < 0.001, "perfect").when(F.col("gap") <= 0.05, "minor").when(F.col("gap") > 0.10, "major").otherwise("moderate"))


def reconcile_report(rows: DataFrame, largest: int = 3) -> DataFrame:
    """By year: entities in each band of the gap, totals, the gap's mean, median, 95th percentile and maximum, and its largest entities.

    largest: the ``largest`` entities of the largest reported total (ties by hcp_id), each as hcp_id:gap in basis points.
    """
    rows = kept(rows)
    g = F.col("gap")
    report = rows.groupBy("program_year").agg(
        F.count_if(g < 0.01).alias("under_1"), F.count_if((g >= 0.01) & (g < 0.05)).alias("from_1_to_5"), F.count_if((g >= 0.05) & (g < 0.10)).alias("from_5_to_10"), F.count_if(g >= 0.10).alias("over_10"),
        F.sum("internal_total").alias("internal"), F.sum("reported_total").alias("reported"), F.avg(g).alias("mean_gap"), F.max(g).alias("max_gap"),
    )
    cuts = quantile_columns(rows, {"median_gap": ("gap", 0.5), "p95_gap": ("gap", 0.95)}, ["program_year"])
    # Spark keeps so many rows of a year in each task before it exchanges them
    top = top_n_per(rows.where("reported_total > 0"), "program_year", [F.desc("reported_total"), F.col("hcp_id")], largest)
    named = F.concat("hcp_id", F.lit(":"), F.round(g * 10_000 * 1.0000000001).cast("long").cast("string"))
    top = top.groupBy("program_year").agg(F.array_sort(F.collect_list(F.struct("place", named.alias("x")))).alias("t")).select("program_year", F.array_join(F.col("t.x"), " ").alias("largest"))
    return report.join(cuts, "program_year", "left").join(top, "program_year", "left")


def attribution_importance(df: DataFrame, columns: list[str], score: str | None = None, share: float = 0.01, key: str = "hcp_id") -> DataFrame:
    """Mean absolute attribution of each feature and its percentage of the sum.

    score: also mean_abs_top, the mean among the ceil(n * share) rows of the highest score (ties by key).
    """
    aggs = [F.avg(F.abs(c)).alias(c) for c in columns]
    if score:
        low = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))).alias("_low")
        df = with_places(df.select(key, low, *columns), [], "_low", key)
        top = F.col("so_far") <= F.ceil(F.col("total") * F.lit(round(share * 10_000)) / 10_000)
        aggs += [F.avg(F.when(top, F.abs(c))).alias(f"_top_{c}") for c in columns]
    row = df.agg(*aggs)
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs"), *([F.col(f"_top_{c}").alias("mean_abs_top")] if score else [])) for c in columns])).alias("x")).select("x.*")
    return rows.withColumn("pct_of_total", F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy()) * 100)  # a row for each feature


def eval_summary(df: DataFrame, category: str, metric: str) -> DataFrame:
    """By category and over all: mean, median, least, most, count without NaN, nearest-rank 95th percentile."""
    rows = df.where(F.col(metric).isNotNull() & ~F.isnan(metric)).select(F.col(category).alias("category"), F.col(metric).cast("double").alias("x"))
    rows = kept(rows.select(F.explode(F.array("category", F.lit("ALL"))).alias("category"), "x"))
    k = F.ceil(F.col("total") * 0.95)
    placed = with_places(rows, ["category"], "x", "x")
    stats = placed.groupBy("category").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.count(F.lit(1)).alias("n"), F.max(F.when((F.col("below") < k) & (k <= F.col("below") + F.col("same")), F.col("x"))).alias("p95"))
    median = quantile_columns(rows, {"median": ("x", 0.5)}, ["category"]).withColumnRenamed("category", "_category")
    return stats.join(median, F.col("category").eqNullSafe(F.col("_category")), "left").drop("_category")


def latency_stats(df: DataFrame, by: list[str]) -> DataFrame:
    df = kept(df.select(*by, "success", F.when(F.col("success"), F.col("seconds").cast("double")).alias("ok")))
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), F.avg("ok").alias("mean"), F.coalesce(F.stddev_samp("ok"), F.lit(0.0)).alias("std"))
    cuts = quantile_columns(df, {"median": ("ok", 0.5), "p95": ("ok", 0.95), "p99": ("ok", 0.99)}, by).withColumnsRenamed({c: f"_{c}" for c in by})
    return rows.join(cuts, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left").drop(*[f"_{c}" for c in by])


def eval_delta(current: DataFrame, previous: DataFrame, metric: str = "mean") -> DataFrame:
    return current.select("category", F.col(metric).alias("now")).join(previous.select("category", F.col(metric).alias("then")), "category", "full").withColumn("delta", F.col("now") - F.col("then"))


def gate_failures(summary: DataFrame, gates: dict[str, float], metric: str = "mean") -> DataFrame:
    """Categories under their gate."""
    gate = F.create_map(*[F.lit(x) for p in gates.items() for x in p])[F.col("category")]
    return summary.withColumn("gate", gate).where(F.col(metric) < F.col("gate"))


def drilldown(payments: DataFrame, hcp_id: str | None = None, year: int | None = None) -> DataFrame:
    """Totals of an entity (of all, if none is named) by year and nature, by year and company, and by year."""
    rows = payments.where(F.col("hcp_id") == hcp_id) if hcp_id else payments
    rows = rows.where(F.col("program_year") == year) if year else rows

    def level(name: str, key: Column) -> DataFrame:
        return rows.groupBy("hcp_id", "program_year", key.alias("key")).agg(F.sum("payment_amount").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(name))

    return reduce(DataFrame.unionByName, [level("nature", F.col("nature_of_payment")), level("company", F.col("company_name")), level("year", F.lit("all"))])


def entity_profile(scores: DataFrame, totals: DataFrame, hcp_id: str) -> DataFrame:
    """One entity's scores with its yearly totals; of columns on both sides the scores' stay."""
    new = [c for c in totals.columns if c not in scores.columns]
    return scores.where(F.col("hcp_id") == hcp_id).join(totals.select("hcp_id", *new), "hcp_id", "left")


def vs_population(df: DataFrame, columns: list[str]) -> DataFrame:
    """(hcp_id, feature, value, mean, direction) of each row against the mean of all."""
    mean = df.agg(*[F.avg(c).alias(c) for c in columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in columns])).alias("m")).select("m.*")
    rows = df.unpivot("hcp_id", columns, "feature", "value").join(F.broadcast(mean), "feature")  # a row for each column
    return rows.withColumn("direction", F.when(F.col("value") > F.col("mean"), "high").otherwise("low"))


def all_pairs(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """The distinct (hcp_id, program_year) of several tables, each named with its two columns; pairs with a null aren't any."""
    pairs = [df.select(F.col(key).alias("hcp_id"), F.col(year).cast("long").alias("program_year")).distinct() for df, key, year in sources]
    return reduce(DataFrame.unionByName, pairs).distinct().where("hcp_id is not null and program_year is not null")


def rate_by(df: DataFrame, by: str, flags: list[str], sizes: list[str] = ()) -> DataFrame:
    """By group: rows, the share of each flag (null counts as not set) and the mean of each size."""
    rates = [F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{c}_rate") for c in flags]
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *rates, *[F.avg(c).alias(f"mean_{c}") for c in sizes])


def filter_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct values of a few low-cardinality columns, sorted, in one row."""
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def investigation_report(scores: DataFrame, flags: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """A nested row an entity: profile, fired flags, top features."""
    fired = flags.select("hcp_id", F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in names])).alias("fired_flags"))
    top = features.groupBy("hcp_id").agg(F.array_sort(F.collect_list(F.struct("place", "feature", "value", "direction"))).alias("top_features"))  # a few of each entity
    profile = F.struct("specialty", "state", "risk_score", "risk_tier", "recommended_action").alias("profile")
    return scores.select("hcp_id", profile).join(fired, "hcp_id", "left").join(top, "hcp_id", "left")


def monitoring_report(distribution: DataFrame, patterns: DataFrame, segments: DataFrame, issues: DataFrame) -> DataFrame:
    """One nested row of the population's reports, each of a few rows."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    parts = [listed(distribution, "distribution"), listed(patterns, "flag_patterns"), listed(segments, "segments"), listed(issues, "issues")]
    return reduce(DataFrame.crossJoin, parts)  # one row each


def compare_models(df: DataFrame, scores: list[str], label: str, contamination: float = 0.10) -> DataFrame:
    """A row for each score column: ROC-AUC, average precision, and precision and recall of the rows above the contamination's quantile.

    All scores go through one long table, which is written once.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("s")) for c in scores])).alias("x")
    long = kept(df.select(F.col(label).cast("int").alias("y"), each).select("x.*", "y"))
    cut = quantiles(long, ["s"], [1 - contamination], ["model"]).select("model", F.col("q").alias("cut"))
    p, y = F.col("s") >= F.col("cut"), F.col("y") == 1
    cells = long.join(F.broadcast(cut), "model").groupBy("model").agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))  # a row for each score column
    precision, recall = (F.when(F.col("tp") + F.col(o) > 0, F.col("tp") / (F.col("tp") + F.col(o))).otherwise(0.0) for o in ("fp", "fn"))
    cells = cells.select("model", precision.alias("precision"), recall.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rankings(long).join(cells, "model").withColumn("f1", f1)


def top_groups(df: DataFrame, by: str, amount: str, member: str, order: list[str], n: int = 10) -> DataFrame:
    """The members of the n groups of the largest total (ties by name), in the order of the list (others after it, by name).

    df: a few rows a group. Gives by, member, amount, total (the group's), place (the group's, from 1) and member_place.
    """
    summed = df.groupBy(by, member).agg(F.sum(amount).alias(amount))
    totals = summed.groupBy(F.col(by).alias("_group")).agg(F.sum(amount).alias("total")).orderBy(F.desc("total"), "_group").limit(n)
    totals = totals.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "_group")))  # n rows
    rows = summed.join(F.broadcast(totals), F.col(by).eqNullSafe(F.col("_group"))).drop("_group")
    known = F.create_map(*[F.lit(x) for p in zip(order, range(len(order)), strict=True) for x in p])[F.col(member)]
    return rows.withColumn("member_place", F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce(known, F.lit(len(order))), member)))  # the members of one of n groups
