"""Feature matrices, rule flags and risk scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources.io import kept
from .ranks import quantiles

_AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "std": lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))}

#: How events aggregate to their speaker.
EVENT_AGGREGATES = {
    "raw_event_risk_score": ("mean", "max", "std"), "attendee_count": ("mean", "min", "sum"), "speaker_fee": ("mean", "max", "sum"), "total_program_cost": ("mean", "max", "sum"),
    "meal_cost_per_attendee": ("mean", "max"), "speaker_fee_fmv_pct": ("mean", "max"), "attendees_signed_pct": ("mean", "min"),
}
#: Weights of severities, and the least score of each tier.
SEVERITY_POINTS = {"critical": 40, "high": 20, "medium": 10}
TIERS = ((60.0, "critical"), (25.0, "high"), (10.0, "medium"), (0.0, "low"))
ACTIONS = {"critical": "Immediate investigation", "high": "Compliance review", "medium": "Enhanced monitoring", "low": "Routine monitoring"}


def agg_spec(df: DataFrame, key: str, spec: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns ``column_function`` by key; the sample deviation of a single row is 0."""
    return df.groupBy(key).agg(*[_AGGREGATES[f](c).alias(f"{c}_{f}") for c, fs in spec.items() for f in fs])


def event_matrix(features: DataFrame) -> DataFrame:
    """Aggregates of a speaker's events, sums of flags, event count, shares and the variation of risk."""
    flags = [c for c in features.columns if c.endswith("_flag") or c == "cost_per_head_over_limit"]
    aggs = [_AGGREGATES[f](c).alias(f"{c}_{f}") for c, fs in EVENT_AGGREGATES.items() for f in fs]
    rows = features.groupBy(F.col("speaker_hcp_id").alias("hcp_id")).agg(*aggs, *[F.sum(F.col(c).cast("int")).alias(f"{c}_sum") for c in flags], F.count(F.lit(1)).alias("total_events_as_speaker"))
    n, mean = F.col("total_events_as_speaker"), F.col("raw_event_risk_score_mean")
    shares = {"pct_events_low_attendance": "low_attendance_flag", "pct_events_over_fmv": "speaker_fee_over_fmv_flag", "pct_events_missing_attestation": "missing_attestation_flag", "pct_events_rapid_repeat": "rapid_repeat_flag"}
    return rows.withColumns({k: F.when(n > 0, F.col(f"{c}_sum") / n).otherwise(0.0) for k, c in shares.items()} | {"event_risk_score_cv": F.when(mean > 0, F.col("raw_event_risk_score_std") / mean).otherwise(0.0)})


def numeric_matrix(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Numbers and flags only, flags as 0 and 1."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    return df.select(*[F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes if (t in kinds or t.startswith("decimal")) and c not in exclude])


def fill_nulls(df: DataFrame, keep: tuple[str, ...] = (), special: dict[str, float] | None = None) -> DataFrame:
    """Null, NaN and infinite numbers to 0, or to what special gives for a name."""
    out = []
    for c, t in df.dtypes:
        value = F.lit((special or {}).get(c, 0))
        if c in keep or t in ("string", "date", "timestamp"):
            out.append(F.col(c))
        elif t in ("double", "float"):
            bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            out.append(F.when(bad, value.cast(t)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.coalesce(c, F.lit(False) if t == "boolean" else value.cast(t)).alias(c))
    return df.select(*out)


def minmax_100(df: DataFrame, column: str, name: str) -> DataFrame:
    """0-100 between the least and the largest value; 50 if they are the same."""
    bounds = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    spread = F.col("high") - F.col("low")
    return df.crossJoin(F.broadcast(bounds)).withColumn(name, F.when(spread < 1e-9, 50.0).otherwise((F.col(column) - F.col("low")) / spread * 100)).drop("low", "high")


def robust_parameters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, median, iqr), an IQR of 0 as 1."""
    found = quantiles(df, columns, (0.25, 0.5, 0.75)).groupBy(F.col("column").alias("feature")).pivot("p", [0.25, 0.5, 0.75]).agg(F.max("q"))
    iqr = F.col("`0.75`") - F.col("`0.25`")
    return found.select("feature", F.col("`0.5`").alias("median"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR of each column."""
    df = kept(df)
    row = robust_parameters(df, columns).groupBy().pivot("feature", columns).agg(F.first(F.struct("median", "iqr")))
    row = row.select(*[F.col(c).alias(f"p_{c}") for c in columns])
    scaled = df.crossJoin(F.broadcast(row)).withColumns({c: (F.col(c) - F.col(f"p_{c}.median")) / F.col(f"p_{c}.iqr") for c in columns})
    return scaled.drop(*[f"p_{c}" for c in columns])


def col_or(df: DataFrame, name: str, default: float) -> Column:
    """The column with its nulls as default, or the default if there is no such column."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))


def rule_definitions(df: DataFrame, cfg: Config) -> dict[str, tuple[Column, str, str]]:
    """Flag -> (condition, severity, rule id). Missing columns count as 0, rates that are good when high as 1."""

    def c(name: str, default: float = 0.0) -> Column:
        return col_or(df, name, default)

    y1, y2, y3 = cfg.years
    near = sum(((c(f"spend_{y}") >= cfg.near_cap).cast("int") for y in cfg.years), F.lit(0))
    n = c("total_interactions", 1.0)
    vague = F.when(n > 0, c("interactions_with_vague_rationale") / n).otherwise(0.0)
    return {
        "flag_meal_limit_breach": (c("meal_breach_rate") > 0, "medium", "MEAL_003"),
        "flag_meal_chronic_breach": (c("meal_breach_rate") > 0.10, "high", "MEAL_003"),
        "flag_meal_overage_severe": (c("max_meal_overage_pct") > 0.50, "high", "MEAL_003"),
        f"flag_annual_cap_breach_{y1}": (c(f"spend_{y1}") >= cfg.annual_cap, "critical", "COMP_001"),
        f"flag_annual_cap_breach_{y2}": (c(f"spend_{y2}") >= cfg.annual_cap, "critical", "COMP_001"),
        f"flag_annual_cap_breach_{y3}": (c(f"spend_{y3}") >= cfg.annual_cap, "critical", "COMP_001"),
        f"flag_near_cap_{y3}": (c(f"spend_{y3}") >= cfg.near_cap, "high", "COMP_001"),
        "flag_chronic_near_cap": (near >= 2, "high", "COMP_001"),
        "flag_speaker_fmv_breach": (c("speaker_fee_over_fmv_flag_sum") > 0, "high", "SPEAKER_001"),
        "flag_speaker_fmv_chronic": (c("pct_events_over_fmv") > 0.25, "critical", "SPEAKER_001"),
        "flag_repeat_speaker": (c("repeat_speaker_flag_sum") > 0, "medium", "SPEAKER_003"),
        "flag_high_repeat_speaker": (c("high_repeat_speaker_flag_sum") > 0, "high", "SPEAKER_002"),
        "flag_low_attendance_pattern": (c("pct_events_low_attendance") > 0.25, "high", "SPEAKER_004"),
        "flag_rapid_repeat_pattern": (c("pct_events_rapid_repeat") > 0.20, "medium", "SPEAKER_005"),
        "flag_missing_attestation": (c("attendees_signed_pct_min", 1.0) < cfg.min_signed, "medium", "ATTEST_001"),
        "flag_chronic_missing_attestation": (c("pct_events_missing_attestation") > 0.25, "high", "ATTEST_001"),
        "flag_vague_rationale": (c("interactions_with_vague_rationale") > 0, "medium", "ATTEST_002"),
        "flag_vague_rationale_pattern": (vague > 0.20, "high", "ATTEST_002"),
        "flag_fmv_non_compliance": (c("fmv_compliance_rate", 1.0) < cfg.fmv_rate, "high", "ATTEST_003"),
        "flag_rep_concentration": (c("top_rep_concentration_pct") > 0.80, "medium", "POLICY"),
        "flag_speaking_fee_concentration": (c("pct_speaking_fee") > 0.70, "high", "SPEAKER_001"),
        "flag_escalating_spend": (c("multi_year_increasing_flag") == 1, "medium", "POLICY"),
        "flag_escalating_rank": (c("escalating_rank") > 0, "medium", "POLICY"),
    }


def apply_rules(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """hcp_id and the flags."""
    return df.select("hcp_id", *[condition.alias(name) for name, (condition, _, _) in rule_definitions(df, cfg).items()])


def flag_summary(flags: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Counts by severity, whether any or a critical one fired, the most severe, and the ids of fired rules in order."""
    rules = {k: v for k, v in rule_definitions(flags, cfg).items() if k in flags.columns}

    def count(severity: str | None) -> Column:
        return sum((F.col(k).cast("int") for k, (_, s, _) in rules.items() if severity in (None, s)), F.lit(0))

    ids = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(k), F.lit(rule)) for k, (_, _, rule) in rules.items()])))
    rows = flags.withColumns({"total_rule_flags": count(None)} | {f"{s}_flags": count(s) for s in SEVERITY_POINTS})
    worst = reduce(lambda out, s: F.when(F.col(f"{s}_flags") > 0, s).otherwise(out), reversed(SEVERITY_POINTS), F.lit("none"))
    return rows.withColumns({"has_any_flag": F.col("total_rule_flags") > 0, "has_critical_flag": F.col("critical_flags") > 0, "most_severe_flag": worst, "flagged_rule_ids": F.concat_ws(",", ids)})


def rule_score() -> Column:
    """Points of the fired flags by severity, 100 at most."""
    return F.least(F.lit(100.0), sum((F.col(f"{s}_flags") * float(p) for s, p in SEVERITY_POINTS.items()), F.lit(0.0)))


def risk_scores(summary: DataFrame, anomalies: DataFrame) -> DataFrame:
    """0.6 * rule score + 0.4 * anomaly score, and its tier; a critical flag makes it high at least."""
    rows = summary.join(anomalies.select("hcp_id", "anomaly_score"), "hcp_id").withColumn("rule_score", rule_score())
    rows = rows.withColumn("risk_score", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("rule_score") * 0.6 + F.col("anomaly_score") * 0.4)))
    tier = reduce(lambda out, t: F.when(F.col("risk_score") >= t[0], t[1]).otherwise(out), reversed(TIERS), F.lit("low"))
    rows = rows.withColumn("tier", tier).withColumn("risk_tier", F.when(F.col("has_critical_flag") & F.col("tier").isin("low", "medium"), "high").otherwise(F.col("tier"))).drop("tier")
    return rows.withColumn("recommended_action", F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("risk_tier")])


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key repeats on a side or lacks its partner."""
    marked = [d.groupBy(key).count().select(key, F.col("count").alias(n)) for d, n in ((a, "a"), (b, "b"))]
    bad = marked[0].join(marked[1], key, "full").where("a is null or b is null or a > 1 or b > 1").limit(1).count()
    if bad:
        raise ValueError(f"{key} isn't one to one")
    return a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key)


def merge_all(first: DataFrame, *others: DataFrame, key: str = "hcp_id") -> DataFrame:
    """Left joins that take new columns only."""
    return reduce(lambda a, b: a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key, "left"), others, first)


def flag_citations(flags: DataFrame, rules: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    """(hcp_id, flag, rule_id, threshold, citation) of each fired flag: its first rule that exists, cited by the rule's first source."""
    spec = flags.sparkSession.createDataFrame([(f, i, r) for f, rs in ids.items() for i, r in enumerate(rs)], "flag string, place int, rule_id string")
    chosen = spec.join(rules, "rule_id").groupBy("flag").agg(F.min_by(F.struct("rule_id", "threshold", "citation"), "place").alias("rule"))
    fired = flags.select("hcp_id", *ids).unpivot("hcp_id", list(ids), "flag", "fired").where("fired").drop("fired")
    return fired.join(F.broadcast(chosen), "flag", "left").select("hcp_id", "flag", "rule.rule_id", "rule.threshold", "rule.citation")  # a row for each flag there is


#: Authorities in the order in which they are asked.
AUTHORITIES = ("OIG", "Company", "PhRMA", "CMS")


def reconcile_rules(sources: DataFrame, fallback: DataFrame) -> DataFrame:
    """One threshold for each rule: the strictest value given; among equals the authority asked first; else the fallback.

    sources: rule_id, authority, value, threshold_type (maximum: lower is stricter; minimum: higher; else 1 is stricter).
    """
    place = F.array_position(F.array(*map(F.lit, AUTHORITIES)), F.col("authority"))
    strict = F.when(F.col("threshold_type") == "maximum", F.col("value")).otherwise(-F.col("value"))
    known = sources.where(F.col("value").isNotNull() & (place > 0))
    best = known.groupBy("rule_id").agg(F.min_by(F.struct("value", "authority"), F.struct(strict, place)).alias("best"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "authority"))), lambda x: x.authority), ", ").alias("names"))
    rows = fallback.select("rule_id", F.col("value").alias("fallback")).join(best, "rule_id", "full")
    used = F.col("best").isNull()
    note = F.when(used, "No explicit threshold; fallback default used.").when(F.col("n") == 1, F.concat(F.lit("Single source ("), "best.authority", F.lit(")."))).otherwise(F.concat(F.lit("Multiple sources ("), "names", F.lit("). Effective source: "), "best.authority", F.lit(".")))
    return rows.select("rule_id", F.coalesce("best.value", "fallback").alias("threshold"), F.coalesce("best.authority", F.lit("fallback")).alias("effective_source"), (F.col("n") == 1).alias("single_source"), used.alias("used_fallback"), note.alias("note"))


def effective_rules(rules: DataFrame, fallback: DataFrame, default: float | None = None) -> DataFrame:
    """The registry's threshold, else the fallback table's, else a constant."""
    return fallback.withColumnRenamed("threshold", "other").join(rules.select("rule_id", "threshold"), "rule_id", "full").select("rule_id", F.coalesce("threshold", "other", F.lit(default).cast("double")).alias("threshold"))


def infer_scope(rules: DataFrame) -> DataFrame:
    """Time and entity scope of a rule from its name, unit and category."""
    text = F.lower(F.concat_ws(" ", "rule_name", "unit", "category"))

    def pick(pairs: dict[str, tuple[str, ...]], other: str) -> Column:
        return reduce(lambda out, kv: F.when(reduce(Column.__or__, [text.contains(w) for w in kv[1]]), kv[0]).otherwise(out), reversed(list(pairs.items())), F.lit(other))

    return rules.withColumns({"time_scope": pick({"annual": ("annual", "year"), "quarterly": ("quarter",), "monthly": ("month",), "per_event": ("event", "program", "meal")}, "unspecified"), "entity_scope": pick({"speaker": ("speaker",), "attendee": ("attendee", "attest"), "meal": ("meal",), "venue": ("venue",)}, "hcp")})


def compare_rules(rules: DataFrame, fallback: DataFrame) -> DataFrame:
    """Whether the company's value is stricter than the industry's, and the threshold as text."""
    rows = rules.join(fallback.select("rule_id", F.col("threshold").alias("default")), "rule_id", "left")
    company, industry = F.col("company_value"), F.coalesce("industry_value", "default")
    stricter = F.when(F.col("threshold_type") == "minimum", company > industry).otherwise(company < industry)
    return rows.select("rule_id", company.alias("company_value"), industry.alias("industry_value"), F.coalesce(stricter, F.lit(False)).alias("company_stricter"), F.concat(F.format_string("%.2f", F.coalesce(company, industry)), F.lit(" "), "unit").alias("threshold_text"))


def rule_dimensions(rules: DataFrame, columns: tuple[str, ...] = ("time_scope", "entity_scope", "category", "severity")) -> DataFrame:
    """The distinct values of each dimension with the number of rules, as (dimension, value, rules)."""
    return rules.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "dimension", "value").where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rules"))
