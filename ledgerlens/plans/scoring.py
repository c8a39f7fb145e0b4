"""Queries over feature matrices, rule flags and risk scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from . import benchmarks, marts
from .fixtures import CONFIG as C
from .fixtures import sql
from .registry import query
from .steps import Y1, Y2, Y3, steps

SQL_AGG = {"mean": "avg({c})", "max": "max({c})", "min": "min({c})", "sum": "sum({c})", "std": "coalesce(stddev_samp({c}), 0)"}
FLAGS = "low_attendance_flag very_low_attendance_flag cost_per_head_over_limit high_venue_cost_flag over_total_cost_ceiling_flag speaker_fee_over_fmv_flag repeat_speaker_flag high_repeat_speaker_flag rapid_repeat_flag missing_attestation_flag".split()
MATRIX = f"""SELECT *, low_attendance_flag_sum / CAST(total_events_as_speaker AS DOUBLE) AS pct_events_low_attendance, speaker_fee_over_fmv_flag_sum / CAST(total_events_as_speaker AS DOUBLE) AS pct_events_over_fmv,
 missing_attestation_flag_sum / CAST(total_events_as_speaker AS DOUBLE) AS pct_events_missing_attestation, rapid_repeat_flag_sum / CAST(total_events_as_speaker AS DOUBLE) AS pct_events_rapid_repeat,
 CASE WHEN raw_event_risk_score_mean > 0 THEN raw_event_risk_score_std / raw_event_risk_score_mean ELSE 0 END AS event_risk_score_cv FROM (SELECT speaker_hcp_id AS hcp_id,
 {", ".join(("CAST(" + SQL_AGG[f].format(c=c) + " AS BIGINT)" if (c, f) in (("attendee_count", "sum"), ("attendee_count", "min")) else SQL_AGG[f].format(c=c)) + f" AS {c}_{f}" for c, fs in S.EVENT_AGGREGATES.items() for f in fs)},
 {", ".join(f"CAST(sum(CAST({c} AS INTEGER)) AS BIGINT) AS {c}_sum" for c in FLAGS)}, count(*) AS total_events_as_speaker FROM event_features GROUP BY 1)"""
MATRIX_DOUBLES = " ".join(f"{c}_{f}" for c, fs in S.EVENT_AGGREGATES.items() for f in fs if (c, f) not in (("attendee_count", "sum"), ("attendee_count", "min"))) + " pct_events_low_attendance pct_events_over_fmv pct_events_missing_attestation pct_events_rapid_repeat event_risk_score_cv"
NEAR = " + ".join(f"CAST(spend_{y} >= {C.near_cap} AS INTEGER)" for y in C.years)
#: Flag, condition, severity and rule id, for SQL.
RULES = [
    ("flag_meal_limit_breach", "meal_breach_rate > 0", "medium", "MEAL_003"), ("flag_meal_chronic_breach", "meal_breach_rate > 0.10", "high", "MEAL_003"), ("flag_meal_overage_severe", "max_meal_overage_pct > 0.50", "high", "MEAL_003"),
    *[(f"flag_annual_cap_breach_{y}", f"spend_{y} >= {C.annual_cap}", "critical", "COMP_001") for y in C.years], (f"flag_near_cap_{Y3}", f"spend_{Y3} >= {C.near_cap}", "high", "COMP_001"), ("flag_chronic_near_cap", f"{NEAR} >= 2", "high", "COMP_001"),
    ("flag_speaker_fmv_breach", "coalesce(speaker_fee_over_fmv_flag_sum, 0) > 0", "high", "SPEAKER_001"), ("flag_speaker_fmv_chronic", "coalesce(x.pct_events_over_fmv, 0) > 0.25", "critical", "SPEAKER_001"),
    ("flag_repeat_speaker", "coalesce(repeat_speaker_flag_sum, 0) > 0", "medium", "SPEAKER_003"), ("flag_high_repeat_speaker", "coalesce(high_repeat_speaker_flag_sum, 0) > 0", "high", "SPEAKER_002"),
    ("flag_low_attendance_pattern", "coalesce(pct_events_low_attendance, 0) > 0.25", "high", "SPEAKER_004"), ("flag_rapid_repeat_pattern", "coalesce(pct_events_rapid_repeat, 0) > 0.20", "medium", "SPEAKER_005"),
    ("flag_missing_attestation", f"coalesce(attendees_signed_pct_min, 1) < {C.min_signed}", "medium", "ATTEST_001"), ("flag_chronic_missing_attestation", "coalesce(pct_events_missing_attestation, 0) > 0.25", "high", "ATTEST_001"),
    ("flag_vague_rationale", "interactions_with_vague_rationale > 0", "medium", "ATTEST_002"), ("flag_vague_rationale_pattern", "CASE WHEN total_interactions > 0 THEN interactions_with_vague_rationale / CAST(total_interactions AS DOUBLE) ELSE 0 END > 0.20", "high", "ATTEST_002"),
    ("flag_fmv_non_compliance", f"fmv_compliance_rate < {C.fmv_rate}", "high", "ATTEST_003"), ("flag_rep_concentration", "top_rep_concentration_pct > 0.80", "medium", "POLICY"), ("flag_speaking_fee_concentration", "pct_speaking_fee > 0.70", "high", "SPEAKER_001"),
    ("flag_escalating_spend", "multi_year_increasing_flag", "medium", "POLICY"), ("flag_escalating_rank", "escalating_rank", "medium", "POLICY"),
]
FLAG_SQL = f"SELECT p.hcp_id, {', '.join(f'{c} AS {n}' for n, c, _, _ in RULES)} FROM profile p LEFT JOIN matrix x USING (hcp_id) LEFT JOIN climbing k USING (hcp_id)"
CLIMB = f"SELECT hcp_id, r2 - r1 > 0 AND r3 - r2 > 0 AS escalating_rank FROM (SELECT hcp_id, {', '.join(f'percent_rank() OVER (PARTITION BY specialty ORDER BY spend_{y}) AS r{i}' for i, y in enumerate(C.years, 1))} FROM profile)"


def counted(severity: str | None) -> str:
    return " + ".join(f"CAST({n} AS INTEGER)" for n, _, s, _ in RULES if severity in (None, s))


IDS = "array_to_string([x for x in [" + ", ".join(f"CASE WHEN {n} THEN {i} END" for i, (n, _, _, _) in enumerate(RULES)) + "] if x IS NOT NULL], ',')"
FIRST = {r: min(i for i, x in enumerate(RULES) if x[3] == r) for r in dict.fromkeys(x[3] for x in RULES)}
# a rule's id stands at its first flag that fired: the flags of one rule in order, then the rules by that place
RULE_IDS = "array_to_string(list_transform(list_sort([x for x in [" + ", ".join("{'p': least(" + ", ".join(f"CASE WHEN {x[0]} THEN {i} ELSE 99 END" for i, x in enumerate(RULES) if x[3] == r) + f"), 'r': '{r}'}}" for r in FIRST) + "] if x.p < 99]), lambda x: x.r), ',')"
SUMMARY = f"SELECT *, {counted(None)} AS total_rule_flags, {', '.join(f'{counted(s)} AS {s}_flags' for s in S.SEVERITY_POINTS)}, {RULE_IDS} AS flagged_rule_ids FROM flags"
WORST = "CASE WHEN critical_flags > 0 THEN 'critical' WHEN high_flags > 0 THEN 'high' WHEN medium_flags > 0 THEN 'medium' ELSE 'none' END AS most_severe_flag"
SCORES = f"""SELECT *, CASE WHEN critical_flags > 0 AND tier IN ('low', 'medium') THEN 'high' ELSE tier END AS risk_tier FROM (SELECT *, CASE WHEN risk_score >= 60 THEN 'critical' WHEN risk_score >= 25 THEN 'high' WHEN risk_score >= 10 THEN 'medium' ELSE 'low' END AS tier
 FROM (SELECT *, least(100.0, greatest(0.0, rule_score * 0.6 + anomaly_score * 0.4)) AS risk_score FROM (SELECT s.*, {WORST}, least(100.0, critical_flags * 40.0 + high_flags * 20.0 + medium_flags * 10.0) AS rule_score, anomaly_score
 FROM summary s JOIN (SELECT hcp_id, (combined_raw_risk_score - min(combined_raw_risk_score) OVER ()) / (max(combined_raw_risk_score) OVER () - min(combined_raw_risk_score) OVER ()) * 100 AS anomaly_score FROM profile) USING (hcp_id))))"""
ALL = steps("profile", matrix=MATRIX, climbing=CLIMB, flags=FLAG_SQL, summary=SUMMARY, scores=SCORES)
SCORE_COLUMNS = "hcp_id total_rule_flags critical_flags high_flags medium_flags most_severe_flag flagged_rule_ids rule_score anomaly_score risk_score risk_tier"


def matrix(spark, sf_dir):
    return S.event_matrix(marts.features_of_events(spark, sf_dir))


def flags(spark, sf_dir):
    from ..operators.benchmarks import peer_ranks

    spend, profile, matrix = marts.stored(spark, sf_dir, with_matrix=True)
    rows = S.merge_all(profile.drop("pct_events_over_fmv"), spend, matrix)
    by_year = profile.select("hcp_id", "specialty").join(spend.select("hcp_id", *[f"spend_{y}" for y in C.years]), "hcp_id")
    ranks = peer_ranks(by_year, {f"r{i}": (("specialty",), f"spend_{y}") for i, y in enumerate(C.years, 1)})
    return S.apply_rules(rows.join(ranks.select("hcp_id", ((F.col("r2") > F.col("r1")) & (F.col("r3") > F.col("r2"))).alias("escalating_rank")), "hcp_id"), C)


def summary(spark, sf_dir):
    return S.flag_summary(flags(spark, sf_dir), C)


def scores(spark, sf_dir):
    """Risk scores with the scaled heuristic score in the anomaly score's place."""
    flagged = summary(spark, sf_dir)  # first, as it wants the event matrix
    anomalies = S.minmax_100(marts.profile(spark, sf_dir).select("hcp_id", "combined_raw_risk_score"), "combined_raw_risk_score", "anomaly_score")
    return S.risk_scores(flagged, anomalies)


@query(sql("SELECT * FROM matrix", doubles=MATRIX_DOUBLES, **steps("event_features", matrix=MATRIX)))
def event_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query(sql("SELECT * FROM flags", **ALL))
def rule_flags(spark, sf_dir):
    return flags(spark, sf_dir)


@query(sql(f"SELECT hcp_id, total_rule_flags, critical_flags, high_flags, medium_flags, total_rule_flags > 0 AS has_any_flag, critical_flags > 0 AS has_critical_flag, {WORST}, flagged_rule_ids FROM summary", **ALL))
def rule_summary(spark, sf_dir):
    return summary(spark, sf_dir).select("hcp_id", "total_rule_flags", "critical_flags", "high_flags", "medium_flags", "has_any_flag", "has_critical_flag", "most_severe_flag", "flagged_rule_ids")


@query(sql(f"SELECT {SCORE_COLUMNS.replace(' ', ', ')} FROM scores", doubles="rule_score anomaly_score risk_score", **ALL))
def risk_scores(spark, sf_dir):
    return scores(spark, sf_dir).select(*SCORE_COLUMNS.split())


SCALED = ["lifetime_total_spend", "meal_breach_rate", "raw_spend_risk_score"]


@query(sql("SELECT hcp_id, " + ", ".join(f"({c} - q_{c}[2]) / CASE WHEN q_{c}[3] = q_{c}[1] THEN 1 ELSE q_{c}[3] - q_{c}[1] END AS {c}" for c in SCALED) + " FROM spend, (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q_{c}" for c in SCALED) + " FROM spend)", doubles=" ".join(SCALED), **steps("spend")))
def robust_scaled_spend(spark, sf_dir):
    return S.robust_scale(marts.spend(spark, sf_dir).select("hcp_id", *SCALED), SCALED)


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, q[2] AS median, CASE WHEN q[3] = q[1] THEN 1 ELSE q[3] - q[1] END AS iqr FROM (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM spend)" for c in SCALED), doubles="median iqr", **steps("spend")))
def robust_parameters(spark, sf_dir):
    return S.robust_parameters(marts.spend(spark, sf_dir), SCALED)


@query(sql(f"SELECT hcp_id, rank() OVER (ORDER BY combined_raw_risk_score) / CAST(count(*) OVER () AS DOUBLE) AS percentile FROM profile", doubles="percentile", places=6, **steps("profile")), places=6)
def global_percentile(spark, sf_dir):
    from ..operators.benchmarks import frac_rank_global

    return frac_rank_global(marts.profile(spark, sf_dir).select("hcp_id", "combined_raw_risk_score"), "combined_raw_risk_score", "percentile").drop("combined_raw_risk_score")


@query(sql("SELECT " + ", ".join(f"CAST({c} AS INTEGER) AS {c}" if c.endswith("flag") else c for c in ("meal_breach_rate", "at_cap_flag", "multi_year_increasing_flag")) + f", coalesce(yoy_growth_{Y1 % 100}{Y2 % 100}, 0) AS yoy_growth_{Y1 % 100}{Y2 % 100} FROM spend", doubles=f"meal_breach_rate yoy_growth_{Y1 % 100}{Y2 % 100}", **steps("spend")))
def numeric_matrix(spark, sf_dir):
    rows = S.fill_nulls(marts.spend(spark, sf_dir)).select("hcp_id", "meal_breach_rate", "at_cap_flag", "multi_year_increasing_flag", f"yoy_growth_{Y1 % 100}{Y2 % 100}")
    return S.numeric_matrix(rows)
