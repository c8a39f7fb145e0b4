"""Speaker events: attendance, repeats of a speaker, flags and risk; interactions and labels of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .payments import share, steady, zero_filled


def attendance(attendees: DataFrame) -> DataFrame:
    signed = F.count_if("signed_attestation")
    return attendees.groupBy("event_id").agg(F.count(F.lit(1)).alias("attended"), signed.alias("signed_count"), (signed.cast("double") / F.count(F.lit(1))).alias("attendees_signed_pct"))


def speaker_windows(events: DataFrame) -> DataFrame:
    """Events of the speaker in the year, and days since the one before (ties of a date by event_id)."""
    by = Window.partitionBy("speaker_hcp_id", "program_year")
    before = F.lag("event_date").over(by.orderBy("event_date", "event_id"))
    return events.withColumns({"events_same_speaker_year": F.count(F.lit(1)).over(by), "days_since_last_event_same_speaker": F.datediff("event_date", before)})


def event_features(events: DataFrame, attendees: DataFrame, cfg: Config = Config()) -> DataFrame:
    money = ["speaker_fee", "venue_cost", "travel_reimbursement", "total_program_cost"]
    rows = speaker_windows(events.where("event_id is not null").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in money}))
    rows = rows.join(attendance(attendees), "event_id", "left").withColumns({"attendee_count": F.coalesce("attended", F.col("attendee_count").cast("long"), F.lit(0)), "attendees_signed_pct": F.coalesce("attendees_signed_pct", F.lit(0.0))})
    total, n = F.col("total_program_cost"), F.col("attendee_count")
    rows = rows.withColumns({"meal_cost_per_attendee": F.when(n > 0, total / n).otherwise(0.0), "venue_cost_pct_of_total": share(F.col("venue_cost"), total), "speaker_fee_fmv_pct": F.col("speaker_fee") / cfg.speaker_fee_ceiling})
    gap = F.col("days_since_last_event_same_speaker")
    rows = rows.withColumns({
        "low_attendance_flag": n < cfg.min_attendees, "very_low_attendance_flag": n < cfg.min_attendees - 1, "cost_per_head_over_limit": F.col("meal_cost_per_attendee") > cfg.cost_per_head,
        "high_venue_cost_flag": F.col("venue_cost") > cfg.venue_ceiling, "over_total_cost_ceiling_flag": total > cfg.total_ceiling, "speaker_fee_over_fmv_flag": F.col("speaker_fee") > cfg.speaker_fee_ceiling,
        "repeat_speaker_flag": F.col("events_same_speaker_year") > cfg.repeat_events, "high_repeat_speaker_flag": F.col("events_same_speaker_year") > cfg.high_repeat_events,
        "rapid_repeat_flag": F.coalesce(gap < cfg.rapid_days, F.lit(False)), "missing_attestation_flag": F.col("attendees_signed_pct") < cfg.min_signed,
    })
    rows = rows.withColumn("raw_event_risk_score", event_risk(cfg))
    return rows.select("event_id", "event_date", "program_year", "speaker_hcp_id", "compliance_approved", "attendee_count", *money, "meal_cost_per_attendee", "venue_cost_pct_of_total", "speaker_fee_fmv_pct", "events_same_speaker_year", "days_since_last_event_same_speaker", "attendees_signed_pct", *[c for c in rows.columns if c.endswith("_flag") or c == "cost_per_head_over_limit"], "raw_event_risk_score")


def event_risk(cfg: Config) -> Column:
    """0-100: attestation gap 25, cost a head 25, venue 20, fee 20, low attendance 10; each ratio counts to 1."""

    def part(ratio: Column, points: float) -> Column:
        return F.least(F.lit(1.0), ratio) * points

    return F.least(
        F.lit(100.0),
        F.least(F.lit(25.0), (1 - F.col("attendees_signed_pct")) * 25) + part(F.col("meal_cost_per_attendee") / cfg.cost_per_head, 25.0) + part(F.col("venue_cost") / cfg.venue_ceiling, 20.0)
        + part(F.col("speaker_fee_fmv_pct"), 20.0) + F.when(F.col("low_attendance_flag"), 10.0).otherwise(0.0),
    )


def entity_events(features: DataFrame) -> DataFrame:
    over = F.count_if("speaker_fee_over_fmv_flag")
    return features.groupBy(F.col("speaker_hcp_id").alias("hcp_id")).agg(
        F.count(F.lit(1)).alias("total_events_as_speaker"), steady(F.avg("raw_event_risk_score")).alias("avg_event_risk_score"), F.max("raw_event_risk_score").alias("max_event_risk_score"),
        F.count_if("low_attendance_flag").alias("events_with_low_attendance"), over.alias("events_over_fmv"), F.count_if("missing_attestation_flag").alias("events_missing_attestation"),
        F.count_if("rapid_repeat_flag").alias("events_rapid_repeat"), steady(F.sum("speaker_fee")).alias("total_speaker_fees_events"), (over.cast("double") / F.count(F.lit(1))).alias("pct_events_over_fmv"),
    )


def events_of_matrix(matrix: DataFrame) -> DataFrame:
    """entity_events() from scoring.event_matrix(), which holds the same aggregates."""
    n = F.col("total_events_as_speaker")
    return matrix.select(
        "hcp_id", n, steady(F.col("raw_event_risk_score_mean")).alias("avg_event_risk_score"), F.col("raw_event_risk_score_max").alias("max_event_risk_score"),
        F.col("low_attendance_flag_sum").alias("events_with_low_attendance"), F.col("speaker_fee_over_fmv_flag_sum").alias("events_over_fmv"), F.col("missing_attestation_flag_sum").alias("events_missing_attestation"),
        F.col("rapid_repeat_flag_sum").alias("events_rapid_repeat"), steady(F.col("speaker_fee_sum")).alias("total_speaker_fees_events"), (F.col("speaker_fee_over_fmv_flag_sum").cast("double") / n).alias("pct_events_over_fmv"),
    )


def entity_interactions(interactions: DataFrame, cfg: Config = Config()) -> DataFrame:
    return merged_interactions(interaction_years(interactions, cfg), interactions.select("hcp_id", "rep_id").where("rep_id is not null"))


def interaction_years(interactions: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each entity's and year's sums, from which merged_interactions() makes the entity's row."""
    meal = F.col("interaction_type") == "meal"
    cost = F.when(meal, F.col("meal_cost"))
    vague = F.count_if(F.col("business_rationale").isin(*cfg.vague_texts) | F.col("business_rationale").isNull())
    return interactions.groupBy("hcp_id", "program_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(meal).alias("meals"), F.sum(cost).alias("meal_cost"), F.count(cost).alias("meal_costs"), vague.alias("vague"), F.count_if("fmv_approved").alias("approved"))


def merged_interactions(years: DataFrame, reps: DataFrame) -> DataFrame:
    """An entity's interactions over its years. reps: rows (hcp_id, rep_id), repeats allowed."""
    n, vague = F.sum("n"), F.sum("vague")
    approved = F.sum("approved").cast("double") / n
    score = F.least(F.lit(100.0), F.least(F.lit(50.0), n.cast("double") / 100 * 50) + F.least(F.lit(30.0), (1 - approved) * 30) + F.least(F.lit(20.0), vague.cast("double") / n * 20))
    rows = years.groupBy("hcp_id").agg(n.alias("total_interactions"), F.sum("meals").alias("total_meals"), steady(F.sum("meal_cost") / F.nullif(F.sum("meal_costs"), F.lit(0))).alias("avg_meal_cost"), vague.alias("interactions_with_vague_rationale"), approved.alias("fmv_compliance_rate"), score.alias("interaction_frequency_score"))
    met = reps.groupBy(F.col("hcp_id").alias("_hcp")).agg(F.count_distinct("rep_id").alias("unique_reps_interacted"))
    rows = rows.join(met, F.col("hcp_id").eqNullSafe(F.col("_hcp")), "left").drop("_hcp").fillna(0, ["unique_reps_interacted"])
    return rows.select("hcp_id", "total_interactions", "total_meals", "avg_meal_cost", "interactions_with_vague_rationale", "fmv_compliance_rate", "unique_reps_interacted", "interaction_frequency_score")


SEVERITIES = ("none", "low", "medium", "high")


def entity_labels(violations: DataFrame) -> DataFrame:
    """Number of violations and the worst severity, in the order none, low, medium, high."""
    order = F.coalesce(*[F.when(F.col("violation_severity") == s, i) for i, s in enumerate(SEVERITIES)], F.lit(0))
    return violations.groupBy("hcp_id").agg(F.count_if("is_violation").alias("ground_truth_violation_count"), F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(order) + 1).alias("ground_truth_max_severity"))


def risk_profile(entities: DataFrame, spend: DataFrame, events: DataFrame, interactions: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The spine with spend, event and interaction signals, presence flags, signal count and combined score."""
    spend_columns = "lifetime_total_spend peak_year_spend annual_cap_pct_used at_cap_flag near_cap_flag meal_breach_rate max_meal_overage_pct pct_speaking_fee multi_year_increasing_flag raw_spend_risk_score has_payments".split()
    rows = entities.join(spend.select("hcp_id", *spend_columns), "hcp_id", "left").join(events, "hcp_id", "left").join(interactions, "hcp_id", "left")
    rows = rows.withColumn("fmv_compliance_rate", F.coalesce("fmv_compliance_rate", F.lit(1.0)))
    if labels is not None:
        rows = rows.join(labels, "hcp_id", "left").withColumn("ground_truth_max_severity", F.coalesce("ground_truth_max_severity", F.lit("none")))
    rows = zero_filled(rows)
    has = [F.col("has_payments"), F.col("total_events_as_speaker") > 0, F.col("total_interactions") > 0]
    signals = [F.col("at_cap_flag"), F.col("near_cap_flag"), F.col("multi_year_increasing_flag"), *[F.col(c) > 0 for c in ("events_over_fmv", "events_with_low_attendance", "events_missing_attestation")]]
    return rows.withColumns({
        "has_speaker_events": has[1], "has_interactions": has[2], "data_completeness_score": sum((h.cast("int") for h in has), F.lit(0)),
        "risk_signal_count": sum((s.cast("int") for s in signals), F.lit(0)), "combined_raw_risk_score": combined_risk(has),
    })


def combined_risk(has: list[Column]) -> Column:
    """Weights .40, .35 and .25, spread over the sources that are there; 0 without any."""
    weights, scores = (0.40, 0.35, 0.25), ("raw_spend_risk_score", "avg_event_risk_score", "interaction_frequency_score")
    weight = sum((F.when(h, w).otherwise(0.0) for h, w in zip(has, weights, strict=True)), F.lit(0.0))
    total = sum((F.when(h, F.col(s) * w).otherwise(0.0) for h, s, w in zip(has, scores, weights, strict=True)), F.lit(0.0))
    return steady(F.when(weight > 0, total / weight).otherwise(0.0))
