"""Record-level checks: running counters of speakers and attendees, bursts, and the violation types of each record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config

#: Violation types by severity.
SEVERITY = {
    "high": ("ANNUAL_COMPENSATION_CAP_EXCEEDED", "SPEAKER_FEE_EXCEEDS_FMV", "SPEAKER_SELECTED_BY_PRESCRIBING", "CMS_RECONCILIATION_GAP", "SPEAKER_VENUE_INAPPROPRIATE"),
    "medium": ("MEAL_COST_EXCESSIVE", "RAPID_INTERACTION_PATTERN", "LOW_ATTENDEE_COUNT", "REPEAT_SAME_TOPIC_PROGRAMS", "SPEAKER_RAPID_REPEAT", "ALCOHOL_PROVIDED", "REPEAT_PROGRAM_ATTENDANCE", "NON_HCP_ATTENDEES"),
    "low": ("VAGUE_BUSINESS_RATIONALE", "ATTENDEE_SAME_OFFICE_AS_SPEAKER"),
}
#: Venues and attendees that a program shouldn't have, and texts that say nothing.
VENUES = ("resort", "casino", "golf_club")
NON_PROFESSIONALS = ("staff", "guest", "spouse", "administrator")
VAGUE = ("meeting", "other", "discussion", "follow up", "n/a")


def ytd_total(interactions: DataFrame) -> DataFrame:
    """Running total of the year by date (ties by id), to cents."""
    w = Window.partitionBy("hcp_id", "program_year").orderBy("interaction_date", "interaction_id").rowsBetween(Window.unboundedPreceding, 0)
    return interactions.withColumn("annual_total_ytd", F.round(F.sum("payment_amount").over(w), 2))


def weekly_burst(interactions: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Marks every row of an entity, representative, calendar year and ISO week with more rows than allowed."""
    w = Window.partitionBy("hcp_id", "rep_id", F.year("interaction_date"), F.weekofyear("interaction_date"))
    return interactions.withColumn("weekly_count", F.count(F.lit(1)).over(w)).withColumn("weekly_burst", F.col("weekly_count") > cfg.weekly_interactions)


def reconciliation_anomaly(interactions: DataFrame, reported: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """Marks rows of an entity and year whose total is off the reported one by more than the tolerance."""
    total = F.sum("payment_amount").over(Window.partitionBy("hcp_id", "program_year"))
    rows = interactions.withColumn("year_total", total).join(reported, ["hcp_id", "program_year"], "left")
    gap = F.abs(F.col("year_total") - F.col("reported_total")) / F.col("reported_total")
    return rows.withColumn("is_reconciliation_anomaly", F.coalesce((F.col("reported_total") > 0) & (gap > tolerance), F.lit(False)))


def running_counters(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """What a speaker had done when a program took place: programs of the year, of its topic in the year and ever, fees of the year."""
    order = ("event_date", "event_id")
    year = Window.partitionBy("speaker_hcp_id", "program_year").orderBy(*order)
    topic_year = Window.partitionBy("speaker_hcp_id", "program_topic", "program_year").orderBy(*order)
    topic = Window.partitionBy("speaker_hcp_id", "program_topic").orderBy(*order)
    rows = events.withColumns({
        "times_spoke_this_year": F.row_number().over(year), "times_spoke_same_topic": F.row_number().over(topic_year), "topic_repeat_count": F.row_number().over(topic),
        "annual_speaker_compensation": F.round(F.sum("speaker_fee").over(year.rowsBetween(Window.unboundedPreceding, 0)), 2),
    })
    return rows.withColumn("repeat_speaker", F.col("times_spoke_this_year") > cfg.repeat_events)


def rapid_pairs(events: DataFrame, days: int = 30) -> DataFrame:
    """Marks both programs of a pair of one speaker, one after the other, within so many days (not on one day)."""
    w = Window.partitionBy("speaker_hcp_id").orderBy("event_date", "event_id")
    before, after = F.datediff("event_date", F.lag("event_date").over(w)), F.datediff(F.lead("event_date").over(w), "event_date")
    return events.withColumn("rapid_pair", F.coalesce(before.between(1, days - 1), F.lit(False)) | F.coalesce(after.between(1, days - 1), F.lit(False)))


def attendance_counters(attendees: DataFrame) -> DataFrame:
    """How often an attendee had been to the topic."""
    w = Window.partitionBy("attendee_hcp_id", "program_topic").orderBy("event_date", "event_id", "attendee_id")
    return attendees.withColumn("times_attended_same_topic", F.row_number().over(w))


def violation_columns(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """violation_types (comma-joined, in the order of checks), violation_severity, is_violation."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    worst = reduce(lambda out, s: F.when(F.arrays_overlap("found", F.array(*map(F.lit, SEVERITY[s]))), s).otherwise(out), ("medium", "high"), F.when(F.size("found") > 0, "low").otherwise("none"))
    return df.withColumn("found", found).withColumns({"violation_types": F.concat_ws(",", "found"), "violation_severity": worst, "is_violation": F.size("found") > 0}).drop("found")


def interaction_violations(interactions: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Meal cost, vague text, weekly burst and running total over the cap."""
    rows = weekly_burst(ytd_total(interactions), cfg)
    kind = F.col("meal_type") if "meal_type" in interactions.columns else F.lit(None).cast("string")
    limit = F.coalesce(*[F.when(kind == k, v) for k, v in cfg.interaction_meal_limits], F.lit(cfg.other_meal_limit))
    text = F.trim(F.coalesce("business_rationale", F.lit("")))
    checks = {
        "MEAL_COST_EXCESSIVE": F.col("meal_cost") > limit,
        "VAGUE_BUSINESS_RATIONALE": (F.length(text) < 15) | F.lower(text).isin(*VAGUE),
        "RAPID_INTERACTION_PATTERN": F.col("weekly_burst"),
        "ANNUAL_COMPENSATION_CAP_EXCEEDED": F.col("annual_total_ytd") > cfg.annual_cap,
    }
    if "is_reconciliation_anomaly" in interactions.columns:
        checks["CMS_RECONCILIATION_GAP"] = F.col("is_reconciliation_anomaly")
    return violation_columns(rows, checks)


def event_violations(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Venue, fee, choice by prescribing, attendance, repeats, alcohol and cap. Missing columns don't fire."""
    rows = rapid_pairs(running_counters(events, cfg), cfg.rapid_days)

    def has(name: str, condition) -> dict[str, Column]:
        return {name: condition()} if condition is not None else {}

    columns = set(events.columns)
    benchmark = F.col("fmv_benchmark") if "fmv_benchmark" in columns else F.lit(cfg.speaker_fee_ceiling)
    checks: dict[str, Column] = {}
    if "venue_type" in columns:
        checks["SPEAKER_VENUE_INAPPROPRIATE"] = F.col("venue_type").isin(*VENUES)
    checks |= {
        "SPEAKER_FEE_EXCEEDS_FMV": F.col("speaker_fee") > benchmark,
        "SPEAKER_SELECTED_BY_PRESCRIBING": (F.col("times_spoke_this_year") > 4) & (F.col("annual_speaker_compensation") > benchmark * 4),
        "LOW_ATTENDEE_COUNT": F.col("attendee_count") < cfg.min_attendees,
        "REPEAT_SAME_TOPIC_PROGRAMS": F.col("times_spoke_same_topic") > cfg.repeat_events,
        "SPEAKER_RAPID_REPEAT": F.col("rapid_pair"),
    }
    if "alcohol_provided" in columns:
        checks["ALCOHOL_PROVIDED"] = F.col("alcohol_provided")
    checks["ANNUAL_COMPENSATION_CAP_EXCEEDED"] = F.col("annual_speaker_compensation") > cfg.annual_cap
    return violation_columns(rows, checks)


def attendee_violations(attendees: DataFrame, repeats: int = 3) -> DataFrame:
    rows = attendance_counters(attendees)
    checks = {"REPEAT_PROGRAM_ATTENDANCE": F.col("times_attended_same_topic") >= repeats, "NON_HCP_ATTENDEES": F.col("attendee_type").isin(*NON_PROFESSIONALS)}
    if "same_office_as_speaker" in attendees.columns:
        checks["ATTENDEE_SAME_OFFICE_AS_SPEAKER"] = F.col("same_office_as_speaker")
    return violation_columns(rows, checks)


def violation_ground_truth(interactions: DataFrame, events: DataFrame) -> DataFrame:
    """Interactions and events with their violations, as one relation."""
    columns = ["program_year", "violation_types", "violation_severity", "is_violation"]
    one = interactions.select(F.col("interaction_id").cast("long").alias("record_id"), "hcp_id", F.lit("interaction").alias("record_type"), *columns)
    return one.unionByName(events.select(F.col("event_id").cast("long").alias("record_id"), F.col("speaker_hcp_id").alias("hcp_id"), F.lit("speaker_event").alias("record_type"), *columns))


def violation_frequency(df: DataFrame, n: int = 5) -> DataFrame:
    types = df.where("violation_types <> ''").select(F.explode(F.split("violation_types", ",")).alias("violation_type"))
    return types.groupBy("violation_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "violation_type").limit(n)


def fmv_benchmark(df: DataFrame, card: DataFrame) -> DataFrame:
    """Rate by (specialty, tier), else by ('Other', tier)."""
    other = card.where("specialty = 'Other'").select("tier", F.col("rate").alias("other"))
    return df.join(F.broadcast(card), ["specialty", "tier"], "left").join(F.broadcast(other), "tier", "left").withColumn("fmv_benchmark", F.coalesce("rate", "other")).drop("rate", "other")  # a rate card
