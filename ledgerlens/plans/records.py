"""Queries over record-level checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import records as R
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query

YTD = "SELECT *, round(sum(payment_amount) OVER (PARTITION BY hcp_id, program_year ORDER BY interaction_date, interaction_id ROWS UNBOUNDED PRECEDING), 2) AS annual_total_ytd, count(*) OVER (PARTITION BY hcp_id, rep_id, year(interaction_date), weekofyear(interaction_date)) AS weekly_count FROM interactions"
COUNTERS = f"""SELECT *, row_number() OVER (PARTITION BY speaker_hcp_id, program_year ORDER BY event_date, event_id) AS times_spoke_this_year, row_number() OVER (PARTITION BY speaker_hcp_id, program_topic, program_year ORDER BY event_date, event_id) AS times_spoke_same_topic,
 row_number() OVER (PARTITION BY speaker_hcp_id, program_topic ORDER BY event_date, event_id) AS topic_repeat_count, round(sum(speaker_fee) OVER (PARTITION BY speaker_hcp_id, program_year ORDER BY event_date, event_id ROWS UNBOUNDED PRECEDING), 2) AS annual_speaker_compensation,
 coalesce(date_diff('day', lag(event_date) OVER w, event_date) BETWEEN 1 AND {C.rapid_days - 1}, false) OR coalesce(date_diff('day', event_date, lead(event_date) OVER w) BETWEEN 1 AND {C.rapid_days - 1}, false) AS rapid_pair FROM speaker_events WINDOW w AS (PARTITION BY speaker_hcp_id ORDER BY event_date, event_id)"""


def joined(checks: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items())
    return f"[x FOR x IN [{listed}] IF x IS NOT NULL]"


def severity(found: str) -> str:
    return f"CASE WHEN list_has_any({found}, {list(R.SEVERITY['high'])}) THEN 'high' WHEN list_has_any({found}, {list(R.SEVERITY['medium'])}) THEN 'medium' WHEN len({found}) > 0 THEN 'low' ELSE 'none' END"


TEXT = "trim(coalesce(business_rationale, ''))"
ICHECKS = {"MEAL_COST_EXCESSIVE": f"meal_cost > {C.other_meal_limit}", "VAGUE_BUSINESS_RATIONALE": f"length({TEXT}) < 15 OR lower({TEXT}) IN {R.VAGUE}", "RAPID_INTERACTION_PATTERN": f"weekly_count > {C.weekly_interactions}", "ANNUAL_COMPENSATION_CAP_EXCEEDED": f"annual_total_ytd > {C.annual_cap}"}
ECHECKS = {
    "SPEAKER_FEE_EXCEEDS_FMV": f"speaker_fee > {C.speaker_fee_ceiling}", "SPEAKER_SELECTED_BY_PRESCRIBING": f"times_spoke_this_year > 4 AND annual_speaker_compensation > {4 * C.speaker_fee_ceiling}", "LOW_ATTENDEE_COUNT": f"attendee_count < {C.min_attendees}",
    "REPEAT_SAME_TOPIC_PROGRAMS": f"times_spoke_same_topic > {C.repeat_events}", "SPEAKER_RAPID_REPEAT": "rapid_pair", "ANNUAL_COMPENSATION_CAP_EXCEEDED": f"annual_speaker_compensation > {C.annual_cap}",
}
IVIOLATIONS = f"SELECT *, array_to_string(f, ',') AS violation_types, {severity('f')} AS violation_severity, len(f) > 0 AS is_violation FROM (SELECT *, {joined(ICHECKS)} AS f FROM ytd)"
EVIOLATIONS = f"SELECT *, array_to_string(f, ',') AS violation_types, {severity('f')} AS violation_severity, len(f) > 0 AS is_violation FROM (SELECT *, {joined(ECHECKS)} AS f FROM counters)"
TRUTH = "SELECT interaction_id AS record_id, hcp_id, 'interaction' AS record_type, program_year, violation_types, violation_severity, is_violation FROM iv UNION ALL SELECT event_id, speaker_hcp_id, 'speaker_event', program_year, violation_types, violation_severity, is_violation FROM ev"
ALL = {"ytd": YTD, "counters": COUNTERS, "iv": IVIOLATIONS, "ev": EVIOLATIONS, "truth": TRUTH}
ATTENDED = "SELECT a.*, e.event_date, e.program_topic, row_number() OVER (PARTITION BY attendee_hcp_id, program_topic ORDER BY event_date, a.event_id, attendee_id) AS times_attended_same_topic FROM attendees a JOIN speaker_events e ON a.event_id = e.event_id"
ACHECKS = {"REPEAT_PROGRAM_ATTENDANCE": "times_attended_same_topic >= 3", "NON_HCP_ATTENDEES": f"attendee_type IN {R.NON_PROFESSIONALS}"}


def interactions(spark, sf_dir):
    return R.interaction_violations(view(spark, sf_dir, "interactions"), C)


def events(spark, sf_dir):
    return R.event_violations(view(spark, sf_dir, "speaker_events"), C)


def truth(spark, sf_dir):
    return R.violation_ground_truth(interactions(spark, sf_dir), events(spark, sf_dir))


@query(sql("SELECT interaction_id, annual_total_ytd, weekly_count, violation_types, violation_severity, is_violation FROM iv", doubles="annual_total_ytd", ytd=YTD, iv=IVIOLATIONS))
def interaction_violations(spark, sf_dir):
    return interactions(spark, sf_dir).select("interaction_id", "annual_total_ytd", "weekly_count", "violation_types", "violation_severity", "is_violation")


@query(sql("SELECT event_id, CAST(times_spoke_this_year AS INTEGER) AS times_spoke_this_year, CAST(times_spoke_same_topic AS INTEGER) AS times_spoke_same_topic, CAST(topic_repeat_count AS INTEGER) AS topic_repeat_count, annual_speaker_compensation, rapid_pair, violation_types, violation_severity FROM ev", doubles="annual_speaker_compensation", counters=COUNTERS, ev=EVIOLATIONS))
def event_violations(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "times_spoke_this_year", "times_spoke_same_topic", "topic_repeat_count", "annual_speaker_compensation", "rapid_pair", "violation_types", "violation_severity")


@query(sql(f"SELECT attendee_id, event_id, CAST(times_attended_same_topic AS INTEGER) AS times_attended_same_topic, array_to_string(f, ',') AS violation_types, {severity('f')} AS violation_severity FROM (SELECT *, {joined(ACHECKS)} AS f FROM attended_rows)", attended_rows=ATTENDED))
def attendee_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "attendees").join(view(spark, sf_dir, "speaker_events").select("event_id", "event_date", "program_topic"), "event_id")
    return R.attendee_violations(rows).select("attendee_id", "event_id", "times_attended_same_topic", "violation_types", "violation_severity")


@query(sql("SELECT * FROM truth", **ALL))
def violation_ground_truth(spark, sf_dir):
    return truth(spark, sf_dir)


@query(sql("SELECT hcp_id, count(*) FILTER (WHERE is_violation) AS ground_truth_violation_count, CASE max(CASE violation_severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS ground_truth_max_severity FROM truth GROUP BY hcp_id", **ALL))
def entity_labels(spark, sf_dir):
    return E.entity_labels(truth(spark, sf_dir))


@query(sql("SELECT x AS violation_type, count(*) AS n FROM (SELECT unnest(string_split(violation_types, ',')) AS x FROM truth WHERE violation_types <> '') GROUP BY 1 ORDER BY n DESC, x LIMIT 5", **ALL))
def violation_frequency(spark, sf_dir):
    return R.violation_frequency(truth(spark, sf_dir))


@query(sql("SELECT * EXCLUDE (business_rationale) FROM interactions", doubles="meal_cost payment_amount"))
def interaction_features_only(spark, sf_dir):
    """A projection that leaves labels and texts out."""
    return view(spark, sf_dir, "interactions").drop("business_rationale", "violation_types", "violation_severity", "is_violation")


REPORTED = "SELECT hcp_id, program_year, round(sum(payment_amount) * CASE WHEN CAST(substr(hcp_id, 5) AS INTEGER) % 3 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 2) AS reported_total FROM interactions GROUP BY hcp_id, program_year"


@query(sql("SELECT interaction_id, coalesce(reported_total > 0 AND abs(total - reported_total) / reported_total > 0.1, false) AS is_reconciliation_anomaly FROM (SELECT *, sum(payment_amount) OVER (PARTITION BY hcp_id, program_year) AS total FROM interactions) LEFT JOIN reported USING (hcp_id, program_year)", reported=REPORTED))
def reconciliation_anomaly(spark, sf_dir):
    rows = view(spark, sf_dir, "interactions")
    factor = F.when(F.substring("hcp_id", 5, 20).cast("int") % 3 == 0, 1.2).otherwise(1.0)
    reported = rows.groupBy("hcp_id", "program_year").agg(F.sum("payment_amount").alias("t")).select("hcp_id", "program_year", F.round(F.col("t") * factor, 2).alias("reported_total"))
    return R.reconciliation_anomaly(rows, reported).select("interaction_id", "is_reconciliation_anomaly")
