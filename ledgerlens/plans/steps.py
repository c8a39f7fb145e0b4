"""SQL of the marts over the driver's views, step by step, for the queries that check the operators."""

from __future__ import annotations

from .fixtures import CONFIG as C

Y1, Y2, Y3 = C.years
A, B, D = (f"{y % 100:02d}" for y in C.years)

STEPS = {
    "staged": f"""SELECT r.record_id, r.program_year, concat('HCP_', CAST(r.profile_id AS STRING)) AS hcp_id, r.profile_id, r.specialty, r.state, coalesce(m.pseudo_name, r.company_raw) AS company_name,
 coalesce(m.is_target, false) AS is_target, coalesce(m.is_competitor, false) AS is_competitor, m.pseudo_name IS NULL AND r.company_raw IS NOT NULL AS is_population_only, r.payment_amount, r.payment_date, r.nature_of_payment
 FROM payments_raw r LEFT JOIN company_map m ON lower(r.company_raw) LIKE concat('%', m.pattern, '%') WHERE r.recipient_type IN {C.recipient_types}""",
    "target": "SELECT * FROM staged WHERE is_target",
    "population": "SELECT * EXCLUDE (has_target) FROM (SELECT *, bool_or(is_target) OVER (PARTITION BY hcp_id) AS has_target FROM staged) WHERE has_target",
    "classified": f"""SELECT *, nature_of_payment = 'Food and Beverage' AS is_meal, lower(nature_of_payment) LIKE '%speaker%' OR lower(nature_of_payment) LIKE '%faculty%' AS is_speaking_fee,
 nature_of_payment = 'Consulting Fee' AS is_consulting, nature_of_payment = 'Food and Beverage' AND payment_amount > {C.meal_limit} AS meal_over_limit,
 CASE WHEN nature_of_payment = 'Food and Beverage' AND payment_amount > {C.meal_limit} THEN (payment_amount - {C.meal_limit}) / {C.meal_limit} END AS meal_overage_pct FROM target""",
    "entity_year": """SELECT hcp_id, program_year, sum(payment_amount) AS year_spend, count(*) AS year_payment_count, sum(CASE WHEN is_meal THEN payment_amount ELSE 0 END) AS year_food_beverage,
 sum(CASE WHEN is_speaking_fee THEN payment_amount ELSE 0 END) AS year_speaking_fee, sum(CASE WHEN is_consulting THEN payment_amount ELSE 0 END) AS year_consulting,
 count(*) FILTER (WHERE is_speaking_fee) AS year_speaking_count, count(*) FILTER (WHERE is_meal) AS year_meal_count, count(*) FILTER (WHERE meal_over_limit) AS year_meals_over_limit,
 max(meal_overage_pct) AS year_max_meal_overage_pct FROM classified GROUP BY hcp_id, program_year""",
    "cross_year": "SELECT hcp_id, sum(year_spend) AS lifetime_total_spend, CAST(sum(year_payment_count) AS BIGINT) AS lifetime_payment_count, sum(year_food_beverage) AS food_beverage_total, sum(year_speaking_fee) AS speaking_fee_total,"
    + " sum(year_consulting) AS consulting_fee_total, CAST(sum(year_speaking_count) AS BIGINT) AS speaking_fee_count, "
    + ", ".join(f"max(CASE WHEN program_year = {y} THEN year_spend ELSE 0 END) AS spend_{y}" for y in C.years)
    + ", count(DISTINCT program_year) AS active_payment_years, CAST(sum(year_meals_over_limit) AS BIGINT) AS meals_over_limit_count, CAST(sum(year_meal_count) AS BIGINT) AS total_meal_count, max(year_max_meal_overage_pct) AS max_meal_overage_pct FROM entity_year GROUP BY hcp_id",
    "reps": """SELECT hcp_id, avg(n) AS avg_unique_reps, max(n) AS max_unique_reps, max(top) AS top_rep_concentration_pct FROM
 (SELECT hcp_id, program_year, count(*) AS n, CAST(max(c) AS DOUBLE) / sum(c) AS top FROM (SELECT hcp_id, program_year, rep_id, count(*) AS c FROM interactions WHERE rep_id IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY hcp_id""",
    "spend": f"""SELECT *, least(100.0, least(30.0, annual_cap_pct_used * 30) + least(25.0, meal_breach_rate * 250) + least(20.0, max_meal_overage_pct * 20) + least(15.0, pct_speaking_fee * 15)
 + CASE WHEN multi_year_increasing_flag THEN 10.0 ELSE 0.0 END) AS raw_spend_risk_score FROM (SELECT m.hcp_id, coalesce(lifetime_total_spend, 0) AS lifetime_total_spend, coalesce(lifetime_payment_count, 0) AS lifetime_payment_count,
 coalesce(spend_{Y1}, 0) AS spend_{Y1}, coalesce(spend_{Y2}, 0) AS spend_{Y2}, coalesce(spend_{Y3}, 0) AS spend_{Y3}, coalesce(peak, 0) AS peak_year_spend, coalesce(active_payment_years, 0) AS active_payment_years,
 coalesce(peak / {C.annual_cap}, 0) AS annual_cap_pct_used, coalesce(peak >= {C.annual_cap}, false) AS at_cap_flag, coalesce(peak >= {C.near_cap}, false) AS near_cap_flag, coalesce(meals_over_limit_count, 0) AS meals_over_limit_count,
 coalesce(CASE WHEN total_meal_count > 0 THEN CAST(meals_over_limit_count AS DOUBLE) / total_meal_count END, 0) AS meal_breach_rate, coalesce(max_meal_overage_pct, 0) AS max_meal_overage_pct,
 CASE WHEN spend_{Y1} > 0 THEN (spend_{Y2} - spend_{Y1}) / spend_{Y1} END AS yoy_growth_{A}{B}, CASE WHEN spend_{Y2} > 0 THEN (spend_{Y3} - spend_{Y2}) / spend_{Y2} END AS yoy_growth_{B}{D},
 coalesce(spend_{Y1} > 0 AND spend_{Y2} > spend_{Y1} AND spend_{Y3} > spend_{Y2}, false) AS multi_year_increasing_flag, coalesce(food_beverage_total / lifetime_total_spend, 0) AS pct_food_beverage,
 coalesce(speaking_fee_total / lifetime_total_spend, 0) AS pct_speaking_fee, coalesce(consulting_fee_total / lifetime_total_spend, 0) AS pct_consulting, coalesce(speaking_fee_total, 0) AS speaking_fee_total,
 coalesce(speaking_fee_count, 0) AS speaking_fee_count, coalesce(consulting_fee_total, 0) AS consulting_fee_total, coalesce(food_beverage_total, 0) AS food_beverage_total,
 coalesce(avg_unique_reps, 0) AS avg_unique_reps, coalesce(max_unique_reps, 0) AS max_unique_reps, coalesce(top_rep_concentration_pct, 0) AS top_rep_concentration_pct, lifetime_total_spend IS NOT NULL AS has_payments
 FROM (SELECT DISTINCT hcp_id FROM master) m LEFT JOIN (SELECT c.*, greatest(spend_{Y1}, spend_{Y2}, spend_{Y3}) AS peak, r.* EXCLUDE (hcp_id) FROM cross_year c LEFT JOIN reps r USING (hcp_id)) f ON m.hcp_id = f.hcp_id)""",
    "attended": "SELECT event_id, count(*) AS attended, count(*) FILTER (WHERE signed_attestation) AS signed_count, CAST(count(*) FILTER (WHERE signed_attestation) AS DOUBLE) / count(*) AS attendees_signed_pct FROM attendees GROUP BY event_id",
    "event_rows": f"""SELECT e.event_id, e.event_date, e.program_year, e.speaker_hcp_id, e.compliance_approved, coalesce(a.attended, e.attendee_count, 0) AS attendee_count, e.speaker_fee, e.venue_cost, e.travel_reimbursement, e.total_program_cost,
 CASE WHEN coalesce(a.attended, e.attendee_count) > 0 THEN e.total_program_cost / coalesce(a.attended, e.attendee_count) ELSE 0 END AS meal_cost_per_attendee,
 CASE WHEN e.total_program_cost > 0 THEN e.venue_cost / e.total_program_cost ELSE 0 END AS venue_cost_pct_of_total, e.speaker_fee / {C.speaker_fee_ceiling} AS speaker_fee_fmv_pct,
 count(*) OVER (PARTITION BY e.speaker_hcp_id, e.program_year) AS events_same_speaker_year,
 CAST(date_diff('day', lag(e.event_date) OVER (PARTITION BY e.speaker_hcp_id, e.program_year ORDER BY e.event_date, e.event_id), e.event_date) AS INTEGER) AS days_since_last_event_same_speaker, coalesce(a.attendees_signed_pct, 0) AS attendees_signed_pct
 FROM speaker_events e LEFT JOIN attended a USING (event_id)""",
    "event_features": f"""SELECT *, attendee_count < {C.min_attendees} AS low_attendance_flag, attendee_count < {C.min_attendees - 1} AS very_low_attendance_flag, meal_cost_per_attendee > {C.cost_per_head} AS cost_per_head_over_limit,
 venue_cost > {C.venue_ceiling} AS high_venue_cost_flag, total_program_cost > {C.total_ceiling} AS over_total_cost_ceiling_flag, speaker_fee > {C.speaker_fee_ceiling} AS speaker_fee_over_fmv_flag,
 events_same_speaker_year > {C.repeat_events} AS repeat_speaker_flag, events_same_speaker_year > {C.high_repeat_events} AS high_repeat_speaker_flag, coalesce(days_since_last_event_same_speaker < {C.rapid_days}, false) AS rapid_repeat_flag,
 attendees_signed_pct < {C.min_signed} AS missing_attestation_flag, least(100.0, least(25.0, (1 - attendees_signed_pct) * 25) + least(1.0, meal_cost_per_attendee / {C.cost_per_head}) * 25 + least(1.0, venue_cost / {C.venue_ceiling}) * 20
 + least(1.0, speaker_fee_fmv_pct) * 20 + CASE WHEN attendee_count < {C.min_attendees} THEN 10.0 ELSE 0.0 END) AS raw_event_risk_score FROM event_rows""",
    "entity_events": """SELECT speaker_hcp_id AS hcp_id, count(*) AS total_events_as_speaker, avg(raw_event_risk_score) AS avg_event_risk_score, max(raw_event_risk_score) AS max_event_risk_score,
 count(*) FILTER (WHERE low_attendance_flag) AS events_with_low_attendance, count(*) FILTER (WHERE speaker_fee_over_fmv_flag) AS events_over_fmv, count(*) FILTER (WHERE missing_attestation_flag) AS events_missing_attestation,
 count(*) FILTER (WHERE rapid_repeat_flag) AS events_rapid_repeat, sum(speaker_fee) AS total_speaker_fees_events, CAST(count(*) FILTER (WHERE speaker_fee_over_fmv_flag) AS DOUBLE) / count(*) AS pct_events_over_fmv FROM event_features GROUP BY 1""",
    "entity_interactions": """SELECT hcp_id, n AS total_interactions, meals AS total_meals, avg_meal_cost, vague AS interactions_with_vague_rationale, approved AS fmv_compliance_rate, unique_reps_interacted,
 least(100.0, least(50.0, n / 100.0 * 50) + least(30.0, (1 - approved) * 30) + least(20.0, vague / n * 20)) AS interaction_frequency_score FROM (SELECT hcp_id, count(*) AS n, count(*) FILTER (WHERE interaction_type = 'meal') AS meals,
 avg(CASE WHEN interaction_type = 'meal' THEN meal_cost END) AS avg_meal_cost, count(*) FILTER (WHERE business_rationale IN ('', 'Meeting', 'Other') OR business_rationale IS NULL) AS vague,
 CAST(count(*) FILTER (WHERE fmv_approved) AS DOUBLE) / count(*) AS approved, count(DISTINCT rep_id) AS unique_reps_interacted FROM interactions GROUP BY hcp_id)""",
    "profile": """SELECT *, total_events_as_speaker > 0 AS has_speaker_events, total_interactions > 0 AS has_interactions, CAST(has_payments AS INTEGER) + CAST(total_events_as_speaker > 0 AS INTEGER) + CAST(total_interactions > 0 AS INTEGER) AS data_completeness_score,
 CAST(at_cap_flag AS INTEGER) + CAST(near_cap_flag AS INTEGER) + CAST(multi_year_increasing_flag AS INTEGER) + CAST(events_over_fmv > 0 AS INTEGER) + CAST(events_with_low_attendance > 0 AS INTEGER) + CAST(events_missing_attestation > 0 AS INTEGER) AS risk_signal_count,
 CASE WHEN w > 0 THEN (CASE WHEN has_payments THEN raw_spend_risk_score * 0.40 ELSE 0 END + CASE WHEN total_events_as_speaker > 0 THEN avg_event_risk_score * 0.35 ELSE 0 END + CASE WHEN total_interactions > 0 THEN interaction_frequency_score * 0.25 ELSE 0 END) / w ELSE 0 END AS combined_raw_risk_score
 FROM (SELECT *, CASE WHEN has_payments THEN 0.40::DOUBLE ELSE 0 END + CASE WHEN total_events_as_speaker > 0 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN total_interactions > 0 THEN 0.25::DOUBLE ELSE 0 END AS w FROM
 (SELECT m.*, s.* EXCLUDE (hcp_id), coalesce(total_events_as_speaker, 0) AS total_events_as_speaker, coalesce(avg_event_risk_score, 0) AS avg_event_risk_score, coalesce(max_event_risk_score, 0) AS max_event_risk_score, coalesce(events_with_low_attendance, 0) AS events_with_low_attendance,
 coalesce(events_over_fmv, 0) AS events_over_fmv, coalesce(events_missing_attestation, 0) AS events_missing_attestation, coalesce(events_rapid_repeat, 0) AS events_rapid_repeat, coalesce(total_speaker_fees_events, 0) AS total_speaker_fees_events, coalesce(pct_events_over_fmv, 0) AS pct_events_over_fmv,
 coalesce(total_interactions, 0) AS total_interactions, coalesce(total_meals, 0) AS total_meals, coalesce(avg_meal_cost, 0) AS avg_meal_cost, coalesce(interactions_with_vague_rationale, 0) AS interactions_with_vague_rationale, coalesce(fmv_compliance_rate, 1) AS fmv_compliance_rate,
 coalesce(unique_reps_interacted, 0) AS unique_reps_interacted, coalesce(interaction_frequency_score, 0) AS interaction_frequency_score FROM master m LEFT JOIN spend s USING (hcp_id) LEFT JOIN entity_events e USING (hcp_id) LEFT JOIN entity_interactions i USING (hcp_id)))""",
}
#: What each step reads.
NEEDS = {
    "target": ["staged"], "population": ["staged"], "classified": ["staged", "target"], "entity_year": ["staged", "target", "classified"], "cross_year": ["staged", "target", "classified", "entity_year"], "reps": [],
    "spend": ["staged", "target", "classified", "entity_year", "cross_year", "reps"], "event_rows": ["attended"], "event_features": ["attended", "event_rows"], "entity_events": ["attended", "event_rows", "event_features"], "entity_interactions": [],
    "profile": ["staged", "target", "classified", "entity_year", "cross_year", "reps", "spend", "attended", "event_rows", "event_features", "entity_events", "entity_interactions"],
}


def steps(*names: str, **more: str) -> dict[str, str]:
    """The named steps with all that they read, in an order that works; more: further steps after them."""
    wanted = {n for name in names for n in [*NEEDS.get(name, []), name]}
    return {n: STEPS[n] for n in STEPS if n in wanted} | more
