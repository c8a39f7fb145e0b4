"""Views that give the driver's tables the shape of payments, interactions, events, attendees and entities.

One text serves Spark and the SQL that checks it: ``{name}`` stands for a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CONFIG = Config(
    years=(1998, 1999, 2000), annual_cap=150_000.0, meal_limit=60_000.0, speaker_fee_ceiling=140_000.0, venue_ceiling=120_000.0, total_ceiling=400_000.0,
    cost_per_head=100_000.0, other_meal_limit=150.0, interaction_meal_limits=(), weekly_interactions=1,
)

VIEWS = {
    "company_map": "SELECT * FROM (VALUES ('brand#2','Target Co',true,false),('brand#3','Peer A',false,true),('brand#4','Peer B',false,true),('brand#5','Peer C',false,true),('brand#6','Peer D',false,true),('brand#7','Peer D',false,true)) AS t(pattern,pseudo_name,is_target,is_competitor)",
    "payments_raw": """SELECT concat(CAST(l.l_orderkey AS STRING), '-', CAST(l.l_linenumber AS STRING), '-', CAST(l.l_partkey AS STRING), '-', CAST(l.l_suppkey AS STRING)) AS record_id, CAST(year(o.o_orderdate) AS BIGINT) AS program_year,
  o.o_custkey AS profile_id, c.c_mktsegment AS specialty, n.n_name AS state, p.p_brand AS company_raw,
  l.l_extendedprice * (1 - l.l_discount) AS payment_amount, CAST(o.o_orderdate AS DATE) AS payment_date,
  CASE o.o_orderpriority WHEN '5-LOW' THEN 'Food and Beverage' WHEN '1-URGENT' THEN 'Compensation for faculty or speaker'
       WHEN '2-HIGH' THEN 'Consulting Fee' WHEN '3-MEDIUM' THEN 'Education' ELSE 'Travel and Lodging' END AS nature_of_payment,
  CASE l.l_returnflag WHEN 'A' THEN 'Covered Recipient Physician' WHEN 'N' THEN 'Covered Recipient Non-Physician Practitioner'
       ELSE 'Covered Recipient Teaching Hospital' END AS recipient_type
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
WHERE year(o.o_orderdate) BETWEEN 1998 AND 2000""",
    "master": """SELECT concat('HCP_', CAST(c.c_custkey AS STRING)) AS hcp_id, c.c_mktsegment AS specialty, n.n_name AS state,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'national' WHEN c.c_custkey % 10 <= 3 THEN 'regional' ELSE 'local' END AS fmv_tier,
  c.c_acctbal > 9000 AS is_kol FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "speaker_events": """SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date, CAST(year(o_orderdate) AS BIGINT) AS program_year,
  concat('HCP_', CAST(o_custkey AS STRING)) AS speaker_hcp_id, o_totalprice AS total_program_cost, o_totalprice * 0.4 AS speaker_fee,
  o_totalprice * 0.3 AS venue_cost, CAST(0 AS DOUBLE) AS travel_reimbursement, 1 AS attendee_count, o_orderpriority AS program_topic,
  o_orderstatus = 'F' AS compliance_approved FROM {orders}""",
    "attendees": """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS attendee_id, l_orderkey AS event_id,
  concat('HCP_', CAST(l_suppkey AS STRING)) AS attendee_hcp_id, l_returnflag <> 'R' AS signed_attestation,
  CASE l_returnflag WHEN 'R' THEN 'staff' ELSE 'hcp' END AS attendee_type FROM {lineitem}""",
    "interactions": """SELECT event_id AS interaction_id, concat('HCP_', CAST(user_id AS STRING)) AS hcp_id, CAST(ts AS DATE) AS interaction_date,
  CAST(year(ts) AS BIGINT) AS program_year, CASE event_type WHEN 'purchase' THEN 'meal' WHEN 'click' THEN 'education' WHEN 'view' THEN 'consulting'
  WHEN 'signup' THEN 'advisory_board' ELSE 'conference' END AS interaction_type,
  concat('REP_', regexp_extract(props, '[0-9]+', 0)) AS rep_id,
  CASE WHEN event_type = 'purchase' THEN value END AS meal_cost, value AS payment_amount, value <= 150 AS fmv_approved,
  CASE WHEN event_id % 9 = 0 THEN 'Meeting' WHEN event_id % 31 = 0 THEN NULL ELSE 'Reviewed updated guidelines' END AS business_rationale
FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used) if used else spark.sql(text)


def sql(body: str, *, doubles: str = "", places: int = 4, **steps: str) -> str:
    """SQL text: the views that body and steps name, the steps in order, then body with its doubles rounded."""
    parts = []
    everything = body + " ".join(steps.values())
    for name, text in VIEWS.items():
        if name in everything.replace("fx_" + name, ""):
            for t in TABLES:
                text = text.replace("{" + t + "}", t)
            parts.append(f"{name} AS ({text})")
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    head = f"WITH {', '.join(parts)} " if parts else ""
    if not doubles:
        return head + body
    return f"{head}SELECT * REPLACE ({', '.join(f'round({c} * 1.0000000001::DOUBLE, {places}) AS {c}' for c in doubles.split())}) FROM ({body}) AS result"
