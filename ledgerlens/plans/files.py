"""Queries that go through files: CSV folders, years that are ingested, registries, written tables and reports; and checks on columns that few sources have."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import records as R
from ..operators import scoring as S
from ..operators import texts as T
from ..sources import io
from . import records
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query

RAW = "record_id profile_id recipient_type specialty state company_raw payment_amount payment_date nature_of_payment program_year".split()


def folder(spark, name):
    return f"{io.own_folder(spark, name)}/{name}"


@query(sql(f"SELECT {', '.join(RAW)} FROM payments_raw", doubles="payment_amount"))
def payments_from_csv(spark, sf_dir):
    """The payments written as quoted CSV, a folder a year, and read again."""
    path = folder(spark, "csv")
    view(spark, sf_dir, "payments_raw").select(*RAW).write.partitionBy("program_year").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return io.read_payments_csv(spark, path).select(*RAW)


@query(sql("SELECT record_id, company_raw, payment_amount, program_year FROM payments_raw WHERE contains(lower(company_raw), 'brand#2')", doubles="payment_amount"))
def ingested_years(spark, sf_dir):
    """Two years, then all three: the second run writes the third alone."""
    path, source = folder(spark, "years"), view(spark, sf_dir, "payments_raw").select("record_id", "company_raw", "payment_amount", "program_year")
    first = io.ingest_years(spark, source, path, list(C.years[:2]), "BRAND#2")
    second = io.ingest_years(spark, source, path, list(C.years), "BRAND#2")
    if (first, second) != (list(C.years[:2]), [C.years[2]]):
        raise RuntimeError(f"ingested {first}, then {second}")
    return io.read_table(spark, path, ["record_id", "company_raw", "payment_amount", "program_year"])


@query("SELECT o_orderstatus, o_orderkey, o_totalprice, 0 AS others FROM orders")
def written_table(spark, sf_dir):
    """A table partitioned by status, read back with some of its columns; beside it a source that isn't there."""
    path = folder(spark, "table")
    io.write_table(view(spark, sf_dir, "orders"), path, ["o_orderstatus"])
    none = io.optional_source(spark, f"{path}-none", "k int")
    return io.read_table(spark, path, ["o_orderstatus", "o_orderkey", "o_totalprice"]).crossJoin(none.agg(F.count(F.lit(1)).cast("int").alias("others")))  # one row


@query("SELECT c_mktsegment AS rule_id, CAST(count(*) AS DOUBLE) AS threshold, false AS is_boolean, 'OIG' AS authority, CAST(max(c_custkey) AS DOUBLE) AS value FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'has_customers', 1.0, true, NULL, NULL")
def registry_rules(spark, sf_dir):
    """A registry of rules made from the segments, written as JSON and loaded: rules, each with its first source."""
    path = folder(spark, "rules")
    some = view(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("m"))
    rule = F.struct(F.col("c_mktsegment").alias("rule_id"), F.col("n").cast("string").alias("threshold"), F.array(F.struct(F.lit("OIG").alias("authority"), F.col("m").cast("string").alias("extracted_value"))).alias("sources"))
    last = F.struct(F.lit("has_customers").alias("rule_id"), F.lit("true").alias("threshold"), F.array().cast("array<struct<authority string, extracted_value string>>").alias("sources"))
    some.agg(F.concat(F.collect_list(rule), F.array(last)).alias("rules")).coalesce(1).write.json(path)  # a row a segment
    rules, sources = io.load_rules(spark, path)
    return rules.join(sources.where("place = 0 or place is null").select("rule_id", "authority", "value"), "rule_id", "left").select("rule_id", "threshold", "is_boolean", "authority", "value")


@query("SELECT c_mktsegment AS segment, count(*) AS n, 'json' AS kind FROM customer GROUP BY ALL UNION ALL SELECT c_mktsegment, count(*), 'csv' FROM customer GROUP BY ALL UNION ALL SELECT c_mktsegment, count(*), 'view' FROM customer GROUP BY ALL")
def written_reports(spark, sf_dir):
    """A summary as JSON and as one CSV file, read again; and the same from tables registered as views."""
    path = folder(spark, "reports")
    rows = view(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    io.write_summary(rows, f"{path}/json")
    io.write_csv(rows, f"{path}/csv")
    io.register_views(spark, sf_dir, ["customer"])
    parts = [spark.read.schema("segment string, n long").json(f"{path}/json").withColumn("kind", F.lit("json")), spark.read.schema("segment string, n long").csv(f"{path}/csv", header=True).withColumn("kind", F.lit("csv")), spark.sql("SELECT c_mktsegment AS segment, count(*) AS n, 'view' AS kind FROM customer GROUP BY c_mktsegment")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def one_to_one(spark, sf_dir):
    rows = view(spark, sf_dir, "customer")
    return S.join_one_to_one(rows.select("c_custkey", "c_name", "c_mktsegment"), rows.select("c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey")


@query("""WITH e AS (SELECT vec_id // 10 AS chunk_id, vec_id % 10 AS i, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT chunk_id, v AS answer FROM e WHERE i = 0), s AS (SELECT chunk_id, i, list_cosine_similarity(v, answer) AS score FROM e JOIN a USING (chunk_id) WHERE i > 0)
SELECT chunk_id, i, round(score * 1.0000000001::DOUBLE, 4) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, max(score) OVER (PARTITION BY chunk_id) AS best, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, i) AS place FROM s) WHERE best >= 0.1 AND place <= 2""")
def nearest_sentences(spark, sf_dir):
    """Vectors in tens: the first is the answer, the others are a chunk's sentences."""
    e = view(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("chunk_id"), (F.col("vec_id") % 10).alias("i"), F.col("embedding").alias("v"))
    return T.select_sentences(e.where("i > 0").join(e.where("i = 0").select("chunk_id", F.col("v").alias("answer")), "chunk_id"), 2, 0.1)


@query("SELECT doc_id, concat('[Policy] ', coalesce(source, ''), CASE WHEN lang = 'en' THEN ' | [Rules] english' ELSE '' END) AS contexts FROM documents")
def document_contexts(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select("doc_id", F.array(F.coalesce("source", F.lit(""))).alias("p"), F.when(F.col("lang") == "en", F.array(F.lit("english"))).alias("r"))
    return T.assemble_contexts(rows, {"p": "Policy", "r": "Rules"}).select("doc_id", F.array_join("contexts", " | ").alias("contexts"))


MEALS = (("breakfast", 60.0), ("lunch", 90.0), ("dinner", 120.0))
KIND = "CASE interaction_id % 4 WHEN 0 THEN 'breakfast' WHEN 1 THEN 'lunch' WHEN 2 THEN 'dinner' END"
LIMIT = f"coalesce({', '.join(f'CASE WHEN meal_type = {k!r} THEN {v} END' for k, v in MEALS)}, {C.other_meal_limit})"
WITH_MEALS = f"SELECT *, {KIND} AS meal_type, interaction_id % 7 = 0 AS is_reconciliation_anomaly FROM ytd"
MORE = records.ICHECKS | {"MEAL_COST_EXCESSIVE": f"meal_cost > {LIMIT}", "CMS_RECONCILIATION_GAP": "is_reconciliation_anomaly"}


@query(sql(f"SELECT interaction_id, array_to_string(f, ',') AS violation_types, {records.severity('f')} AS violation_severity FROM (SELECT *, {records.joined(MORE)} AS f FROM fed)", ytd=records.YTD, fed=WITH_MEALS))
def meal_type_violations(spark, sf_dir):
    """Limits by meal type, and gaps of the reconciliation."""
    rows = view(spark, sf_dir, "interactions").withColumns({"meal_type": F.expr(KIND), "is_reconciliation_anomaly": F.col("interaction_id") % 7 == 0})
    return R.interaction_violations(rows, replace(C, interaction_meal_limits=MEALS)).select("interaction_id", "violation_types", "violation_severity")


VENUE = f"CASE event_id % 5 WHEN 0 THEN '{R.VENUES[0]}' WHEN 1 THEN '{R.VENUES[-1]}' ELSE 'office' END"
BENCHMARK = "CAST(90000 + event_id % 3 * 30000 AS DOUBLE)"
WITH_VENUES = f"SELECT *, {VENUE} AS venue_type, event_id % 11 = 0 AS alcohol_provided, {BENCHMARK} AS fmv_benchmark FROM counters"
ALL_EVENTS = {"SPEAKER_VENUE_INAPPROPRIATE": f"venue_type IN {tuple(R.VENUES)}"} | {k: v for k, v in records.ECHECKS.items() if k != "ANNUAL_COMPENSATION_CAP_EXCEEDED"}
ALL_EVENTS |= {"SPEAKER_FEE_EXCEEDS_FMV": "speaker_fee > fmv_benchmark", "SPEAKER_SELECTED_BY_PRESCRIBING": "times_spoke_this_year > 4 AND annual_speaker_compensation > fmv_benchmark * 4", "ALCOHOL_PROVIDED": "alcohol_provided", "ANNUAL_COMPENSATION_CAP_EXCEEDED": records.ECHECKS["ANNUAL_COMPENSATION_CAP_EXCEEDED"]}


@query(sql(f"SELECT event_id, array_to_string(f, ',') AS violation_types, {records.severity('f')} AS violation_severity FROM (SELECT *, {records.joined(ALL_EVENTS)} AS f FROM held)", counters=records.COUNTERS, held=WITH_VENUES))
def venue_violations(spark, sf_dir):
    """Venues, alcohol and a benchmark of each event."""
    rows = view(spark, sf_dir, "speaker_events").withColumns({"venue_type": F.expr(VENUE), "alcohol_provided": F.col("event_id") % 11 == 0, "fmv_benchmark": F.expr(BENCHMARK)})
    return R.event_violations(rows, C).select("event_id", "violation_types", "violation_severity")


SAME_OFFICE = records.ACHECKS | {"ATTENDEE_SAME_OFFICE_AS_SPEAKER": "event_id % 13 = 0"}


@query(sql(f"SELECT attendee_id, event_id, array_to_string(f, ',') AS violation_types, {records.severity('f')} AS violation_severity FROM (SELECT *, {records.joined(SAME_OFFICE)} AS f FROM attended_rows)", attended_rows=records.ATTENDED))
def same_office_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "attendees").join(view(spark, sf_dir, "speaker_events").select("event_id", "event_date", "program_topic"), "event_id")
    return R.attendee_violations(rows.withColumn("same_office_as_speaker", F.col("event_id") % 13 == 0)).select("attendee_id", "event_id", "violation_types", "violation_severity")
