"""Queries over peer groups, lookups, rule registries, model comparison and hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..operators import records as V
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import texts as T
from . import marts
from .benchmarks import BASE, base
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query
from .reports import SCORED, scored
from .steps import Y1, Y2, Y3, steps

YEARS = C.years

GROUPED = f"""SELECT hcp_id, specialty, state, spend_{Y3} AS v, n1 >= 5 AS s, CASE WHEN n1 >= 5 THEN n2 ELSE n3 END >= 5 AS t
 FROM (SELECT *, count(*) OVER (PARTITION BY specialty) AS n1, count(*) OVER (PARTITION BY specialty, state) AS n2, count(*) OVER (PARTITION BY state) AS n3 FROM base)"""
PAIRED = "SELECT a.hcp_id, a.s, a.t, a.specialty, a.state, a.v, b.v AS w FROM grouped a JOIN grouped b ON (NOT a.s OR a.specialty = b.specialty) AND (NOT a.t OR a.state = b.state)"


@query(sql("""SELECT hcp_id, concat(CASE WHEN s THEN concat('specialty=', specialty) ELSE 'full population' END, CASE WHEN t THEN concat(', state=', state) ELSE '' END) AS peer_group, count(*) AS peer_count,
 avg(w) AS peer_mean, max(w) AS peer_max, quantile_cont(w, 0.5) AS peer_median, (count(*) FILTER (WHERE w < v) + count(*) FILTER (WHERE w <= v) + 1) * 50.0 / count(*) AS percentile FROM paired GROUP BY hcp_id, s, t, specialty, state""",
 doubles="peer_mean peer_max peer_median percentile", **steps("profile", base=BASE, grouped=GROUPED, paired=PAIRED)))
def peer_benchmark(spark, sf_dir):
    return B.peer_groups(base(spark, sf_dir), f"spend_{Y3}")


@query(sql(f"""SELECT b.hcp_id, coalesce(m.ratio, (SELECT avg(ratio) FROM lookup)) AS ratio FROM base b LEFT JOIN lookup m USING (specialty)""", doubles="ratio",
 **steps("profile", base=BASE, lookup=f"SELECT specialty, avg(spend_{Y3}) AS ratio FROM base WHERE state < 'J' AND specialty <> 'MACHINERY' GROUP BY specialty")))
def specialty_ratio(spark, sf_dir):
    rows = base(spark, sf_dir)
    lookup = rows.where("state < 'J' AND specialty <> 'MACHINERY'").groupBy("specialty").agg(F.avg(f"spend_{Y3}").alias("ratio"))
    return B.map_join(rows.select("hcp_id", "specialty"), lookup, "specialty", "ratio").select("hcp_id", "ratio")


@query(sql("SELECT record_id, hcp_id, payment_amount FROM staged WHERE hcp_id IN (SELECT speaker_hcp_id FROM speaker_events WHERE total_program_cost > 300000)", doubles="payment_amount", **steps("staged")))
def payments_of_selected(spark, sf_dir):
    chosen = view(spark, sf_dir, "speaker_events").where("total_program_cost > 300000").select(F.col("speaker_hcp_id").alias("hcp_id"))
    return B.restrict(marts.staged(spark, sf_dir), chosen).select("record_id", "hcp_id", "payment_amount")


@query(sql(" UNION ALL ".join(f"SELECT hcp_id, CAST({y} AS BIGINT) AS program_year, spend_{y} AS total FROM base WHERE spend_{y} IS NOT NULL" for y in YEARS), doubles="total", **steps("profile", base=BASE)))
def long_totals(spark, sf_dir):
    return B.totals_long(base(spark, sf_dir), YEARS, "spend_")


RULES = "SELECT concat('R', CAST(s_suppkey AS STRING)) AS rule_id, concat(CASE s_suppkey % 4 WHEN 0 THEN 'Annual speaker cap ' WHEN 1 THEN 'Meal limit per program ' WHEN 2 THEN 'Venue cost ' ELSE 'Quarterly attendee count ' END, s_name) AS rule_name, 'usd' AS unit, CASE s_suppkey % 3 WHEN 0 THEN 'spend' WHEN 1 THEN 'attestation' ELSE 'other' END AS category, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS severity, s_acctbal AS value, s_suppkey, s_nationkey FROM {supplier}"
RULES_SQL = RULES.replace("{supplier}", "supplier")
SCOPED = """SELECT *, CASE WHEN t LIKE '%annual%' OR t LIKE '%year%' THEN 'annual' WHEN t LIKE '%quarter%' THEN 'quarterly' WHEN t LIKE '%month%' THEN 'monthly' WHEN t LIKE '%event%' OR t LIKE '%program%' OR t LIKE '%meal%' THEN 'per_event' ELSE 'unspecified' END AS time_scope,
 CASE WHEN t LIKE '%speaker%' THEN 'speaker' WHEN t LIKE '%attendee%' OR t LIKE '%attest%' THEN 'attendee' WHEN t LIKE '%meal%' THEN 'meal' WHEN t LIKE '%venue%' THEN 'venue' ELSE 'hcp' END AS entity_scope FROM (SELECT *, lower(concat(rule_name, ' ', unit, ' ', category)) AS t FROM ruled)"""


def rules(spark, sf_dir):
    return spark.sql(RULES, supplier=view(spark, sf_dir, "supplier"))


@query(sql("SELECT rule_id, time_scope, entity_scope FROM scoped", ruled=RULES_SQL, scoped=SCOPED))
def rule_scopes(spark, sf_dir):
    return S.infer_scope(rules(spark, sf_dir)).select("rule_id", "time_scope", "entity_scope")


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS rules FROM scoped GROUP BY {c}" for c in ("time_scope", "entity_scope", "category", "severity")), ruled=RULES_SQL, scoped=SCOPED))
def rule_dimensions(spark, sf_dir):
    return S.rule_dimensions(S.infer_scope(rules(spark, sf_dir)))


@query(sql("SELECT rule_id, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN value END, CASE WHEN s_suppkey % 2 = 0 THEN 10.0 END, 7.0) AS threshold FROM ruled WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 0", doubles="threshold", ruled=RULES_SQL))
def effective_thresholds(spark, sf_dir):
    rows = rules(spark, sf_dir)
    fallback = rows.where("s_suppkey % 2 = 0").select("rule_id", F.lit(10.0).alias("threshold"))
    return S.effective_rules(rows.where("s_suppkey % 3 > 0").select("rule_id", F.col("value").alias("threshold")), fallback, 7.0)


SOURCES = "SELECT concat('N', CAST(s_nationkey AS STRING)) AS rule_id, CASE s_suppkey % 5 WHEN 0 THEN 'OIG' WHEN 1 THEN 'Company' WHEN 2 THEN 'PhRMA' WHEN 3 THEN 'CMS' ELSE 'Nobody' END AS authority, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal END AS value, CASE WHEN s_nationkey % 2 = 0 THEN 'maximum' ELSE 'minimum' END AS threshold_type FROM {supplier}"


@query(sql("""SELECT n.rule_id, coalesce(b.value, 1.0) AS threshold, coalesce(b.authority, 'fallback') AS effective_source, b.value IS NULL AS used_fallback FROM (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS rule_id FROM nation) n LEFT JOIN
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY CASE threshold_type WHEN 'maximum' THEN value ELSE -value END, CASE authority WHEN 'OIG' THEN 1 WHEN 'Company' THEN 2 WHEN 'PhRMA' THEN 3 ELSE 4 END) AS k FROM sourced WHERE value IS NOT NULL AND authority <> 'Nobody') WHERE k = 1) b ON n.rule_id = b.rule_id""",
 doubles="threshold", sourced=SOURCES.replace("{supplier}", "supplier")))
def reconciled_thresholds(spark, sf_dir):
    sources = spark.sql(SOURCES, supplier=view(spark, sf_dir, "supplier"))
    fallback = view(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.lit(1.0).alias("value"))
    return S.reconcile_rules(sources, fallback).select("rule_id", "threshold", "effective_source", "used_fallback")


CARD = "SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'Other' ELSE c_mktsegment END AS specialty, CASE WHEN c_custkey % 10 = 0 THEN 'national' WHEN c_custkey % 10 <= 3 THEN 'regional' ELSE 'local' END AS tier, avg(c_acctbal) AS rate FROM {customer} GROUP BY 1, 2"


@query(sql("SELECT m.hcp_id, coalesce(c.rate, o.rate) AS fmv_benchmark FROM master m LEFT JOIN card c ON m.specialty = c.specialty AND m.fmv_tier = c.tier LEFT JOIN card o ON o.specialty = 'Other' AND o.tier = m.fmv_tier", doubles="fmv_benchmark", card=CARD.replace("{customer}", "customer")))
def rate_card_benchmark(spark, sf_dir):
    card = spark.sql(CARD, customer=view(spark, sf_dir, "customer"))
    return V.fmv_benchmark(view(spark, sf_dir, "master").withColumnRenamed("fmv_tier", "tier"), card).select("hcp_id", "fmv_benchmark")


@query(sql(f"SELECT p.hcp_id, p.specialty, p.spend_{Y3}, t.spend_{Y1}, t.spend_{Y2} FROM base p JOIN base t USING (hcp_id) WHERE p.hcp_id = 'HCP_7'", doubles=f"spend_{Y3} spend_{Y1} spend_{Y2}", **steps("profile", base=BASE)))
def entity_profile(spark, sf_dir):
    rows = base(spark, sf_dir)
    return R.entity_profile(rows.select("hcp_id", "specialty", f"spend_{Y3}"), rows.select("hcp_id", "specialty", f"spend_{Y1}", f"spend_{Y2}"), "HCP_7")


@query(sql(f"SELECT coalesce(a.category, b.category) AS category, a.m - b.m AS delta FROM (SELECT nature_of_payment AS category, avg(payment_amount) AS m FROM staged WHERE program_year = {Y3} GROUP BY 1) a FULL JOIN (SELECT nature_of_payment AS category, avg(payment_amount) AS m FROM staged WHERE program_year = {Y2} GROUP BY 1) b ON a.category = b.category", doubles="delta", **steps("staged")))
def year_delta(spark, sf_dir):
    means = marts.staged(spark, sf_dir).groupBy("program_year", F.col("nature_of_payment").alias("category")).agg(F.avg("payment_amount").alias("mean"))
    return R.eval_delta(means.where(F.col("program_year") == Y3), means.where(F.col("program_year") == Y2)).select("category", "delta")


@query(sql("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2"))
def first_hits(spark, sf_dir):
    return T.dedupe_hits(view(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "event_type", "user_id", "event_id")


@query(sql("SELECT doc_id, CASE WHEN NOT g THEN 'low' WHEN r AND p THEN CASE WHEN s THEN 'medium' ELSE 'high' END WHEN r OR p THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT doc_id, lang = 'en' AS r, source LIKE '%e%' AS p, n_chars > 2000 AS s, n_chars > 100 AS g FROM documents)"))
def document_confidence(spark, sf_dir):
    rows = view(spark, sf_dir, "documents").select("doc_id", (F.col("lang") == "en").alias("has_rules"), F.col("source").contains("e").alias("has_policy"), (F.col("n_chars") > 2000).alias("scope_warning"), (F.col("n_chars") > 100).alias("grounded"))
    return T.answer_confidence(rows).select("doc_id", "confidence")


def _compared(column: str) -> str:
    return f"""SELECT '{column}' AS model, (SELECT (sum(r) FILTER (WHERE bad) - p * (p + 1) / 2.0) / (p * (n - p)) FROM (SELECT bad, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS r FROM two), (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS p FROM two) GROUP BY p, n) AS roc_auc,
 (SELECT sum(p / t * cp / cn) FROM (SELECT CAST(p AS DOUBLE) AS p, sum(p) OVER (ORDER BY x DESC) AS cp, sum(n) OVER (ORDER BY x DESC) AS cn, sum(p) OVER () AS t FROM (SELECT {column} AS x, count(*) AS n, count(*) FILTER (WHERE bad) AS p FROM two GROUP BY 1))) AS average_precision,
 CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1
 FROM (SELECT count(*) FILTER (WHERE {column} >= cut AND bad) AS tp, count(*) FILTER (WHERE {column} >= cut AND NOT bad) AS fp, count(*) FILTER (WHERE {column} < cut AND bad) AS fn FROM two, (SELECT quantile_cont({column}, 0.9) AS cut FROM two))"""


@query(sql(f"{_compared('score')} UNION ALL {_compared('size')}", doubles="roc_auc average_precision precision recall f1", scored=SCORED.replace("l.quality,", "l.quality, CAST(d.n_chars AS DOUBLE) AS size,"), two="SELECT score, size, quality = 0 AS bad FROM scored"))
def model_comparison(spark, sf_dir):
    sizes = view(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size"))
    return R.compare_models(scored(spark, sf_dir).join(sizes, "doc_id"), ["score", "size"], "bad")
