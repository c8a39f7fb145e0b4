"""Queries over monitoring, exploration, reconciliation and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payments as P
from ..operators import reports as R
from ..operators import scoring as S
from ..sources.io import kept
from . import marts, records, scoring
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query
from .steps import Y1, Y2, Y3, steps

FLAGS = [n for n, _, _, _ in scoring.RULES]
SEVERITY = {n: s for n, _, s, _ in scoring.RULES}
ALL = scoring.ALL | {"full_scores": "SELECT s.*, m.specialty, m.state, m.fmv_tier FROM scores s JOIN master m USING (hcp_id)"}
COUNTS = ", ".join(f"count(*) FILTER (WHERE risk_tier = '{t}') AS {t}" for t in R.TIERS)


def scores(spark, sf_dir):
    return scoring.scores(spark, sf_dir).join(view(spark, sf_dir, "master").select("hcp_id", "specialty", "state", "fmv_tier"), "hcp_id")


@query(sql("SELECT risk_tier, count(*) AS n, count(*) / CAST((SELECT count(*) FROM full_scores) AS DOUBLE) AS share, avg(risk_score) AS avg_score, quantile_cont(risk_score, 0.5) AS median_score FROM full_scores GROUP BY 1", doubles="share avg_score median_score", **ALL))
def risk_distribution(spark, sf_dir):
    return R.risk_distribution(scores(spark, sf_dir))


@query(sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {n}) AS n, count(*) FILTER (WHERE {n}) / CAST(count(*) AS DOUBLE) AS rate, '{s}' AS severity FROM flags" for n, s in SEVERITY.items()) + ") WHERE n > 0 ORDER BY n DESC, flag LIMIT 10", doubles="rate", **ALL))
def flag_patterns(spark, sf_dir):
    return R.flag_patterns(scoring.flags(spark, sf_dir), FLAGS, SEVERITY)


@query(sql("SELECT specialty, count(*) AS entities, count(*) FILTER (WHERE risk_tier = 'critical') / CAST(count(*) AS DOUBLE) AS critical_rate, count(*) FILTER (WHERE risk_tier = 'high') / CAST(count(*) AS DOUBLE) AS high_rate, avg(risk_score) AS avg_score, "
 + "list_sort([" + ", ".join(f"{{'n': -count(*) FILTER (WHERE {n}), 'i': {i}, 'f': '{n}'}}" for i, n in enumerate(FLAGS)) + "])[1].f AS top_flag FROM full_scores GROUP BY specialty HAVING count(*) >= 5 ORDER BY critical_rate DESC, high_rate DESC, specialty LIMIT 10", doubles="critical_rate high_rate avg_score", **ALL))
def risk_segments(spark, sf_dir):
    return R.risk_segments(scores(spark, sf_dir), "specialty", FLAGS)


def _cluster(by: str) -> str:
    return f"SELECT 'critical_cluster_{by}' AS issue, {by} AS subject, count(*) FILTER (WHERE risk_tier = 'critical') / CAST(count(*) AS DOUBLE) AS rate FROM full_scores GROUP BY {by} HAVING count(*) >= 10 AND count(*) FILTER (WHERE risk_tier = 'critical') / CAST(count(*) AS DOUBLE) > 0.02"


def _many(by: str, limit: float) -> str:
    return f"SELECT 'multi_flag_{by}', {by}, count(*) FILTER (WHERE total_rule_flags >= 2) / CAST(count(*) AS DOUBLE) FROM full_scores GROUP BY {by} HAVING count(*) >= 10 AND count(*) FILTER (WHERE total_rule_flags >= 2) / CAST(count(*) AS DOUBLE) > {limit}"


@query(sql(" UNION ALL ".join([_cluster("specialty"), _cluster("state"), _many("specialty", 0.30), _many("state", 0.25), *[f"SELECT 'dominant_flag', '{n}', count(*) FILTER (WHERE {n}) / CAST(sum(total_rule_flags) AS DOUBLE) FROM full_scores HAVING count(*) FILTER (WHERE {n}) / CAST(sum(total_rule_flags) AS DOUBLE) > 0.4" for n in FLAGS]]), doubles="rate", **ALL))
def systemic_issues(spark, sf_dir):
    return R.systemic_issues(scores(spark, sf_dir), FLAGS)


@query(sql(f"SELECT specialty, count(*) AS total, {COUNTS}, count(*) FILTER (WHERE risk_tier IN ('critical', 'high')) AS elevated FROM full_scores GROUP BY specialty", **ALL))
def tier_by_specialty(spark, sf_dir):
    return R.tier_counts(scores(spark, sf_dir), "specialty")


@query(sql(f"SELECT state, count(*) AS total, {COUNTS}, count(*) FILTER (WHERE risk_tier IN ('critical', 'high')) AS elevated FROM full_scores GROUP BY state", **ALL))
def tier_by_state(spark, sf_dir):
    return R.tier_counts(scores(spark, sf_dir), "state")


@query(sql(" UNION ALL ".join(f"SELECT {y} AS year, round(sum(spend_{y}) / 1e6, 2) AS total_millions, count(*) FILTER (WHERE spend_{y} >= {0.75 * C.annual_cap}) AS near_cap, count(*) FILTER (WHERE spend_{y} >= {C.annual_cap}) AS at_cap, avg(spend_{y}) AS avg_spend FROM spend" for y in C.years), doubles="total_millions avg_spend", **steps("spend")))
def yearly_trend(spark, sf_dir):
    return R.yearly_trend(marts.spend(spark, sf_dir), C.years, C.annual_cap)


REPS = {"rep_counts": "SELECT hcp_id, rep_id, count(*) AS n FROM interactions WHERE rep_id IS NOT NULL GROUP BY ALL", "first_rep": "SELECT hcp_id, rep_id AS primary_rep, n AS interactions FROM (SELECT *, row_number() OVER (PARTITION BY hcp_id ORDER BY n DESC, rep_id) AS k FROM rep_counts) WHERE k = 1"}


@query(sql("SELECT * FROM first_rep", **REPS))
def primary_rep(spark, sf_dir):
    return R.primary_rep(view(spark, sf_dir, "interactions"))


@query(sql("SELECT c.hcp_id, c.rep_id, c.n AS interactions, c.rep_id = f.primary_rep AS is_primary FROM rep_counts c JOIN first_rep f USING (hcp_id)", **REPS))
def rep_edges(spark, sf_dir):
    return R.rep_edges(view(spark, sf_dir, "interactions"))


@query(sql(f"SELECT primary_rep, count(*) AS entities, {COUNTS}, sum(risk_score) AS total_risk, avg(risk_score) AS avg_risk FROM full_scores JOIN first_rep USING (hcp_id) GROUP BY primary_rep", doubles="total_risk avg_risk", **ALL, **REPS))
def rep_leaderboard(spark, sf_dir):
    return R.rep_leaderboard(scores(spark, sf_dir), R.primary_rep(view(spark, sf_dir, "interactions")))


@query(sql(f"SELECT rep_id, count(DISTINCT hcp_id) AS entities, {COUNTS}, count(*) FILTER (WHERE rep_id = primary_rep) AS primary_edges, count(*) FILTER (WHERE rep_id <> primary_rep) AS secondary_edges, avg(risk_score) AS avg_risk FROM rep_counts JOIN first_rep USING (hcp_id) JOIN full_scores USING (hcp_id) GROUP BY rep_id", doubles="avg_risk", **ALL, **REPS))
def rep_panel(spark, sf_dir):
    return R.rep_panel(R.rep_edges(view(spark, sf_dir, "interactions")), scores(spark, sf_dir))


@query(sql("SELECT node, min(hop) AS hop FROM (SELECT 'REP_0' AS node, 0 AS hop UNION ALL SELECT hcp_id, 1 FROM rep_counts WHERE rep_id = 'REP_0' UNION ALL SELECT rep_id, 2 FROM rep_counts WHERE hcp_id IN (SELECT hcp_id FROM rep_counts WHERE rep_id = 'REP_0')) GROUP BY node", **REPS))
def two_hop(spark, sf_dir):
    edges = R.rep_edges(view(spark, sf_dir, "interactions"))
    return R.two_hop(edges, spark.createDataFrame([("REP_0",)], "node string"))


@query(sql("SELECT count(risk_score) AS n, min(risk_score) AS least, avg(risk_score) AS mean, stddev_samp(risk_score) AS std, max(risk_score) AS most, " + ", ".join(f"quantile_cont(risk_score, {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM full_scores", doubles="least mean std most p25 p50 p75 p90 p95 p99", **ALL))
def score_statistics(spark, sf_dir):
    return R.score_stats(scores(spark, sf_dir), "risk_score")


@query(sql("SELECT CAST(least(floor(risk_score / 5), 19) AS INTEGER) AS bin, count(*) AS n FROM full_scores WHERE risk_score BETWEEN 0 AND 100 GROUP BY 1", **ALL))
def score_histogram(spark, sf_dir):
    return R.histogram(scores(spark, sf_dir), "risk_score", 0.0, 100.0, 20)


@query(sql("SELECT risk_tier, min(risk_score) AS least, quantile_cont(risk_score, 0.25) AS q1, quantile_cont(risk_score, 0.5) AS median, quantile_cont(risk_score, 0.75) AS q3, max(risk_score) AS most FROM full_scores GROUP BY risk_tier", doubles="least q1 median q3 most", **ALL))
def score_boxes(spark, sf_dir):
    return R.box_stats(scores(spark, sf_dir), "risk_score", "risk_tier")


@query(sql(f"SELECT CASE WHEN r <= 0.25 THEN '0-25' WHEN r <= 0.5 THEN '25-50' WHEN r <= 0.75 THEN '50-75' WHEN r <= 0.9 THEN '75-90' ELSE '90-100' END AS band, count(*) AS n FROM (SELECT rank() OVER (PARTITION BY specialty ORDER BY spend_{Y3}) / CAST(count(*) OVER (PARTITION BY specialty) AS DOUBLE) AS r FROM profile) GROUP BY 1", **steps("profile")))
def spend_rank_bands(spark, sf_dir):
    from ..operators.benchmarks import frac_rank

    rows = marts.profile(spark, sf_dir).select("hcp_id", "specialty").join(marts.spend(spark, sf_dir).select("hcp_id", f"spend_{Y3}"), "hcp_id")
    return R.rank_bands(frac_rank(rows, f"spend_{Y3}", "specialty", "r"), "r")


IMPORTANT = ["lifetime_total_spend", "annual_cap_pct_used", "meal_breach_rate", "pct_speaking_fee", "avg_event_risk_score", "interaction_frequency_score"]


@query(sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(corr({c}, combined_raw_risk_score), 0) AS correlation, abs(coalesce(corr({c}, combined_raw_risk_score), 0)) AS importance FROM profile" for c in IMPORTANT) + ")", doubles="correlation importance", **steps("profile")))
def pearson_importance(spark, sf_dir):
    return R.pearson_importance(marts.profile(spark, sf_dir), IMPORTANT, "combined_raw_risk_score")


@query(sql("SELECT * EXCLUDE (m), m / sum(m) OVER () * 100 AS pct_of_total, m AS mean_abs FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({c})) AS m, avg(CASE WHEN i <= ceil(n * 0.01) THEN abs({c}) END) AS mean_abs_top FROM placed" for c in IMPORTANT) + ")", doubles="mean_abs mean_abs_top pct_of_total", **steps("profile", placed="SELECT *, row_number() OVER (ORDER BY combined_raw_risk_score DESC, hcp_id) AS i, count(*) OVER () AS n FROM profile")))
def attribution_importance(spark, sf_dir):
    """The features in place of attributions, the heuristic score in place of the model's."""
    return R.attribution_importance(marts.profile(spark, sf_dir), IMPORTANT, "combined_raw_risk_score")


PAIRS = " UNION ALL ".join(f"SELECT '{min(a, b)}' AS flag_a, '{max(a, b)}' AS flag_b, count(*) FILTER (WHERE {a} AND {b}) AS n FROM flags" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :])
TOTALS = " UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {n}) AS c FROM flags" for n in FLAGS)


@query(sql("SELECT p.* FROM pairs p WHERE flag_a IN (SELECT flag FROM top) AND flag_b IN (SELECT flag FROM top)", **ALL, pairs=PAIRS, totals=TOTALS, top="SELECT flag FROM totals ORDER BY c DESC, flag LIMIT 10"))
def flag_cooccurrence(spark, sf_dir):
    return R.flag_cooccurrence(scoring.flags(spark, sf_dir), FLAGS)


@query(sql("SELECT *, coalesce((avg_risk - min(avg_risk) OVER ()) / nullif(max(avg_risk) OVER () - min(avg_risk) OVER (), 0), 0) AS avg_risk_scaled, coalesce((elevated_share - min(elevated_share) OVER ()) / nullif(max(elevated_share) OVER () - min(elevated_share) OVER (), 0), 0) AS elevated_share_scaled FROM (SELECT state, count(*) AS n, avg(risk_score) AS avg_risk, count(*) FILTER (WHERE risk_tier IN ('critical', 'high')) / CAST(count(*) AS DOUBLE) AS elevated_share FROM full_scores GROUP BY state HAVING count(*) >= 20 ORDER BY elevated_share DESC, state LIMIT 12)", doubles="avg_risk elevated_share avg_risk_scaled elevated_share_scaled", **ALL))
def state_profile(spark, sf_dir):
    return R.state_profile(scores(spark, sf_dir), 20, 12)


@query(sql("SELECT hcp_id, specialty, risk_score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY specialty ORDER BY risk_score DESC, hcp_id) AS INTEGER) AS place FROM full_scores) WHERE place <= 5", doubles="risk_score", **ALL))
def top_per_specialty(spark, sf_dir):
    return R.top_n_per(scores(spark, sf_dir), "specialty", [F.desc("risk_score"), F.col("hcp_id")], 5).select("hcp_id", "specialty", "risk_score", "place")


@query(sql("SELECT total, elevated, elevated / CAST(total AS DOUBLE) AS elevated_share, (SELECT avg(m) FROM (SELECT avg(risk_score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY risk_tier ORDER BY risk_score DESC, hcp_id) AS k FROM full_scores) WHERE k <= 100 GROUP BY risk_tier)) AS stratified_top_score FROM (SELECT count(*) AS total, count(*) FILTER (WHERE risk_tier IN ('critical', 'high')) AS elevated FROM full_scores)", doubles="elevated_share stratified_top_score", **ALL))
def overview_kpis(spark, sf_dir):
    return R.overview_kpis(scores(spark, sf_dir))


@query(sql("SELECT concat(CASE WHEN rule_score > mx THEN 'high' ELSE 'low' END, '-', CASE WHEN anomaly_score > my THEN 'high' ELSE 'low' END) AS cell, count(*) AS n, count(*) / CAST((SELECT count(*) FROM full_scores) AS DOUBLE) AS share FROM full_scores, (SELECT quantile_cont(rule_score, 0.5) AS mx, quantile_cont(anomaly_score, 0.5) AS my FROM full_scores) GROUP BY 1", doubles="share", **ALL))
def median_quadrants(spark, sf_dir):
    return R.median_quadrants(scores(spark, sf_dir), "rule_score", "anomaly_score")


@query(sql("SELECT hcp_id, specialty, rule_score, (r + (t - 1) / 2.0) / n AS mean_rank, (r - 1) / CAST(n AS DOUBLE) AS below, (r + t - 1) / CAST(n AS DOUBLE) AS not_above FROM (SELECT *, rank() OVER (PARTITION BY specialty ORDER BY rule_score) AS r, count(*) OVER (PARTITION BY specialty, rule_score) AS t, count(*) OVER (PARTITION BY specialty) AS n FROM full_scores)", doubles="rule_score mean_rank below not_above", **ALL))
def peer_percentiles(spark, sf_dir):
    return R.peer_percentile(scores(spark, sf_dir), "rule_score", "specialty")


@query(sql("SELECT hcp_id, risk_score, risk_tier FROM full_scores WHERE lower(specialty) = 'building' ORDER BY risk_score DESC, hcp_id LIMIT 20 OFFSET 20", doubles="risk_score", **ALL))
def scored_page(spark, sf_dir):
    rows = R.scope_filter(scores(spark, sf_dir), specialty="Building")
    return R.page(rows, [F.desc("risk_score"), F.col("hcp_id")], 20, 20).select("hcp_id", "risk_score", "risk_tier")


@query(sql("SELECT hcp_id, risk_score, CAST(row_number() OVER (ORDER BY risk_score DESC, hcp_id) AS INTEGER) AS place FROM full_scores ORDER BY risk_score DESC, hcp_id LIMIT 50", doubles="risk_score", **ALL))
def investigation_queue(spark, sf_dir):
    return R.investigation_queue(scores(spark, sf_dir)).select("hcp_id", "risk_score", "place")


@query(sql("SELECT hcp_id, feature, value, CAST(k AS INTEGER) AS place, CASE WHEN value > 0 THEN 'high' WHEN value < 0 THEN 'low' ELSE 'none' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY hcp_id ORDER BY abs(value) DESC, feature) AS k FROM (" + " UNION ALL ".join(f"SELECT hcp_id, '{c}' AS feature, {c} AS value FROM profile" for c in IMPORTANT) + ")) WHERE k <= 3", doubles="value", **steps("profile")))
def top_features(spark, sf_dir):
    return R.top_features(marts.profile(spark, sf_dir), "hcp_id", IMPORTANT, 3)


TOV = """SELECT hcp_id, program_year, sum(CASE WHEN is_target AND lower(nature_of_payment) LIKE '%food%' THEN payment_amount ELSE 0 END) AS meals, sum(CASE WHEN is_target AND (lower(nature_of_payment) LIKE '%speaker%' OR lower(nature_of_payment) LIKE '%faculty%') THEN payment_amount ELSE 0 END) AS speaking,
 sum(CASE WHEN is_target AND lower(nature_of_payment) LIKE '%consult%' THEN payment_amount ELSE 0 END) AS consulting, sum(CASE WHEN is_target AND lower(nature_of_payment) LIKE '%travel%' THEN payment_amount ELSE 0 END) AS travel, sum(payment_amount) AS all_companies, count(*) AS payments,
 sum(CASE WHEN is_target THEN payment_amount ELSE 0 END) / nullif(sum(payment_amount), 0) AS share_of_wallet FROM staged GROUP BY ALL"""
MEASURES = ["meals", "speaking", "consulting", "travel", "all_companies"]
WIDE = "SELECT hcp_id, " + ", ".join(f"max(CASE WHEN program_year = {y} THEN {m} END) AS {m}_{y}" for y in C.years for m in MEASURES) + " FROM tov GROUP BY hcp_id"


@query(sql("SELECT * FROM tov", doubles="meals speaking consulting travel all_companies share_of_wallet", **steps("staged", tov=TOV)))
def transfer_of_value(spark, sf_dir):
    return R.tov_long(marts.staged(spark, sf_dir))


@query(sql("SELECT * FROM wide", doubles=" ".join(f"{m}_{y}" for y in C.years for m in MEASURES), **steps("staged", tov=TOV, wide=WIDE)))
def transfer_of_value_wide(spark, sf_dir):
    return R.tov_wide(R.tov_long(marts.staged(spark, sf_dir)), C.years, MEASURES)


@query(sql(" UNION ALL ".join(f"SELECT hcp_id, {y} AS year, coalesce(meals_{y}, 0) + coalesce(speaking_{y}, 0) + coalesce(consulting_{y}, 0) + coalesce(travel_{y}, 0) AS own, greatest(0, all_companies_{y} - (coalesce(meals_{y}, 0) + coalesce(speaking_{y}, 0) + coalesce(consulting_{y}, 0) + coalesce(travel_{y}, 0))) AS other_payers FROM wide WHERE all_companies_{y} > 0" for y in C.years), doubles="own other_payers", **steps("staged", tov=TOV, wide=WIDE)))
def payment_mix(spark, sf_dir):
    return R.payment_mix(R.tov_wide(R.tov_long(marts.staged(spark, sf_dir)), C.years, MEASURES), C.years)


@query(sql("SELECT hcp_id, " + ", ".join(f"coalesce(sum(payment_amount) FILTER (WHERE program_year = {y}), 0) AS total_{y}" for y in C.years) + ", sum(payment_amount) AS total_all FROM target GROUP BY hcp_id", doubles=" ".join(f"total_{y}" for y in C.years) + " total_all", **steps("target")))
def yearly_totals(spark, sf_dir):
    return R.yearly_totals(marts.target(spark, sf_dir), C.years)


@query(sql("SELECT hcp_id, arg_min(specialty, record_id) AS specialty, arg_min(company_name, record_id) AS company_name FROM staged GROUP BY hcp_id", **steps("staged")))
def first_seen(spark, sf_dir):
    return R.first_seen(marts.staged(spark, sf_dir), "hcp_id", ["specialty", "company_name"], "record_id")


INTERNAL = "SELECT hcp_id, program_year, sum(amount) AS internal_total, count(DISTINCT component) AS components FROM (SELECT hcp_id, program_year, 'payments' AS component, payment_amount AS amount FROM target UNION ALL SELECT speaker_hcp_id, program_year, 'fees', speaker_fee * 0.01 FROM speaker_events UNION ALL SELECT speaker_hcp_id, program_year, 'travel', travel_reimbursement FROM speaker_events) GROUP BY ALL"
RECONCILED = f"SELECT hcp_id, program_year, coalesce(internal_total, 0) AS internal_total, components, coalesce(reported_total, 0) AS reported_total, CASE WHEN coalesce(reported_total, 0) > 0 THEN abs(coalesce(internal_total, 0) - reported_total) / reported_total END AS gap FROM internal i FULL JOIN (SELECT hcp_id, program_year, sum(payment_amount) AS reported_total FROM target GROUP BY ALL) r USING (hcp_id, program_year)"


def reconciled(spark, sf_dir):
    target, events = marts.target(spark, sf_dir), view(spark, sf_dir, "speaker_events")

    def part(df, name, amount):
        return df.select("hcp_id", "program_year", F.lit(name).alias("component"), amount.alias("amount"))

    speakers = events.withColumnRenamed("speaker_hcp_id", "hcp_id")
    internal = R.internal_totals([part(target, "payments", F.col("payment_amount")), part(speakers, "fees", F.col("speaker_fee") * 0.01), part(speakers, "travel", F.col("travel_reimbursement"))])
    return R.reconcile(internal, target.groupBy("hcp_id", "program_year").agg(F.sum("payment_amount").alias("reported_total")))


@query(sql("SELECT *, CASE WHEN gap IS NULL THEN 'unreported' WHEN gap < 0.001 THEN 'perfect' WHEN gap <= 0.05 THEN 'minor' WHEN gap > 0.10 THEN 'major' ELSE 'moderate' END AS band FROM reconciled", doubles="internal_total reported_total gap", **steps("target", internal=INTERNAL, reconciled=RECONCILED)))
def reconciliation(spark, sf_dir):
    return reconciled(spark, sf_dir)


@query(sql("SELECT program_year, count(*) FILTER (WHERE gap < 0.01) AS under_1, count(*) FILTER (WHERE gap >= 0.01 AND gap < 0.05) AS from_1_to_5, count(*) FILTER (WHERE gap >= 0.05 AND gap < 0.1) AS from_5_to_10, count(*) FILTER (WHERE gap >= 0.1) AS over_10, sum(internal_total) AS internal, sum(reported_total) AS reported, avg(gap) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.95) AS p95_gap, max(gap) AS max_gap, any_value(largest) AS largest FROM reconciled LEFT JOIN (SELECT program_year, string_agg(concat(hcp_id, ':', CAST(CAST(round(gap * 10000 * 1.0000000001::DOUBLE) AS BIGINT) AS VARCHAR)), ' ' ORDER BY k) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY program_year ORDER BY reported_total DESC, hcp_id) AS k FROM reconciled WHERE reported_total > 0) WHERE k <= 3 GROUP BY program_year) USING (program_year) GROUP BY program_year", doubles="internal reported mean_gap median_gap p95_gap max_gap", **steps("target", internal=INTERNAL, reconciled=RECONCILED)))
def reconciliation_report(spark, sf_dir):
    return R.reconcile_report(reconciled(spark, sf_dir))


# a score from the documents themselves, against the labels
SCORED = "SELECT l.doc_id, l.quality, length(regexp_replace(d.text, '[^*#$%&|!]', '', 'g')) / CAST(length(d.text) AS DOUBLE) AS score FROM labels l JOIN documents d USING (doc_id) WHERE length(d.text) > 0"


def scored(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").where(F.length("text") > 0)
    junk = F.length(F.regexp_replace("text", "[^*#$%&|!]", "")) / F.length("text")
    return view(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", junk.alias("score"), (F.col("quality") == 0).alias("bad"))


@query(sql("SELECT tp, fp, fn, tn, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, 2 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) AS f1 FROM (SELECT count(*) FILTER (WHERE score > 0.02 AND quality = 0) AS tp, count(*) FILTER (WHERE score > 0.02 AND quality <> 0) AS fp, count(*) FILTER (WHERE score <= 0.02 AND quality = 0) AS fn, count(*) FILTER (WHERE score <= 0.02 AND quality <> 0) AS tn FROM scored)", doubles="precision recall f1", scored=SCORED))
def label_metrics(spark, sf_dir):
    return R.label_metrics(scored(spark, sf_dir).select((F.col("score") > 0.02).cast("int").alias("predicted"), F.col("bad").cast("int").alias("label")))


TOPK = " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS share, count(*) AS k, count(*) FILTER (WHERE quality = 0) AS hits FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS i FROM scored) WHERE i <= ceil((SELECT count(*) FROM scored) * {s})" for s in (0.01, 0.05, 0.1))


@query(sql("SELECT share, k, hits, hits / CAST(k AS DOUBLE) AS precision, hits / CAST(ones AS DOUBLE) AS recall, CASE WHEN hits > 0 THEN 2.0 * hits / (k + ones) ELSE 0 END AS f1, (hits / CAST(k AS DOUBLE)) / (ones / CAST(n AS DOUBLE)) AS lift FROM topk, (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0) AS ones FROM scored)", doubles="share precision recall f1 lift", scored=SCORED, topk=TOPK))
def topk_evaluation(spark, sf_dir):
    return R.topk_eval(scored(spark, sf_dir), "score", "bad")


@query(sql("""SELECT (SELECT (sum(r) FILTER (WHERE quality = 0) - p * (p + 1) / 2.0) / (p * (n - p)) FROM (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored), (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0) AS p FROM scored) GROUP BY p, n) AS roc_auc,
 (SELECT sum(p / t * cp / cn) FROM (SELECT CAST(p AS DOUBLE) AS p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS t FROM (SELECT score, count(*) AS n, count(*) FILTER (WHERE quality = 0) AS p FROM scored GROUP BY score))) AS average_precision""", doubles="roc_auc average_precision", scored=SCORED))
def ranking_metrics(spark, sf_dir):
    return R.ranking_metrics(scored(spark, sf_dir), "score", "bad")


@query(sql("SELECT category, avg(x) AS mean, quantile_cont(x, 0.5) AS median, min(x) AS least, max(x) AS most, count(*) AS n, max(CASE WHEN i = ceil(n * 0.95) THEN x END) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY x) AS i, count(*) OVER (PARTITION BY category) AS n FROM (SELECT interaction_type AS category, payment_amount AS x FROM interactions UNION ALL SELECT 'ALL', payment_amount FROM interactions)) GROUP BY category", doubles="mean median least most p95"))
def evaluation_summary(spark, sf_dir):
    return R.eval_summary(view(spark, sf_dir, "interactions"), "interaction_type", "payment_amount")


@query(sql("SELECT interaction_type, count(*) AS runs, count(*) FILTER (WHERE fmv_approved) AS successes, avg(payment_amount) FILTER (WHERE fmv_approved) AS mean, quantile_cont(payment_amount, 0.5) FILTER (WHERE fmv_approved) AS median, quantile_cont(payment_amount, 0.95) FILTER (WHERE fmv_approved) AS p95, quantile_cont(payment_amount, 0.99) FILTER (WHERE fmv_approved) AS p99, coalesce(stddev_samp(payment_amount) FILTER (WHERE fmv_approved), 0) AS std FROM interactions GROUP BY interaction_type", doubles="mean median p95 p99 std"))
def latency_statistics(spark, sf_dir):
    rows = view(spark, sf_dir, "interactions").select("interaction_type", F.col("fmv_approved").alias("success"), F.col("payment_amount").alias("seconds"))
    return R.latency_stats(rows, ["interaction_type"])


@query(sql("SELECT fmv_tier, count(*) AS n, avg(CASE WHEN has_payments THEN 1.0 ELSE 0.0 END) AS rate FROM profile GROUP BY fmv_tier", doubles="rate", **steps("profile")))
def payment_rate_by_tier(spark, sf_dir):
    return marts.profile(spark, sf_dir).groupBy("fmv_tier").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("has_payments").cast("double")).alias("rate"))


LEVELS = " UNION ALL ".join(f"SELECT '{n}' AS level, hcp_id, program_year, {k} AS key, sum(payment_amount) AS total, count(*) AS n FROM target GROUP BY ALL" for n, k in (("nature", "nature_of_payment"), ("company", "company_name"), ("year", "'all'")))


@query(sql(LEVELS, doubles="total", **steps("target")))
def payment_drilldown(spark, sf_dir):
    return R.drilldown(marts.target(spark, sf_dir))


@query(sql("SELECT hcp_id, feature, value, mean, CASE WHEN value > mean THEN 'high' ELSE 'low' END AS direction FROM (" + " UNION ALL ".join(f"SELECT hcp_id, '{c}' AS feature, {c} AS value, avg({c}) OVER () AS mean FROM profile" for c in IMPORTANT[:3]) + ")", doubles="value mean", **steps("profile")))
def against_population(spark, sf_dir):
    return R.vs_population(marts.profile(spark, sf_dir), IMPORTANT[:3])


@query(sql("SELECT list_sort(list(DISTINCT specialty)) AS specialty, list_sort(list(DISTINCT state)) AS state, list_sort(list(DISTINCT fmv_tier)) AS fmv_tier FROM master"))
def filter_options(spark, sf_dir):
    return R.filter_options(view(spark, sf_dir, "master"), ["specialty", "state", "fmv_tier"])


@query()
def investigation_reports(spark, sf_dir):
    """Nested rows; their parts are compared with SQL by the queries above."""
    top = R.top_features(marts.profile(spark, sf_dir), "hcp_id", IMPORTANT, 3)
    return R.investigation_report(scores(spark, sf_dir), scoring.flags(spark, sf_dir), top, FLAGS)


@query()
def monitoring_report(spark, sf_dir):
    rows = kept(scores(spark, sf_dir).select("hcp_id", "specialty", "state", "risk_tier", "risk_score", "total_rule_flags", *FLAGS))  # read by all four
    return R.monitoring_report(R.risk_distribution(rows), R.flag_patterns(rows, FLAGS, SEVERITY), R.risk_segments(rows, "state", FLAGS), R.systemic_issues(rows, FLAGS))
