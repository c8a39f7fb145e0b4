"""Queries over thresholds, groups with members, scopes of questions, key pairs, flag rates and the feature store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..operators import models as M
from ..operators import reports as R
from ..operators import scoring as S
from ..operators import texts as T
from ..operators.events import entity_labels
from ..operators.feature_store import FeatureStore
from ..sources.io import own_folder
from . import marts, records
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query
from .steps import Y3, steps
from .texts import TAXONOMY

SCORES = ("combined_raw_risk_score", "raw_spend_risk_score", "interaction_frequency_score")
LABELS = ("has_violation", "is_high", "is_serious", "is_moderate_or_worse")
CLASSES = "SELECT hcp_id, n > 0 AS has_violation, s = 3 AS is_high, s = 3 AND n >= 2 AS is_serious, s >= 2 AS is_moderate_or_worse FROM (SELECT hcp_id, count(*) FILTER (WHERE is_violation) AS n, max(CASE violation_severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS s FROM truth GROUP BY hcp_id)"
JUDGED = f"SELECT hcp_id, {', '.join(SCORES)}, {', '.join(f'coalesce({c}, false) AS {c}' for c in LABELS)} FROM profile LEFT JOIN classes USING (hcp_id)"
PLACED = " UNION ALL ".join(f"SELECT '{c}' AS score, {c} AS x, row_number() OVER (ORDER BY {c} DESC, hcp_id) AS i, {', '.join(LABELS)} FROM judged" for c in SCORES)
CUTS = " UNION ALL ".join([*[f"SELECT score, 'top {s:g}' AS cut, i <= ceil((SELECT count(*) FROM judged) * {s}) AS flagged, {', '.join(LABELS)} FROM placed" for s in (0.01, 0.05, 0.1)], f"SELECT score, 'above 0', x > 0, {', '.join(LABELS)} FROM placed WHERE score = 'raw_spend_risk_score'"])
CELLS = " UNION ALL ".join(f"SELECT score, '{c}' AS label, cut, count(*) AS n, count(*) FILTER (WHERE flagged) AS k, count(*) FILTER (WHERE flagged AND {c}) AS hits, count(*) FILTER (WHERE {c}) AS ones FROM cuts GROUP BY score, cut" for c in LABELS)


@query(sql("""SELECT score, label, cut, k, hits, CASE WHEN k > 0 THEN hits / CAST(k AS DOUBLE) ELSE 0 END AS precision, CASE WHEN ones > 0 THEN hits / CAST(ones AS DOUBLE) ELSE 0 END AS recall, CASE WHEN hits > 0 THEN 2.0 * hits / (k + ones) ELSE 0 END AS f1,
 CASE WHEN ones > 0 AND k > 0 THEN hits / CAST(k AS DOUBLE) / (ones / CAST(n AS DOUBLE)) ELSE 0 END AS lift, ones / CAST(n AS DOUBLE) AS base_rate, k / CAST(n AS DOUBLE) AS flagged_share FROM cells""",
 doubles="precision recall f1 lift base_rate flagged_share", **steps("profile", **records.ALL, classes=CLASSES, judged=JUDGED, placed=PLACED, cuts=CUTS, cells=CELLS)))
def threshold_evaluation(spark, sf_dir):
    """Every score against every label at three shares, and the spend score's natural threshold."""
    labels = M.label_classes(entity_labels(records.truth(spark, sf_dir))).select("hcp_id", *LABELS)
    rows = marts.profile(spark, sf_dir).select("hcp_id", *SCORES).join(labels, "hcp_id", "left").fillna(False, list(LABELS))
    return R.threshold_eval(rows, list(SCORES), list(LABELS), natural=("raw_spend_risk_score",))


TIER_ORDER = ("local", "regional", "national")


@query(sql("""SELECT state, fmv_tier, n, total, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY state ORDER BY CASE fmv_tier WHEN 'local' THEN 0 WHEN 'regional' THEN 1 WHEN 'national' THEN 2 ELSE 3 END, fmv_tier) AS INTEGER) AS member_place
 FROM tiers JOIN (SELECT state, total, row_number() OVER (ORDER BY total DESC, state) AS place FROM (SELECT state, CAST(sum(n) AS BIGINT) AS total FROM tiers GROUP BY state)) USING (state) WHERE place <= 10""", tiers="SELECT state, fmv_tier, count(*) AS n FROM master GROUP BY ALL"))
def top_states(spark, sf_dir):
    """The ten states of most entities, each with its tiers from local to national."""
    tiers = view(spark, sf_dir, "master").groupBy("state", "fmv_tier").agg(F.count(F.lit(1)).alias("n"))
    return R.top_groups(tiers, "state", "n", "fmv_tier", list(TIER_ORDER))


TERMS = "SELECT 'jurisdiction' AS dimension, lower(n_name) AS term, n_name AS value FROM nation UNION ALL SELECT 'hcp_specialty', lower(c_mktsegment), c_mktsegment FROM customer GROUP BY ALL UNION ALL SELECT * FROM (VALUES ('time_scope', 'annual', 'annual'), ('time_scope', 'per year', 'annual'), ('time_scope', 'weekly', 'weekly'), ('time_scope', 'per week', 'weekly'))"
ASKED = "SELECT o_orderkey AS question_id, concat('What is the ', CASE o_orderkey % 3 WHEN 0 THEN 'annual' WHEN 1 THEN 'weekly' ELSE 'general' END, ' limit in ', lower(n_name), ', for ', c_mktsegment, '?') AS text, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(sql("""SELECT question_id, CASE question_id % 3 WHEN 1 THEN 'time_scope:weekly' ELSE '' END AS mismatched, concat('hcp_specialty:', c_mktsegment, ' jurisdiction:', n_name) AS unsupported FROM asked""", asked=ASKED))
def question_scopes(spark, sf_dir):
    """Questions made from orders: rules exist by annual scope alone, so weekly ones mismatch, and states and specialties are unsupported."""
    tables = {t: view(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    asked = spark.sql(ASKED.replace("orders", "{orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN nation", "JOIN {nation}"), **tables)
    terms = spark.sql(TERMS.replace("FROM nation", "FROM {nation}").replace("FROM customer", "FROM {customer}"), nation=tables["nation"], customer=tables["customer"])
    rules = spark.createDataFrame([("time_scope", "annual")], "dimension string, value string")
    return T.scope_gaps(asked, terms, rules, ["question_id"]).select("question_id", F.concat_ws(" ", "mismatched").alias("mismatched"), F.concat_ws(" ", "unsupported").alias("unsupported"))


COLLAPSED = "WITH d AS (SELECT doc_id, [x for x in string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+') if x <> ''] AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 375) / 338.0)) AS INTEGER) + 1)) AS i FROM d WHERE len(w) > 0), t AS (SELECT doc_id, i, array_to_string(w[i * 338 + 1:i * 338 + 375], ' ') AS text, CAST(least(i * 338 + 375, len(w)) - i * 338 AS INTEGER) AS word_count FROM c)"


@query(COLLAPSED + " SELECT doc_id, concat(CAST(doc_id AS VARCHAR), '_chunk_', lpad(CAST(i AS VARCHAR), 4, '0')) AS chunk_id, word_count, md5(text) AS text_md5, array_to_string([x for x in [" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in TAXONOMY.items()) + "] if x IS NOT NULL], ',') AS tags FROM t")
def policy_chunks(spark, sf_dir):
    """Windows of 375 words, 37 shared, with their number of words and tags."""
    chunks = T.tag_text(T.chunk_words(view(spark, sf_dir, "documents"), 375, 37), TAXONOMY)
    return chunks.select("doc_id", "chunk_id", "word_count", F.md5("text").alias("text_md5"), F.concat_ws(",", "tags").alias("tags"))


RATES = ("low_attendance_flag", "speaker_fee_over_fmv_flag", "missing_attestation_flag", "rapid_repeat_flag", "high_venue_cost_flag")


@query(sql(f"SELECT fmv_tier, count(*) AS n, {', '.join(f'avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END) AS {c}_rate' for c in RATES)}, avg(speaker_fee) AS mean_speaker_fee FROM event_features JOIN master ON speaker_hcp_id = hcp_id GROUP BY fmv_tier", doubles=" ".join(f"{c}_rate" for c in RATES) + " mean_speaker_fee", **steps("event_features")))
def event_flag_rates(spark, sf_dir):
    rows = marts.features_of_events(spark, sf_dir).withColumnRenamed("speaker_hcp_id", "hcp_id").join(view(spark, sf_dir, "master").select("hcp_id", "fmv_tier"), "hcp_id")
    return R.rate_by(rows, "fmv_tier", list(RATES), ["speaker_fee"])


RIVALS = f"SELECT hcp_id, sum(payment_amount) AS competitor_spend, avg(payment_amount) AS competitor_avg_spend FROM staged WHERE is_competitor AND program_year = {Y3} GROUP BY hcp_id"


@query(sql(f"""SELECT hcp_id, own_spend, coalesce(competitor_spend, 0) AS competitor_spend, coalesce(competitor_avg_spend, 0) AS competitor_avg_spend, CASE WHEN own_spend + coalesce(competitor_spend, 0) > 0 THEN own_spend / (own_spend + coalesce(competitor_spend, 0)) END AS share_of_wallet, true AS available, 'with' AS source
 FROM (SELECT hcp_id, spend_{Y3} AS own_spend FROM spend) LEFT JOIN rivals USING (hcp_id) UNION ALL SELECT hcp_id, spend_{Y3}, NULL, NULL, NULL, false, 'without' FROM spend""", doubles="own_spend competitor_spend competitor_avg_spend share_of_wallet", **steps("spend", rivals=RIVALS)))
def competitor_availability(spark, sf_dir):
    """Shares of wallet with the competitors' source, and what is left of them without it."""
    own = marts.spend(spark, sf_dir).select("hcp_id", F.col(f"spend_{Y3}").alias("spend"))
    paid = marts.staged(spark, sf_dir).where(f"is_competitor and program_year = {Y3}").groupBy("hcp_id").agg(F.sum("payment_amount").alias("competitor_spend"), F.avg("payment_amount").alias("competitor_avg_spend"))
    return B.competitor_benchmarks(own, paid).withColumn("source", F.lit("with")).unionByName(B.competitor_benchmarks(own, None).withColumn("source", F.lit("without")))


@query(sql("SELECT hcp_id, program_year FROM target WHERE hcp_id IS NOT NULL AND program_year IS NOT NULL UNION SELECT hcp_id, program_year FROM interactions WHERE hcp_id IS NOT NULL AND program_year IS NOT NULL UNION SELECT speaker_hcp_id, program_year FROM speaker_events WHERE speaker_hcp_id IS NOT NULL AND program_year IS NOT NULL", **steps("target")))
def entity_year_pairs(spark, sf_dir):
    return R.all_pairs((marts.target(spark, sf_dir), "hcp_id", "program_year"), (view(spark, sf_dir, "interactions"), "hcp_id", "program_year"), (view(spark, sf_dir, "speaker_events"), "speaker_hcp_id", "program_year"))


LIMITS = "SELECT nature_of_payment AS rule_id, max(CASE WHEN is_target THEN payment_amount END) AS company_value, max(CASE WHEN NOT is_target THEN payment_amount END) AS industry_value, avg(payment_amount) AS mean_amount FROM staged GROUP BY nature_of_payment"


@query(sql("SELECT rule_id, company_value, coalesce(industry_value, mean_amount) AS industry_value, coalesce(company_value < coalesce(industry_value, mean_amount), false) AS company_stricter FROM limits", doubles="company_value industry_value", **steps("staged", limits=LIMITS)))
def company_against_industry(spark, sf_dir):
    """The largest payment of each kind as a maximum: the company's own against the others'."""
    staged = marts.staged(spark, sf_dir)
    rows = staged.groupBy(F.col("nature_of_payment").alias("rule_id")).agg(F.max(F.when(F.col("is_target"), F.col("payment_amount"))).alias("company_value"), F.max(F.when(~F.col("is_target"), F.col("payment_amount"))).alias("industry_value"), F.avg("payment_amount").alias("threshold"))
    rules = rows.select("rule_id", "company_value", "industry_value", F.lit("maximum").alias("threshold_type"), F.lit("USD").alias("unit"))
    return S.compare_rules(rules, rows.select("rule_id", "threshold")).select("rule_id", "company_value", "industry_value", "company_stricter")


@query(sql("SELECT * FROM spend", doubles=marts.SPEND_DOUBLES, **steps("spend")))
def stored_spend_mart(spark, sf_dir):
    """The spend mart from a feature store that was brought up to date twice: years but the last, then the last."""
    target, met = marts.target(spark, sf_dir), view(spark, sf_dir, "interactions")
    years = sorted({r[0] for df in (target, met) for r in df.select("program_year").distinct().collect()} | set(C.years))  # a row a year
    store = FeatureStore(spark, own_folder(spark, "store"), C)
    store.update(target, met, years[:-1])
    store.update(target, met, years)
    return store.spend_mart(view(spark, sf_dir, "master"))
