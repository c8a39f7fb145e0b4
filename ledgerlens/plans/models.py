"""Queries over anomaly models and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import quality_checks as Q
from ..operators.nearest import Neighbours
from . import marts, records, scoring
from .fixtures import sql, view
from .registry import query
from .steps import steps

FEATURES = ["lifetime_total_spend", "annual_cap_pct_used", "meal_breach_rate", "pct_speaking_fee", "avg_event_risk_score", "interaction_frequency_score"]
LONG = " UNION ALL ".join(f"SELECT hcp_id, '{c}' AS feature, {c} AS x FROM profile" for c in FEATURES)


def features(spark, sf_dir):
    return marts.profile(spark, sf_dir).select("hcp_id", *FEATURES)


@query()
def isolation_forest(spark, sf_dir):
    """Seeded random trees: no SQL gives the same; tests compare the ranking with planted outliers."""
    rows = features(spark, sf_dir)
    return M.iforest_label(M.iforest_score(rows, M.iforest_fit(rows, FEATURES), FEATURES))


@query(sql("SELECT hcp_id, sum(greatest(CASE WHEN skew < 0 THEN l WHEN skew > 0 THEN r ELSE l + r END, (l + r) / 2)) AS copod_score FROM (SELECT *, -ln((k + t - 1) / CAST(n AS DOUBLE)) AS l, -ln((n - k + 1) / CAST(n AS DOUBLE)) AS r FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) AS k, count(*) OVER (PARTITION BY feature, x) AS t, count(*) OVER (PARTITION BY feature) AS n FROM long)) JOIN (SELECT feature, skewness(x) AS skew FROM long GROUP BY feature) USING (feature) GROUP BY hcp_id", doubles="copod_score", **steps("profile", long=LONG)))
def copod(spark, sf_dir):
    return M.copod(features(spark, sf_dir), "hcp_id", FEATURES)


@query(sql("SELECT hcp_id, feature, least(f, 1 - f) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x, hcp_id) / CAST(count(*) OVER (PARTITION BY feature) AS DOUBLE) AS f FROM long)", doubles="tail", **steps("profile", long=LONG)))
def tail_probabilities(spark, sf_dir):
    return M.tail_probs(features(spark, sf_dir), "hcp_id", FEATURES)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, vec_id) AS k FROM (SELECT a.vec_id AS q, b.vec_id, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id)) WHERE k <= 20),
kd AS (SELECT q AS vec_id, max(d) AS kd FROM nn GROUP BY q), lrd AS (SELECT q, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM nn JOIN kd USING (vec_id) GROUP BY q)
SELECT n.q AS vec_id, round(avg(o.lrd) / any_value(l.lrd) * 1.0000000001::DOUBLE, 4) AS lof FROM nn n JOIN lrd o ON n.vec_id = o.q JOIN lrd l ON n.q = l.q GROUP BY n.q""")
def local_outlier_factor(spark, sf_dir):
    return M.lof(Neighbours(view(spark, sf_dir, "embeddings"), 20).table())


@query()
def principal_components(spark, sf_dir):
    """The sign of a component is free: no SQL gives the same; tests check the variance."""
    return M.pca(features(spark, sf_dir), FEATURES, 3).select("hcp_id", *[F.abs(F.col("components")[i]).alias(f"component_{i}") for i in range(3)])


@query(sql("SELECT hcp_id, n > 0 AS has_violation, s = 3 AS is_high, s = 3 AND n >= 2 AS is_serious, s >= 2 AS is_moderate_or_worse FROM (SELECT hcp_id, count(*) FILTER (WHERE is_violation) AS n, max(CASE violation_severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS s FROM truth GROUP BY hcp_id)", **records.ALL))
def label_classes(spark, sf_dir):
    from ..operators.events import entity_labels

    return M.label_classes(entity_labels(records.truth(spark, sf_dir))).select("hcp_id", "has_violation", "is_high", "is_serious", "is_moderate_or_worse")


def _check(name: str, subject: str, failures: str, table: str) -> str:
    return f"SELECT '{name}' AS check, '{subject}' AS subject, {failures} = 0 AS passed, CAST({failures} AS BIGINT) AS failures FROM {table}"


@query(sql(" UNION ALL ".join([
    _check("not_null", "hcp_id", "count(*) FILTER (WHERE hcp_id IS NULL)", "staged"), _check("not_null", "payment_amount", "count(*) FILTER (WHERE payment_amount IS NULL)", "staged"), _check("not_null", "company_name", "count(*) FILTER (WHERE company_name IS NULL)", "staged"),
    "SELECT 'unique' AS check, 'record_id' AS subject, count(*) FILTER (WHERE c > 1) = 0 AS passed, count(*) FILTER (WHERE c > 1) AS failures FROM (SELECT count(*) AS c FROM staged GROUP BY record_id)",
    _check("accepted", "nature_of_payment", "count(*) FILTER (WHERE nature_of_payment NOT IN ('Food and Beverage', 'Consulting Fee', 'Education'))", "staged"), _check("range", "payment_amount", "count(*) FILTER (WHERE NOT payment_amount BETWEEN 0 AND 90000)", "staged"),
    _check("rate", "is_target", "(CASE WHEN avg(CAST(is_target AS INTEGER)) BETWEEN 0.2 AND 0.4 THEN 0 ELSE 1 END)", "staged"), _check("row_count", "*", "(CASE WHEN count(*) BETWEEN 1 AND 1000000000 THEN 0 ELSE 1 END)", "staged"),
]), **steps("staged")))
def quality_checks(spark, sf_dir):
    rows = marts.staged(spark, sf_dir)
    return Q.all_checks(Q.check_not_null(rows, ["hcp_id", "payment_amount", "company_name"]), Q.check_unique(rows, "record_id"), Q.check_accepted(rows, "nature_of_payment", ["Food and Beverage", "Consulting Fee", "Education"]), Q.check_ranges(rows, {"payment_amount": (0, 90000)}), Q.check_rates(rows, {"is_target": (0.2, 0.4)}), Q.check_row_count(rows, 1, 1_000_000_000))


@query(sql(" UNION ALL ".join(_check("binary", n, f"count(*) FILTER (WHERE CAST({n} AS INTEGER) NOT IN (0, 1))", "flags") for n, _, _, _ in scoring.RULES), **scoring.ALL))
def flag_checks(spark, sf_dir):
    return Q.check_binary(scoring.flags(spark, sf_dir), [n for n, _, _, _ in scoring.RULES])
