"""Queries against the SQL that checks them, on the smallest tables."""

import os

import duckdb
import pytest

from ledgerlens.plans.fixtures import TABLES
from ledgerlens.plans.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
#: A query of each kind; all of them with ALL_QUERIES=1.
SOME = "threshold_evaluation top_states question_scopes policy_chunks event_flag_rates competitor_availability entity_year_pairs company_against_industry stored_spend_mart attribution_importance model_comparison peer_benchmark staged_payments population_payments company_match_fan_out spend_mart event_features risk_profile benchmark_ratios benchmark_classes peer_statistics full_priority event_matrix rule_flags risk_scores global_percentile interaction_violations event_violations violation_ground_truth flag_patterns systemic_issues two_hop reconciliation_report ranking_metrics topk_evaluation evaluation_summary document_chunks cosine_top_k keyword_lookup copod local_outlier_factor quality_checks".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = db.sql(ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    expected = sorted(repr(tuple(plain(dict(zip(relation.columns, r, strict=True))[c]) for c in columns)) for r in relation.fetchall())
    assert rows == expected


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
