"""Keyword lookup over whole texts, and rules whose texts stand on many rows."""

import duckdb

from ledgerlens.operators import texts as T
from ledgerlens.plans.registry import ORACLE_SQL, QUERIES


def test_rules_on_many_rows(spark):
    queries = spark.createDataFrame([(1, "red green blue")], "query_id long, text string")
    rules = spark.createDataFrame([("a", "red"), ("a", "Red, green"), ("a", None), ("b", "x" * 50 + " blue green red")], "rule_id string, text string")
    assert [(r.rule_id, r.score) for r in T.lookup_rules(queries, rules).orderBy("place").collect()] == [("b", 3), ("a", 2)]


def test_whole_texts_match_sql(spark):
    con = duckdb.connect()
    for name in ("keyword_lookup", "keyword_lookup_whole"):
        for sf in ("sf0.001", "sf0.01"):
            for t in ("documents", "benchmark"):
                con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
            df = QUERIES[name](spark, f"/root/testdata/{sf}")
            assert "collect_list" not in df._jdf.queryExecution().toString()
            want = con.sql(f"SELECT query_id, rule_id, score, place FROM ({ORACLE_SQL[name]})").fetchall()
            assert want and sorted(tuple(r) for r in df.select("query_id", "rule_id", "score", "place").collect()) == sorted(want)
