"""Scopes of questions, words of many rules, top groups, pairs and rates on small tables."""

from collections import Counter

import pytest

from ledgerlens.operators import benchmarks, reports, texts


def test_longest_term_counts(spark):
    terms = spark.createDataFrame([("state", "virginia", "VA"), ("state", "West Virginia", "WV"), ("role", "nurse", "nurse"), ("role", "nurse practitioner", "NP"), ("time", "per year", "annual"), ("time", None, "x"), ("state", "west", "W")], "dimension string, term string, value string")
    rules = spark.createDataFrame([("time", "weekly"), ("state", "VA")], "dimension string, value string")
    asked = ["Limits in West Virginia per year?", "virginia NURSE, per week", "a nurse practitioner in the west, virginia", "per  year", None, "", "virginian nurses"]
    df = spark.createDataFrame(list(enumerate(asked)), "id long, text string")
    got = {r.id: (r.mismatched, r.unsupported) for r in texts.scope_gaps(df, terms, rules, ["id"]).collect()}
    assert got == {0: (["state:WV", "time:annual"], []), 1: ([], ["role:nurse"]), 2: (["state:WV"], ["role:NP"]), 3: (["time:annual"], []), 4: ([], []), 5: ([], []), 6: ([], [])}
    assert texts.TermTrie([("a", "x y z", "1"), ("a", "x", "2")]).found("x y x y z") == [("a", "2"), ("a", "1")]


def test_too_many_terms(spark, monkeypatch):
    monkeypatch.setattr(texts, "MOST_TERMS", 1)
    terms = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "dimension string, term string, value string")
    with pytest.raises(ValueError, match="terms"):
        texts.scope_gaps(terms, terms, terms.select("dimension", "value"), ["value"], "term")


@pytest.mark.parametrize("hot", [4096, 5])
def test_a_word_in_every_rule(spark, monkeypatch, hot):
    monkeypatch.setattr(texts, "HOT", hot)
    rules = [(f"r{i:03}", f"the word{i % 7} rule{i % 3} the") for i in range(90)]
    asked = [(1, "the word1 rule2"), (2, "The"), (3, "none of it"), (4, None)]
    got = {(r.query_id, r.place): (r.rule_id, r.score) for r in texts.lookup_rules(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(rules, "rule_id string, text string"), 4).collect()}
    want = {}
    for q, text in asked:
        scores = Counter({r: len(set((text or "").lower().split()) & set(t.split())) for r, t in rules})
        best = sorted(((-s, r) for r, s in scores.items() if s), key=lambda x: x)[:4]
        want |= {(q, k + 1): (r, -s) for k, (s, r) in enumerate(best)}
    assert got == want


def test_top_groups(spark):
    rows = spark.createDataFrame([("a", "Low", 3), ("a", "High", 1), ("b", "Critical", 9), ("b", "Low", 1), ("c", "High", 2), (None, "Low", 5), ("a", "Odd", 1)], "g string, tier string, n long")
    got = [(r.g, r.place, r.tier, r.member_place) for r in reports.top_groups(rows, "g", "n", "tier", ["Low", "Medium", "High", "Critical"], 3).orderBy("place", "member_place").collect()]
    assert got == [("b", 1, "Low", 1), ("b", 1, "Critical", 2), (None, 2, "Low", 1), ("a", 3, "Low", 1), ("a", 3, "High", 2), ("a", 3, "Odd", 3)]


def test_pairs_rates_and_missing_source(spark):
    one = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", None)], "id string, y int")
    assert sorted(map(tuple, reports.all_pairs((one, "id", "y"), (spark.createDataFrame([("z", 3), ("x", 1)], "k string, yr long"), "k", "yr")).collect())) == [("x", 1), ("z", 3)]
    flags = spark.createDataFrame([("a", True, 2.0), ("a", None, 4.0), ("b", False, None)], "g string, f boolean, s double")
    assert sorted(map(tuple, reports.rate_by(flags, "g", ["f"], ["s"]).collect())) == [("a", 2, 0.5, 3.0), ("b", 1, 0.0, None)]
    own = spark.createDataFrame([("x", 0.0), ("y", None), ("z", 3.0)], "hcp_id string, spend double")
    rivals = spark.createDataFrame([("z", 1.0, 0.5)], "hcp_id string, competitor_spend double, competitor_avg_spend double")
    assert sorted(map(tuple, benchmarks.competitor_benchmarks(own, rivals).collect())) == [("x", 0.0, 0.0, 0.0, None, True), ("y", 0.0, 0.0, 0.0, None, True), ("z", 3.0, 1.0, 0.5, 0.75, True)]
    assert {tuple(r)[2:] for r in benchmarks.competitor_benchmarks(own, None).collect()} == {(None, None, None, False)}


def test_thresholds(spark):
    rows = [(f"h{i:02}", float(i // 2), None if i == 3 else float(i - 10), i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "hcp_id string, a double, b double, y boolean")
    got = {(r.score, r.cut): (r.k, r.hits) for r in reports.threshold_eval(df, ["a", "b"], ["y"], (0.1,), ("b",)).collect()}
    top = sorted(rows, key=lambda r: (-r[1], r[0]))[:4]
    assert got == {("a", "top 0.1"): (4, sum(r[3] for r in top)), ("b", "top 0.1"): (4, sum(r[3] for r in rows[-4:])), ("b", "above 0"): (29, sum(r[3] for r in rows[11:]))}
