"""Operators on small frames."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models, quality_checks, reports, scoring, texts
from ledgerlens.operators.benchmarks import frac_rank_global
from ledgerlens.operators.payments import match_company
from ledgerlens.sources import io


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_two_patterns_give_two_rows(spark):
    pay = spark.createDataFrame([("Acme Brand Co",), ("Other",), (None,)], "company_raw string")
    seed = spark.createDataFrame([("acme",), ("brand",)], "pattern string")
    assert match_company(pay, seed).groupBy("company_raw").count().where("company_raw = 'Acme Brand Co'").first()["count"] == 2
    assert match_company(pay, seed).count() == 4


def test_reconciled_rules(spark):
    sources = spark.createDataFrame(
        [("A", "OIG", 10.0, "maximum"), ("A", "CMS", 8.0, "maximum"), ("B", "Company", 0.8, "minimum"), ("B", "PhRMA", 0.7, "minimum"), ("C", "CMS", None, "maximum"), ("D", "OIG", 5.0, "maximum"), ("D", "Company", 5.0, "maximum"), ("E", "PhRMA", 1.0, "prohibited")],
        "rule_id string, authority string, value double, threshold_type string",
    )
    fallback = spark.createDataFrame([("A", 1.0), ("C", 3.0)], "rule_id string, value double")
    got = {r.rule_id: (r.threshold, r.effective_source, r.used_fallback) for r in scoring.reconcile_rules(sources, fallback).collect()}
    assert got == {"A": (8.0, "CMS", False), "B": (0.8, "Company", False), "C": (3.0, "fallback", True), "D": (5.0, "OIG", False), "E": (1.0, "PhRMA", False)}


def test_flag_citations(spark):
    flags = spark.createDataFrame([("HCP_1", True, False), ("HCP_2", True, True)], "hcp_id string, f1 boolean, f2 boolean")
    rules = spark.createDataFrame([("R2", 5.0, "doc 2"), ("R3", 6.0, "doc 3")], "rule_id string, threshold double, citation string")
    got = sorted(rows(scoring.flag_citations(flags, rules, {"f1": ["R1", "R2", "R3"], "f2": ["R3"]})))
    assert got == [("HCP_1", "f1", "R2", 5.0, "doc 2"), ("HCP_2", "f1", "R2", 5.0, "doc 2"), ("HCP_2", "f2", "R3", 6.0, "doc 3")]


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert scoring.join_one_to_one(a, b, "k").count() == 2
    with pytest.raises(ValueError, match="one to one"):
        scoring.join_one_to_one(a, b.union(b), "k")


def test_missing_columns_count_as_defaults(spark):
    flags = scoring.apply_rules(spark.createDataFrame([("HCP_1", 0.2)], "hcp_id string, meal_breach_rate double")).first()
    assert flags.flag_meal_limit_breach and flags.flag_meal_chronic_breach and not flags.flag_missing_attestation and not flags.flag_fmv_non_compliance


def test_nulls_and_infinities_are_filled(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (float("inf"), True, None), (float("nan"), False, "b")], "x double, f boolean, s string")
    assert rows(scoring.fill_nulls(df)) == [(1.0, False, "a"), (0.0, True, None), (0.0, False, "b")]


def test_minmax_of_a_constant(spark):
    assert rows(scoring.minmax_100(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", "y").select("y")) == [(50.0,), (50.0,)]


def test_global_rank_with_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 3)], "x double")
    assert sorted(rows(frac_rank_global(df, "x", "r"))) == [(1.0, 0.25), (1.0, 0.25), (3.0, 0.75), (5.0, 1.0)]
    assert sorted(rows(frac_rank_global(df, "x", "r", "average")))[0] == (1.0, 1.5 / 4)


def test_isolation_forest_finds_planted_outliers(spark):
    data = [(f"HCP_{i}", float(i % 17) / 17, float(i * 7 % 23) / 23) for i in range(600)] + [(f"OUT_{i}", 8.0 + i, -9.0 - i) for i in range(5)]
    df = spark.createDataFrame(data, "hcp_id string, a double, b double")
    model = models.iforest_fit(df, ["a", "b"], trees=40)
    assert model.count() == 40
    scored = models.iforest_label(models.iforest_score(df, model, ["a", "b"]))
    top = [r.hcp_id for r in scored.orderBy(F.desc("score")).limit(5).collect()]
    assert sorted(top) == [f"OUT_{i}" for i in range(5)]
    assert scored.where("is_outlier").count() <= 61
    r = scored.first()
    assert abs(r.attribution_a + r.attribution_b - (r.path_length - r.mean_path_length)) < 1e-9


def test_principal_components_keep_variance(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + (i % 3), float(i % 5)) for i in range(60)], "a double, b double, c double")
    got = models.pca(df, ["a", "b", "c"], 2).select(F.variance(F.col("components")[0]).alias("v0"), F.variance(F.col("components")[1]).alias("v1")).first()
    total = df.select((F.variance("a") + F.variance("b") + F.variance("c")).alias("t")).first().t
    assert got.v0 > got.v1 and got.v0 + got.v1 > 0.95 * total


def test_answers_are_trimmed(spark):
    df = spark.createDataFrame([("I cannot say. However, rules exist. Please ask the compliance team for help.",), ("All fine here.",), (None,)], "answer string")
    got = rows(texts.trim_answers(df).select("was_trimmed", "trimmed"))
    assert got == [(True, "I cannot say. Please ask the compliance team for help."), (False, "All fine here."), (False, None)]


def test_confidence_and_contexts(spark):
    df = spark.createDataFrame([(True, True, False, True), (True, True, True, True), (True, False, False, True), (True, True, False, False)], "has_rules boolean, has_policy boolean, scope_warning boolean, grounded boolean")
    assert [r.confidence for r in texts.answer_confidence(df).collect()] == ["high", "medium", "medium", "low"]
    c = spark.createDataFrame([(["a"], None)], "x array<string>, y array<string>")
    assert texts.assemble_contexts(c, {"x": "rule", "y": "policy"}).first().contexts == ["[rule] a"]


def test_citations_and_selection(spark):
    c = texts.clean_citations(spark.createDataFrame([("One [1] and two [12].",)], "text string")).first()
    assert (c.citations, c.clean) == (["1", "12"], "One and two.")
    s = spark.createDataFrame([("c", i, v, [1.0, 0.0]) for i, v in enumerate(([1.0, 0.0], [0.0, 1.0], [0.9, 0.1]))] + [("d", 0, [0.0, 1.0], [1.0, 0.0])], "chunk_id string, i int, v array<double>, answer array<double>")
    assert sorted((r.chunk_id, r.i) for r in texts.select_sentences(s).collect()) == [("c", 0), ("c", 2)]
    hits = spark.createDataFrame([("q", "c1", 2), ("q", "c1", 1), ("q", "c2", 3)], "q string, chunk string, i int")
    assert sorted(rows(texts.dedupe_hits(hits, "chunk", "q", "i"))) == [("q", "c1", 1), ("q", "c2", 3)]


def test_gates_and_delta(spark):
    now = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "category string, mean double")
    before = spark.createDataFrame([("a", 0.7)], "category string, mean double")
    assert {r.category: r.delta and round(r.delta, 6) for r in reports.eval_delta(now, before).collect()} == {"a": -0.2, "b": None}
    assert [r.category for r in reports.gate_failures(now, {"a": 0.6, "b": 0.6}).collect()] == ["a"]


def test_leakage_and_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "k int, x double")
    assert quality_checks.check_leakage(df, ["x", "y"]) == ["x"]
    assert rows(quality_checks.check_unique(df, "k")) == [("unique", "k", False, 1)]
    assert rows(quality_checks.check_not_null(df, ["k", "x"])) == [("not_null", "k", True, 0), ("not_null", "x", False, 1)]


def test_sources_and_sinks(spark, tmp_path):
    for year, line in ((2022, '1,7,Covered Recipient Physician,ONC,NY,"Acme, Inc.",12.5,2022-03-01,Education'), (2023, "2,x,Covered Recipient Physician,ONC,NY,Other,bad,2023-01-09,Education")):
        folder = tmp_path / "csv" / f"program_year={year}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("record_id,profile_id,recipient_type,specialty,state,company_raw,payment_amount,payment_date,nature_of_payment\n" + line + "\n")
    pay = io.read_payments_csv(spark, str(tmp_path / "csv"))
    assert sorted((r.record_id, r.profile_id, r.company_raw, r.payment_amount, r.program_year) for r in pay.collect()) == [("1", 7, "Acme, Inc.", 12.5, 2022), ("2", None, "Other", None, 2023)]
    out = str(tmp_path / "t")
    assert io.ingest_years(spark, pay, out, [2022]) == [2022]
    assert io.ingest_years(spark, pay, out, [2022, 2023], "other") == [2023]
    assert io.ingest_years(spark, pay, out, [2022, 2023]) == []
    assert io.read_table(spark, out, ["record_id"]).count() == 2
    assert io.optional_source(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "rules.json").write_text('{"rules": [{"rule_id": "A", "threshold": true, "sources": [{"authority": "OIG", "extracted_value": 5}]}, {"rule_id": "B", "threshold": 2.5, "sources": []}]}')
    rules, sources = io.load_rules(spark, str(tmp_path / "rules.json"))
    assert sorted((r.rule_id, r.threshold, r.is_boolean) for r in rules.collect()) == [("A", 1.0, True), ("B", 2.5, False)]
    assert sorted((r.rule_id, r.authority, r.value) for r in sources.collect()) == [("A", "OIG", 5.0), ("B", None, None)]
    io.write_csv(rules.select("rule_id"), str(tmp_path / "c"))
    io.write_summary(rules.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "s"))
    io.write_table(rules, str(tmp_path / "w"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 2 and spark.read.parquet(str(tmp_path / "w")).count() == 2
