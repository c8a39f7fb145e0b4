"""Company matching against LIKE, by the automaton and by grams."""

import pytest

from ledgerlens.operators import payments

NAMES = ["Acme Pharma Inc", "ACME", "acm", "Nova 100% Ltd", "no_va", "nova", "", None, "a\nb acme x", "beta acme nova", "日本 Acme"] + ["Acme Pharma Inc"] * 50
PATTERNS = ["acme", "nova", "ac_e", "no%va", "a", "", "日本", "pharma inc", "zz", None, "acme ph", "b%x"]


@pytest.mark.parametrize("most", [200_000, 3])
def test_equals_like(spark, monkeypatch, most):
    monkeypatch.setattr(payments, "MOST_PATTERNS", most)
    names = spark.createDataFrame(list(enumerate(NAMES)), "id long, company_raw string")
    seeds = spark.createDataFrame([(p, f"name {i}") for i, p in enumerate(PATTERNS)] + [("nova", "again")], "pattern string, pseudo_name string")
    found = payments.match_company(names, seeds)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()
    got = sorted(((r.id, r.pattern, r.pseudo_name) for r in found.collect()), key=repr)
    names.createOrReplaceTempView("company_names")
    seeds.createOrReplaceTempView("company_seeds")
    want = spark.sql("SELECT id, pattern, pseudo_name FROM company_names LEFT JOIN company_seeds ON lower(company_raw) LIKE concat('%', pattern, '%')").collect()
    assert got == sorted((tuple(r) for r in want), key=repr)
    assert sum(1 for r in got if r[0] == 9) == 7  # two and more patterns of one name are as many rows
