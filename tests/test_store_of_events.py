"""The feature store's event matrix: written once, whichever query comes first, and the profile's signals follow from it."""

from ledgerlens.operators import events, payments
from ledgerlens.plans import registry  # noqa: F401  (first: it imports the others)
from ledgerlens.plans import marts, scoring


def test_matrix_once(spark, monkeypatch):
    sf_dir, calls, rows = "/root/testdata/sf0.001", [], []
    real = marts.features_of_events
    monkeypatch.setattr(marts, "features_of_events", lambda *a: calls.append(a) or real(*a))
    for first in (scoring.flags, marts.profile):
        monkeypatch.setattr(marts, "_STORES", {})
        calls.clear()
        first(spark, sf_dir)
        for _ in range(3):
            scoring.flags(spark, sf_dir)
        assert len(calls) == (1 if first is scoring.flags else 2)
        rows.append(sorted(map(tuple, marts.profile(spark, sf_dir).collect()), key=repr))
    assert rows[0] == rows[1]
    features = real(spark, sf_dir)
    whole, derived = events.entity_events(features), events.events_of_matrix(scoring.S.event_matrix(features))
    assert derived.dtypes == whole.dtypes


def test_few_patterns_without_python(spark):
    names = spark.createDataFrame([(1, "Acme"), (2, None)], "id long, company_raw string")
    few, many = (spark.createDataFrame([(f"p{i}",) for i in range(n)], "pattern string") for n in (6, 40))
    plans = [payments.match_company(names, seeds)._jdf.queryExecution().toString() for seeds in (few, many)]
    assert "Python" not in plans[0] and "Python" in plans[1]
