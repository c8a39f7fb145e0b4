"""Sums of the same amounts in another order compare as equal."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import benchmarks, events, payments


def given(spark, orders):
    rows = [(h, 2024, a, "S", "C", True) for h, amounts in orders.items() for a in amounts]
    df = spark.createDataFrame(rows, "hcp_id string, program_year long, payment_amount double, specialty string, company_name string, is_meal boolean").coalesce(1)
    return df.withColumns({c: F.lit(False) for c in ("is_speaking_fee", "is_consulting", "meal_over_limit")} | {"meal_overage_pct": F.lit(None).cast("double")})


def test_order_of_payments_changes_no_rank(spark):
    df = given(spark, {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1]})
    assert sum([0.1, 0.2]) + 0.3 != sum([0.3, 0.2]) + 0.1
    years = payments.entity_year_spend(df)
    assert {r.r for r in benchmarks.peer_ranks(years, {"r": (("program_year",), "year_spend")}).collect()} == {0.0}
    for found, column in ((benchmarks.industry_spend(df, (2024,)), "industry_spend_2024"), (benchmarks.competitor_spend(df, (2024,)), "competitor_spend_2024"), (benchmarks.competitor_spend(df, (2024,)), "competitor_spend_3yr")):
        assert [r[0] for r in found.select(column).distinct().collect()] == [pytest.approx(0.6)]


def test_order_of_events_changes_no_combined_score(spark):
    scores = ((0.1 + 0.2) + 0.3, (0.3 + 0.2) + 0.1)
    df = spark.createDataFrame([(0.0, s, 0.0) for s in scores], "raw_spend_risk_score double, avg_event_risk_score double, interaction_frequency_score double")
    assert df.select(events.combined_risk([F.lit(False), F.lit(True), F.lit(False)]).alias("s")).distinct().count() == 1


def test_payments_of_one_kind_only_are_all_of_an_entity(spark):
    """Sums of one kind and of all, by year and over the years: where they are the same payments, the share is 1 whatever their order."""
    amounts = {"a": [0.1, 0.2, 0.3, 1e5 + 0.7], "b": [1e5 + 0.7, 0.3, 0.2, 0.1]}
    df = given(spark, amounts).withColumn("is_speaking_fee", F.lit(True))
    rows = df.unionByName(df.withColumns({"program_year": F.lit(2023).cast("long"), "payment_amount": F.col("payment_amount") / 3}))
    years = payments.entity_year_spend(rows)
    spend = payments.entity_spend(years, (2023, 2024))
    assert {r[0] for r in spend.select(payments.share(F.col("speaking_fee_total"), F.col("lifetime_total_spend"))).collect()} == {1.0}
    assert spend.select("lifetime_total_spend", "food_beverage_total", "speaking_fee_total").distinct().count() == 1


def test_order_of_events_changes_no_mean(spark):
    rows = [(h, x, x) for h, xs in {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1]}.items() for x in xs]
    df = spark.createDataFrame(rows, "speaker_hcp_id string, raw_event_risk_score double, speaker_fee double").coalesce(1)
    df = df.withColumns({c: F.lit(False) for c in ("speaker_fee_over_fmv_flag", "low_attendance_flag", "missing_attestation_flag", "rapid_repeat_flag")})
    assert events.entity_events(df).select("avg_event_risk_score", "total_speaker_fees_events").distinct().count() == 1
