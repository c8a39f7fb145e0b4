"""Queries over the marts: payments, spend, events, interactions and the risk profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import payments as P
from ..operators import scoring as S
from ..operators.feature_store import FeatureStore
from ..sources.io import exists, own_folder
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query
from .steps import A, B, D, Y1, Y2, Y3, steps

SPEND_DOUBLES = f"lifetime_total_spend spend_{Y1} spend_{Y2} spend_{Y3} peak_year_spend annual_cap_pct_used meal_breach_rate max_meal_overage_pct yoy_growth_{A}{B} yoy_growth_{B}{D} pct_food_beverage pct_speaking_fee pct_consulting speaking_fee_total consulting_fee_total food_beverage_total avg_unique_reps top_rep_concentration_pct raw_spend_risk_score"
EVENT_DOUBLES = "speaker_fee venue_cost travel_reimbursement total_program_cost meal_cost_per_attendee venue_cost_pct_of_total speaker_fee_fmv_pct attendees_signed_pct raw_event_risk_score"
ENTITY_EVENT_DOUBLES = "avg_event_risk_score max_event_risk_score total_speaker_fees_events pct_events_over_fmv"
INTERACTION_DOUBLES = "avg_meal_cost fmv_compliance_rate interaction_frequency_score"
PROFILE_DOUBLES = f"lifetime_total_spend peak_year_spend annual_cap_pct_used meal_breach_rate max_meal_overage_pct pct_speaking_fee raw_spend_risk_score {ENTITY_EVENT_DOUBLES} {INTERACTION_DOUBLES} combined_raw_risk_score"
HIDDEN = ["first_name", "last_name", "npi", "address", "city"]


def staged(spark, sf_dir):
    return P.stage_payments(view(spark, sf_dir, "payments_raw"), view(spark, sf_dir, "company_map"), C)


def target(spark, sf_dir):
    return P.target_payments(staged(spark, sf_dir))


#: Folder of the feature store of each (application, folder of tables).
_STORES: dict[tuple[str, str], str] = {}


def stored(spark, sf_dir, with_matrix=False):
    """(spend mart, risk profile; with_matrix: event matrix) of the application's feature store over these tables.

    The first query that asks brings the store up to date and writes the marts; those after it read them. Where the first
    query wants the matrix, the events are aggregated once for it, and the profile's signals follow from it. The views hold
    payments of the configured years only. The queries spend_mart and risk_profile don't read it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    root = _STORES.get(key)
    if not root or not exists(spark, f"{root}/profile/_SUCCESS"):
        root = own_folder(spark, "features")
        store = FeatureStore(spark, root, C)
        master, met = view(spark, sf_dir, "master"), view(spark, sf_dir, "interactions")
        store.update(target(spark, sf_dir), met, sorted({r[0] for r in met.select("program_year").distinct().collect()} | set(C.years)))  # a row a year
        store.spend_mart(master).write.parquet(f"{root}/spend")
        events = E.events_of_matrix(_written_matrix(spark, sf_dir, root)) if with_matrix else E.entity_events(features_of_events(spark, sf_dir))
        E.risk_profile(master, spark.read.parquet(f"{root}/spend"), events, store.entity_interactions()).write.parquet(f"{root}/profile")
        _STORES[key] = root
    found = spark.read.parquet(f"{root}/spend"), spark.read.parquet(f"{root}/profile")
    return (*found, _written_matrix(spark, sf_dir, root)) if with_matrix else found


def _written_matrix(spark, sf_dir, root):
    if not exists(spark, f"{root}/matrix/_SUCCESS"):
        S.event_matrix(features_of_events(spark, sf_dir)).write.mode("overwrite").parquet(f"{root}/matrix")
    return spark.read.parquet(f"{root}/matrix")


def spend(spark, sf_dir):
    return stored(spark, sf_dir)[0]


def profile(spark, sf_dir):
    return stored(spark, sf_dir)[1]


def direct_spend(spark, sf_dir):
    return P.spend_mart(view(spark, sf_dir, "master"), target(spark, sf_dir), view(spark, sf_dir, "interactions"), C)


def features_of_events(spark, sf_dir):
    return E.event_features(view(spark, sf_dir, "speaker_events"), view(spark, sf_dir, "attendees"), C)


def direct_profile(spark, sf_dir):
    return E.risk_profile(view(spark, sf_dir, "master"), direct_spend(spark, sf_dir), E.entity_events(features_of_events(spark, sf_dir)), E.entity_interactions(view(spark, sf_dir, "interactions"), C))


@query(sql("SELECT * FROM staged", doubles="payment_amount", **steps("staged")))
def staged_payments(spark, sf_dir):
    return staged(spark, sf_dir).drop(*HIDDEN)


@query(sql("SELECT * FROM target", doubles="payment_amount", **steps("target")))
def target_payments(spark, sf_dir):
    return target(spark, sf_dir).drop(*HIDDEN)


@query(sql("SELECT * FROM staged WHERE is_competitor", doubles="payment_amount", **steps("staged")))
def competitor_payments(spark, sf_dir):
    return P.competitor_payments(staged(spark, sf_dir)).drop(*HIDDEN)


@query(sql("SELECT * FROM population", doubles="payment_amount", **steps("population")))
def population_payments(spark, sf_dir):
    return P.population_payments(staged(spark, sf_dir)).select("record_id", "program_year", "hcp_id", "profile_id", "specialty", "state", "company_name", "is_target", "is_competitor", "is_population_only", "payment_amount", "payment_date", "nature_of_payment")


@query(sql("SELECT * FROM (SELECT r.record_id, r.company_raw, m.pattern FROM payments_raw r LEFT JOIN (SELECT pattern FROM company_map UNION ALL SELECT 'brand#25') m ON lower(r.company_raw) LIKE concat('%', m.pattern, '%'))"))
def company_match_fan_out(spark, sf_dir):
    """A name that holds two patterns gives two rows."""
    seeds = view(spark, sf_dir, "company_map").select("pattern").union(spark.createDataFrame([("brand#25",)], "pattern string"))
    return P.match_company(view(spark, sf_dir, "payments_raw"), seeds).select("record_id", "company_raw", "pattern")


@query(sql("SELECT record_id, hcp_id, is_meal, is_speaking_fee, is_consulting, meal_over_limit, meal_overage_pct FROM classified", doubles="meal_overage_pct", **steps("classified")))
def classified_payments(spark, sf_dir):
    return P.classify_payments(target(spark, sf_dir), C).select("record_id", "hcp_id", "is_meal", "is_speaking_fee", "is_consulting", "meal_over_limit", "meal_overage_pct")


@query(sql("SELECT * FROM entity_year", doubles="year_spend year_food_beverage year_speaking_fee year_consulting year_max_meal_overage_pct", **steps("entity_year")))
def entity_year_spend(spark, sf_dir):
    return P.entity_year_spend(P.classify_payments(target(spark, sf_dir), C))


@query(sql("SELECT * FROM cross_year", doubles=f"lifetime_total_spend food_beverage_total speaking_fee_total consulting_fee_total spend_{Y1} spend_{Y2} spend_{Y3} max_meal_overage_pct", **steps("cross_year")))
def entity_spend(spark, sf_dir):
    return P.entity_spend(P.entity_year_spend(P.classify_payments(target(spark, sf_dir), C)), C.years)


@query(sql("SELECT * FROM reps", doubles="avg_unique_reps top_rep_concentration_pct", **steps("reps")))
def rep_concentration(spark, sf_dir):
    return P.rep_concentration(view(spark, sf_dir, "interactions"))


@query(sql("SELECT * FROM spend", doubles=SPEND_DOUBLES, **steps("spend")))
def spend_mart(spark, sf_dir):
    return direct_spend(spark, sf_dir)


@query(sql("SELECT * FROM attended", doubles="attendees_signed_pct", **steps("attended")))
def event_attendance(spark, sf_dir):
    return E.attendance(view(spark, sf_dir, "attendees"))


@query(sql("SELECT event_id, speaker_hcp_id, events_same_speaker_year, days_since_last_event_same_speaker FROM event_rows", **steps("event_rows")))
def speaker_windows(spark, sf_dir):
    return E.speaker_windows(view(spark, sf_dir, "speaker_events")).select("event_id", "speaker_hcp_id", "events_same_speaker_year", "days_since_last_event_same_speaker")


@query(sql("SELECT * FROM event_features", doubles=EVENT_DOUBLES, **steps("event_features")))
def event_features(spark, sf_dir):
    return features_of_events(spark, sf_dir)


@query(sql("SELECT * FROM entity_events", doubles=ENTITY_EVENT_DOUBLES, **steps("entity_events")))
def entity_events(spark, sf_dir):
    return E.entity_events(features_of_events(spark, sf_dir))


@query(sql("SELECT * FROM entity_interactions", doubles=INTERACTION_DOUBLES, **steps("entity_interactions")))
def entity_interactions(spark, sf_dir):
    return E.entity_interactions(view(spark, sf_dir, "interactions"), C)


PROFILE_COLUMNS = "hcp_id specialty state fmv_tier is_kol lifetime_total_spend peak_year_spend annual_cap_pct_used at_cap_flag near_cap_flag meal_breach_rate max_meal_overage_pct pct_speaking_fee multi_year_increasing_flag raw_spend_risk_score has_payments total_events_as_speaker avg_event_risk_score max_event_risk_score events_with_low_attendance events_over_fmv events_missing_attestation events_rapid_repeat total_speaker_fees_events pct_events_over_fmv total_interactions total_meals avg_meal_cost interactions_with_vague_rationale fmv_compliance_rate unique_reps_interacted interaction_frequency_score has_speaker_events has_interactions data_completeness_score risk_signal_count combined_raw_risk_score"


@query(sql(f"SELECT {PROFILE_COLUMNS.replace(' ', ', ')} FROM profile", doubles=PROFILE_DOUBLES, **steps("profile")))
def risk_profile(spark, sf_dir):
    return direct_profile(spark, sf_dir).select(*PROFILE_COLUMNS.split())


@query(sql("SELECT count(*) FILTER (WHERE has_payments) AS matched, count(*) FILTER (WHERE NOT has_payments) AS unmatched FROM spend", **steps("spend")))
def payment_coverage(spark, sf_dir):
    """Entities with and without payments of the target company."""
    paid = target(spark, sf_dir).select("hcp_id").distinct().withColumn("paid", F.lit(True))
    return view(spark, sf_dir, "master").join(paid, "hcp_id", "left").agg(F.count_if("paid").alias("matched"), F.count_if(F.col("paid").isNull()).alias("unmatched"))
