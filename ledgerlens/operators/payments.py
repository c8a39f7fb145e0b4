"""Payments: staging, company normalisation, subsets, and spend features of entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .patterns import FEW_PATTERNS, MOST_PATTERNS, contained_numbers, pattern_numbers


def steady(total: Column) -> Column:
    """A sum or mean of doubles without its last digits, which change with the order of the rows: equal ones compare and rank as equal."""
    return F.round(total, 8)


def growth(new: Column, old: Column) -> Column:
    """(new - old) / old, null without a positive base."""
    return F.when(old > 0, (new - old) / old)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 without a positive whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def match_company(payments: DataFrame, company_map: DataFrame, company: str = "company_raw") -> DataFrame:
    """Left join on lower(name) LIKE '%' + pattern + '%'; a name with two patterns gives two rows, one with none a row of nulls.

    The map's patterns are numbered; each task runs its names through one automaton of them (a few patterns: through a column of
    their LIKEs, without Python), and the numbers found join the map.
    """
    seed = company_map.where("pattern is not null")
    patterns = sorted(r.pattern for r in seed.select("pattern").distinct().limit(MOST_PATTERNS + 1).collect())
    if len(patterns) > MOST_PATTERNS:
        return _matched_by_grams(payments, seed, company)
    numbers = contained_numbers if len(patterns) <= FEW_PATTERNS and not any("\\" in p for p in patterns) else pattern_numbers
    rows = payments.withColumn("_number", F.explode_outer(numbers(patterns)(F.lower(payments[company]))))
    numbered = seed.join(F.broadcast(seed.sparkSession.createDataFrame(list(enumerate(patterns)), "_at int, _text string")), F.col("pattern") == F.col("_text")).drop("_text")  # MOST_PATTERNS rows at most
    return rows.join(F.broadcast(numbered), F.col("_number") == F.col("_at"), "left").drop("_number", "_at")


def _matched_by_grams(payments: DataFrame, seed: DataFrame, company: str) -> DataFrame:
    """match_company() for maps too large to broadcast: distinct names meet patterns in three characters of theirs.

    Patterns that are shorter or hold wildcards meet every name's first characters by the key ''.
    """
    name = F.lower(payments[company])
    names = payments.select(name.alias("_name")).where("_name is not null").distinct()
    plain = (F.length("pattern") >= 3) & ~F.col("pattern").rlike("[%_\\\\]")
    keyed = seed.select("pattern").distinct().withColumn("_gram", F.when(plain, F.substring("pattern", 1, 3)).otherwise(""))
    grams = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.length("_name") - 2, F.lit(1))), lambda i: F.substring(F.col("_name"), i, F.lit(3))))
    met = names.withColumn("_gram", F.explode(grams)).join(keyed, "_gram").where(F.expr("_name LIKE concat('%', pattern, '%')")).select("_name", F.col("pattern").alias("_text"))
    found = met.join(seed, F.col("_text") == F.col("pattern")).drop("_text")
    return payments.join(found, name == found["_name"], "left").drop("_name")


def stage_payments(payments: DataFrame, company_map: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Entity key, typed nulls for identity fields, company name and kind, and only recipients of the given types."""
    rows = match_company(payments.where(F.col("recipient_type").isin(*cfg.recipient_types)), company_map)
    hidden = [F.lit(None).cast("string").alias(c) for c in ("first_name", "last_name", "npi", "address", "city")]
    return rows.select(
        "record_id", "program_year", F.concat(F.lit("HCP_"), F.col("profile_id").cast("string")).alias("hcp_id"), "profile_id", *hidden, "specialty", "state",
        F.coalesce("pseudo_name", "company_raw").alias("company_name"), F.coalesce("is_target", F.lit(False)).alias("is_target"),
        F.coalesce("is_competitor", F.lit(False)).alias("is_competitor"), (F.col("pseudo_name").isNull() & F.col("company_raw").isNotNull()).alias("is_population_only"),
        "payment_amount", "payment_date", "nature_of_payment",
    )


def target_payments(staged: DataFrame) -> DataFrame:
    return staged.where("is_target")


def competitor_payments(staged: DataFrame) -> DataFrame:
    return staged.where("is_competitor")


def population_payments(staged: DataFrame) -> DataFrame:
    """All payments to entities that have any payment of the target company."""
    return staged.join(target_payments(staged).select("hcp_id").distinct(), "hcp_id", "left_semi")


def classify_payments(payments: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Category flags, and by how much a meal is over the limit (null if it isn't)."""
    meal = F.col("nature_of_payment") == cfg.meal_nature
    over = meal & (F.col("payment_amount") > cfg.meal_limit)
    speaking = reduce(Column.__or__, [F.lower("nature_of_payment").contains(p) for p in cfg.speaking_patterns])
    flags = {"is_meal": meal, "is_speaking_fee": speaking, "is_consulting": F.col("nature_of_payment") == cfg.consulting_nature, "meal_over_limit": over}
    return payments.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()} | {"meal_overage_pct": F.when(over, (F.col("payment_amount") - cfg.meal_limit) / cfg.meal_limit)})


def entity_year_spend(classified: DataFrame) -> DataFrame:
    amount = F.col("payment_amount")

    def total(flag: str) -> Column:
        return steady(F.sum(F.when(F.col(flag), amount).otherwise(0.0)))

    return (
        classified.where("hcp_id is not null and payment_amount is not null")
        .groupBy("hcp_id", "program_year")
        .agg(
            steady(F.sum(amount)).alias("year_spend"), F.count(F.lit(1)).alias("year_payment_count"), total("is_meal").alias("year_food_beverage"),
            total("is_speaking_fee").alias("year_speaking_fee"), total("is_consulting").alias("year_consulting"), F.count_if("is_speaking_fee").alias("year_speaking_count"),
            F.count_if("is_meal").alias("year_meal_count"), F.count_if("meal_over_limit").alias("year_meals_over_limit"), F.max("meal_overage_pct").alias("year_max_meal_overage_pct"),
        )
    )


def entity_spend(by_year: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Year rows to one row an entity: totals, spend by year (0 if there is none), active years."""
    per_year = [F.max(F.when(F.col("program_year") == y, F.col("year_spend")).otherwise(0.0)).alias(f"spend_{y}") for y in years]
    return by_year.groupBy("hcp_id").agg(
        steady(F.sum("year_spend")).alias("lifetime_total_spend"), F.sum("year_payment_count").alias("lifetime_payment_count"), steady(F.sum("year_food_beverage")).alias("food_beverage_total"),
        steady(F.sum("year_speaking_fee")).alias("speaking_fee_total"), steady(F.sum("year_consulting")).alias("consulting_fee_total"), F.sum("year_speaking_count").alias("speaking_fee_count"),
        *per_year, F.count_distinct("program_year").alias("active_payment_years"), F.sum("year_meals_over_limit").alias("meals_over_limit_count"),
        F.sum("year_meal_count").alias("total_meal_count"), F.max("year_max_meal_overage_pct").alias("max_meal_overage_pct"),
    )


def rep_concentration(interactions: DataFrame) -> DataFrame:
    """Distinct representatives a year and the largest one's share: their mean and maximum over years."""
    return rep_years(interactions.where("rep_id is not null").groupBy("hcp_id", "program_year", "rep_id").agg(F.count(F.lit(1)).alias("n")))


def rep_years(counts: DataFrame) -> DataFrame:
    """rep_concentration() of interactions counted by entity, year and representative."""
    years = counts.groupBy("hcp_id", "program_year").agg(F.count(F.lit(1)).alias("reps"), (F.max("n").cast("double") / F.sum("n")).alias("top"))
    return years.groupBy("hcp_id").agg(F.avg("reps").alias("avg_unique_reps"), F.max("reps").alias("max_unique_reps"), F.max("top").alias("top_rep_concentration_pct"))


def spend_features(spend: DataFrame, reps: DataFrame, cfg: Config = Config()) -> DataFrame:
    one, two, three = (F.col(f"spend_{y}") for y in cfg.years)
    peak = F.greatest(one, two, three)
    total = F.col("lifetime_total_spend")
    y1, y2, y3 = (f"{y % 100:02d}" for y in cfg.years)
    return spend.join(reps, "hcp_id", "left").select(
        "hcp_id", "lifetime_total_spend", "lifetime_payment_count", *[f"spend_{y}" for y in cfg.years], peak.alias("peak_year_spend"), "active_payment_years",
        (peak / cfg.annual_cap).alias("annual_cap_pct_used"), (peak >= cfg.annual_cap).alias("at_cap_flag"), (peak >= cfg.near_cap).alias("near_cap_flag"),
        "meals_over_limit_count", share(F.col("meals_over_limit_count").cast("double"), F.col("total_meal_count")).alias("meal_breach_rate"), F.coalesce("max_meal_overage_pct", F.lit(0.0)).alias("max_meal_overage_pct"),
        growth(two, one).alias(f"yoy_growth_{y1}{y2}"), growth(three, two).alias(f"yoy_growth_{y2}{y3}"), ((one > 0) & (two > one) & (three > two)).alias("multi_year_increasing_flag"),
        share(F.col("food_beverage_total"), total).alias("pct_food_beverage"), share(F.col("speaking_fee_total"), total).alias("pct_speaking_fee"), share(F.col("consulting_fee_total"), total).alias("pct_consulting"),
        "speaking_fee_total", "speaking_fee_count", "consulting_fee_total", "food_beverage_total",
        F.coalesce("avg_unique_reps", F.lit(0.0)).alias("avg_unique_reps"), F.coalesce("max_unique_reps", F.lit(0)).alias("max_unique_reps"), F.coalesce("top_rep_concentration_pct", F.lit(0.0)).alias("top_rep_concentration_pct"),
    )


def spend_risk() -> Column:
    """0-100: cap 30, meal breaches 25, overage 20, speaking share 15, rising spend 10."""
    return F.least(
        F.lit(100.0),
        F.least(F.lit(30.0), F.col("annual_cap_pct_used") * 30) + F.least(F.lit(25.0), F.col("meal_breach_rate") * 250) + F.least(F.lit(20.0), F.col("max_meal_overage_pct") * 20)
        + F.least(F.lit(15.0), F.col("pct_speaking_fee") * 15) + F.when(F.col("multi_year_increasing_flag"), 10.0).otherwise(0.0),
    )


def zero_filled(df: DataFrame, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Numbers to 0 and flags to false where they are null."""
    return df.select(*[F.coalesce(c, F.lit(False if t == "boolean" else 0).cast(t)).alias(c) if c not in keep_null and t in ("boolean", "double", "bigint", "int") else F.col(c) for c, t in df.dtypes])


def spend_mart(entities: DataFrame, target: DataFrame, interactions: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each entity, with zeros where it has no payments (growth stays null), and the spend risk."""
    return spend_mart_of_years(entities, entity_year_spend(classify_payments(target, cfg)), rep_concentration(interactions), cfg)


def spend_mart_of_years(entities: DataFrame, by_year: DataFrame, reps: DataFrame, cfg: Config = Config()) -> DataFrame:
    """spend_mart() of what each year's payments came to."""
    features = spend_features(entity_spend(by_year, cfg.years), reps, cfg)
    rows = entities.select("hcp_id").distinct().join(features.withColumn("has_payments", F.lit(True)), "hcp_id", "left")
    rows = zero_filled(rows, tuple(c for c in rows.columns if c.startswith("yoy_growth")))
    return rows.withColumn("raw_spend_risk_score", spend_risk())
