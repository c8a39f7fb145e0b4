"""Queries over peer, industry and competitor benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchmarks as B
from ..sources.io import kept
from . import marts
from .fixtures import CONFIG as C
from .fixtures import sql, view
from .registry import query
from .steps import Y1, Y2, Y3, steps

YEARS = C.years
BASE = f"SELECT p.hcp_id, p.specialty, p.state, spend_{Y1}, spend_{Y2}, spend_{Y3}, meal_breach_rate, combined_raw_risk_score FROM profile p"
INDUSTRY = "SELECT hcp_id, max(specialty) AS specialty, " + ", ".join(f"sum(CASE WHEN program_year = {y} THEN payment_amount ELSE 0 END) AS industry_spend_{y}" for y in YEARS) + f", count(DISTINCT CASE WHEN program_year = {Y3} THEN company_name END) AS industry_company_count, count(*) FILTER (WHERE program_year = {Y3}) AS industry_payment_count FROM population GROUP BY hcp_id"
COMPETITORS = "SELECT hcp_id, max(specialty) AS specialty, " + ", ".join(f"sum(CASE WHEN program_year = {y} THEN payment_amount ELSE 0 END) AS competitor_spend_{y}" for y in YEARS) + ", sum(payment_amount) AS competitor_spend_3yr, count(DISTINCT company_name) AS competitor_company_count FROM staged WHERE is_competitor GROUP BY hcp_id"


def base(spark, sf_dir):
    spend = marts.spend(spark, sf_dir).select("hcp_id", *[f"spend_{y}" for y in YEARS])
    return marts.profile(spark, sf_dir).select("hcp_id", "specialty", "state", "meal_breach_rate", "combined_raw_risk_score").join(spend, "hcp_id")


def industry(spark, sf_dir, payments=None):
    from ..operators.payments import population_payments

    return B.industry_spend(population_payments(payments or marts.staged(spark, sf_dir)), YEARS)


def competitors(spark, sf_dir, payments=None):
    from ..operators.payments import competitor_payments

    return B.competitor_spend(competitor_payments(payments or marts.staged(spark, sf_dir)), YEARS)


def ranked(by: str, column: str, name: str) -> str:
    return f"percent_rank() OVER (PARTITION BY {by} ORDER BY {column}) AS {name}"


def capped(part: str, whole: str, cap: str, name: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN least({cap}, {part} / {whole}) ELSE 0 END AS {name}"


RANKED = "SELECT *, " + ", ".join([*[ranked("specialty", f"spend_{y}", f"rank_{y}") for y in YEARS], ranked("specialty", "spend_3yr", "rank_3yr"), ranked("state", f"spend_{Y3}", "rank_state"), ranked("specialty, state", f"spend_{Y3}", "rank_specialty_state"), ranked("specialty", "combined_raw_risk_score", "risk_rank"), ranked("specialty", "meal_breach_rate", "meal_breach_rank")]) + f" FROM (SELECT *, spend_{Y1} + spend_{Y2} + spend_{Y3} AS spend_3yr FROM base)"
PEERS = "SELECT specialty, count(DISTINCT hcp_id) AS peer_count, " + ", ".join(f"avg(spend_{y}) AS avg_spend_{y}, quantile_cont(spend_{y}, 0.9) AS p90_spend_{y}" for y in YEARS) + ", avg(spend_3yr) AS avg_spend_3yr, quantile_cont(spend_3yr, 0.5) AS p50_spend_3yr, quantile_cont(spend_3yr, 0.9) AS p90_spend_3yr, quantile_cont(spend_3yr, 0.95) AS p95_spend_3yr, avg(combined_raw_risk_score) AS avg_combined_raw_risk_score, quantile_cont(combined_raw_risk_score, 0.9) AS p90_combined_raw_risk_score FROM ranked GROUP BY specialty"
PEER_DOUBLES = " ".join(f"avg_spend_{y} p90_spend_{y}" for y in YEARS) + " avg_spend_3yr p50_spend_3yr p90_spend_3yr p95_spend_3yr avg_combined_raw_risk_score p90_combined_raw_risk_score"
IND = "SELECT specialty, " + ", ".join(f"avg(industry_spend_{y}) AS ind_avg_{y}" for y in YEARS) + " FROM industry GROUP BY specialty"
COMP = f"SELECT specialty, avg(competitor_spend_{Y3}) AS comp_avg FROM competitors GROUP BY specialty"
RATIOS = f"""SELECT r.*, peer_group_size, use_national_benchmark, coalesce(industry_company_count, 0) AS industry_company_count, coalesce(competitor_company_count, 0) AS competitor_company_count,
 {", ".join(capped(f"spend_{y}", f"avg_spend_{y}", "10.0", f"vs_peer_{y}") for y in YEARS)}, {capped("spend_3yr", "avg_spend_3yr", "10.0", "vs_peer_3yr")},
 {", ".join(capped(f"spend_{y}", f"ind_avg_{y}", "10.0", f"vs_industry_{y}") for y in YEARS)}, {capped("spend_3yr", "(" + " + ".join(f"coalesce(ind_avg_{y}, 0)" for y in YEARS) + ")", "10.0", "vs_industry_3yr")},
 {", ".join(capped(f"spend_{y}", f"industry_spend_{y}", "1.0", f"sow_{y}") for y in YEARS)}, {capped("spend_3yr", "(" + " + ".join(f"industry_spend_{y}" for y in YEARS) + ")", "1.0", "sow_3yr")}, {capped(f"spend_{Y3}", "comp_avg", "10.0", "vs_competitor")},
 {" + ".join(f"CAST(spend_{y} >= {C.annual_cap} AS INTEGER)" for y in YEARS)} AS years_at_cap, {" + ".join(f"CAST(spend_{y} >= {C.near_cap} AS INTEGER)" for y in YEARS)} AS years_near_cap,
 {" + ".join(f"CAST(rank_{y} > 0.9 AS INTEGER)" for y in YEARS)} AS outlier_years, rank_{Y2} - rank_{Y1} AS rank_change_1, rank_{Y3} - rank_{Y2} AS rank_change_2
 FROM ranked r LEFT JOIN peers USING (specialty) LEFT JOIN sizes USING (specialty, state) LEFT JOIN (SELECT * RENAME (specialty AS s1) FROM industry) i ON r.hcp_id = i.hcp_id LEFT JOIN ind ON ind.specialty = coalesce(i.s1, r.specialty)
 LEFT JOIN (SELECT * RENAME (specialty AS s2) FROM competitors) k ON r.hcp_id = k.hcp_id LEFT JOIN comp ON comp.specialty = coalesce(k.s2, r.specialty)"""
SIZES = f"SELECT specialty, state, count(DISTINCT hcp_id) AS peer_group_size, count(DISTINCT hcp_id) < {C.min_peers} AS use_national_benchmark FROM ranked GROUP BY ALL"
ALL = steps("profile", "population", base=BASE, industry=INDUSTRY, competitors=COMPETITORS, ranked=RANKED, peers=PEERS, sizes=SIZES, ind=IND, comp=COMP, ratios=RATIOS)
CLIMB = "rank_change_1 > 0 AND rank_change_2 > 0"
RISING = f"sow_{Y3} > sow_{Y2} AND sow_{Y2} > sow_{Y1}"
IND_YEARS = " + ".join(f"CAST(vs_industry_{y} > 2 AS INTEGER)" for y in YEARS)
SHOWN = f"hcp_id specialty state spend_3yr rank_{Y1} rank_{Y2} rank_{Y3} rank_3yr rank_state rank_specialty_state risk_rank meal_breach_rank peer_group_size use_national_benchmark years_at_cap years_near_cap outlier_years rank_change_1 rank_change_2 vs_peer_{Y3} vs_peer_3yr vs_industry_{Y3} vs_industry_3yr sow_{Y1} sow_{Y2} sow_{Y3} sow_3yr vs_competitor industry_company_count competitor_company_count"
BENCH_DOUBLES = f"spend_3yr rank_{Y1} rank_{Y2} rank_{Y3} rank_3yr rank_state rank_specialty_state risk_rank meal_breach_rank rank_change_1 rank_change_2 vs_peer_{Y3} vs_peer_3yr vs_industry_{Y3} vs_industry_3yr sow_{Y1} sow_{Y2} sow_{Y3} sow_3yr vs_competitor"


def bench(spark, sf_dir):
    staged = kept(marts.staged(spark, sf_dir).select("hcp_id", "specialty", "program_year", "payment_amount", "company_name", "is_target", "is_competitor"))  # read by both, which need no more
    return B.benchmark(base(spark, sf_dir), industry(spark, sf_dir, staged), competitors(spark, sf_dir, staged), C, exact=True)


@query(sql(f"SELECT {SHOWN.replace(' ', ', ')} FROM ratios", doubles=BENCH_DOUBLES, **ALL))
def benchmark_ratios(spark, sf_dir):
    return bench(spark, sf_dir).select(*SHOWN.split())


@query(sql(f"""SELECT hcp_id, CASE WHEN years_at_cap >= 2 THEN 'chronic_breach' WHEN years_at_cap = 1 THEN 'single_breach' WHEN years_near_cap >= 2 THEN 'chronic_near_cap' WHEN years_near_cap = 1 THEN 'near_cap' ELSE 'compliant' END AS cap_pattern,
 CASE WHEN spend_{Y3} > spend_{Y2} AND spend_{Y2} > spend_{Y1} THEN 'increasing' WHEN spend_{Y3} < spend_{Y2} AND spend_{Y2} < spend_{Y1} THEN 'decreasing' WHEN spend_{Y3} > spend_{Y1} THEN 'net_increasing' ELSE 'stable' END AS spend_trend,
 CASE WHEN spend_{Y1} > 0 THEN (spend_{Y2} - spend_{Y1}) / spend_{Y1} END AS growth_1, CASE WHEN spend_{Y2} > 0 THEN (spend_{Y3} - spend_{Y2}) / spend_{Y2} END AS growth_2, {CLIMB} AS escalating_rank, outlier_years >= 2 AS persistent_outlier,
 {IND_YEARS} AS industry_outlier_years, vs_industry_{Y3} > 3 AS industry_high_outlier, risk_rank > 0.99 AS risk_top_1, risk_rank > 0.95 AS risk_top_5, risk_rank > 0.9 AS risk_top_10, {" + ".join(f"CAST(sow_{y} > 0.5 AS INTEGER)" for y in YEARS)} AS sow_dominant_years,
 sow_{Y3} > 0.8 AS sow_exclusive, {RISING} AS sow_increasing, vs_competitor > 2 AS competitor_outlier,
 CASE WHEN rank_{Y3} > 0.75 AND vs_industry_{Y3} > 1.5 THEN 'investigate' WHEN {CLIMB} AND years_near_cap >= 2 THEN 'investigate' WHEN rank_{Y3} > 0.75 THEN 'review' WHEN vs_industry_{Y3} > 1.5 THEN 'competitive_intelligence' ELSE 'continue' END AS quadrant,
 least(100.0, rank_{Y3} * 30 + least(1.0, vs_industry_{Y3} / 3) * 25 + sow_{Y3} * 25 + least(10.0, outlier_years * 5.0) + least(10.0, ({IND_YEARS}) * 5.0)) AS priority, rank_{Y3} > 0.9 AND vs_industry_{Y3} > 2 AS dual_outlier,
 rank_{Y3} > 0.9 AND vs_industry_{Y3} > 2 AND sow_{Y3} > 0.8 AS triple_signal, {CLIMB} AND {RISING} AS escalating_risk, outlier_years >= 2 AND {IND_YEARS} >= 2 AS chronic_risk FROM ratios""", doubles="growth_1 growth_2 priority", **ALL))
def benchmark_classes(spark, sf_dir):
    return bench(spark, sf_dir).select("hcp_id", "cap_pattern", "spend_trend", "growth_1", "growth_2", "escalating_rank", "persistent_outlier", "industry_outlier_years", "industry_high_outlier", "risk_top_1", "risk_top_5", "risk_top_10", "sow_dominant_years", "sow_exclusive", "sow_increasing", "competitor_outlier", "quadrant", "priority", "dual_outlier", "triple_signal", "escalating_risk", "chronic_risk")


@query(sql(f"SELECT hcp_id, concat('rank ', CAST(CAST(round(rank_{Y3} * 100) AS INTEGER) AS VARCHAR), 'th pct, ', format('{{:.1f}}', vs_industry_{Y3}), 'x industry, outlier ', CAST(outlier_years AS VARCHAR), '/3 years, SOW ', CAST(CAST(round(sow_{Y3} * 100) AS INTEGER) AS VARCHAR), '%') AS quadrant_reason FROM ratios", **ALL))
def benchmark_reasons(spark, sf_dir):
    return bench(spark, sf_dir).select("hcp_id", "quadrant_reason")


@query(sql("SELECT * FROM peers", doubles=PEER_DOUBLES, **ALL))
def peer_statistics(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("spend_3yr", sum((F.col(f"spend_{y}") for y in YEARS), F.lit(0.0)))
    return B.peer_stats(rows, "specialty", {f"spend_{y}": (0.9,) for y in YEARS} | {"spend_3yr": (0.5, 0.9, 0.95), "combined_raw_risk_score": (0.9,)}, exact=True)


@query(sql("SELECT * FROM industry", doubles=" ".join(f"industry_spend_{y}" for y in YEARS), **ALL))
def industry_spend(spark, sf_dir):
    return industry(spark, sf_dir)


@query(sql("SELECT * FROM competitors", doubles=" ".join(f"competitor_spend_{y}" for y in YEARS) + " competitor_spend_3yr", **ALL))
def competitor_spend(spark, sf_dir):
    return competitors(spark, sf_dir)


@query(sql(f"SELECT hcp_id, sum(payment_amount) FILTER (WHERE program_year = {Y3} AND is_competitor) AS spend FROM staged GROUP BY hcp_id", doubles="spend", **steps("staged")))
def competitor_year(spark, sf_dir):
    return B.year_spend(marts.staged(spark, sf_dir), Y3)


@query(sql(f"SELECT specialty, avg(total) AS avg_total, quantile_cont(total, 0.9) AS p90_total, count(*) AS entities FROM (SELECT hcp_id, specialty, sum(payment_amount) AS total FROM population WHERE program_year = {Y3} GROUP BY ALL) GROUP BY specialty", doubles="avg_total p90_total", **steps("population")))
def population_statistics(spark, sf_dir):
    from ..operators.payments import population_payments

    return B.population_stats(population_payments(marts.staged(spark, sf_dir)), Y3, exact=True)


REAL = "SELECT hcp_id, " + ", ".join(f"rank() OVER (PARTITION BY specialty ORDER BY spend_{y}) / CAST(count(*) OVER (PARTITION BY specialty) AS DOUBLE) AS rank_{y}, avg(spend_{y}) OVER (PARTITION BY specialty) AS peer_avg_{y}, spend_{y}" for y in YEARS) + " FROM base"
AT, NEAR = (" + ".join(f"CAST(spend_{y} >= {cap} AS INTEGER)" for y in YEARS) for cap in (C.annual_cap, C.near_cap))
OUT = " + ".join(f"CAST(rank_{y} > 0.9 AS INTEGER)" for y in YEARS)


@query(sql(f"""SELECT hcp_id, {", ".join(f"rank_{y}, peer_avg_{y}, {capped(f'spend_{y}', f'peer_avg_{y}', '10.0', f'vs_peer_{y}')}" for y in YEARS)}, {OUT} AS outlier_years,
 CASE WHEN spend_{Y3} > spend_{Y2} AND spend_{Y2} > spend_{Y1} THEN 3 WHEN spend_{Y3} > spend_{Y1} THEN 2 WHEN spend_{Y3} < spend_{Y2} AND spend_{Y2} < spend_{Y1} THEN 0 ELSE 1 END AS trend,
 CASE WHEN {AT} >= 2 THEN 4 WHEN {AT} = 1 THEN 3 WHEN {NEAR} >= 2 THEN 2 WHEN {NEAR} = 1 THEN 1 ELSE 0 END AS cap_pattern, least(40.0, rank_{Y3} * 30 + least(10.0, ({OUT}) * 5.0)) AS base_score FROM real""",
 doubles=" ".join(f"rank_{y} peer_avg_{y} vs_peer_{y}" for y in YEARS) + " base_score", **steps("profile", base=BASE, real=REAL)))
def real_benchmarks(spark, sf_dir):
    return B.real_benchmarks(base(spark, sf_dir), C).select("hcp_id", *[c for y in YEARS for c in (f"rank_{y}", f"peer_avg_{y}", f"vs_peer_{y}")], "outlier_years", "trend", "cap_pattern", "base_score")


PRIORITY_IN = f"SELECT b.hcp_id, b.specialty, {', '.join(f'spend_{y}' for y in YEARS)}, competitor, avg(coalesce(spend_{Y3}, 0)) OVER (PARTITION BY coalesce(b.specialty, 'Unknown')) AS population_avg FROM base b LEFT JOIN (SELECT hcp_id, sum(payment_amount) FILTER (WHERE program_year = {Y3} AND is_competitor) AS competitor FROM staged GROUP BY hcp_id) USING (hcp_id)"


@query(sql(f"""SELECT hcp_id, share_of_wallet, rank, years_above, (1 - coalesce(share_of_wallet, 0)) * 40 + least(2.0, CASE WHEN population_avg > 0 THEN spend_{Y3} / population_avg ELSE 0 END) / 2 * 30 + least(30.0, rank * 20 + least(3, years_above) / 3 * 10) AS full_priority
 FROM (SELECT *, CASE WHEN spend_{Y3} + coalesce(competitor, 0) > 0 THEN spend_{Y3} / (spend_{Y3} + coalesce(competitor, 0)) END AS share_of_wallet, rank() OVER (ORDER BY spend_{Y3}) / CAST(count(*) OVER () AS DOUBLE) AS rank,
 CAST(spend_{Y1} > m AS INTEGER) + CAST(spend_{Y2} > m AS INTEGER) AS years_above FROM given, (SELECT quantile_cont(spend_{Y3}, 0.5) AS m FROM given WHERE spend_{Y3} > 0))""", doubles="share_of_wallet rank full_priority", **steps("profile", base=BASE, given=PRIORITY_IN)))
def full_priority(spark, sf_dir):
    rows = B.local_population_average(base(spark, sf_dir), f"spend_{Y3}").join(B.year_spend(marts.staged(spark, sf_dir), Y3).withColumnRenamed("spend", "competitor"), "hcp_id", "left")
    return B.full_priority(rows, C)
