"""Affordability jobs: mortgage stress, first-time-buyer gap, rankings, deterioration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as L
from ..functions.numeric import round_half_away as rnd, round_int, safe_div
from ..functions.windows import value_at


def annuity_factor(rate: float, years: int) -> float:
    """Monthly repayment per unit borrowed: r(1+r)^n / ((1+r)^n - 1), r monthly."""
    r = rate / 12.0
    n = years * 12
    g = (1.0 + r) ** n
    return r * g / (g - 1.0)


def mortgage_stress(prof: DataFrame, aff: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Deposit, max mortgage, gap and stressed repayment per place-year (inner join with wages)."""
    med = prof.select("county", "year", "median")
    df = med.join(aff.select("county", "year", "avg_annual_wage", "population"), ["county", "year"])
    wage = F.col("avg_annual_wage")
    deposit = round_int(F.col("median") * F.lit(cfg.deposit_pct))
    max_mort = round_int(wage * F.lit(cfg.lti_limit))
    max_price = round_int(max_mort / F.lit(1.0 - cfg.deposit_pct))
    gap = rnd(F.col("median") - max_price, 0)
    gap_pct = rnd(safe_div(gap, "median") * F.lit(100.0), 1)
    repay = round_int(max_mort * F.lit(annuity_factor(cfg.stress_rate, cfg.term_years)))
    return df.select(
        "county", "year", round_int("median").alias("median_price"), "avg_annual_wage", "population",
        deposit.alias("deposit_needed"),
        rnd(safe_div(deposit, wage * F.lit(cfg.savings_rate)), 1).alias("years_to_deposit"),
        max_mort.alias("max_mortgage"),
        max_price.alias("max_affordable_price"),
        gap.alias("affordability_gap"),
        gap_pct.alias("gap_pct"),
        repay.alias("stressed_monthly_repayment"),
        rnd(safe_div(repay, wage / F.lit(12.0)) * F.lit(100.0), 1).alias("repayment_to_income_pct"),
        L.ftb_status(gap_pct).alias("ftb_status"))


def ftb_gap(aff: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The unrounded latest-year form: LTI x wage / LTV against the median."""
    max_price = F.col("avg_annual_wage") * F.lit(cfg.lti_limit) / F.lit(1.0 - cfg.deposit_pct)
    return (aff.where(F.col("year") == F.lit(cfg.latest_year))
               .select("county", "year", "median_price",
                       (F.col("avg_annual_wage") * F.lit(cfg.lti_limit)).alias("max_mortgage_lti"),
                       max_price.alias("max_affordable_price"),
                       (F.col("median_price") - max_price).alias("affordability_gap_eur"),
                       rnd(safe_div(F.col("median_price") - max_price, "median_price") * F.lit(100.0), 1)
                       .alias("gap_pct")))


def affordability_ranking(aff: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Status, change since the base year and rank within the year (RANK, most years first)."""
    base = value_at("years_salary_to_buy", F.col("year") == F.lit(cfg.base_year), "county")
    w = Window.partitionBy("year").orderBy(F.col("years_salary_to_buy").desc_nulls_first())
    return aff.select("county", "region", "year", "median_price", "avg_annual_wage", "years_salary_to_buy",
                      "price_to_income_ratio", "monthly_rent_estimate",
                      L.affordability_status("years_salary_to_buy").alias("affordability_status"),
                      rnd(F.col("years_salary_to_buy") - base, 1).alias("deterioration_vs_base"),
                      F.rank().over(w).alias("unaffordability_rank"))


def affordability_deterioration(aff: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    is_b, is_l = F.col("year") == F.lit(cfg.base_year), F.col("year") == F.lit(cfg.latest_year)
    e = aff.groupBy("county", "region").agg(
        F.max(F.when(is_b, F.col("years_salary_to_buy"))).alias("ratio_base"),
        F.max(F.when(is_l, F.col("years_salary_to_buy"))).alias("ratio_latest"),
        F.max(F.when(is_b, F.col("median_price"))).alias("price_base"),
        F.max(F.when(is_l, F.col("median_price"))).alias("price_latest"))
    # the ratios have one decimal: subtracted as such, a change of exactly 1 or 2 years meets its label
    delta = F.col("ratio_latest").cast("decimal(12,1)") - F.col("ratio_base").cast("decimal(12,1)")
    return e.select("*", delta.cast("double").alias("yrs_salary_deterioration"),
                    rnd((F.col("price_latest") - F.col("price_base")) * F.lit(100.0)
                        / F.nullif(F.col("price_base"), F.lit(0.0)), 1).alias("price_growth_pct"),
                    L.deterioration_trend(delta).alias("trend"))
