"""Scores: investment scorecard, tiers, undervalued screen, risk-adjusted ranking,
heat index and the national summary.

All of these run on place-level tables (one row per county, or per
county-year); global scalars are one-row aggregates broadcast to the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as L
from ..functions.numeric import pct_change, round_half_away as rnd, round_int, safe_div
from ..functions.windows import truncated_average_rank
from ..operators.scalars import min_max_scores, with_scalars
from .market import mean_of_rounded

WEIGHTS_INVEST = (("growth_score", 0.30), ("supply_score", 0.30), ("yield_score", 0.25), ("affordability_score", 0.15))
WEIGHTS_HEAT = (("price_score", 0.30), ("growth_score", 0.30), ("volume_score", 0.25), ("vol_growth_score", 0.15))


def place_median(c: str) -> F.Column:
    """Exact median over a *place-level* table (one row per place, or per place and year).

    A group here holds at most one value per place, a bound fixed by the place
    dimension, so Spark's exact ``percentile`` is safe; sale-level medians use
    ``grouped_profile`` instead.
    """
    return F.percentile(F.col(c), 0.5)


def weighted(weights) -> F.Column:
    expr = None
    for name, w in weights:
        term = F.col(name) * F.lit(w)
        expr = term if expr is None else expr + term
    return expr


def investment_scores(aff: DataFrame, sd: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The investment_scores table: inputs at the base and latest year, 0-100 scores,
    composite (30/30/25/15), tier and RANK on the composite."""
    is_b, is_l = F.col("year") == F.lit(cfg.base_year), F.col("year") == F.lit(cfg.latest_year)
    a = aff.groupBy("county", "region").agg(
        F.max(F.when(is_b, F.col("median_price"))).alias("median_price_base"),
        F.max(F.when(is_l, F.col("median_price"))).alias("median_price_latest"),
        F.max(F.when(is_l, F.col("monthly_rent_estimate"))).alias("__rent"),
        F.max(F.when(is_l, F.col("years_salary_to_buy"))).alias("years_salary_to_buy"))
    s = sd.where(is_l).select("county", "supply_deficit_pct")
    j = a.join(s, "county", "left").select(
        "county", "region", "median_price_base", "median_price_latest",
        rnd(pct_change("median_price_latest", "median_price_base"), 1).alias("price_growth_pct"),
        rnd(safe_div(F.col("__rent") * F.lit(12.0), "median_price_latest") * F.lit(100.0), 2)
        .alias("rental_yield_est_pct"),
        "years_salary_to_buy", "supply_deficit_pct")
    j = min_max_scores(j, {"growth_score": ("price_growth_pct", False),
                           "supply_score": ("supply_deficit_pct", False),
                           "yield_score": ("rental_yield_est_pct", False),
                           "affordability_score": ("years_salary_to_buy", True)})
    comp = rnd(weighted(WEIGHTS_INVEST), 1)
    j = j.withColumn("composite_investment_score", comp)
    return j.select("*", L.tier("composite_investment_score", cfg.tier_cutoffs, cfg.tier_default)
                    .alias("investment_tier"),
                    F.rank().over(Window.orderBy(F.col("composite_investment_score").desc_nulls_first()))
                    .alias("rank"))


def investment_scorecard(inv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return inv.select("rank", "county", "region", "investment_tier", "composite_investment_score",
                      "median_price_latest", "price_growth_pct", "rental_yield_est_pct", "years_salary_to_buy",
                      "supply_deficit_pct", "growth_score", "supply_score", "yield_score", "affordability_score")


def tier_summary(inv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per tier: counts, averages and the county list ordered by rank (rows per tier <= places)."""
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("county")))), lambda s: s["county"]),
        ", ")
    return inv.groupBy("investment_tier").agg(
        F.count(F.lit(1)).alias("county_count"),
        rnd(mean_of_rounded("composite_investment_score", 1), 1).alias("avg_score"),
        round_int(F.avg("median_price_latest")).alias("avg_median_price"),
        rnd(mean_of_rounded("price_growth_pct", 1), 1).alias("avg_growth_pct"),
        rnd(mean_of_rounded("rental_yield_est_pct", 2), 2).alias("avg_rental_yield"),
        listed.alias("counties"))


def _undervalued_cond(nat, cfg: Config) -> F.Column:
    return ((F.col("median_price_latest") < nat)
            & (F.col("price_growth_pct") > F.lit(cfg.undervalued_min_growth))
            & (F.col("supply_deficit_pct") > F.lit(cfg.undervalued_min_deficit)))


def risk_adjusted_return(growth="price_growth_pct", yld="rental_yield_est_pct", yrs="years_salary_to_buy"):
    """Exact: the inputs are decimals of one, two and one places, so equal scores tie."""
    return F.expr(f"cast({growth} as decimal(12,1)) * 0.4BD + cast({yld} as decimal(12,2)) * 10BD * 0.4BD"
                  f" - cast({yrs} as decimal(12,1)) * 2BD * 0.2BD")


def undervalued_median(inv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Every place with discount to the national *median*, risk-adjusted return and the flag."""
    nat = inv.agg(place_median("median_price_latest").alias("nat_median"))
    j = with_scalars(inv, nat)
    return j.select("county", "region", "median_price_latest", "nat_median",
                    rnd(safe_div(F.col("nat_median") - F.col("median_price_latest"), "nat_median") * F.lit(100.0), 1)
                    .alias("discount_to_national_pct"),
                    F.round(risk_adjusted_return(), 1).cast("double").alias("risk_adj_return"),
                    "price_growth_pct", "supply_deficit_pct",
                    _undervalued_cond(F.col("nat_median"), cfg).alias("undervalued"))


def undervalued_mean(inv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The SQL form: national figure = rounded *mean*; only flagged places are kept."""
    nat = inv.agg(rnd(F.avg("median_price_latest"), 0).alias("nat_median"))
    j = with_scalars(inv, nat)
    return (j.where(_undervalued_cond(F.col("nat_median"), cfg))
             .select("county", "region", "median_price_latest", "nat_median",
                     rnd((F.col("nat_median") - F.col("median_price_latest")) * F.lit(100.0)
                         / F.nullif(F.col("nat_median"), F.lit(0.0)), 1).alias("discount_to_national_pct"),
                     "price_growth_pct", "supply_deficit_pct", "composite_investment_score", "investment_tier"))


def risk_adjusted_ranking(inv: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    score = risk_adjusted_return()
    return inv.select("county", "region", "median_price_latest", "price_growth_pct", "rental_yield_est_pct",
                      "years_salary_to_buy",
                      F.round(score, 1).cast("double").alias("risk_adj_return_score"),
                      F.rank().over(Window.orderBy(score.desc_nulls_first())).alias("risk_adj_rank"),
                      truncated_average_rank(F.round(score, 1)).alias("risk_adj_rank_avg"))


def heat_index(pulse_value: DataFrame, velocity: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Latest-year heat index from ``market_pulse_value`` and ``velocity_annual``."""
    mp = (pulse_value.where(F.col("year") == F.lit(cfg.latest_year))
                     .select("county", "region", "median_price", "yoy_growth_pct", "transactions"))
    v = velocity.where(F.col("year") == F.lit(cfg.latest_year)).select("county", "vol_yoy_pct")
    df = mp.join(v, "county", "left")
    df = min_max_scores(df, {"price_score": ("median_price", False),
                             "growth_score": (F.coalesce(F.col("yoy_growth_pct"), F.lit(0.0)), False),
                             "volume_score": ("transactions", False),
                             "vol_growth_score": (F.coalesce(F.col("vol_yoy_pct"), F.lit(0.0)), False)})
    heat = rnd(weighted(WEIGHTS_HEAT), 1)
    df = df.withColumn("heat_index", heat)
    return df.select("*", L.market_temperature("heat_index").alias("market_temperature"),
                     F.row_number().over(Window.orderBy(F.col("heat_index").desc_nulls_last(), F.col("county")))
                     .alias("rank"))


def national_summary(pulse_value: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per year: median of place medians, total sales, mean of place growth."""
    return pulse_value.groupBy("year").agg(
        round_int(place_median("median_price")).alias("national_median"),
        F.sum("transactions").alias("total_transactions"),
        rnd(mean_of_rounded("yoy_growth_pct", 1), 1).alias("avg_yoy"))


def national_latest(pulse_value: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row for the latest year: median, sum and mean over places."""
    latest = pulse_value.where(F.col("year") == F.lit(cfg.latest_year))
    return latest.agg(F.lit(cfg.latest_year).alias("year"), F.lit("National").alias("description"),
                      place_median("median_price").alias("median_price"),
                      F.sum("transactions").alias("transactions"),
                      mean_of_rounded("yoy_growth_pct", 1).alias("yoy_growth_pct"))
