"""Key findings as DataFrames (the reference prints them): top-k / bottom-k reports.

Each is ``orderBy(metric, tie-break).limit(k)`` on a place-level result, which
Spark plans as TakeOrderedAndProject (per-partition top-k, then a merge of
k rows per partition) — no global sort of the input.  Here the limit *is* the
feature.  NULL metrics are skipped (as ``nlargest`` does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config, DEFAULT


def top_momentum(signals: DataFrame, cfg: Config = DEFAULT, k: int = 3) -> DataFrame:
    return (signals.where(F.col("momentum_3m").isNotNull())
                   .orderBy(F.col("momentum_3m").desc(), F.col("county"))
                   .limit(k).select("county", "momentum_3m", "signal"))


def top_unaffordable(ranking: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return (ranking.where((F.col("year") == F.lit(cfg.latest_year)) & F.col("years_salary_to_buy").isNotNull())
                   .orderBy(F.col("years_salary_to_buy").desc(), F.col("county"))
                   .limit(cfg.top_k)
                   .select("county", "median_price", "years_salary_to_buy", "affordability_status"))


def top_heat(heat: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return heat.where(F.col("rank") <= F.lit(cfg.top_k)).select("rank", "county", "heat_index", "market_temperature")


def postcode_spread(snapshot: DataFrame, cfg: Config = DEFAULT, k: int = 3) -> DataFrame:
    cols = ["postcode", "zone", "median_price", "transactions"]
    top = (snapshot.orderBy(F.col("median_price").desc(), F.col("postcode")).limit(k)
                   .select(F.lit("highest").alias("position"), *cols))
    bottom = (snapshot.orderBy(F.col("median_price").asc(), F.col("postcode")).limit(k)
                      .select(F.lit("lowest").alias("position"), *cols))
    return top.unionByName(bottom)


def top_premium(nvsh: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return (nvsh.where((F.col("year") == F.lit(cfg.latest_year)) & F.col("new_build_premium_pct").isNotNull())
                .orderBy(F.col("new_build_premium_pct").desc(), F.col("county"))
                .limit(cfg.top_k)
                .select("county", "second_hand_median", "new_build_median", "new_build_premium_pct", "premium_signal"))


def cannot_afford(stress: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return (stress.where((F.col("year") == F.lit(cfg.latest_year)) & F.col("ftb_status").contains("Cannot"))
                  .orderBy("county").limit(cfg.top_k)
                  .select("county", "median_price", "max_affordable_price", "gap_pct", "ftb_status"))


def top_investment(card: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return (card.orderBy(F.col("rank").asc_nulls_last(), F.col("county")).limit(cfg.top_k)
                .select("rank", "county", "composite_investment_score", "investment_tier", "median_price_latest",
                        "price_growth_pct", "rental_yield_est_pct"))
