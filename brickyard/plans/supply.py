"""Supply jobs: shortage status and cumulative deficit, supply vs growth, commuter belt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as L
from ..functions.numeric import round_half_away as rnd, round_int
from ..functions.windows import momentum, running_sum, series
from .market import mean_of_rounded


def supply_gap(sd: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return sd.select("*",
                     running_sum("supply_deficit", series("county", "year")).alias("cumulative_deficit"),
                     L.supply_status("supply_ratio").alias("supply_status"))


def supply_vs_growth(sd: DataFrame, aff: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    s = sd.groupBy("county").agg(rnd(mean_of_rounded("supply_ratio", 3), 3).alias("avg_supply_ratio"))
    is_b, is_l = F.col("year") == F.lit(cfg.base_year), F.col("year") == F.lit(cfg.latest_year)
    pb = F.max(F.when(is_b, F.col("median_price")))
    pl = F.max(F.when(is_l, F.col("median_price")))
    p = aff.groupBy("county").agg(rnd((pl - pb) * F.lit(100.0) / F.nullif(pb, F.lit(0.0)), 1).alias("price_growth_pct"))
    return (s.join(p, "county")
             .select("county", "avg_supply_ratio", "price_growth_pct",
                     L.market_pressure("avg_supply_ratio", "price_growth_pct").alias("market_pressure_label")))


def commuter_belt(prof: DataFrame, aff: DataFrame, sd: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Aggregate first, then join the two (county, year) dimensions (both unique on the key)."""
    p = prof.where(F.col("county").isin(*cfg.commuter_places))
    a = p.select("county", "year", F.col("n").alias("transactions"), round_int("median").alias("median_price"))
    j = (a.join(aff.select("county", "year", "years_salary_to_buy", "monthly_rent_estimate"), ["county", "year"])
          .join(sd.select("county", "year", "supply_ratio", "supply_deficit"), ["county", "year"]))
    return j.withColumn("yoy_growth_pct", rnd(momentum("median_price", series("county", "year"), 1), 1))
