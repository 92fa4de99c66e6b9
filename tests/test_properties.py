"""Invariants over the synthetic tables."""

import pytest
from pyspark.sql import functions as F

from brickyard.config import TEST
from brickyard.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def q():
    return catalog.queries(TEST)


def test_scores_in_range(spark, q):
    card = q["investment_scorecard"](spark, SF)
    cols = ["growth_score", "supply_score", "yield_score", "affordability_score", "composite_investment_score"]
    (r,) = card.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).collect()
    for c in cols:
        assert 0.0 <= r[f"lo_{c}"] <= r[f"hi_{c}"] <= 100.0
    heat = q["heat_index"](spark, SF).agg(F.min("heat_index"), F.max("heat_index")).first()
    assert 0.0 <= heat[0] <= heat[1] <= 100.0


def test_cumulative_deficit_ends_at_total(spark, q):
    gap = q["supply_gap"](spark, SF)
    last = gap.groupBy("county").agg(F.max_by("cumulative_deficit", "year").alias("c"), F.sum("supply_deficit").alias("t"))
    assert last.where(F.col("c") != F.col("t")).count() == 0


def test_focus_and_rest_sum_to_all(spark, q):
    fvr = q["focus_vs_rest"](spark, SF)
    assert fvr.where(F.col("focus_transactions") + F.col("rest_transactions") != F.col("total_transactions")).count() == 0
    pulse = q["market_pulse"](spark, SF).groupBy("year").agg(F.sum("transaction_count").alias("n"))
    joined = pulse.join(fvr, "year").where(F.col("n") != F.col("total_transactions"))
    assert joined.count() == 0


def test_quantiles_ordered(spark, q):
    d = q["price_distribution"](spark, SF)
    bad = d.where(~((F.col("min") <= F.col("p10")) & (F.col("p10") <= F.col("p25")) & (F.col("p25") <= F.col("median"))
                    & (F.col("median") <= F.col("p75")) & (F.col("p75") <= F.col("p90")) & (F.col("p90") <= F.col("max"))))
    assert bad.count() == 0


def test_partition_count_invariance(spark, q):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in q["market_pulse"](spark, SF).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        many = sorted(tuple(r) for r in q["market_pulse"](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many


def test_dimensions_unique_on_place_year(spark, q):
    from brickyard.operators.scalars import require_unique
    require_unique(q["affordability_table"](spark, SF), ["county", "year"], "affordability")
    require_unique(q["supply_demand_table"](spark, SF), ["county", "year"], "supply_demand")
    dup = spark.createDataFrame([("A", 2020), ("A", 2020), ("B", 2020)], "county string, year int")
    with pytest.raises(ValueError, match="not unique"):
        require_unique(dup, ["county", "year"])
