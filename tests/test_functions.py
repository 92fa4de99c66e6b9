"""Column helpers and labels on micro-fixtures (the quirks of SURVEY §2.12)."""

import pytest
from pyspark.sql import Window, functions as F

from brickyard.functions import labels as L
from brickyard.functions.numeric import round_half_away, round_int
from brickyard.functions.windows import momentum, rolling_mean, series, truncated_average_rank
from brickyard.operators.scalars import min_max_scores
from brickyard.functions.cleaning import postcode


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_round_half_away_from_zero_on_binary_value(spark):
    got = _one(spark, [(1.005,), (2.5,), (-2.5,), (0.125,), (-0.04,), (None,)], "x double",
               round_half_away("x", 2))
    assert got[:4] == [1.0, 2.5, -2.5, 0.13]
    got0 = _one(spark, [(2.5,), (-2.5,), (3.4999,), (-0.4,)], "x double", round_half_away("x", 0))
    assert got0 == [3.0, -3.0, 3.0, 0.0]
    assert str(got0[3]) == "0.0"                       # never -0.0
    assert _one(spark, [(-0.04,)], "x double", round_half_away("x", 1)) == [0.0]


def test_round_int_type(spark):
    df = spark.createDataFrame([(2.5,)], "x double").select(round_int("x").alias("r"))
    assert df.schema["r"].dataType.typeName() == "long" and df.first().r == 3


@pytest.mark.parametrize("value,label", [
    (4.9, "Manageable"), (5.0, "Moderate"), (7.0, "High Stress"), (9.0, "Critical"), (12.0, "Severe Crisis")])
def test_affordability_status(spark, value, label):
    assert _one(spark, [(value,)], "x double", L.affordability_status("x")) == [label]


@pytest.mark.parametrize("value,label", [
    (0.399, "Critical Shortage"), (0.4, "Severe Shortage"), (0.6, "Moderate Shortage"), (0.8, "Near Balance"),
    (None, "Near Balance")])
def test_supply_status(spark, value, label):
    assert _one(spark, [(value,)], "x double", L.supply_status("x")) == [label]


@pytest.mark.parametrize("value,label", [
    (0.0, "Flat"), (3.0, "Accelerating"), (3.1, "Strong Acceleration"), (1.0, "Flat"), (-1.0, "Decelerating"),
    (-3.0, "Sharp Decline"), (None, "Insufficient Data")])
def test_momentum_signal_intent(spark, value, label):
    assert _one(spark, [(value,)], "x double", L.momentum_signal("x")) == [label]


@pytest.mark.parametrize("value,label", [
    (0.0, "Second-Hand Premium"), (0.1, "Low Premium / At Parity"), (10.0, "Low Premium / At Parity"),
    (20.5, "High Premium"), (None, "Insufficient Data")])
def test_premium_signal(spark, value, label):
    assert _one(spark, [(value,)], "x double", L.premium_signal("x")) == [label]


def test_truncated_average_rank(spark):
    got = _one(spark, [(5,), (7,), (7,), (9,), (None,)], "x int", truncated_average_rank("x"))
    assert sorted(got, key=lambda v: (v is None, v)) == [1, 2, 2, 4, None]


def test_rolling_mean_min_periods_and_row_based_momentum(spark):
    # a place with a missing month: momentum looks 3 *rows* back, not 3 months
    rows = [("A", m, float(100 + 10 * i)) for i, m in enumerate([1, 2, 3, 5, 6, 7, 8])]
    df = spark.createDataFrame(rows, "c string, m int, p double")
    w = series("c", "m")
    out = df.select("m", rolling_mean("p", w, 6, 3).alias("r6"), momentum("p", w, 3).alias("m3")).orderBy("m")
    got = out.collect()
    assert got[0].r6 is None and got[1].r6 is None and got[2].r6 == 110.0
    assert got[3].m3 == pytest.approx((130 / 100 - 1) * 100)      # month 5 vs month 1 (3 rows back)


def test_two_month_place_has_no_rolling_mean(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "c string, m int, p double")
    assert [r.r for r in df.select(rolling_mean("p", series("c", "m"), 6, 3).alias("r")).collect()] == [None, None]


def test_min_max_all_equal_is_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0)], "k string, x double")
    out = min_max_scores(df, {"s": ("x", False)}).collect()
    assert [r.s for r in out] == [None, None, None]


def test_min_max_inverted(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, x double")
    out = {r.k: (r.s, r.t) for r in min_max_scores(df, {"s": ("x", False), "t": ("x", True)}).collect()}
    assert out == {"a": (0.0, 100.0), "b": (100.0, 0.0)}


@pytest.mark.parametrize("code,expected,zone", [
    ("D15 AB12", "D15", "Outer City"), ("D6W XY00", "D06W", "Inner City"), ("D6 1AA", "D06", "Inner City"),
    ("T12 X", None, None), (None, None, None), ("D09 Q", "D09", "Mid City"), ("D19 Q", "D19", "Commuter")])
def test_postcode_and_zone(spark, code, expected, zone):
    df = spark.createDataFrame([(code,)], "eircode string").select(postcode().alias("p"))
    got = df.select("p", F.when(F.col("p").isNotNull(), L.zone("p")).alias("z")).first()
    assert (got.p, got.z) == (expected, zone)
