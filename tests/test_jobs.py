"""Jobs on hand-built micro-fixtures (FIXTURES.md §7) with literal expected rows."""

import datetime as dt

import pytest

from brickyard.config import Config
from brickyard.plans import afford, invest, market

SCHEMA = ("date_of_sale date, county string, region string, price_eur double, property_type string, "
          "not_full_market boolean, vat_exclusive boolean, year int, month int, quarter string, eircode string")
NEW, OLD = "New Dwelling house /Apartment", "Second-Hand Dwelling house /Apartment"
CFG = Config(focus_place="Dublin", base_year=2020, latest_year=2022, postcode_min_sales=20)


def sale(y, m, county, price, new=False, eircode=None, d=1, region="R"):
    return (dt.date(y, m, d), county, region, float(price), NEW if new else OLD, False, new, y, m,
            f"Q{(m - 1) // 3 + 1}", eircode)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_market_pulse_base_year_vs_first_year(spark):
    rows = [sale(2020, 1, "A", 100000), sale(2021, 1, "A", 110000), sale(2022, 1, "A", 121000),
            sale(2021, 1, "B", 200000), sale(2022, 1, "B", 150000), sale(2022, 2, "B", 150001)]
    prof = market.place_year_profile(frame(spark, rows), CFG)
    got = {(r.county, r.year): r for r in market.market_pulse(prof, CFG).collect()}
    assert got[("A", 2022)].yoy_growth_pct == 10.0 and got[("A", 2022)].growth_since_base_pct == 21.0
    # B has no base year: the base-year form is NULL, the first-year form uses 2021
    assert got[("B", 2022)].growth_since_base_pct is None
    assert got[("B", 2022)].growth_since_first_pct == -25.0
    assert got[("B", 2022)].median_price == 150001          # 150000.5 rounds half away from zero
    assert got[("A", 2020)].yoy_growth_pct is None


def test_single_sale_distribution(spark):
    prof = market.place_year_profile(frame(spark, [sale(2020, 1, "A", 123456.4)]), CFG)
    (r,) = market.price_distribution(prof, CFG).collect()
    assert r.std is None and r.p10 == r.median == r.p90 == r.min == r.max == 123456.0


def test_new_vs_secondhand_drops_place_with_one_type(spark):
    rows = [sale(2022, 1, "A", 300000, new=True), sale(2022, 2, "A", 310000, new=True),
            sale(2022, 3, "A", 320000, new=True),
            sale(2022, 1, "B", 240000, new=True), sale(2022, 1, "B", 200000)]
    by_type = market.property_type(market.place_year_type_profile(frame(spark, rows), CFG), CFG)
    got = market.new_vs_secondhand(by_type, CFG).collect()
    assert [(r.county, r.new_build_premium_eur, r.new_build_premium_pct, r.premium_signal) for r in got] == \
        [("B", 40000, 20.0, "Moderate Premium")]


def test_postcode_minimum_support(spark):
    rows = [sale(2022, 1, "Dublin", 300000 + i, eircode="D4 ABC") for i in range(19)]
    rows += [sale(2022, 1, "Dublin", 500000 + i, eircode="D6W XYZ") for i in range(20)]
    annual = market.postcode_annual(market.side_profile(frame(spark, rows), CFG), CFG)
    got = annual.collect()
    assert [(r.postcode, r.zone, r.transactions) for r in got] == [("D06W", "Inner City", 20)]
    snap = market.postcode_snapshot(annual, CFG).collect()
    assert snap[0].price_rank == 1


def test_momentum_signals_latest_month_only(spark):
    rows = [sale(2022, m, "A", 100000 * (1.02 ** m)) for m in range(1, 8)]
    rows += [sale(2022, m, "B", 100000) for m in range(1, 6)]           # B stops in May
    monthly = market.monthly_momentum(market.place_month_profile(frame(spark, rows), CFG), CFG)
    sig = market.momentum_signals(monthly, CFG).collect()
    assert [(r.county, r.sale_month, r.momentum_3m, r.signal) for r in sig] == \
        [("A", dt.date(2022, 7, 1), 6.1, "Strong Acceleration")]


def test_seasonal_pattern_flags(spark):
    rows = []
    for y in (2021, 2022):
        rows += [sale(y, 1, "A", 90000), sale(y, 2, "A", 100000), sale(y, 3, "A", 110000)]
    season = market.seasonality(market.side_profile(frame(spark, rows), CFG), CFG)
    pat = {r.month: r for r in market.seasonal_pattern(season, CFG).collect()}
    assert pat[1].avg_price_index == 90.0 and pat[1].best_time_to_buy and not pat[1].best_time_to_sell
    assert pat[3].avg_price_index == 110.0 and pat[3].best_time_to_sell
    assert pat[2].month_name == "Feb"


def test_mortgage_stress_by_hand(spark):
    ms = frame(spark, [sale(2022, 1, "A", 300000)])
    aff = spark.createDataFrame([("A", 2022, 50000.0, 1000)], "county string, year int, avg_annual_wage double, "
                                                              "population bigint")
    (r,) = afford.mortgage_stress(market.place_year_profile(ms, CFG), aff, CFG).collect()
    assert (r.deposit_needed, r.years_to_deposit, r.max_mortgage, r.max_affordable_price) == (30000, 4.0, 200000, 222222)
    assert (r.affordability_gap, r.gap_pct, r.ftb_status) == (77778.0, 25.9, "Cannot Afford — Major Gap")
    assert (r.stressed_monthly_repayment, r.repayment_to_income_pct) == (1199, 28.8)


def test_affordability_rank_ties(spark):
    aff = spark.createDataFrame(
        [("A", "R", 2022, 1.0, 1.0, 9.0, 1.0, 1.0), ("B", "R", 2022, 1.0, 1.0, 9.0, 1.0, 1.0),
         ("C", "R", 2022, 1.0, 1.0, 4.9, 1.0, 1.0), ("D", "R", 2022, 1.0, 1.0, None, 1.0, 1.0)],
        "county string, region string, year int, median_price double, avg_annual_wage double, "
        "years_salary_to_buy double, price_to_income_ratio double, monthly_rent_estimate double")
    got = {r.county: (r.unaffordability_rank, r.affordability_status)
           for r in afford.affordability_ranking(aff, CFG).collect()}
    # NULL first on DESC (PostgreSQL order), then the tie shares a rank
    assert got == {"D": (1, "Manageable"), "A": (2, "Critical"), "B": (2, "Critical"), "C": (4, "Manageable")}


def test_risk_adjusted_ranks_with_ties(spark):
    inv = spark.createDataFrame(
        [("A", "R", 1.0, 10.0, 5.0, 5.0), ("B", "R", 1.0, 10.0, 5.0, 5.0), ("C", "R", 1.0, 20.0, 5.0, 5.0),
         ("D", "R", 1.0, 0.0, 5.0, 5.0)],
        "county string, region string, median_price_latest double, price_growth_pct double, "
        "rental_yield_est_pct double, years_salary_to_buy double")
    got = {r.county: (r.risk_adj_return_score, r.risk_adj_rank, r.risk_adj_rank_avg)
           for r in invest.risk_adjusted_ranking(inv, CFG).collect()}
    assert got == {"C": (26.0, 1, 1), "A": (22.0, 2, 2), "B": (22.0, 2, 2), "D": (18.0, 4, 4)}


def test_approximate_quantiles_only_when_asked(spark):
    rows = [sale(2022, 1, "A", 100000 + 1000 * i) for i in range(101)]
    exact = market.market_pulse(market.place_year_profile(frame(spark, rows), CFG), CFG).first()
    approx_cfg = CFG.with_(exact_quantiles=False)
    approx = market.market_pulse(market.place_year_profile(frame(spark, rows), approx_cfg), approx_cfg).first()
    assert exact.median_price == 150000
    assert abs(approx.median_price - 150000) <= 1000


def test_zero_base_division_guard(spark):
    from pyspark.sql import functions as F
    from brickyard.functions.numeric import pct_change, safe_div
    df = spark.createDataFrame([(5.0, 0.0), (5.0, None), (6.0, 3.0)], "cur double, prev double")
    got = [(r.p, r.d) for r in df.select(pct_change("cur", "prev").alias("p"), safe_div("cur", "prev").alias("d")).collect()]
    assert got == [(None, None), (None, None), (100.0, 2.0)]


def test_running_deficit_carries_over_null(spark):
    from brickyard.plans import supply
    sd = spark.createDataFrame(
        [("A", "R", 2020, 1, 2, 10, 0.5, 1.0), ("A", "R", 2021, 1, 2, None, 0.5, 1.0), ("A", "R", 2022, 1, 2, 5, 0.399, 1.0)],
        "county string, region string, year int, new_completions long, estimated_demand long, supply_deficit long, "
        "supply_ratio double, supply_deficit_pct double")
    got = [(r.year, r.cumulative_deficit, r.supply_status) for r in supply.supply_gap(sd, CFG).orderBy("year").collect()]
    assert got == [(2020, 10, "Severe Shortage"), (2021, 10, "Severe Shortage"), (2022, 15, "Critical Shortage")]


def test_place_without_base_year(spark):
    aff = spark.createDataFrame(
        [("A", "R", 2020, 1.0, 1.0, 5.0, 1.0, 1.0), ("A", "R", 2022, 1.0, 1.0, 7.5, 1.0, 1.0),
         ("B", "R", 2022, 1.0, 1.0, 12.0, 1.0, 1.0)],
        "county string, region string, year int, median_price double, avg_annual_wage double, "
        "years_salary_to_buy double, price_to_income_ratio double, monthly_rent_estimate double")
    got = {(r.county, r.year): (r.deterioration_vs_base, r.affordability_status)
           for r in afford.affordability_ranking(aff, CFG).collect()}
    assert got[("A", 2022)] == (2.5, "High Stress") and got[("B", 2022)] == (None, "Severe Crisis")
    det = {r.county: (r.yrs_salary_deterioration, r.trend) for r in afford.affordability_deterioration(aff, CFG).collect()}
    assert det == {"A": (2.5, "Rapidly Worsening"), "B": (None, "Stable")}


def test_heat_ties_broken_by_place(spark):
    pulse = spark.createDataFrame([(c, "R", 2022, 100000, 1.0, 10) for c in ("C", "A", "B")],
                                  "county string, region string, year int, median_price long, yoy_growth_pct double, "
                                  "transactions long")
    vel = spark.createDataFrame([(c, 2022, 5.0) for c in ("C", "A", "B")], "county string, year int, vol_yoy_pct double")
    got = sorted((r.rank, r.county, r.heat_index) for r in invest.heat_index(pulse, vel, CFG).collect())
    assert got == [(1, "A", None), (2, "B", None), (3, "C", None)]       # all equal: scores NULL, ranks by place


def test_a_band_of_prices_in_one_bucket(spark):
    rows = [sale(2022, 1, "A", 300000 + i * 0.01) for i in range(60)]
    r = market.place_year_profile(frame(spark, rows), CFG).first()
    assert (r.median, r.p10, r.p90) == (300000.295, pytest.approx(300000.059, abs=1e-9), pytest.approx(300000.531, abs=1e-9))
