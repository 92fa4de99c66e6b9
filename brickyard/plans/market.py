"""Market jobs: price levels, growth, momentum, velocity, segments, seasonality.

Every job is ``DataFrame(s), Config -> DataFrame`` over *market sales*
(canonical transactions with ``not_full_market = FALSE``).  Heavy work is
one grouped aggregation over the sales (partial aggregation map-side,
exact quantiles via ``grouped_profile``); every window, pivot and label
runs on the aggregated place x period series, which is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as L
from ..functions.numeric import pct_change, round_half_away as rnd, round_int, safe_div
from ..functions.windows import (momentum, rolling_mean, series,
                                 truncated_average_rank, value_at)
from ..operators.scalars import with_scalars
from . import profiles as P


def month_name(month_col) -> F.Column:
    m = F.col(month_col) if isinstance(month_col, str) else month_col
    return F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM")


# ---------------------------------------------------------------------------
# The shared place-year profile and P1 market pulse
# ---------------------------------------------------------------------------

def place_year_profile(ms: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(county, region, year) -> n, total, mean, min, max, stddev, p10, p25, median, p75, p90."""
    return P.place_year(P.profiles(ms, cfg, only=("place_year",)))


def market_pulse(prof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Place-year price levels and growth; growth from the rounded median (SQL form)."""
    p = prof
    a = p.select("county", "region", "year",
                 F.col("n").alias("transaction_count"),
                 round_int("median").alias("median_price"),
                 round_int("mean").alias("avg_price"),
                 round_int("p25").alias("p25_price"),
                 round_int("p75").alias("p75_price"),
                 round_int("min").alias("min_price"),
                 round_int("max").alias("max_price"),
                 rnd(F.col("total") / F.lit(1e9), 3).alias("total_value_bn"))
    w = series("county", "year")
    prev = F.lag("median_price").over(w)
    base = value_at("median_price", F.col("year") == F.lit(cfg.base_year), "county")
    first = F.first("median_price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return a.select("*",
                    prev.alias("prev_year_median"),
                    rnd(pct_change("median_price", prev), 1).alias("yoy_growth_pct"),
                    rnd(pct_change("median_price", base), 1).alias("growth_since_base_pct"),
                    rnd(safe_div("median_price", first) * F.lit(100.0) - F.lit(100.0), 1)
                    .alias("growth_since_first_pct"))


def market_pulse_value(prof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The enhanced form: growth from the unrounded median, total value in billions."""
    p = prof
    w = series("county", "year")
    base = value_at("median", F.col("year") == F.lit(cfg.base_year), "county")
    return p.select("county", "region", "year",
                    F.col("n").alias("transactions"),
                    round_int("median").alias("median_price"),
                    round_int("mean").alias("avg_price"),
                    round_int("p25").alias("p25"),
                    round_int("p75").alias("p75"),
                    rnd(momentum("median", w, 1), 1).alias("yoy_growth_pct"),
                    rnd(pct_change("median", base), 1).alias("growth_since_base_pct"),
                    rnd(F.col("total") / F.lit(1e9), 3).alias("total_value_bn"))


# ---------------------------------------------------------------------------
# P2 focus market vs the rest, P3 regions
# ---------------------------------------------------------------------------

SIDES = ("focus", "region", "month", "vat", "postcode", "zone")


def side_profile(ms: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(profile, place, part, year, month) -> n, mean, stddev, median, ...: the smaller breakdowns."""
    return P.profiles(ms, cfg, only=SIDES)


def focus_vs_rest(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = side.where("profile = 'focus'").withColumnRenamed("place", "market")
    is_f, is_r = F.col("market") == "focus", F.col("market") == "rest"
    med = round_int("median")
    y = p.groupBy("year").agg(
        F.max(F.when(is_f, med)).alias("focus_median"),
        F.max(F.when(is_r, med)).alias("rest_median"),
        F.max(F.when(is_f, F.col("n"))).alias("focus_transactions"),
        F.max(F.when(is_r, F.col("n"))).alias("rest_transactions"),
        F.sum("n").alias("total_transactions"))
    prem = F.col("focus_median") - F.col("rest_median")
    return y.select("*", prem.alias("focus_premium"),
                    rnd(prem * F.lit(100.0) / F.nullif(F.col("rest_median"), F.lit(0)), 1).alias("focus_premium_pct"))


def regional_trends(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = side.where("profile = 'region'").drop("region").withColumnRenamed("place", "region")
    a = p.select("region", "year", F.col("n").alias("transactions"),
                 round_int("median").alias("median_price"),
                 round_int("mean").alias("avg_price"),
                 round_int("stddev").alias("price_stddev"))
    return a.withColumn("yoy_growth_pct", rnd(momentum("median_price", series("region", "year"), 1), 1))


# ---------------------------------------------------------------------------
# P4 monthly momentum and latest-month signals
# ---------------------------------------------------------------------------

def place_month_profile(ms: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(county, region, sale_month) -> n, median, ... plus year and month; shared by the monthly jobs."""
    return P.place_month(P.profiles(ms, cfg, only=("place_month",)))


def monthly_momentum(mprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = mprof
    w = series("county", "sale_month")
    return p.select(
        "county", "region", "sale_month",
        round_int("median").alias("median_price"),
        F.col("n").alias("transactions"),
        rnd(momentum("median", w, 1), 2).alias("mom_pct"),
        round_int(rolling_mean("median", w, 6, 3)).alias("rolling_6m_avg"),
        rnd(momentum("median", w, 3), 1).alias("momentum_3m"),
        rnd(momentum("median", w, 6), 1).alias("momentum_6m"),
        round_int(rolling_mean("n", w, 3, 2)).alias("vol_rolling_3m"))


def monthly_momentum_sql(mprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The SQL form: rolling 6-month mean with no minimum count, 3-month momentum."""
    p = mprof
    w = series("county", "sale_month")
    return p.select("county", "sale_month", round_int("median").alias("median_price"),
                    round_int(rolling_mean("median", w, 6)).alias("rolling_6m_avg"),
                    rnd(momentum("median", w, 3), 1).alias("momentum_3m_pct"))


def momentum_signals(monthly: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows of the latest month overall, with the 3-month momentum signal."""
    latest = with_scalars(monthly, monthly.agg(F.max("sale_month").alias("__latest")))
    return (latest.where(F.col("sale_month") == F.col("__latest")).drop("__latest")
                  .withColumn("signal", L.momentum_signal("momentum_3m")))


def complete_months(months: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sale_month, days_seen, complete): coverage of every month, judged by the days that the median month has sales on."""
    m = months.where("profile = 'month'").select(F.make_date("year", "month", F.lit(1)).alias("sale_month"), F.col("days").alias("days_seen"))
    usual = m.agg(F.percentile("days_seen", 0.5).alias("__usual"))  # one value a calendar month
    return with_scalars(m, usual).select("sale_month", "days_seen", (F.col("days_seen") >= F.col("__usual") * F.lit(cfg.complete_share)).alias("complete"))


def momentum_signals_complete(monthly: DataFrame, months: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The signals of the latest complete month: a month that has just begun says nothing about most places."""
    latest = complete_months(months, cfg).where("complete").agg(F.max("sale_month").alias("__latest"))
    return (with_scalars(monthly, latest).where(F.col("sale_month") == F.col("__latest")).drop("__latest")
            .withColumn("signal", L.momentum_signal("momentum_3m")))


# ---------------------------------------------------------------------------
# P5 transaction velocity
# ---------------------------------------------------------------------------

def velocity_annual(prof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Annual sales volume per place (the place-year profile's count) and its growth."""
    a = prof.select("county", "year", F.col("n").alias("volume"))
    w = series("county", "year")
    a = a.withColumn("vol_yoy_pct", rnd(momentum("volume", w, 1), 1))
    return a.withColumn("prev_vol_yoy_pct", F.lag("vol_yoy_pct").over(w))


def velocity_monthly(mprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = mprof
    w = series(["county", "month"], "year")
    return p.select("county", "year", "month", F.col("n").alias("volume"),
                    round_int("median").alias("median_price"),
                    rnd(momentum("n", w, 1), 1).alias("vol_yoy_pct"),
                    rnd(momentum("median", w, 1), 1).alias("price_yoy_pct"))


# ---------------------------------------------------------------------------
# P6 new build vs second-hand, P7 the SQL average form
# ---------------------------------------------------------------------------

def place_year_type_profile(ms: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(county, region, year, type_label) -> n, median, ...; shared by the new-build jobs."""
    return P.place_type(P.profiles(ms, cfg, only=("place_type",)))


def property_type(tprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = tprof
    return p.select("county", "region", "year", "type_label", F.col("n").alias("transactions"),
                    round_int("median").alias("median_price"))


def property_segments(sprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Apartments and houses per place-year, with those whose description tells neither: sales, share, price and growth."""
    w, place = series(["county", "segment"], "year"), Window.partitionBy("county", "year")
    return sprof.select("county", "region", "year", "segment", F.col("n").alias("transactions"),
                        rnd(F.col("n") * F.lit(100.0) / F.sum("n").over(place), 1).alias("share_pct"),
                        round_int("median").alias("median_price"), rnd(momentum("median", w, 1), 1).alias("yoy_growth_pct"))


def segment_premium(sprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What a house costs over an apartment, per place-year that has both."""
    of = lambda name, c: F.max(F.when(F.col("segment") == name, F.col(c)))
    p = sprof.groupBy("county", "year").agg(of(L.HOUSE, "median").alias("__house"), of(L.APARTMENT, "median").alias("__flat"),
                                            of(L.HOUSE, "n").alias("house_sales"), of(L.APARTMENT, "n").alias("apartment_sales"))
    return (p.where("__house is not null and __flat is not null")
             .select("county", "year", "house_sales", "apartment_sales", round_int("__house").alias("house_median"), round_int("__flat").alias("apartment_median"),
                     rnd((F.col("__house") - F.col("__flat")) * F.lit(100.0) / F.nullif(F.col("__flat"), F.lit(0.0)), 1).alias("house_premium_pct")))


def new_vs_secondhand(by_type: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pivot of ``property_type`` with explicit values; rows lacking either type are dropped."""
    pv = (by_type.groupBy("county", "region", "year")
                 .pivot("type_label", [L.NEW_BUILD, L.SECOND_HAND])
                 .agg(F.first("median_price"))
                 .withColumnRenamed(L.NEW_BUILD, "new_build_median")
                 .withColumnRenamed(L.SECOND_HAND, "second_hand_median")
                 .dropna(subset=["new_build_median", "second_hand_median"]))
    prem = F.col("new_build_median") - F.col("second_hand_median")
    pct = rnd(safe_div(prem, "second_hand_median") * F.lit(100.0), 1)
    return pv.select("*", prem.alias("new_build_premium_eur"), pct.alias("new_build_premium_pct"),
                     L.premium_signal(pct).alias("premium_signal"))


def new_build_premium_vat(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Premium of the median new-build (VAT exclusive) price over the rest, per place-year."""
    p = side.where("profile = 'vat'").withColumnRenamed("place", "county")
    y = p.groupBy("county", "year").agg(
        F.max(F.when(F.col("part") == "true", F.col("median"))).alias("__new"),
        F.max(F.when(F.col("part") == "false", F.col("median"))).alias("__old"))
    return y.select("county", "year",
                    rnd((F.col("__new") - F.col("__old")) / F.nullif(F.col("__old"), F.lit(0.0)) * F.lit(100.0), 1)
                    .alias("new_build_premium_pct"))


def new_premium_avg(ms: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    is_new = F.col("property_type").like("%New%")
    is_old = F.col("property_type").like("%Second%")
    # exact sums of cents, one division each
    mean = lambda of: F.sum(F.when(of, P.cents("price_eur"))).cast("double") / F.nullif(F.count(F.when(of, F.lit(1))), F.lit(0)) / F.lit(100.0)
    new_avg, old_avg = mean(is_new), mean(is_old)
    return (ms.groupBy("county", "year")
              .agg(round_int(new_avg).alias("avg_new_price"),
                   round_int(old_avg).alias("avg_secondhand_price"),
                   round_int(new_avg - old_avg).alias("new_vs_secondhand_premium"),
                   F.count(F.when(is_new, F.lit(1))).alias("__new_n"))
              .where(F.col("__new_n") > F.lit(cfg.new_build_min_sales))
              .drop("__new_n"))


# ---------------------------------------------------------------------------
# P8 postcodes of the focus place
# ---------------------------------------------------------------------------
def postcode_annual(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = (side.where("profile = 'postcode'").withColumnRenamed("place", "postcode")
             .withColumn("zone", L.zone("postcode")))
    p = p.where(F.col("n") >= F.lit(cfg.postcode_min_sales))
    return p.select("postcode", "zone", "year", F.col("n").alias("transactions"),
                    round_int("median").alias("median_price"),
                    round_int("mean").alias("avg_price"),
                    rnd(momentum("median", series("postcode", "year"), 1), 1).alias("yoy_growth_pct"))


def postcode_snapshot(annual: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    latest = annual.where(F.col("year") == F.lit(cfg.latest_year))
    return latest.withColumn("price_rank", truncated_average_rank("median_price"))


# ---------------------------------------------------------------------------
# P12 monthly volume, P13 seasonality, P19 distribution
# ---------------------------------------------------------------------------

def monthly_volume(mprof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """National monthly volume and mean price, rolled up from the place-month profile
    (counts and sums add up exactly across places)."""
    a = mprof.groupBy("year", "month").agg(F.sum("n").alias("transaction_count"),
                                           round_int(F.sum("total").cast("double") / F.sum("n")).alias("avg_price"))
    w = series("month", "year")
    return a.select("*", month_name("month").alias("month_name"),
                    round_int(rolling_mean("transaction_count", w, 3)).alias("rolling_3yr_avg_volume"))


def seasonality(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = side.where("profile = 'month'")
    yw = Window.partitionBy("year")
    return p.select("year", "month", F.col("n").alias("transactions"),
                    round_int("median").alias("median_price"),
                    month_name("month").alias("month_name"),
                    rnd(F.col("median") / F.avg("median").over(yw) * F.lit(100.0), 1).alias("price_seasonal_index"),
                    rnd(F.col("n") / F.avg("n").over(yw) * F.lit(100.0), 1).alias("vol_seasonal_index"))


def mean_of_rounded(c, n: int) -> F.Column:
    """Exact mean of values already rounded to ``n`` decimals (integer sum, one division)."""
    scale = float(10 ** n)
    s = F.sum(round_int(F.col(c) * F.lit(scale)))
    return s / F.count(F.col(c)) / F.lit(scale)


def seasonal_pattern(season: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    g = season.groupBy("month").agg(mean_of_rounded("price_seasonal_index", 1).alias("avg_price_index"),
                                    mean_of_rounded("vol_seasonal_index", 1).alias("avg_vol_index"))
    return g.select("month", "avg_price_index", "avg_vol_index", month_name("month").alias("month_name"),
                    (F.col("avg_price_index") < F.lit(99.0)).alias("best_time_to_buy"),
                    (F.col("avg_price_index") > F.lit(101.0)).alias("best_time_to_sell"))


def price_distribution(prof: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    p = prof
    return p.select("county", "year", F.col("n").alias("count"),
                    *[rnd(c, 0).alias(c if c != "stddev" else "std")
                      for c in ["mean", "stddev", "min", "p10", "p25", "median", "p75", "p90", "max"]])


# ---------------------------------------------------------------------------
# Extensions: announced in the reference's text, not computed there
# ---------------------------------------------------------------------------

def price_volume_divergence(pulse: DataFrame, velocity: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Place-years by whether prices and sales moved the same way."""
    j = pulse.select("county", "year", "yoy_growth_pct").join(velocity.select("county", "year", "vol_yoy_pct"), ["county", "year"])
    price, volume = F.signum("yoy_growth_pct"), F.signum("vol_yoy_pct")
    label = (F.when(price.isNull() | volume.isNull(), F.lit(L.INSUFFICIENT))
              .when((price > 0) & (volume < 0), F.lit("Price Up, Volume Down"))
              .when((price < 0) & (volume > 0), F.lit("Price Down, Volume Up"))
              .otherwise(F.lit("Aligned")))
    return j.select("*", label.alias("divergence"))


def premium_by_zone(side: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """New-build premium of the focus place's postcode zones, per year."""
    p = side.where("profile = 'zone'").withColumnRenamed("place", "zone")
    y = p.groupBy("zone", "year").agg(F.max(F.when(F.col("part") == "true", F.col("median"))).alias("__new"),
                                      F.max(F.when(F.col("part") == "false", F.col("median"))).alias("__old"),
                                      F.sum("n").alias("transactions"))
    return y.select("zone", "year", "transactions", round_int("__new").alias("new_build_median"), round_int("__old").alias("second_hand_median"),
                    rnd(safe_div(F.col("__new") - F.col("__old"), "__old") * F.lit(100.0), 1).alias("new_build_premium_pct"))


def market_direction(national: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The national market's direction: average growth of the places, by one per cent either way."""
    g = F.col("avg_yoy")
    label = (F.when(g.isNull(), F.lit(L.INSUFFICIENT)).when(g > 1, F.lit("Rising")).when(g < -1, F.lit("Falling")).otherwise(F.lit("Stable")))
    return national.select("year", "national_median", "avg_yoy", label.alias("direction"))
