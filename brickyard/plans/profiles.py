"""All price profiles from one histogram of the sales.

The finest cells are (market flag, place, region, year, month, VAT flag, property class, postcode of the focus place);
their histogram of prices in cents is stored once, merges with that of further sales, and every breakdown that the
jobs read is a roll-up of it.  Two reads of the sales serve all profiles: one for the histogram and one for
the values at the quantiles' ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Config, DEFAULT
from ..functions import labels as L
from ..functions.cleaning import postcode
from ..operators import cube

DIMS = ("not_full_market", "county", "region", "year", "month", "vat", "segment", "postcode")
KEYS = ("profile", "place", "region", "part", "year", "month")
QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
#: Breakdowns of the market sales; ``all`` is that of every clean transaction.
NAMES = ("place_year", "place_month", "place_type", "place_segment", "focus", "region", "month", "vat", "postcode", "zone", "all")


def cents(price) -> Column:
    return (F.col(price).cast("decimal(12,2)") * 100).cast("bigint")


def cells(tx: DataFrame, cfg: Config = DEFAULT, *more: str) -> DataFrame:
    """The transactions as cells (with further columns) with their price in cents and their day.

    No dimension is NULL: an unknown flag is no market sale, an unknown text is ''.
    """
    focus = F.col("county") == F.lit(cfg.focus_place)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return tx.select(*more, F.coalesce("not_full_market", F.lit(True)).alias("not_full_market"), blank(F.col("county")).alias("county"),
                     blank(F.col("region")).alias("region"), "year", "month", F.coalesce(F.col("vat_exclusive").cast("string"), F.lit("unknown")).alias("vat"),
                     L.property_class("property_type").alias("segment"), blank(F.when(focus, postcode("eircode"))).alias("postcode"),
                     F.day("date_of_sale").alias("day"), cents("price_eur").alias("v")).where("v is not null")


def histogram(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return cube.histogram(cells(tx, cfg), DIMS)


def type_label() -> Column:
    is_new = F.upper(F.col("vat")).isin(*L.NEW_BUILD_TRUE_TEXT)
    return F.when(is_new, F.lit(L.NEW_BUILD)).otherwise(F.lit(L.SECOND_HAND))


def _sets(cfg: Config, only) -> Column:
    """The groups of a cell, NULL where it has none of a breakdown.  Keys that a breakdown doesn't use are '' or 0."""
    def row(name, place="", region="", part="", year=True, month=False):
        text = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(name).alias("profile"), text(place).alias("place"), text(region).alias("region"), text(part).alias("part"),
                        (F.col("year") if year else F.lit(0)).cast("int").alias("year"), (F.col("month") if month else F.lit(0)).cast("int").alias("month"))

    region, focus, code = F.col("region"), F.col("county") == F.lit(cfg.focus_place), F.col("postcode")
    market = {"place_year": row("place_year", F.col("county"), region), "place_month": row("place_month", F.col("county"), region, month=True),
              "place_type": row("place_type", F.col("county"), region, type_label()), "place_segment": row("place_segment", F.col("county"), region, F.col("segment")),
              "focus": row("focus", F.when(focus, F.lit("focus")).otherwise(F.lit("rest"))), "region": row("region", region),
              "month": row("month", month=True), "vat": row("vat", F.col("county"), part=F.col("vat")),
              "postcode": F.when(code != "", row("postcode", code)), "zone": F.when(code != "", row("zone", L.zone(code), part=F.col("vat")))}
    sold = F.array(*[v for k, v in market.items() if k in only]) if any(k in only for k in market) else None
    every = F.array(row("all", year=False))
    none = F.slice(every, 1, 0)
    parts = ([F.when(~F.col("not_full_market"), sold).otherwise(none)] if sold is not None else []) + ([every] if "all" in only else [])
    return F.concat(*parts)


def _wanted() -> Column:
    of = lambda names: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(QUANTILES[n]).alias("p")) for n in names])
    all_of, median = of(QUANTILES), of(["median"])
    return F.when(F.col("profile") == "place_year", all_of).otherwise(median)


def profiles(tx: DataFrame, cfg: Config = DEFAULT, hist: DataFrame | None = None, only=NAMES) -> DataFrame:
    """(profile, place, region, part, year, month) -> n, total, mean, min, max, stddev, days, p10 ... p90.

    ``hist``: the stored histogram of ``tx``; else it is made (and checkpointed) here.
    """
    from ..session import materialize

    hist = materialize(histogram(tx, cfg)) if hist is None else hist
    return cube.profiles(cells(tx, cfg), hist, DIMS, _sets(cfg, only), KEYS, _wanted(), list(QUANTILES), exact=cfg.exact_quantiles)


def _places(p: DataFrame, name: str) -> DataFrame:
    return p.where(F.col("profile") == name).withColumnRenamed("place", "county").withColumn("region", F.nullif("region", F.lit("")))


def place_year(p: DataFrame) -> DataFrame:
    """(county, region, year) -> n, total, mean, min, max, stddev, p10 ... p90."""
    return _places(p, "place_year").drop("profile", "part", "month", "days")


def place_month(p: DataFrame) -> DataFrame:
    """(county, region, sale_month, year, month) -> n, total, median, ..."""
    p = _places(p, "place_month").drop("profile", "part")
    return p.withColumn("sale_month", F.make_date("year", "month", F.lit(1)))


def place_type(p: DataFrame) -> DataFrame:
    """(county, region, year, type_label) -> n, median, ..."""
    return _places(p, "place_type").withColumnRenamed("part", "type_label").drop("profile", "month")


def place_segment(p: DataFrame) -> DataFrame:
    """(county, region, year, segment) -> n, median, ..."""
    return _places(p, "place_segment").withColumnRenamed("part", "segment").drop("profile", "month")


def load_profile(p: DataFrame, hist: DataFrame) -> DataFrame:
    """One row on all clean transactions; the places and years are those of the histogram's cells."""
    from ..functions.numeric import round_half_away
    from ..operators.scalars import with_scalars

    found = hist.agg(F.countDistinct("county").alias("counties"),
                     F.array_join(F.array_sort(F.collect_set("year")).cast("array<string>"), ",").alias("years"))  # calendar years
    prices = p.where("profile = 'all'").select(F.col("n").alias("transactions"), F.col("min").alias("min_price"), F.col("max").alias("max_price"),
                                               round_half_away("median", 2).alias("median_price"))
    return with_scalars(prices, found).select("transactions", "counties", "years", "min_price", "max_price", "median_price")
