"""Threshold classifiers (the reference's status / signal / tier labels).

Each classifier is a plain ``CASE WHEN`` chain: JVM-side, codegen'd, no UDF.
``sql_*`` twins render the same chain as SQL text for the oracle.
Missing input is NULL (never NaN); where the reference's intent is
"Insufficient Data" for a missing value, that is explicit (SURVEY Q4).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Thresholds and labels that must equal the reference's.
# Listed in the reference's order, highest band first.
# ---------------------------------------------------------------------------
AFFORDABILITY_STATUS = ((12, "Severe Crisis"), (9, "Critical"), (7, "High Stress"), (5, "Moderate"))
AFFORDABILITY_DEFAULT = "Manageable"                       # years of salary, >= bands

SUPPLY_STATUS = ((0.40, "Critical Shortage"), (0.60, "Severe Shortage"), (0.80, "Moderate Shortage"))
SUPPLY_DEFAULT = "Near Balance"                             # supply ratio, < bands

MOMENTUM_SIGNAL = ((3, "Strong Acceleration"), (1, "Accelerating"), (-1, "Flat"), (-3, "Decelerating"))
MOMENTUM_DEFAULT = "Sharp Decline"                          # 3-month momentum, > bands

PREMIUM_SIGNAL = ((20, "High Premium"), (10, "Moderate Premium"), (0, "Low Premium / At Parity"))
PREMIUM_DEFAULT = "Second-Hand Premium"                     # new-build premium pct, > bands

FTB_STATUS = ((20, "Cannot Afford — Major Gap"), (5, "Stretched — Borderline"), (0, "Achievable with Exemption"))
FTB_DEFAULT = "Within LTI Limit"                            # affordability gap pct, > bands

MARKET_TEMPERATURE = ((70, "🔥 Very Hot"), (55, "🌡 Hot"), (40, "😐 Warm"), (25, "❄ Cool"))
TEMPERATURE_DEFAULT = "🧊 Cold"                             # heat index, >= bands

DETERIORATION_TREND = ((2, "Rapidly Worsening"), (1, "Worsening"))
TREND_DEFAULT = "Stable"                                    # change in years of salary, >= bands

INSUFFICIENT = "Insufficient Data"

PRESSURE_BOTH = "High Pressure — Low Supply + High Growth"
PRESSURE_SUPPLY = "Supply Constrained"
PRESSURE_GROWTH = "High Growth"
PRESSURE_DEFAULT = "Moderate"
PRESSURE_MAX_RATIO = 0.5
PRESSURE_MIN_GROWTH = 40

NEW_BUILD = "New Build"
SECOND_HAND = "Second-Hand"
NEW_BUILD_TRUE_TEXT = ("YES", "TRUE", "1")

# Postcode zones of the capital (padded form; SURVEY Q5 pads "D6W" to "D06W").
ZONE_INNER = ("D01", "D02", "D03", "D04", "D05", "D06", "D06W", "D07", "D08")
ZONE_MID = ("D09", "D10", "D11", "D12", "D13", "D14", "D16")
ZONE_OUTER = ("D15", "D17", "D18", "D20", "D22", "D24")
ZONES = (("Inner City", ZONE_INNER), ("Mid City", ZONE_MID), ("Outer City", ZONE_OUTER))
ZONE_DEFAULT = "Commuter"
# ---------------------------------------------------------------------------

# Words of a property's description that tell an apartment from a house.
APARTMENT_RE = r"(?i)\b(apartment|apt|flat|duplex|maisonette|penthouse|studio)s?\b"
HOUSE_RE = r"(?i)\b(house|bungalow|cottage|villa|farmhouse|detached|terraced?)s?\b"
APARTMENT, HOUSE, UNKNOWN_CLASS = "Apartment", "House", "Unknown"

_OPS = {">=": lambda c, t: c >= t, ">": lambda c, t: c > t, "<": lambda c, t: c < t}


def bucket(c, bands, default: str, op: str, null_label: str | None = None) -> Column:
    """CASE WHEN c <op> t1 THEN l1 WHEN ... ELSE default END."""
    c = F.col(c) if isinstance(c, str) else c
    expr = None
    if null_label is not None:
        expr = F.when(c.isNull(), F.lit(null_label))
    for t, label in bands:
        cond = _OPS[op](c, F.lit(t))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def sql_bucket(expr: str, bands, default: str, op: str, null_label: str | None = None) -> str:
    parts = ["CASE"]
    if null_label is not None:
        parts.append(f"WHEN ({expr}) IS NULL THEN {_q(null_label)}")
    for t, label in bands:
        parts.append(f"WHEN ({expr}) {op} {t} THEN {_q(label)}")
    parts.append(f"ELSE {_q(default)} END")
    return " ".join(parts)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def affordability_status(c) -> Column:
    return bucket(c, AFFORDABILITY_STATUS, AFFORDABILITY_DEFAULT, ">=")


def supply_status(c) -> Column:
    return bucket(c, SUPPLY_STATUS, SUPPLY_DEFAULT, "<")


def momentum_signal(c) -> Column:
    return bucket(c, MOMENTUM_SIGNAL, MOMENTUM_DEFAULT, ">", INSUFFICIENT)


def premium_signal(c) -> Column:
    return bucket(c, PREMIUM_SIGNAL, PREMIUM_DEFAULT, ">", INSUFFICIENT)


def ftb_status(c) -> Column:
    return bucket(c, FTB_STATUS, FTB_DEFAULT, ">")


def market_temperature(c) -> Column:
    return bucket(c, MARKET_TEMPERATURE, TEMPERATURE_DEFAULT, ">=")


def deterioration_trend(c) -> Column:
    return bucket(c, DETERIORATION_TREND, TREND_DEFAULT, ">=")


def tier(c, cutoffs, default: str) -> Column:
    return bucket(c, cutoffs, default, ">=")


def market_pressure(ratio, growth) -> Column:
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    growth = F.col(growth) if isinstance(growth, str) else growth
    low = ratio < F.lit(PRESSURE_MAX_RATIO)
    high = growth > F.lit(PRESSURE_MIN_GROWTH)
    return (F.when(low & high, F.lit(PRESSURE_BOTH))
             .when(low, F.lit(PRESSURE_SUPPLY))
             .when(high, F.lit(PRESSURE_GROWTH))
             .otherwise(F.lit(PRESSURE_DEFAULT)))


def zone(postcode) -> Column:
    p = F.col(postcode) if isinstance(postcode, str) else postcode
    expr = None
    for label, codes in ZONES:
        cond = p.isin(*codes)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(ZONE_DEFAULT))


def sql_zone(expr: str) -> str:
    parts = ["CASE"]
    for label, codes in ZONES:
        parts.append(f"WHEN ({expr}) IN ({', '.join(_q(c) for c in codes)}) THEN {_q(label)}")
    parts.append(f"ELSE {_q(ZONE_DEFAULT)} END")
    return " ".join(parts)


def property_class(c) -> Column:
    """Apartment or House from the description; a text that names both or neither says nothing."""
    text = F.col(c) if isinstance(c, str) else c
    flat, house = F.coalesce(text.rlike(APARTMENT_RE), F.lit(False)), F.coalesce(text.rlike(HOUSE_RE), F.lit(False))
    # nested, so that each pattern is tried once
    return F.when(flat, F.when(house, F.lit(UNKNOWN_CLASS)).otherwise(F.lit(APARTMENT))).when(house, F.lit(HOUSE)).otherwise(F.lit(UNKNOWN_CLASS))
