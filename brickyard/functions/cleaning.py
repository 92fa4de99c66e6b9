"""Cleaning expressions for raw register text (all JVM-side; no Python per row).

Every function maps a raw *string* column to a clean typed column and
returns NULL for anything it cannot read (``try_*`` casts, never NaN), so
bad rows fall out at the ``dropna`` step instead of failing the job.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# The 26 places of the register and their region, the place
# name variants folded onto a place, and the header aliases of each column.
# ---------------------------------------------------------------------------
COUNTY_REGIONS = {
    "Dublin": "Leinster", "Kildare": "Leinster", "Meath": "Leinster",
    "Wicklow": "Leinster", "Wexford": "Leinster", "Kilkenny": "Leinster",
    "Carlow": "Leinster", "Laois": "Leinster", "Offaly": "Leinster",
    "Westmeath": "Leinster", "Longford": "Leinster", "Louth": "Leinster",
    "Cork": "Munster", "Limerick": "Munster", "Waterford": "Munster",
    "Tipperary": "Munster", "Clare": "Munster", "Kerry": "Munster",
    "Galway": "Connacht", "Mayo": "Connacht", "Roscommon": "Connacht",
    "Sligo": "Connacht", "Leitrim": "Connacht",
    "Donegal": "Ulster", "Cavan": "Ulster", "Monaghan": "Ulster",
}
COUNTY_VARIANTS = {
    "Tipperary North": "Tipperary", "Tipperary South": "Tipperary",
    "Cork City": "Cork", "Cork County": "Cork",
    "Galway City": "Galway", "Galway County": "Galway",
    "Limerick City": "Limerick", "Limerick County": "Limerick",
    "Waterford City": "Waterford", "Waterford County": "Waterford",
}
HEADER_ALIASES = {
    "date_of_sale": ("Date of Sale (dd/mm/yyyy)", "Date of Sale", "date_of_sale"),
    "county": ("County", "county"),
    "price_eur": ("Price (€)", "Price", "price_eur"),
    "property_type": ("Description of Property", "property_type"),
    "not_full_market_price": ("Not Full Market Price", "not_full_market_price"),
    "vat_exclusive": ("VAT Exclusive", "vat_exclusive"),
    "eircode": ("Eircode", "eircode"),
}
MARKET_SALE_TEXT = ("NO", "N", "FALSE", "0", "")
TRUE_TEXT = ("YES", "TRUE", "1", "Y")
FALSE_TEXT = ("NO", "FALSE", "0", "N")
# A database's CSV export writes booleans as t and f.
TRUE_EXPORT, FALSE_EXPORT = (*TRUE_TEXT, "T"), (*FALSE_TEXT, "F")
UNKNOWN_TYPE = "Unknown"
# ---------------------------------------------------------------------------

# A price header whatever byte form its currency sign arrived in ("Price (€)",
# "Price (\x80)", "Price (â\x82¬)").
PRICE_HEADER_RE = r"(?i)^price(\s*\(.*\))?$"
# Accept: optional leading symbols (any byte form of the currency sign),
# optional minus, digits with thousands commas, optional decimals.
PRICE_TEXT_RE = r"^[^0-9A-Za-z-]*-?[0-9,]+([.][0-9]+)?$"
# "Co. Cork", "Co Mayo", "County Clare" -> place name; bare "Cork" stays.
COUNTY_PREFIX_RE = r"(?i)^co(?:unty\s+|\.\s*|\s+)"
# A numbered postal district of the capital.
CAPITAL_DISTRICT_RE = r"(?i)^dublin\s*\d"
DATE_FORMATS = ("d/M/yyyy", "yyyy-MM-dd")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_price(c) -> Column:
    """Register price text -> DECIMAL(12,2), exactly; NULL unless the text is a plain amount."""
    t = F.trim(_c(c))
    digits = F.regexp_replace(t, r"[^0-9.\-]", "")
    return F.when(t.rlike(PRICE_TEXT_RE), digits.try_cast("decimal(12,2)"))


def clean_county(c) -> Column:
    """Trim, drop a county prefix, fold capital districts, title-case, fold known variants."""
    s = F.trim(_c(c))
    s = F.regexp_replace(s, COUNTY_PREFIX_RE, "")
    s = F.when(s.rlike(CAPITAL_DISTRICT_RE), F.lit("Dublin")).otherwise(s)
    s = F.trim(F.initcap(s))
    variants = F.create_map(*[F.lit(x) for x in chain.from_iterable(COUNTY_VARIANTS.items())])
    return F.when(s != F.lit(""), F.coalesce(variants[s], s))


def parse_sale_date(c) -> Column:
    """Day-first text (``5/3/2021``, ``05/03/2021``) or ISO (``2021-03-05``); bad dates -> NULL."""
    t = F.trim(_c(c))
    return F.coalesce(*[F.try_to_date(t, fmt) for fmt in DATE_FORMATS])


def market_sale(c) -> Column:
    """True for a full-market-price sale ("No"/"N"/"0"/...); missing text is not one."""
    return F.upper(F.trim(_c(c))).isin(*MARKET_SALE_TEXT)


def yes_no(c) -> Column:
    """Register yes/no text -> boolean; anything else -> NULL."""
    u = F.upper(F.trim(_c(c)))
    return F.when(u.isin(*TRUE_TEXT), F.lit(True)).when(u.isin(*FALSE_TEXT), F.lit(False))


def postcode(c="eircode") -> Column:
    """Routing key ``D<1-2 digits>[W]`` at the start of the code, digits padded to two; else NULL."""
    e, pat = _c(c), r"^D(\d{1,2})(W?)"
    digits = F.regexp_extract(e, pat, 1)
    return F.when(digits != F.lit(""), F.concat(F.lit("D"), F.lpad(digits, 2, "0"), F.regexp_extract(e, pat, 2)))


def quarter_label(d) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_c(d)).cast("string"))
