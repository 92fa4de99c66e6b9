"""Canonical-table jobs: the clean transactions and their load profile (A12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Config, DEFAULT
from ..functions.numeric import round_half_away
from . import profiles as P


def load_profile(tx: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row: sales, distinct places, the sorted years present, min / max / median price."""
    from ..session import materialize

    hist = materialize(P.histogram(tx, cfg))
    return P.load_profile(P.profiles(tx, cfg, hist, only=("all",)), hist)


# ---------------------------------------------------------------------------
# The stored tables: types, keys, files
# ---------------------------------------------------------------------------

def typed_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, sql_type, filled, total): the columns as they are stored.

    ``filled`` counts the values; ``total`` is the exact sum of a decimal column, as text with its scale.
    """
    from functools import reduce

    parts = []
    for name, df in tables.items():
        fields = df.schema.fields
        decimal = {f.name for f in fields if f.dataType.typeName() == "decimal"}
        one = df.agg(*[F.count(f.name).alias(f"n_{f.name}") for f in fields], *[F.sum(c).cast("string").alias(f"s_{c}") for c in decimal])
        each = F.array(*[F.struct(F.lit(k + 1).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("sql_type"), F.col(f"n_{f.name}").alias("filled"),
                                  (F.col(f"s_{f.name}") if f.name in decimal else F.lit(None).cast("string")).alias("total")) for k, f in enumerate(fields)])
        parts.append(one.select(F.lit(name).alias("table_name"), F.inline(each)))
    return reduce(DataFrame.unionByName, parts)


def dimension_coverage(ms: DataFrame, aff: DataFrame, sd: DataFrame, scores: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """How the dimensions' keys meet those of the market sales, both ways.

    The second pair keeps only the latest year of each side, as the scores do; a place with no sale, or a sale
    without its dimension row, would drop out of an inner join in silence.
    """
    from ..operators.referential import key_coverage

    latest = F.col("year") == F.lit(cfg.latest_year)
    pairs = [("affordability", ms, aff, ("county", "year")), ("supply_demand", ms, sd, ("county", "year")), ("investment_scores", ms, scores, ("county",)),
             ("affordability_latest", ms, aff.where(latest), ("county", "year")), ("sales_latest", ms.where(latest), aff, ("county", "year"))]
    from functools import reduce
    return reduce(DataFrame.unionByName, [key_coverage(f, d, k).select(F.lit(name).alias("dimension"), "*") for name, f, d, k in pairs])


def scores_from_file(scores: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The scores written as a CSV with dated column names, as other systems hand them over, and read back strictly."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir
    from ..sources import register, schemas
    from ..sources.sinks import write_result

    span = cfg.latest_year - cfg.base_year
    path = f"{ensure_checkpoint_dir(scores.sparkSession).rstrip('/')}/scores-{uuid4().hex}.csv"
    write_result(scores.withColumnsRenamed({"median_price_base": f"median_price_{cfg.base_year}", "median_price_latest": f"median_price_{cfg.latest_year}",
                                            "price_growth_pct": f"price_growth_{span}yr_pct"}), path)
    return schemas.for_jobs(register.read_scores_csv(scores.sparkSession, path, cfg))


# ---------------------------------------------------------------------------
# Register cleaning over text derived from the customer table (oracle-checked)
# ---------------------------------------------------------------------------

def register_text(customer: DataFrame) -> DataFrame:
    """Register-style raw text derived from every customer row.

    Each row gets one of several spellings of every column, chosen by its key,
    so every cleaning rule meets good and bad input.
    """
    from ..functions.cleaning import COUNTY_REGIONS

    k = F.col("c_custkey")
    cents = round_half_away(F.abs(F.col("c_acctbal")) * F.lit(100.0), 0).cast("bigint").cast("string")
    thousands = F.floor(round_half_away(F.abs(F.col("c_acctbal")) * F.lit(100.0), 0) / F.lit(1000)).cast("string")
    rest = F.lpad((round_half_away(F.abs(F.col("c_acctbal")) * F.lit(100.0), 0).cast("bigint") % 1000)
                  .cast("string"), 3, "0")
    pk = k % 6
    price = (F.when(pk == 0, F.concat(F.lit("€"), cents))
              .when(pk == 1, F.concat(cents, F.lit(".50")))
              .when(pk == 2, F.concat(thousands, F.lit(","), rest))
              .when(pk == 3, F.lit("n/a"))
              .when(pk == 4, F.concat(F.lit("1.2."), cents))
              .otherwise(F.concat(F.lit(" "), cents, F.lit(" "))))
    name = F.element_at(F.array(*[F.lit(n) for n in COUNTY_REGIONS]), (k % 26 + 1).cast("int"))
    ck = F.floor(k / 26) % 6
    county = (F.when(ck == 0, name)
               .when(ck == 1, F.concat(F.lit("Co. "), name))
               .when(ck == 2, F.concat(F.lit("County "), F.upper(name)))
               .when(ck == 3, F.lower(name))
               .when(ck == 4, F.concat(F.lit("Dublin "), (k % 24 + 1).cast("string")))
               .otherwise(F.concat(name, F.lit(" City"))))
    day, month, year = (k % 28 + 1).cast("string"), (k % 12 + 1).cast("string"), (k % 5 + 2020).cast("string")
    dk = F.floor(k / 7) % 5
    date = (F.when(dk == 0, F.concat_ws("/", day, month, year))
             .when(dk == 1, F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), year))
             .when(dk == 2, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))
             .when(dk == 3, F.concat(F.lit("31/02/"), year))
             .otherwise(F.lit("")))
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (k % len(v) + 1).cast("int"))
    return customer.select(k.alias("sale_id"), date.alias("date_of_sale"), county.alias("county"), price.alias("price_eur"),
                           pick("No", "N", "0", "Yes", "", None, "FALSE").alias("not_full_market_price"),
                           pick("Yes", "No", "Y", "1", "maybe", None).alias("vat_exclusive"),
                           pick("New Dwelling house /Apartment", "Second-Hand Dwelling house /Apartment").alias("property_type"),
                           pick("D15 AB12", " D6W XY00 ", "", None, "T12 X").alias("eircode"))


def register_files(customer: DataFrame) -> list[DataFrame]:
    """The register text as three yearly files whose headers and columns differ."""
    raw = register_text(customer)
    part = lambda n: raw.where(F.col("sale_id") % 3 == n)
    named = lambda df, **names: df.select(*[F.col(c).alias(h) for c, h in names.items()])
    return [named(part(0), date_of_sale="Date of Sale (dd/mm/yyyy)", county="County", price_eur="Price (\u20ac)",
                  not_full_market_price="Not Full Market Price", vat_exclusive="VAT Exclusive",
                  property_type="Description of Property", eircode="Eircode"),
            named(part(1), county="county", price_eur="Price", date_of_sale="Date of Sale",
                  not_full_market_price="not_full_market_price", property_type="property_type"),
            named(part(2), price_eur="Price (\x80)", date_of_sale="date_of_sale", county="County")]


def register_cleaning(customer: DataFrame, cfg=None) -> DataFrame:
    """The loader's own steps over those files: header aliases, cleaning, union of the years."""
    from ..config import DEFAULT
    from ..sources import register

    regions = register.regions_table(customer.sparkSession)
    return register.union_years(register.standardise(register.canonical(raw), cfg or DEFAULT, regions) for raw in register_files(customer))


# ---------------------------------------------------------------------------
# The file-level load: yearly files in several byte forms, one missing, one unusable
# ---------------------------------------------------------------------------
FILE_YEARS = (2020, 2021, 2022, 2023, 2024)


def write_register_files(customer: DataFrame, directory: str) -> None:
    """The register text as yearly files (folders of part files) below ``directory``.

    2020: all columns in windows-1252 bytes; 2021: other headers and UTF-8; 2022: three columns only; 2023 isn't
    written; 2024 lacks the place.
    """
    raw = register_text(customer)
    # byte 0x80, the currency sign of windows-1252, is what ISO-8859-1 calls \x80
    narrow = raw.withColumn("price_eur", F.replace("price_eur", F.lit("\u20ac"), F.lit("\x80")))

    def write(year: int, df: DataFrame, encoding: str, **names: str) -> None:
        (df.where(F.col("sale_id") % 4 == (year - 2020 if year < 2023 else 3)).select(*[F.col(c).alias(h) for c, h in names.items()])
           .write.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{directory}/PPR-{year}.csv"))

    write(2020, narrow, "ISO-8859-1", date_of_sale="Date of Sale (dd/mm/yyyy)", county="County", price_eur="Price (\x80)", not_full_market_price="Not Full Market Price",
          vat_exclusive="VAT Exclusive", property_type="Description of Property", eircode="Eircode")
    write(2021, raw, "UTF-8", county="county", price_eur="Price (\u20ac)", date_of_sale="Date of Sale", not_full_market_price="not_full_market_price", property_type="property_type")
    write(2022, narrow, "ISO-8859-1", price_eur="Price", date_of_sale="date_of_sale", county="County")
    write(2024, raw, "UTF-8", date_of_sale="Date of Sale", price_eur="Price")


def _files(customer: DataFrame) -> str:
    """A new folder of register files below the session's shared folder."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir

    directory = f"{ensure_checkpoint_dir(customer.sparkSession).rstrip('/')}/register-{uuid4().hex}"
    write_register_files(customer, directory)
    return directory


def register_load(customer: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The clean rows of those files, read as files."""
    from ..sources import register

    return register.read_register(customer.sparkSession, _files(customer), FILE_YEARS, cfg)


def register_manifest(customer: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """What became of each of those files and of every record in them."""
    from ..sources import register

    return register.load_manifest(customer.sparkSession, _files(customer), FILE_YEARS, cfg)
