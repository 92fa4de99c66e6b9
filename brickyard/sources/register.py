"""Raw yearly sale registers -> the canonical ``transactions`` table (P0).

One CSV per year (``PPR-<year>.csv``), headers that vary between years,
bytes in ISO-8859-1 / windows-1252 / UTF-8.  The loader is one lazy plan
with no shuffle: each year is a CSV scan with a per-file column mapping, the
years are a ``unionByName``, and the place -> region lookup (26 fixed rows)
is a broadcast join that also drops unknown places.

Only the header of each file is looked at on the driver (the schema that
Spark infers from the first line); rows never pass through the driver.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import Config, DEFAULT
from ..functions import cleaning as C
from . import schemas
from .synthetic import TX_COLUMNS

log = logging.getLogger(__name__)

REQUIRED = ("date_of_sale", "county", "price_eur")
# Spark's CSV reader accepts ISO-8859-1, US-ASCII and UTF-8/16/32 but not
# windows-1252; ISO-8859-1 decodes every byte, and the price rules accept
# every byte form of the currency sign.
ENCODING = "ISO-8859-1"


def register_path(directory: str, year: int) -> str:
    return f"{directory.rstrip('/')}/PPR-{year}.csv"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or of a folder's files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def resolve_headers(columns: Sequence[str]) -> dict[str, str]:
    """raw header -> canonical name; the first alias present wins."""
    mapping: dict[str, str] = {}
    for canon, aliases in C.HEADER_ALIASES.items():
        hit = next((a for a in aliases if a in columns), None)
        if hit is None and canon == "price_eur":
            hit = next((c for c in columns if re.match(C.PRICE_HEADER_RE, c.strip())), None)
        if hit is not None:
            mapping[hit] = canon
    return mapping


CORRUPT = "_corrupt_record"


def read_register_csv(spark: SparkSession, path: str) -> DataFrame:
    """A yearly file (or a folder of its part files) as strings, plus the text of records with too few or many fields.

    Standard CSV quoting: quotes inside a field are doubled, and quoted fields may hold commas and
    line breaks.  A file with multi-line records is one task; a year may come in part files.
    """
    reader = (spark.read.option("header", True).option("encoding", ENCODING).option("quote", '"').option("escape", '"')
              .option("multiLine", True).option("mode", "PERMISSIVE"))
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    return reader.option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)


def canonical(raw: DataFrame, name: str = "register") -> DataFrame | None:
    """A yearly table under its canonical column names, or None when a required column is missing."""
    mapping = resolve_headers(raw.columns)
    missing = [c for c in REQUIRED if c not in mapping.values()]
    if missing:
        log.warning("%s: missing required column(s) %s; skipped", name, missing)
        return None
    keep = [F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()]
    return raw.select(*keep, *([F.col(CORRUPT)] if CORRUPT in raw.columns else []))


def read_register_file(spark: SparkSession, path: str) -> DataFrame | None:
    """One yearly file as canonical *string* columns, or None when a required column is missing."""
    return canonical(read_register_csv(spark, path), path)


def regions_table(spark: SparkSession) -> DataFrame:
    rows = list(C.COUNTY_REGIONS.items())
    return spark.createDataFrame(rows, "county string, region string")


#: Why a record is left out, in the order they are looked at.
REASONS = ("malformed record", "unreadable date", "unreadable price", "no place", "price out of range", "not a full-market sale", "unknown place")


def judged(df: DataFrame, cfg: Config = DEFAULT, regions: DataFrame | None = None) -> DataFrame:
    """Canonical string columns of one year -> canonical columns and ``reject``, why a row is left out (null: kept)."""
    cols = set(df.columns)
    market = C.market_sale("not_full_market_price") if "not_full_market_price" in cols else F.lit(True)
    ptype = F.col("property_type") if "property_type" in cols else F.lit(C.UNKNOWN_TYPE)
    vat = C.yes_no("vat_exclusive") if "vat_exclusive" in cols else F.lit(None).cast("boolean")
    eir = F.trim(F.col("eircode")) if "eircode" in cols else F.lit(None).cast("string")
    broken = F.col(CORRUPT).isNotNull() if CORRUPT in cols else F.lit(False)
    typed = df.select(C.parse_sale_date("date_of_sale").alias("date_of_sale"),
                      C.clean_county("county").alias("county"),
                      C.clean_price("price_eur").alias("price_eur"),
                      ptype.cast("string").alias("property_type"),
                      F.coalesce(market, F.lit(False)).alias("__market"), broken.alias("__broken"),
                      vat.alias("vat_exclusive"),
                      F.nullif(eir, F.lit("")).alias("eircode"))
    if regions is None:
        regions = regions_table(df.sparkSession)
    d, price = F.col("date_of_sale"), F.col("price_eur")
    unread = d.isNull() | price.isNull() | F.col("county").isNull()
    tests = (F.col("__broken") & unread, d.isNull(), price.isNull(), F.col("county").isNull(),
             (price <= F.lit(cfg.min_price)) | (price >= F.lit(cfg.max_price)), ~F.col("__market"), F.col("region").isNull())
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in zip(REASONS, tests, strict=True)])
    return (typed.join(F.broadcast(regions), "county", "left")  # 26 fixed rows
                 .select("*", F.lit(False).alias("not_full_market"),
                         F.year(d).cast("int").alias("year"), F.month(d).cast("int").alias("month"),
                         C.quarter_label(d).alias("quarter"))
                 .select(*TX_COLUMNS, reason.alias("reject")))


def standardise(df: DataFrame, cfg: Config = DEFAULT, regions: DataFrame | None = None) -> DataFrame:
    """Canonical string columns of one year -> clean canonical rows (B1-B13)."""
    return judged(df, cfg, regions).where(F.col("reject").isNull()).drop("reject")


def _years_of(spark: SparkSession, directory: str, years: Iterable[int]) -> list[tuple[int, str, DataFrame | None]]:
    """(year, status, canonical strings): None for a file that isn't there or lacks a required column."""
    frames = []
    for y in years:
        path = register_path(directory, y)
        if not path_exists(spark, path):
            log.warning("%s not found; skipped", path)
            frames.append((y, "missing", None))
            continue
        raw = read_register_csv(spark, path)
        canon = canonical(raw, path)
        if canon is None:
            lacks = [c for c in REQUIRED if c not in resolve_headers(raw.columns).values()]
            frames.append((y, f"lacks {', '.join(lacks)}", None))
        else:
            frames.append((y, "read", canon))
    if not any(f is not None for _, _, f in frames):
        raise FileNotFoundError(f"no readable register files for {list(years)} in {directory}")
    return frames


def union_years(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_register(spark: SparkSession, directory: str, years: Iterable[int],
                  cfg: Config = DEFAULT) -> DataFrame:
    """All available years, cleaned and unioned; missing or malformed years are skipped."""
    regions = regions_table(spark)
    return union_years(standardise(raw, cfg, regions) for _, _, raw in _years_of(spark, directory, years) if raw is not None)


def load_manifest(spark: SparkSession, directory: str, years: Iterable[int], cfg: Config = DEFAULT) -> DataFrame:
    """One row per file: file_year, status (read, missing, lacks ...), bytes, records, kept and a column per reason.

    Every record of a file that is read is kept or counted under one reason: records = kept + the reasons.
    """
    regions, names = regions_table(spark), [r.replace(" ", "_").replace("-", "_") for r in REASONS]
    parts = []
    for y, status, raw in _years_of(spark, directory, years):
        size = None if status == "missing" else path_bytes(spark, register_path(directory, y))
        head = (F.lit(y).alias("file_year"), F.lit(status).alias("status"), F.lit(size).cast("bigint").alias("bytes"))
        if raw is None:
            parts.append(spark.range(1).select(*head, *[F.lit(None).cast("bigint").alias(c) for c in ("records", "kept", *names)]))
            continue
        reject = F.col("reject")
        parts.append(judged(raw, cfg, regions).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(reject.isNull(), F.lit(1))).alias("kept"),
                                                   *[F.count(F.when(reject == r, F.lit(1))).alias(c) for r, c in zip(REASONS, names, strict=True)])
                     .select(*head, "records", "kept", *names))
    return union_years(parts)


def register_rejects(spark: SparkSession, directory: str, years: Iterable[int], cfg: Config = DEFAULT) -> DataFrame:
    """(file_year, reject, n) of all records: the reasons why rows were left out, and null for the rows kept."""
    regions = regions_table(spark)
    return union_years(judged(raw, cfg, regions).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))
                       .select(F.lit(y).alias("file_year"), "reject", "n") for y, _, raw in _years_of(spark, directory, years) if raw is not None)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """The clean table written by ``sinks.write_clean_table`` (partition pruning on ``year``), or a clean CSV."""
    if path.rstrip("/").endswith(".csv"):
        return read_transactions_csv(spark, path)
    return spark.read.schema(schemas.TRANSACTIONS).parquet(path)


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """A clean ``transactions.csv`` (header; dates as ISO text): typed strictly, columns matched by name.

    The market flag, the VAT flag, the postcode and the calendar columns may be absent: clean tables hold
    full-market sales only, and the calendar follows from the date.
    """
    raw = (spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))
    missing = [c for c in (*REQUIRED, "region") if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing column(s) {missing}")
    types = {f.name: f for f in schemas.TRANSACTIONS.fields}
    d = _strict(types["date_of_sale"], path)
    absent = {"not_full_market": F.lit(False), "vat_exclusive": F.lit(None).cast("boolean"), "eircode": F.lit(None).cast("string"),
              "property_type": F.lit(C.UNKNOWN_TYPE), "year": F.year(d).cast("int"), "month": F.month(d).cast("int"), "quarter": C.quarter_label(d)}
    # the tables' default of both flags is FALSE; an empty VAT flag stays unknown, as the register leaves it
    flags = {"not_full_market": F.lit(False), "vat_exclusive": F.lit(None).cast("boolean")}
    return raw.select(*[(absent[c] if c not in raw.columns else _flag(c, flags[c], path) if c in flags else _strict(types[c], path)).alias(c) for c in TX_COLUMNS])


def _flag(name: str, blank: F.Column, path: str) -> F.Column:
    """A yes/no column in any of its spellings, t and f included; blanks are ``blank``, anything else fails the job."""
    text = F.upper(F.trim(F.col(name)))
    error = F.raise_error(F.concat(F.lit(f"{path}: column {name} has an unreadable value: "), F.col(name))).cast("boolean")
    return (F.when(text.isNull() | text.isin(*[m.upper() for m in MISSING]), blank).when(text.isin(*C.TRUE_EXPORT), F.lit(True))
             .when(text.isin(*C.FALSE_EXPORT), F.lit(False)).otherwise(error))


def read_dimension_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored dimension table (header CSV) read with a fixed schema, columns matched by name."""
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing column(s) {missing}")
    return raw.select(*[_strict(f, path).alias(f.name) for f in schema.fields])


#: Texts that stand for a missing value in a dimension file.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "None")


def _strict(field: T.StructField, path: str) -> F.Column:
    """The field's value; an unreadable one fails the job, as a silent NULL would move scores and ranks."""
    text = F.when(~F.trim(F.col(field.name)).isin(*MISSING), F.trim(F.col(field.name)))
    value = text.try_cast(field.dataType)
    if isinstance(field.dataType, T.IntegerType):
        # whole numbers may come as 3.0, as some writers put a column that once had gaps
        wide = text.try_cast("decimal(38,6)")
        value = F.coalesce(value, F.when(wide == F.floor(wide), wide.try_cast(field.dataType)))
    error = F.raise_error(F.concat(F.lit(f"{path}: column {field.name} has an unreadable value: "), text))
    return F.when(text.isNotNull() & value.isNull(), error.cast(field.dataType)).otherwise(value)


def read_scores_csv(spark: SparkSession, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """A stored investment_scores table; columns named after a year or a span of years are accepted too."""
    raw = spark.read.option("header", True).csv(path)
    span = cfg.latest_year - cfg.base_year
    dated = {f"median_price_{cfg.base_year}": "median_price_base", f"median_price_{cfg.latest_year}": "median_price_latest",
             f"price_growth_{span}yr_pct": "price_growth_pct"}
    raw = raw.withColumnsRenamed({a: b for a, b in dated.items() if b not in raw.columns})
    missing = [f.name for f in schemas.INVESTMENT_SCORES.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing column(s) {missing}")
    return raw.select(*[_strict(f, path).alias(f.name) for f in schemas.INVESTMENT_SCORES.fields])
