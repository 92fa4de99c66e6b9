"""Canonical tables derived from the driver's TPC-H-style tables.

The driver's tables hold no houses, so the four canonical tables of the
property model are derived from them (SURVEY §7.3).  Each derivation has a
Spark form (lazy DataFrames, used by the jobs) and the same rules as SQL
text (CTEs, used by the DuckDB oracle).

| canonical        | derived from                                                   |
|------------------|----------------------------------------------------------------|
| sale             | one order                                                      |
| county / region  | nation / region name of the ordering customer                  |
| price_eur        | o_totalprice, kept when min_price < p < max_price               |
| date_of_sale     | o_orderdate as a date                                          |
| not_full_market  | o_orderpriority = '4-NOT SPECIFIED'                            |
| new build        | o_orderstatus = 'F' (vat_exclusive, property_type)             |
| property kind    | o_orderkey % 4 (property_type)                                 |
| eircode          | 'D' + 2-digit (o_custkey % 24 + 1) + ' X', 24th code 'D6W X'    |

Scale notes: the order -> customer join is the only large join (a
sort-merge join on the customer key, both sides big at scale).  The place
dimension (nation x region) has a fixed cardinality (25 x 5 rows by the
TPC-H specification) and is broadcast; it never grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config, DEFAULT
from ..functions.numeric import round_half_away, safe_div, sql_round

# ---------------------------------------------------------------------------
# Property-type texts of the register, used for synthetic rows.
NEW_TYPE_TEXT = "New "
SECOND_TYPE_TEXT = "Second-Hand "
# Most texts name both kinds; some sources tell them apart (by sale key modulo 4).
KIND_TEXTS = ("Dwelling house /Apartment", "Apartment", "Dwelling house", "Dwelling house /Apartment")
# ---------------------------------------------------------------------------
NOT_FULL_PRIORITY = "4-NOT SPECIFIED"
NEW_STATUS = "F"
WAGE_BASE, WAGE_PER_PLACE, WAGE_PER_YEAR, WAGE_YEAR0 = 15000, 1500, 500, 1995
RENT_YIELD_BASE, RENT_YIELD_PER_PLACE = 0.04, 0.001   # gross yield 4.0 % .. 6.4 % by place
POPULATION_PER_CUSTOMER = 1000
COMPLETIONS_BASE_PCT, COMPLETIONS_PER_PLACE = 20, 3

TX_COLUMNS = ["date_of_sale", "county", "region", "price_eur", "property_type", "not_full_market",
              "vat_exclusive", "year", "month", "quarter", "eircode"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """county (nation) -> region lookup with the place key; 25 rows."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("n_nationkey").alias("place_key"), F.col("n_name").alias("county"),
                     F.col("r_name").alias("region")))


def sales(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """One row per sale with the canonical columns plus ``sale_key`` and ``place_key``."""
    o = (_read(spark, sf_dir, "orders")
         .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
         .where((F.col("o_totalprice") > F.lit(cfg.min_price)) & (F.col("o_totalprice") < F.lit(cfg.max_price))))
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    cust = c.join(F.broadcast(places(spark, sf_dir)), c.c_nationkey == F.col("place_key"))
    j = o.join(cust, o.o_custkey == cust.c_custkey)
    d = F.col("o_orderdate").cast("date")
    is_new = F.col("o_orderstatus") == F.lit(NEW_STATUS)
    code = F.col("o_custkey") % 24
    eircode = (F.when(code == 23, F.lit("D6W X"))
                .otherwise(F.concat(F.lit("D"), F.lpad((code + 1).cast("string"), 2, "0"), F.lit(" X"))))
    return j.select(
        F.col("o_orderkey").alias("sale_key"),
        F.col("place_key"),
        d.alias("date_of_sale"),
        F.col("county"),
        F.col("region"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price_eur"),
        F.concat(F.when(is_new, F.lit(NEW_TYPE_TEXT)).otherwise(F.lit(SECOND_TYPE_TEXT)),
                 F.get(F.array(*map(F.lit, KIND_TEXTS)), (F.col("o_orderkey") % 4).cast("int"))).alias("property_type"),
        (F.col("o_orderpriority") == F.lit(NOT_FULL_PRIORITY)).alias("not_full_market"),
        is_new.alias("vat_exclusive"),
        F.year(d).cast("int").alias("year"),
        F.month(d).cast("int").alias("month"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter"),
        eircode.alias("eircode"))


def transactions(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """The canonical ``transactions`` table (loader output form, SURVEY §1.2)."""
    return sales(spark, sf_dir, cfg).select(*TX_COLUMNS)


def market_sales(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT, keep_keys: bool = False) -> DataFrame:
    """Transactions at full market price (``not_full_market = FALSE``), the input of every job."""
    s = sales(spark, sf_dir, cfg).where(~F.col("not_full_market"))
    return s if keep_keys else s.select(*TX_COLUMNS)


def affordability(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """affordability(county, region, year, median_price, avg_annual_wage, years_salary_to_buy,
    monthly_rent_estimate, price_to_income_ratio, population)."""
    from ..plans.market import place_year_profile
    prof = place_year_profile(market_sales(spark, sf_dir, cfg), cfg)
    return affordability_from(prof, places(spark, sf_dir), _read(spark, sf_dir, "customer"))


def affordability_from(prof: DataFrame, place_dim: DataFrame, customer: DataFrame) -> DataFrame:
    """The affordability dimension from the place-year price profile (its median) and the
    place dimension (25 rows: the place key drives wage and rent)."""
    pop = (customer.groupBy("c_nationkey")
           .agg((F.count(F.lit(1)) * POPULATION_PER_CUSTOMER).alias("population")))
    median = round_half_away(F.col("median"), 0)
    wage = (F.lit(WAGE_BASE) + F.lit(WAGE_PER_PLACE) * F.col("place_key")
            + F.lit(WAGE_PER_YEAR) * (F.col("year") - F.lit(WAGE_YEAR0))).cast("double")
    keyed = prof.join(F.broadcast(place_dim.select("county", "place_key")), "county")
    a = keyed.select("county", "region", "place_key", "year", median.alias("median_price"),
                     wage.alias("avg_annual_wage"))
    rent_yield = F.lit(RENT_YIELD_BASE) + F.lit(RENT_YIELD_PER_PLACE) * F.col("place_key")
    return (a.join(pop, a.place_key == pop.c_nationkey, "left")
             .select("county", "region", "year", "median_price", "avg_annual_wage",
                     round_half_away(safe_div("median_price", "avg_annual_wage"), 1).alias("years_salary_to_buy"),
                     round_half_away(F.col("median_price") * rent_yield / F.lit(12.0), 0)
                     .alias("monthly_rent_estimate"),
                     round_half_away(safe_div("median_price", "avg_annual_wage"), 2).alias("price_to_income_ratio"),
                     F.col("population").cast("bigint").alias("population")))


def supply_demand(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    """supply_demand(county, region, year, new_completions, estimated_demand, supply_deficit,
    supply_ratio, supply_deficit_pct)."""
    return supply_demand_from(market_sales(spark, sf_dir, cfg, keep_keys=True))


def supply_demand_from(keyed_ms: DataFrame) -> DataFrame:
    """The supply dimension from market sales that carry ``sale_key`` and ``place_key``."""
    done = (F.col("sale_key") % 100) < (F.lit(COMPLETIONS_BASE_PCT) + F.lit(COMPLETIONS_PER_PLACE) * F.col("place_key"))
    g = keyed_ms.groupBy("county", "region", "year").agg(
        F.count_if(done).cast("bigint").alias("new_completions"),
        F.count(F.lit(1)).alias("estimated_demand"))
    deficit = F.col("estimated_demand") - F.col("new_completions")
    return g.select("county", "region", "year", "new_completions", "estimated_demand",
                    deficit.alias("supply_deficit"),
                    round_half_away(safe_div(F.col("new_completions").cast("double"), "estimated_demand"), 3)
                    .alias("supply_ratio"),
                    round_half_away(safe_div(deficit.cast("double"), "estimated_demand") * F.lit(100.0), 1)
                    .alias("supply_deficit_pct"))


# ---------------------------------------------------------------------------
# The same derivations as SQL CTEs (DuckDB oracle).
# ---------------------------------------------------------------------------

def sql_ctes(cfg: Config = DEFAULT) -> dict[str, str]:
    """name -> CTE body.  ``tx`` = sales with keys, ``ms`` = market sales, ``aff``, ``sd``."""
    r1 = lambda e: sql_round(e, 1)
    kinds = ", ".join(f"'{k}'" for k in KIND_TEXTS)
    tx = f"""
    SELECT o.o_orderkey AS sale_key, n.n_nationkey AS place_key,
           CAST(o.o_orderdate AS DATE) AS date_of_sale, n.n_name AS county, r.r_name AS region,
           CAST(o.o_totalprice AS DECIMAL(12,2)) AS price_eur,
           CASE WHEN o.o_orderstatus = '{NEW_STATUS}' THEN '{NEW_TYPE_TEXT}' ELSE '{SECOND_TYPE_TEXT}' END
             || [{kinds}][o.o_orderkey % 4 + 1] AS property_type,
           o.o_orderpriority = '{NOT_FULL_PRIORITY}' AS not_full_market,
           o.o_orderstatus = '{NEW_STATUS}' AS vat_exclusive,
           CAST(year(o.o_orderdate) AS INTEGER) AS year,
           CAST(month(o.o_orderdate) AS INTEGER) AS month,
           'Q' || CAST(quarter(o.o_orderdate) AS VARCHAR) AS quarter,
           CASE WHEN o.o_custkey % 24 = 23 THEN 'D6W X'
                ELSE 'D' || lpad(CAST(o.o_custkey % 24 + 1 AS VARCHAR), 2, '0') || ' X' END AS eircode
    FROM orders o
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey
    WHERE o.o_totalprice > {cfg.min_price} AND o.o_totalprice < {cfg.max_price}"""
    ms = "SELECT * FROM tx WHERE NOT not_full_market"
    wage = (f"CAST({WAGE_BASE} + {WAGE_PER_PLACE} * place_key + {WAGE_PER_YEAR} * (year - {WAGE_YEAR0})"
            f" AS DOUBLE)")
    aff = f"""
    SELECT a.county, a.region, a.year, a.median_price, a.avg_annual_wage,
           {r1('a.median_price / nullif(a.avg_annual_wage, 0)')} AS years_salary_to_buy,
           {sql_round(f'a.median_price * (CAST({RENT_YIELD_BASE} AS DOUBLE) + CAST({RENT_YIELD_PER_PLACE} AS DOUBLE) * a.place_key) / 12.0', 0)}
             AS monthly_rent_estimate,
           {sql_round('a.median_price / nullif(a.avg_annual_wage, 0)', 2)} AS price_to_income_ratio,
           CAST(p.population AS BIGINT) AS population
    FROM (SELECT county, region, place_key, year,
                 {sql_round('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)', 0)} AS median_price,
                 {wage} AS avg_annual_wage
          FROM ms GROUP BY county, region, place_key, year) a
    LEFT JOIN (SELECT c_nationkey, count(*) * {POPULATION_PER_CUSTOMER} AS population
               FROM customer GROUP BY c_nationkey) p ON a.place_key = p.c_nationkey"""
    sd = f"""
    SELECT county, region, year, new_completions, estimated_demand,
           estimated_demand - new_completions AS supply_deficit,
           {sql_round('CAST(new_completions AS DOUBLE) / nullif(estimated_demand, 0)', 3)} AS supply_ratio,
           {r1('CAST(estimated_demand - new_completions AS DOUBLE) / nullif(estimated_demand, 0) * 100.0')}
             AS supply_deficit_pct
    FROM (SELECT county, region, year,
                 CAST(count(*) FILTER (WHERE sale_key % 100 < {COMPLETIONS_BASE_PCT} + {COMPLETIONS_PER_PLACE} * place_key)
                      AS BIGINT) AS new_completions,
                 count(*) AS estimated_demand
          FROM ms GROUP BY county, region, year) g"""
    return {"tx": tx, "ms": ms, "aff": aff, "sd": sd}


def sql_with(cfg: Config, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """A ``WITH`` clause holding the named canonical CTEs (dependencies first) and extra CTEs."""
    ctes = sql_ctes(cfg)
    order = ["tx", "ms", "aff", "sd"]
    deps = {"tx": [], "ms": ["tx"], "aff": ["ms"], "sd": ["ms"]}
    want: set[str] = set()

    def add(n):
        if n in want:
            return
        for d in deps[n]:
            add(d)
        want.add(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({ctes[n]})" for n in order if n in want]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n"
