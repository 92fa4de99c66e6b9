"""The four tables at rest: money and rates are exact decimals, counts whole numbers.

Tables are stored and offered to SQL in these types.  Jobs that compute ratios and scores read the dimensions
in doubles (``for_jobs``), which are the nearest ones to the stored decimals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, types as T


PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "date": T.DateType(), "boolean": T.BooleanType()}


def _schema(**columns: str) -> T.StructType:
    def kind(text: str) -> T.DataType:
        return PLAIN[text] if text in PLAIN else T.DecimalType(*map(int, re.findall(r"\d+", text)))
    return T.StructType([T.StructField(name, kind(text)) for name, text in columns.items()])


TRANSACTIONS = _schema(date_of_sale="date", county="string", region="string", price_eur="decimal(12,2)", property_type="string", not_full_market="boolean",
                       vat_exclusive="boolean", year="int", month="int", quarter="string", eircode="string")
AFFORDABILITY = _schema(county="string", region="string", year="int", median_price="decimal(12,2)", avg_annual_wage="decimal(10,2)",
                        years_salary_to_buy="decimal(5,1)", monthly_rent_estimate="decimal(10,2)", price_to_income_ratio="decimal(5,2)", population="int")
SUPPLY_DEMAND = _schema(county="string", region="string", year="int", new_completions="int", estimated_demand="int", supply_deficit="int",
                        supply_ratio="decimal(5,3)", supply_deficit_pct="decimal(5,1)")
INVESTMENT_SCORES = _schema(county="string", region="string", median_price_base="decimal(12,2)", median_price_latest="decimal(12,2)", price_growth_pct="decimal(5,1)",
                            rental_yield_est_pct="decimal(5,2)", years_salary_to_buy="decimal(5,1)", supply_deficit_pct="decimal(5,1)", growth_score="decimal(5,1)",
                            supply_score="decimal(5,1)", yield_score="decimal(5,1)", affordability_score="decimal(5,1)", composite_investment_score="decimal(5,1)",
                            investment_tier="string", rank="int")
TABLES = {"transactions": TRANSACTIONS, "affordability": AFFORDABILITY, "supply_demand": SUPPLY_DEMAND, "investment_scores": INVESTMENT_SCORES}
#: Whole numbers that jobs read as they are.
PERIODS = ("year", "month", "rank")


def at_rest(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its types.  A value that doesn't fit fails the job instead of becoming another one."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def for_jobs(df: DataFrame) -> DataFrame:
    """Decimals as doubles, counts as long."""
    def loose(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        return F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, T.IntegerType) and f.name not in PERIODS else F.col(f.name)
    return df.select(*[loose(f) for f in df.schema.fields])
