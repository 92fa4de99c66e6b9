"""DuckDB oracle: each job as ANSI SQL over the driver tables.

Written independently of the DataFrame code, as SQL a reader can check
against the reference's SQL layer: thresholds, labels, weights, patterns and
lookups stand here as literals, so a wrong constant on either side shows.
Shared are the job parameters (``Config``) and the canonical CTEs
(``sources.synthetic.sql_ctes``).  Doubles are rounded half away from zero on
the binary value; what is exact in decimals is computed in DECIMAL with native
ROUND.  Column names and types match the DataFrame results (counts BIGINT,
years INTEGER, ranks INTEGER).
"""

from __future__ import annotations

from ..config import Config, TEST
from ..sources.synthetic import sql_with


def R(e: str, n: int = 0) -> str:
    """Half away from zero on a double."""
    return f"(CASE WHEN ({e}) < 0 THEN -1.0 WHEN ({e}) = 0 THEN 0.0 ELSE 1.0 END * floor(abs({e}) * 1e{n} + 0.5) / 1e{n} + 0.0)"


def RI(e: str) -> str:
    return f"CAST({R(e)} AS BIGINT)"


def CASE(e: str, op: str, *bands: tuple[float, str], default: str, missing: str | None = None) -> str:
    """CASE WHEN e op limit THEN label ... ELSE default END."""
    null = f"WHEN ({e}) IS NULL THEN '{missing}' " if missing else ""
    return "CASE " + null + " ".join(f"WHEN ({e}) {op} {limit} THEN '{label}'" for limit, label in bands) + f" ELSE '{default}' END"


def D(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def PCT(cur: str, prev: str) -> str:
    """(cur - prev) / prev * 100 (the form the jobs use for SQL-derived growth)."""
    return f"(({cur}) - ({prev})) / nullif({prev}, 0) * 100.0"


def MOM(cur: str, prev: str) -> str:
    """(cur / prev - 1) * 100 (pandas pct_change form)."""
    return f"(({cur}) / nullif({prev}, 0) - 1.0) * 100.0"


def MEAN_R(col: str, n: int) -> str:
    """Exact mean of values rounded to n decimals: integer sum, one division."""
    s = f"1e{n}"
    return f"(CAST(sum({RI(f'{col} * {s}')}) AS BIGINT) / count({col}) / {s})"


def TRUNC_RANK(col: str, partition: str = "") -> str:
    p = f"PARTITION BY {partition} " if partition else ""
    pt = f"PARTITION BY {partition}, {col}" if partition else f"PARTITION BY {col}"
    return (f"CASE WHEN {col} IS NOT NULL THEN CAST(floor(rank() OVER ({p}ORDER BY {col} DESC NULLS LAST)"
            f" + (count(*) OVER ({pt}) - 1) / 2.0) AS INTEGER) END")


def MONTH_NAME(col: str) -> str:
    return f"strftime(make_date(2000, {col}, 1), '%b')"


def W(part: str, order: str, frame: str = "") -> str:
    return f"(PARTITION BY {part} ORDER BY {order}{(' ' + frame) if frame else ''})"


POSTCODE_RE = r"'^D(\d{1,2})(W?)'"
POSTCODE = (f"CASE WHEN regexp_extract(eircode, {POSTCODE_RE}, 1) <> '' THEN 'D' || "
            f"lpad(regexp_extract(eircode, {POSTCODE_RE}, 1), 2, '0') || regexp_extract(eircode, {POSTCODE_RE}, 2) END")


ZONE = """CASE WHEN postcode IN ('D01', 'D02', 'D03', 'D04', 'D05', 'D06', 'D06W', 'D07', 'D08') THEN 'Inner City'
 WHEN postcode IN ('D09', 'D10', 'D11', 'D12', 'D13', 'D14', 'D16') THEN 'Mid City'
 WHEN postcode IN ('D15', 'D17', 'D18', 'D20', 'D22', 'D24') THEN 'Outer City' ELSE 'Commuter' END"""


def _minmax(col: str, inverted: bool = False) -> str:
    num = f"(max({col}) OVER () - {col})" if inverted else f"({col} - min({col}) OVER ())"
    return R(f"{num} / nullif(max({col}) OVER () - min({col}) OVER (), 0) * 100.0", 1)


def _inv_cte(cfg: Config) -> str:
    b, l_ = cfg.base_year, cfg.latest_year
    comp = R("growth_score * 3e-1 + supply_score * 3e-1 + yield_score * 25e-2 + affordability_score * 15e-2", 1)
    tiers = CASE("composite_investment_score", ">=", *cfg.tier_cutoffs, default=cfg.tier_default)
    return f"""
    SELECT *, {tiers} AS investment_tier,
           CAST(rank() OVER (ORDER BY composite_investment_score DESC NULLS FIRST) AS INTEGER) AS rank
    FROM (SELECT *, {comp} AS composite_investment_score
          FROM (SELECT county, region, median_price_base, median_price_latest, price_growth_pct, rental_yield_est_pct,
                       years_salary_to_buy, supply_deficit_pct,
                       {_minmax('price_growth_pct')} AS growth_score,
                       {_minmax('supply_deficit_pct')} AS supply_score,
                       {_minmax('rental_yield_est_pct')} AS yield_score,
                       {_minmax('years_salary_to_buy', True)} AS affordability_score
                FROM (SELECT a.county, a.region, a.median_price_base, a.median_price_latest,
                             {R(PCT('a.median_price_latest', 'a.median_price_base'), 1)} AS price_growth_pct,
                             {R('a.rent * 12.0 / nullif(a.median_price_latest, 0) * 100.0', 2)} AS rental_yield_est_pct,
                             a.years_salary_to_buy, s.supply_deficit_pct
                      FROM (SELECT county, region,
                                   max(CASE WHEN year = {b} THEN median_price END) AS median_price_base,
                                   max(CASE WHEN year = {l_} THEN median_price END) AS median_price_latest,
                                   max(CASE WHEN year = {l_} THEN monthly_rent_estimate END) AS rent,
                                   max(CASE WHEN year = {l_} THEN years_salary_to_buy END) AS years_salary_to_buy
                            FROM aff GROUP BY county, region) a
                      LEFT JOIN (SELECT county, supply_deficit_pct FROM sd WHERE year = {l_}) s
                        ON a.county = s.county) x) y) z"""


def _pulse_value_cte(cfg: Config) -> str:
    return f"""
    SELECT county, region, year, n AS transactions, {RI('median')} AS median_price, {RI('mean')} AS avg_price,
           {RI('p25')} AS p25, {RI('p75')} AS p75,
           {R(MOM('median', f'lag(median) OVER {W("county", "year")}'), 1)} AS yoy_growth_pct,
           {R(PCT('median', f'max(CASE WHEN year = {cfg.base_year} THEN median END) OVER (PARTITION BY county)'), 1)}
             AS growth_since_base_pct,
           {R('total / 1e9', 3)} AS total_value_bn
    FROM (SELECT county, region, year, count(*) AS n, avg(price_eur) AS mean, sum(price_eur) AS total,
                 quantile_cont(CAST(price_eur AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median,
                 quantile_cont(CAST(price_eur AS DOUBLE), 0.75) AS p75
          FROM ms GROUP BY county, region, year) g"""


def _velocity_cte() -> str:
    return f"""
    SELECT *, lag(vol_yoy_pct) OVER {W('county', 'year')} AS prev_vol_yoy_pct
    FROM (SELECT county, year, volume, {R(MOM('volume', f'lag(volume) OVER {W("county", "year")}'), 1)} AS vol_yoy_pct
          FROM (SELECT county, year, count(*) AS volume FROM ms GROUP BY county, year) g) v"""


def _monthly_cte() -> str:
    w = W("county", "sale_month")
    w6 = W("county", "sale_month", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW")
    w3 = W("county", "sale_month", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")
    return f"""
    SELECT county, region, sale_month, {RI('median')} AS median_price, n AS transactions,
           {R(MOM('median', f'lag(median) OVER {w}'), 2)} AS mom_pct,
           {RI(f'CASE WHEN count(median) OVER {w6} >= 3 THEN avg(median) OVER {w6} END')} AS rolling_6m_avg,
           {R(MOM('median', f'lag(median, 3) OVER {w}'), 1)} AS momentum_3m,
           {R(MOM('median', f'lag(median, 6) OVER {w}'), 1)} AS momentum_6m,
           {RI(f'CASE WHEN count(n) OVER {w3} >= 2 THEN avg(n) OVER {w3} END')} AS vol_rolling_3m
    FROM (SELECT county, region, CAST(date_trunc('month', date_of_sale) AS DATE) AS sale_month,
                 count(*) AS n, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median
          FROM ms GROUP BY county, region, CAST(date_trunc('month', date_of_sale) AS DATE)) g"""


def _signals_cte() -> str:
    sig = CASE("momentum_3m", ">", (3, "Strong Acceleration"), (1, "Accelerating"), (-1, "Flat"), (-3, "Decelerating"),
               default="Sharp Decline", missing="Insufficient Data")
    return f"""
    SELECT *, {sig} AS signal FROM mm WHERE sale_month = (SELECT max(sale_month) FROM mm)"""


def _by_type_cte() -> str:
    lab = (f"CASE WHEN upper(CAST(vat_exclusive AS VARCHAR)) IN ('YES', 'TRUE', '1') "
           f"THEN 'New Build' ELSE 'Second-Hand' END")
    return f"""
    SELECT county, region, year, type_label, count(*) AS transactions,
           {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median_price
    FROM (SELECT *, {lab} AS type_label FROM ms) t
    GROUP BY county, region, year, type_label"""


def _nvs_cte() -> str:
    pct = R("(new_build_median - second_hand_median) / nullif(second_hand_median, 0) * 100.0", 1)
    sig = CASE("new_build_premium_pct", ">", (20, "High Premium"), (10, "Moderate Premium"), (0, "Low Premium / At Parity"),
               default="Second-Hand Premium", missing="Insufficient Data")
    return f"""
    SELECT *, {sig} AS premium_signal FROM (
      SELECT county, region, year, new_build_median, second_hand_median,
             new_build_median - second_hand_median AS new_build_premium_eur, {pct} AS new_build_premium_pct
      FROM (SELECT county, region, year,
                   max(CASE WHEN type_label = 'New Build' THEN median_price END) AS new_build_median,
                   max(CASE WHEN type_label = 'Second-Hand' THEN median_price END) AS second_hand_median
            FROM bt GROUP BY county, region, year) p
      WHERE new_build_median IS NOT NULL AND second_hand_median IS NOT NULL) q"""


def _postcode_cte(cfg: Config) -> str:
    return f"""
    SELECT postcode, zone, year, n AS transactions, {RI('median')} AS median_price, {RI('mean')} AS avg_price,
           {R(MOM('median', f'lag(median) OVER {W("postcode", "year")}'), 1)} AS yoy_growth_pct
    FROM (SELECT postcode, {ZONE} AS zone, year, count(*) AS n,
                 quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median, avg(price_eur) AS mean
          FROM (SELECT *, {POSTCODE} AS postcode FROM ms WHERE county = '{cfg.focus_place}') d
          WHERE postcode IS NOT NULL
          GROUP BY postcode, year) g
    WHERE n >= {cfg.postcode_min_sales}"""


def _snapshot_cte(cfg: Config) -> str:
    return f"""
    SELECT *, {TRUNC_RANK('median_price')} AS price_rank FROM pc WHERE year = {cfg.latest_year}"""


def _stress_cte(cfg: Config) -> str:
    ltv = D(1.0 - cfg.deposit_pct)
    max_mort = RI(f"a.avg_annual_wage * {D(cfg.lti_limit)}")
    max_price = RI(f"{max_mort} / {ltv}")
    deposit = RI(f"m.median * {D(cfg.deposit_pct)}")
    gap = R(f"m.median - {max_price}", 0)
    gap_pct = R(f"{gap} / nullif(m.median, 0) * 100.0", 1)
    # monthly repayment per unit borrowed, r (1 + r)^n / ((1 + r)^n - 1)
    grown = f"pow(1.0 + {D(cfg.stress_rate)} / 12.0, {cfg.term_years * 12})"
    repay = RI(f"{max_mort} * ({D(cfg.stress_rate)} / 12.0 * {grown} / ({grown} - 1.0))")
    status = CASE(gap_pct, ">", (20, "Cannot Afford — Major Gap"), (5, "Stretched — Borderline"), (0, "Achievable with Exemption"),
                  default="Within LTI Limit")
    return f"""
    SELECT m.county, m.year, {RI('m.median')} AS median_price, a.avg_annual_wage, a.population,
           {deposit} AS deposit_needed,
           {R(f'{deposit} / nullif(a.avg_annual_wage * {D(cfg.savings_rate)}, 0)', 1)} AS years_to_deposit,
           {max_mort} AS max_mortgage, {max_price} AS max_affordable_price,
           {gap} AS affordability_gap, {gap_pct} AS gap_pct,
           {repay} AS stressed_monthly_repayment,
           {R(f'{repay} / nullif(a.avg_annual_wage / 12.0, 0) * 100.0', 1)} AS repayment_to_income_pct,
           {status} AS ftb_status
    FROM (SELECT county, year, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median FROM ms GROUP BY county, year) m
    JOIN aff a ON m.county = a.county AND m.year = a.year"""


def _ranking_cte(cfg: Config) -> str:
    st = CASE("years_salary_to_buy", ">=", (12, "Severe Crisis"), (9, "Critical"), (7, "High Stress"), (5, "Moderate"), default="Manageable")
    base = f"max(CASE WHEN year = {cfg.base_year} THEN years_salary_to_buy END) OVER (PARTITION BY county)"
    return f"""
    SELECT county, region, year, median_price, avg_annual_wage, years_salary_to_buy, price_to_income_ratio,
           monthly_rent_estimate, {st} AS affordability_status,
           {R(f'years_salary_to_buy - {base}', 1)} AS deterioration_vs_base,
           CAST(rank() OVER (PARTITION BY year ORDER BY years_salary_to_buy DESC NULLS FIRST) AS INTEGER)
             AS unaffordability_rank
    FROM aff"""


def _heat_cte(cfg: Config) -> str:
    heat = R("price_score * 3e-1 + growth_score * 3e-1 + volume_score * 25e-2 + vol_growth_score * 15e-2", 1)
    temp = CASE("heat_index", ">=", (70, "🔥 Very Hot"), (55, "🌡 Hot"), (40, "😐 Warm"), (25, "❄ Cool"), default="🧊 Cold")
    return f"""
    SELECT *, {temp} AS market_temperature,
           CAST(row_number() OVER (ORDER BY heat_index DESC NULLS LAST, county) AS INTEGER) AS rank
    FROM (SELECT *, {heat} AS heat_index
          FROM (SELECT county, region, median_price, yoy_growth_pct, transactions, vol_yoy_pct,
                       {_minmax('median_price')} AS price_score,
                       {_minmax('coalesce(yoy_growth_pct, 0.0)')} AS growth_score,
                       {_minmax('transactions')} AS volume_score,
                       {_minmax('coalesce(vol_yoy_pct, 0.0)')} AS vol_growth_score
                FROM (SELECT m.county, m.region, m.median_price, m.yoy_growth_pct, m.transactions, v.vol_yoy_pct
                      FROM (SELECT * FROM mpv WHERE year = {cfg.latest_year}) m
                      LEFT JOIN (SELECT county, vol_yoy_pct FROM vel WHERE year = {cfg.latest_year}) v
                        ON m.county = v.county) j) s) h"""


#: The register's places by region (fixed values).
PLACES = {
    "Leinster": ("Dublin", "Kildare", "Meath", "Wicklow", "Wexford", "Kilkenny", "Carlow", "Laois", "Offaly", "Westmeath", "Longford", "Louth"),
    "Munster": ("Cork", "Limerick", "Waterford", "Tipperary", "Clare", "Kerry"),
    "Connacht": ("Galway", "Mayo", "Roscommon", "Sligo", "Leitrim"),
    "Ulster": ("Donegal", "Cavan", "Monaghan"),
}


def _register_ctes(cfg: Config, files: int) -> str:
    """The register text of every customer, dealt into files, read by the cleaning rules (c4)."""
    names = ", ".join(f"'{n}'" for places in PLACES.values() for n in places)
    variants = (" ".join(f"WHEN '{n} {v}' THEN '{n}'" for n in ("Cork", "Galway", "Limerick", "Waterford") for v in ("City", "County"))
                + " WHEN 'Tipperary North' THEN 'Tipperary' WHEN 'Tipperary South' THEN 'Tipperary'")
    cents = RI("abs(c_acctbal) * 100.0")
    initcap = "array_to_string(list_transform(string_split(lower(s3), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"""
    WITH b AS (
      SELECT c_custkey AS k, CAST({cents} AS VARCHAR) AS cents,
             CAST(CAST(floor({R('abs(c_acctbal) * 100.0')} / 1000) AS BIGINT) AS VARCHAR) AS thousands,
             lpad(CAST({cents} % 1000 AS VARCHAR), 3, '0') AS rest,
             [{names}][c_custkey % 26 + 1] AS name,
             CAST(c_custkey % 28 + 1 AS VARCHAR) AS d, CAST(c_custkey % 12 + 1 AS VARCHAR) AS m,
             CAST(c_custkey % 5 + 2020 AS VARCHAR) AS y
      FROM customer),
    raw AS (
      SELECT k, k % {files} AS file,
             ['No', 'N', '0', 'Yes', '', NULL, 'FALSE'][k % 7 + 1] AS market_text,
             ['Yes', 'No', 'Y', '1', 'maybe', NULL][k % 6 + 1] AS vat_text,
             ['New Dwelling house /Apartment', 'Second-Hand Dwelling house /Apartment'][k % 2 + 1] AS type_text,
             ['D15 AB12', ' D6W XY00 ', '', NULL, 'T12 X'][k % 5 + 1] AS eir_text,
             CASE k % 6 WHEN 0 THEN '€' || cents WHEN 1 THEN cents || '.50'
                        WHEN 2 THEN thousands || ',' || rest WHEN 3 THEN 'n/a'
                        WHEN 4 THEN '1.2.' || cents ELSE ' ' || cents || ' ' END AS price_text,
             CASE CAST(floor(k / 26) AS BIGINT) % 6 WHEN 0 THEN name WHEN 1 THEN 'Co. ' || name
                        WHEN 2 THEN 'County ' || upper(name) WHEN 3 THEN lower(name)
                        WHEN 4 THEN 'Dublin ' || CAST(k % 24 + 1 AS VARCHAR) ELSE name || ' City' END AS county_text,
             CASE CAST(floor(k / 7) AS BIGINT) % 5 WHEN 0 THEN concat_ws('/', d, m, y)
                        WHEN 1 THEN concat_ws('/', lpad(d, 2, '0'), lpad(m, 2, '0'), y)
                        WHEN 2 THEN concat_ws('-', y, lpad(m, 2, '0'), lpad(d, 2, '0'))
                        WHEN 3 THEN '31/02/' || y ELSE '' END AS date_text
      FROM b),
    c1 AS (
      SELECT *,
             coalesce(CAST(try_strptime(trim(date_text), '%d/%m/%Y') AS DATE),
                      CAST(try_strptime(trim(date_text), '%Y-%m-%d') AS DATE)) AS date_of_sale,
             CASE WHEN regexp_full_match(trim(price_text), '[^0-9A-Za-z-]*-?[0-9,]+([.][0-9]+)?')
                  THEN TRY_CAST(regexp_replace(trim(price_text), '[^0-9.\\-]', '', 'g') AS DECIMAL(12,2)) END AS price_eur,
             regexp_replace(trim(county_text), '(?i)^co(unty\\s+|\\.\\s*|\\s+)', '') AS s2
      FROM raw),
    c2 AS (SELECT *, CASE WHEN regexp_matches(s2, '(?i)^dublin\\s*\\d') THEN 'Dublin' ELSE s2 END AS s3 FROM c1),
    c3 AS (SELECT *, trim({initcap}) AS s4 FROM c2),
    c4 AS (SELECT *,
                  CASE WHEN s4 <> '' THEN CASE s4 {variants} ELSE s4 END END AS county FROM c3)"""


def _regions() -> str:
    return ", ".join(f"('{n}', '{region}')" for region, places in PLACES.items() for n in places)


def _register_rows(cfg: Config, files: int, used: str, typed: str, vat: str, eircode: str, market: str, blank: str = "market_text") -> str:
    """Clean rows: which files have a type, a VAT flag, a postcode and a market flag is given as conditions."""
    return _register_ctes(cfg, files) + f"""
    SELECT c.date_of_sale, c.county, r.region, CAST(c.price_eur AS DOUBLE) AS price_eur,
           CASE WHEN {typed} THEN type_text ELSE 'Unknown' END AS property_type, FALSE AS not_full_market,
           CASE WHEN NOT ({vat}) THEN NULL WHEN upper(vat_text) IN ('YES', 'Y', 'TRUE', '1') THEN TRUE
                WHEN upper(vat_text) IN ('NO', 'N', 'FALSE', '0') THEN FALSE END AS vat_exclusive,
           CAST(year(c.date_of_sale) AS INTEGER) AS year, CAST(month(c.date_of_sale) AS INTEGER) AS month,
           'Q' || CAST(quarter(c.date_of_sale) AS VARCHAR) AS quarter,
           CASE WHEN {eircode} AND trim(eir_text) <> '' THEN trim(eir_text) END AS eircode
    FROM c4 c JOIN (VALUES {_regions()}) r(county, region) ON c.county = r.county
    WHERE ({used}) AND c.date_of_sale IS NOT NULL AND c.price_eur IS NOT NULL
      AND c.price_eur > {cfg.min_price} AND c.price_eur < {cfg.max_price}
      AND (NOT ({market}) OR upper(trim({blank})) IN ('NO', 'N', 'FALSE', '0', ''))"""


def _register_manifest_sql(cfg: Config) -> str:
    ok = "(file > 1 OR coalesce(upper(trim(nullif(market_text, ''))) IN ('NO', 'N', 'FALSE', '0', ''), FALSE))"
    why = (f"CASE WHEN date_of_sale IS NULL THEN 2 WHEN price_eur IS NULL THEN 3 WHEN c.county IS NULL THEN 4 WHEN price_eur <= {cfg.min_price} OR price_eur >= {cfg.max_price} THEN 5"
           f" WHEN NOT {ok} THEN 6 WHEN region IS NULL THEN 7 ELSE 0 END")
    counts = ", ".join(f"CAST(count(*) FILTER (why = {k}) AS BIGINT) AS {name}" for k, name in enumerate(
        ("kept", "malformed_record", "unreadable_date", "unreadable_price", "no_place", "price_out_of_range", "not_a_full_market_sale", "unknown_place")))
    return _register_ctes(cfg, 4) + f""",
    judged AS (SELECT CAST(2020 + file AS INTEGER) AS file_year, {why} AS why FROM c4 c LEFT JOIN (VALUES {_regions()}) r(county, region) ON c.county = r.county WHERE file < 3),
    per_file AS (SELECT file_year, 'read' AS status, count(*) AS records, {counts} FROM judged GROUP BY file_year)
    SELECT * FROM per_file
    UNION ALL SELECT y, s, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES (2023, 'missing'), (2024, 'lacks county')) t(y, s)"""


def oracle_sql(cfg: Config = TEST) -> dict[str, str]:
    b, lt = cfg.base_year, cfg.latest_year
    q: dict[str, str] = {}
    tx_cols = ("date_of_sale, county, region, CAST(price_eur AS DOUBLE) AS price_eur, property_type, not_full_market, vat_exclusive, "
               "year, month, quarter, eircode")

    q["clean_transactions"] = sql_with(cfg, "tx") + f"SELECT {tx_cols} FROM tx"
    q["load_profile"] = sql_with(cfg, "tx") + f"""
    SELECT count(*) AS transactions, count(DISTINCT county) AS counties,
           array_to_string(list_sort(list_distinct(list(year))), ',') AS years,
           CAST(min(price_eur) AS DOUBLE) AS min_price, CAST(max(price_eur) AS DOUBLE) AS max_price,
           {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)', 2)} AS median_price
    FROM tx"""
    q["register_cleaning"] = _register_rows(cfg, 3, "TRUE", "file < 2", "file = 0", "file = 0", "file < 2")
    q["register_load"] = _register_rows(cfg, 4, "file < 3", "file < 2", "file = 0", "file = 0", "file < 2", blank="nullif(market_text, '')")  # a file's blank is missing
    q["register_manifest"] = _register_manifest_sql(cfg)
    q["affordability_table"] = sql_with(cfg, "aff") + "SELECT * FROM aff"
    q["supply_demand_table"] = sql_with(cfg, "sd") + "SELECT * FROM sd"

    # --- the stored tables ---
    types = {"transactions": "date_of_sale date, county string, region string, price_eur decimal(12,2), property_type string, not_full_market boolean, vat_exclusive boolean, year int, month int, quarter string, eircode string",
             "affordability": "county string, region string, year int, median_price decimal(12,2), avg_annual_wage decimal(10,2), years_salary_to_buy decimal(5,1), monthly_rent_estimate decimal(10,2), price_to_income_ratio decimal(5,2), population int",
             "supply_demand": "county string, region string, year int, new_completions int, estimated_demand int, supply_deficit int, supply_ratio decimal(5,3), supply_deficit_pct decimal(5,1)",
             "investment_scores": "county string, region string, median_price_base decimal(12,2), median_price_latest decimal(12,2), price_growth_pct decimal(5,1), rental_yield_est_pct decimal(5,2), years_salary_to_buy decimal(5,1),"
                                  " supply_deficit_pct decimal(5,1), growth_score decimal(5,1), supply_score decimal(5,1), yield_score decimal(5,1), affordability_score decimal(5,1), composite_investment_score decimal(5,1),"
                                  " investment_tier string, rank int"}
    listed = []
    for table, cte in (("transactions", "tx"), ("affordability", "aff"), ("supply_demand", "sd"), ("investment_scores", "inv")):
        for k, column in enumerate(types[table].split(", ")):
            name, kind = column.split(" ")
            total = f"CAST(sum(CAST({name} AS {kind})) AS VARCHAR)" if kind.startswith("decimal") else "CAST(NULL AS VARCHAR)"
            listed.append(f"SELECT '{table}' AS table_name, CAST({k + 1} AS INTEGER) AS position, '{name}' AS column_name, '{kind}' AS sql_type, count({name}) AS filled, {total} AS total FROM {cte}")
    q["typed_tables"] = sql_with(cfg, "aff", "sd", extra=[("inv", _inv_cte(cfg))]) + "\nUNION ALL ".join(listed)

    def covered(name: str, facts: str, dim: str, *keys: str) -> str:
        on = " AND ".join(f"f.{k} IS NOT DISTINCT FROM d.{k}" for k in keys)
        by = ", ".join(keys)
        return f"""SELECT '{name}' AS dimension, count(f.n) AS fact_keys, count(d.n) AS dimension_keys, count(*) FILTER (d.n IS NULL) AS facts_without_dimension,
            CAST(coalesce(sum(f.n) FILTER (d.n IS NULL), 0) AS BIGINT) AS fact_rows_without_dimension, count(*) FILTER (f.n IS NULL) AS dimension_without_facts,
            count(*) FILTER (d.n > 1) AS repeated_dimension_keys
            FROM (SELECT {by}, count(*) AS n FROM {facts} GROUP BY {by}) f FULL JOIN (SELECT {by}, count(*) AS n FROM {dim} GROUP BY {by}) d ON {on}"""
    late = f"(SELECT * FROM {{}} WHERE year = {lt})"
    q["dimension_coverage"] = sql_with(cfg, "aff", "sd", extra=[("inv", _inv_cte(cfg))]) + " UNION ALL ".join((
        covered("affordability", "ms", "aff", "county", "year"), covered("supply_demand", "ms", "sd", "county", "year"), covered("investment_scores", "ms", "inv", "county"),
        covered("affordability_latest", "ms", late.format("aff"), "county", "year"), covered("sales_latest", late.format("ms"), "aff", "county", "year")))

    # --- market ---
    w = W("county", "year")
    q["market_pulse"] = sql_with(cfg, "ms", extra=[("g", f"""
    SELECT county, region, year, count(*) AS transaction_count,
           {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median_price,
           {RI('avg(price_eur)')} AS avg_price,
           {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.25)')} AS p25_price,
           {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.75)')} AS p75_price,
           {RI('min(price_eur)')} AS min_price,
           {RI('max(price_eur)')} AS max_price,
           {R('sum(price_eur) / 1e9', 3)} AS total_value_bn
    FROM ms GROUP BY county, region, year""")]) + f"""
    SELECT *, lag(median_price) OVER {w} AS prev_year_median,
           {R(PCT('median_price', f'lag(median_price) OVER {w}'), 1)} AS yoy_growth_pct,
           {R(PCT('median_price', f'max(CASE WHEN year = {b} THEN median_price END) OVER (PARTITION BY county)'), 1)}
             AS growth_since_base_pct,
           {R(f'median_price / nullif(first_value(median_price) OVER ({w[1:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) * 100.0 - 100.0', 1)}
             AS growth_since_first_pct
    FROM g"""
    q["market_pulse_value"] = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg))]) + "SELECT * FROM mpv"

    q["focus_vs_rest"] = sql_with(cfg, "ms", extra=[("a", f"""
    SELECT year, CASE WHEN county = '{cfg.focus_place}' THEN 'focus' ELSE 'rest' END AS market,
           {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median_price, count(*) AS n
    FROM ms GROUP BY year, CASE WHEN county = '{cfg.focus_place}' THEN 'focus' ELSE 'rest' END"""), ("p", """
    SELECT year,
           max(CASE WHEN market = 'focus' THEN median_price END) AS focus_median,
           max(CASE WHEN market = 'rest' THEN median_price END) AS rest_median,
           max(CASE WHEN market = 'focus' THEN n END) AS focus_transactions,
           max(CASE WHEN market = 'rest' THEN n END) AS rest_transactions,
           CAST(sum(n) AS BIGINT) AS total_transactions
    FROM a GROUP BY year""")]) + f"""
    SELECT *, focus_median - rest_median AS focus_premium,
           {R('(focus_median - rest_median) * 100.0 / nullif(rest_median, 0)', 1)} AS focus_premium_pct
    FROM p"""

    q["regional_trends"] = sql_with(cfg, "ms", extra=[("g", f"""
    SELECT region, year, count(*) AS transactions, {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median_price,
           {RI('avg(price_eur)')} AS avg_price, {RI('stddev_samp(price_eur)')} AS price_stddev
    FROM ms GROUP BY region, year""")]) + f"""
    SELECT *, {R(MOM('median_price', f'lag(median_price) OVER {W("region", "year")}'), 1)} AS yoy_growth_pct FROM g"""

    q["monthly_momentum"] = sql_with(cfg, "ms", extra=[("mm", _monthly_cte())]) + "SELECT * FROM mm"
    w6 = W("county", "sale_month", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW")
    q["monthly_momentum_sql"] = sql_with(cfg, "ms", extra=[("g", """
    SELECT county, CAST(date_trunc('month', date_of_sale) AS DATE) AS sale_month,
           quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median
    FROM ms GROUP BY county, CAST(date_trunc('month', date_of_sale) AS DATE)""")]) + f"""
    SELECT county, sale_month, {RI('median')} AS median_price, {RI(f'avg(median) OVER {w6}')} AS rolling_6m_avg,
           {R(MOM('median', f'lag(median, 3) OVER {W("county", "sale_month")}'), 1)} AS momentum_3m_pct
    FROM g"""
    days = [("days", """SELECT CAST(date_trunc('month', date_of_sale) AS DATE) AS sale_month, CAST(count(DISTINCT date_of_sale) AS INTEGER) AS days_seen FROM ms GROUP BY 1"""),
            ("cm", "SELECT sale_month, days_seen, days_seen >= (SELECT quantile_cont(days_seen, 0.5) FROM days) * CAST(0.8 AS DOUBLE) AS complete FROM days")]
    q["complete_months"] = sql_with(cfg, "ms", extra=days) + "SELECT * FROM cm"
    q["momentum_signals_complete"] = sql_with(cfg, "ms", extra=[*days, ("mm", _monthly_cte()), ("sig", _signals_cte().replace("(SELECT max(sale_month) FROM mm)", "(SELECT max(sale_month) FROM cm WHERE complete)"))]) + \
        "SELECT * FROM sig"
    q["momentum_signals"] = sql_with(cfg, "ms", extra=[("mm", _monthly_cte()), ("sig", _signals_cte())]) + \
        "SELECT * FROM sig"

    q["velocity_annual"] = sql_with(cfg, "ms", extra=[("vel", _velocity_cte())]) + "SELECT * FROM vel"
    wm = W("county, month", "year")
    q["velocity_monthly"] = sql_with(cfg, "ms", extra=[("g", """
    SELECT county, year, month, count(*) AS volume, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median
    FROM ms GROUP BY county, year, month""")]) + f"""
    SELECT county, year, month, volume, {RI('median')} AS median_price,
           {R(MOM('volume', f'lag(volume) OVER {wm}'), 1)} AS vol_yoy_pct,
           {R(MOM('median', f'lag(median) OVER {wm}'), 1)} AS price_yoy_pct
    FROM g"""

    q["property_type"] = sql_with(cfg, "ms", extra=[("bt", _by_type_cte())]) + "SELECT * FROM bt"
    kind = "CASE WHEN property_type LIKE '%Dwelling house' THEN 'House' WHEN property_type NOT LIKE '%house%' AND property_type LIKE '%Apartment' THEN 'Apartment' ELSE 'Unknown' END"
    seg = [("seg", f"""SELECT county, region, year, segment, count(*) AS n, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median
    FROM (SELECT *, {kind} AS segment FROM ms) s GROUP BY county, region, year, segment""")]
    q["property_segments"] = sql_with(cfg, "ms", extra=seg) + f"""
    SELECT county, region, year, segment, n AS transactions, {R('n * 100.0 / sum(n) OVER (PARTITION BY county, year)', 1)} AS share_pct, {RI('median')} AS median_price,
           {R(MOM('median', f'lag(median) OVER {W("county, segment", "year")}'), 1)} AS yoy_growth_pct FROM seg"""
    q["segment_premium"] = sql_with(cfg, "ms", extra=seg) + f"""
    SELECT h.county, h.year, h.n AS house_sales, a.n AS apartment_sales, {RI('h.median')} AS house_median, {RI('a.median')} AS apartment_median,
           {R('(h.median - a.median) * 100.0 / nullif(a.median, 0)', 1)} AS house_premium_pct
    FROM seg h JOIN seg a ON a.county = h.county AND a.year = h.year AND h.segment = 'House' AND a.segment = 'Apartment'"""
    q["new_vs_secondhand"] = sql_with(cfg, "ms", extra=[("bt", _by_type_cte()), ("nvs", _nvs_cte())]) + \
        "SELECT * FROM nvs"
    q["new_build_premium_vat"] = sql_with(cfg, "ms", extra=[("t", """
    SELECT county, year, vat_exclusive, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median
    FROM ms GROUP BY county, year, vat_exclusive""")]) + f"""
    SELECT county, year,
           {R('(max(CASE WHEN vat_exclusive THEN median END) - max(CASE WHEN NOT vat_exclusive THEN median END)) / nullif(max(CASE WHEN NOT vat_exclusive THEN median END), 0) * 100.0', 1)}
             AS new_build_premium_pct
    FROM t GROUP BY county, year"""
    q["new_premium_avg"] = sql_with(cfg, "ms") + f"""
    SELECT county, year,
           {RI("avg(CASE WHEN property_type LIKE '%New%' THEN price_eur END)")} AS avg_new_price,
           {RI("avg(CASE WHEN property_type LIKE '%Second%' THEN price_eur END)")} AS avg_secondhand_price,
           {RI("avg(CASE WHEN property_type LIKE '%New%' THEN price_eur END) - avg(CASE WHEN property_type LIKE '%Second%' THEN price_eur END)")}
             AS new_vs_secondhand_premium
    FROM ms GROUP BY county, year
    HAVING count(CASE WHEN property_type LIKE '%New%' THEN 1 END) > {cfg.new_build_min_sales}"""

    q["postcode_annual"] = sql_with(cfg, "ms", extra=[("pc", _postcode_cte(cfg))]) + "SELECT * FROM pc"
    q["postcode_snapshot"] = sql_with(cfg, "ms", extra=[("pc", _postcode_cte(cfg)),
                                                        ("snap", _snapshot_cte(cfg))]) + "SELECT * FROM snap"

    q["monthly_volume"] = sql_with(cfg, "ms") + f"""
    SELECT year, month, transaction_count, avg_price, {MONTH_NAME('month')} AS month_name,
           {RI(f'avg(transaction_count) OVER {W("month", "year", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW")}')}
             AS rolling_3yr_avg_volume
    FROM (SELECT year, month, count(*) AS transaction_count, {RI('avg(price_eur)')} AS avg_price
          FROM ms GROUP BY year, month) g"""

    sea = f"""
    SELECT year, month, n AS transactions, {RI('median')} AS median_price, {MONTH_NAME('month')} AS month_name,
           {R('median / avg(median) OVER (PARTITION BY year) * 100.0', 1)} AS price_seasonal_index,
           {R('n / avg(n) OVER (PARTITION BY year) * 100.0', 1)} AS vol_seasonal_index
    FROM (SELECT year, month, count(*) AS n, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) AS median FROM ms GROUP BY year, month) g"""
    q["seasonality"] = sql_with(cfg, "ms", extra=[("sea", sea)]) + "SELECT * FROM sea"
    q["seasonal_pattern"] = sql_with(cfg, "ms", extra=[("sea", sea)]) + f"""
    SELECT month, avg_price_index, avg_vol_index, {MONTH_NAME('month')} AS month_name,
           avg_price_index < 99.0 AS best_time_to_buy, avg_price_index > 101.0 AS best_time_to_sell
    FROM (SELECT month, {MEAN_R('price_seasonal_index', 1)} AS avg_price_index,
                 {MEAN_R('vol_seasonal_index', 1)} AS avg_vol_index
          FROM sea GROUP BY month) g"""

    q["price_distribution"] = sql_with(cfg, "ms") + f"""
    SELECT county, year, count(*) AS count, {R('avg(price_eur)')} AS mean, {R('stddev_samp(price_eur)')} AS std,
           {R('min(price_eur)')} AS min, {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.1)')} AS p10,
           {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.25)')} AS p25, {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median,
           {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.75)')} AS p75, {R('quantile_cont(CAST(price_eur AS DOUBLE), 0.9)')} AS p90,
           {R('max(price_eur)')} AS max
    FROM ms GROUP BY county, year"""

    # --- affordability ---
    q["mortgage_stress"] = sql_with(cfg, "aff", extra=[("st", _stress_cte(cfg))]) + "SELECT * FROM st"
    ltv = D(1.0 - cfg.deposit_pct)
    mp = f"avg_annual_wage * {D(cfg.lti_limit)} / {ltv}"
    q["ftb_gap"] = sql_with(cfg, "aff") + f"""
    SELECT county, year, median_price, avg_annual_wage * {D(cfg.lti_limit)} AS max_mortgage_lti,
           {mp} AS max_affordable_price, median_price - ({mp}) AS affordability_gap_eur,
           {R(f'(median_price - ({mp})) / nullif(median_price, 0) * 100.0', 1)} AS gap_pct
    FROM aff WHERE year = {lt}"""
    q["affordability_ranking"] = sql_with(cfg, "aff", extra=[("rk", _ranking_cte(cfg))]) + "SELECT * FROM rk"
    change = "CAST(ratio_latest AS DECIMAL(12,1)) - CAST(ratio_base AS DECIMAL(12,1))"
    trend = CASE(change, ">=", (2, "Rapidly Worsening"), (1, "Worsening"), default="Stable")
    q["affordability_deterioration"] = sql_with(cfg, "aff") + f"""
    SELECT *, CAST({change} AS DOUBLE) AS yrs_salary_deterioration,
           {R('(price_latest - price_base) * 100.0 / nullif(price_base, 0)', 1)} AS price_growth_pct,
           {trend} AS trend
    FROM (SELECT county, region,
                 max(CASE WHEN year = {b} THEN years_salary_to_buy END) AS ratio_base,
                 max(CASE WHEN year = {lt} THEN years_salary_to_buy END) AS ratio_latest,
                 max(CASE WHEN year = {b} THEN median_price END) AS price_base,
                 max(CASE WHEN year = {lt} THEN median_price END) AS price_latest
          FROM aff GROUP BY county, region) e"""

    # --- supply ---
    sup = CASE("supply_ratio", "<", (0.40, "Critical Shortage"), (0.60, "Severe Shortage"), (0.80, "Moderate Shortage"),
               default="Near Balance")
    q["supply_gap"] = sql_with(cfg, "sd") + f"""
    SELECT *, CAST(sum(supply_deficit) OVER {W('county', 'year', 'ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}
                   AS BIGINT) AS cumulative_deficit,
           {sup} AS supply_status
    FROM sd"""
    press = ("CASE WHEN s.avg_supply_ratio < 0.5 AND p.price_growth_pct > 40 THEN 'High Pressure — Low Supply + High Growth' "
             "WHEN s.avg_supply_ratio < 0.5 THEN 'Supply Constrained' WHEN p.price_growth_pct > 40 THEN 'High Growth' ELSE 'Moderate' END")
    q["supply_vs_growth"] = sql_with(cfg, "aff", "sd") + f"""
    SELECT s.county, s.avg_supply_ratio, p.price_growth_pct, {press} AS market_pressure_label
    FROM (SELECT county, {R(MEAN_R('supply_ratio', 3), 3)} AS avg_supply_ratio FROM sd GROUP BY county) s
    JOIN (SELECT county,
                 {R(f'(max(CASE WHEN year = {lt} THEN median_price END) - max(CASE WHEN year = {b} THEN median_price END)) * 100.0 / nullif(max(CASE WHEN year = {b} THEN median_price END), 0)', 1)}
                   AS price_growth_pct
          FROM aff GROUP BY county) p ON s.county = p.county"""
    places = ", ".join(f"'{c}'" for c in cfg.commuter_places)
    q["commuter_belt"] = sql_with(cfg, "aff", "sd") + f"""
    SELECT *, {R(MOM('median_price', f'lag(median_price) OVER {W("county", "year")}'), 1)} AS yoy_growth_pct
    FROM (SELECT t.county, t.year, t.transactions, t.median_price, a.years_salary_to_buy, a.monthly_rent_estimate,
                 s.supply_ratio, s.supply_deficit
          FROM (SELECT county, year, count(*) AS transactions, {RI('quantile_cont(CAST(price_eur AS DOUBLE), 0.5)')} AS median_price
                FROM ms WHERE county IN ({places}) GROUP BY county, year) t
          JOIN aff a ON t.county = a.county AND t.year = a.year
          JOIN sd s ON t.county = s.county AND t.year = s.year) j"""

    # --- scores ---
    inv = sql_with(cfg, "aff", "sd", extra=[("inv", _inv_cte(cfg))])
    q["investment_scores_table"] = inv + "SELECT * FROM inv"
    q["investment_scorecard"] = inv + """
    SELECT rank, county, region, investment_tier, composite_investment_score, median_price_latest, price_growth_pct,
           rental_yield_est_pct, years_salary_to_buy, supply_deficit_pct, growth_score, supply_score, yield_score,
           affordability_score
    FROM inv"""
    q["tier_summary"] = inv + f"""
    SELECT investment_tier, count(*) AS county_count,
           {R(MEAN_R('composite_investment_score', 1), 1)} AS avg_score,
           {RI('avg(median_price_latest)')} AS avg_median_price,
           {R(MEAN_R('price_growth_pct', 1), 1)} AS avg_growth_pct,
           {R(MEAN_R('rental_yield_est_pct', 2), 2)} AS avg_rental_yield,
           string_agg(county, ', ' ORDER BY rank, county) AS counties
    FROM inv GROUP BY investment_tier"""
    rar = ("(CAST(price_growth_pct AS DECIMAL(12,1)) * 0.4 + CAST(rental_yield_est_pct AS DECIMAL(12,2)) * 10 * 0.4"
           " - CAST(years_salary_to_buy AS DECIMAL(12,1)) * 2 * 0.2)")
    cond = (f"median_price_latest < nat_median AND price_growth_pct > {D(cfg.undervalued_min_growth)} "
            f"AND supply_deficit_pct > {D(cfg.undervalued_min_deficit)}")
    q["undervalued_median"] = inv + f"""
    SELECT county, region, median_price_latest, nat_median,
           {R('(nat_median - median_price_latest) / nullif(nat_median, 0) * 100.0', 1)} AS discount_to_national_pct,
           CAST(round({rar}, 1) AS DOUBLE) AS risk_adj_return, price_growth_pct, supply_deficit_pct, {cond} AS undervalued
    FROM inv CROSS JOIN (SELECT quantile_cont(median_price_latest, 0.5) AS nat_median FROM inv) n"""
    q["undervalued_mean"] = inv + f"""
    SELECT county, region, median_price_latest, nat_median,
           {R('(nat_median - median_price_latest) * 100.0 / nullif(nat_median, 0)', 1)} AS discount_to_national_pct,
           price_growth_pct, supply_deficit_pct, composite_investment_score, investment_tier
    FROM inv CROSS JOIN (SELECT {R('avg(median_price_latest)')} AS nat_median FROM inv) n
    WHERE {cond}"""
    q["risk_adjusted_ranking"] = inv + f"""
    SELECT county, region, median_price_latest, price_growth_pct, rental_yield_est_pct, years_salary_to_buy,
           risk_adj_return_score,
           CAST(rank() OVER (ORDER BY raw DESC NULLS FIRST) AS INTEGER) AS risk_adj_rank,
           {TRUNC_RANK('risk_adj_return_score')} AS risk_adj_rank_avg
    FROM (SELECT *, {rar} AS raw, CAST(round({rar}, 1) AS DOUBLE) AS risk_adj_return_score FROM inv) r"""

    heat = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg)), ("vel", _velocity_cte()),
                                      ("heat", _heat_cte(cfg))])
    q["heat_index"] = heat + "SELECT * FROM heat"
    q["national_summary"] = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg))]) + f"""
    SELECT year, {RI('quantile_cont(median_price, 0.5)')} AS national_median,
           CAST(sum(transactions) AS BIGINT) AS total_transactions,
           {R(MEAN_R('yoy_growth_pct', 1), 1)} AS avg_yoy
    FROM mpv GROUP BY year"""
    q["national_latest"] = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg))]) + f"""
    SELECT {lt} AS year, 'National' AS description, quantile_cont(median_price, 0.5) AS median_price,
           CAST(sum(transactions) AS BIGINT) AS transactions, {MEAN_R('yoy_growth_pct', 1)} AS yoy_growth_pct
    FROM mpv WHERE year = {lt}"""

    # --- extensions ---
    q["price_volume_divergence"] = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg)), ("vel", _velocity_cte())]) + """
    SELECT p.county, p.year, p.yoy_growth_pct, v.vol_yoy_pct,
           CASE WHEN p.yoy_growth_pct IS NULL OR v.vol_yoy_pct IS NULL THEN 'Insufficient Data'
                WHEN p.yoy_growth_pct > 0 AND v.vol_yoy_pct < 0 THEN 'Price Up, Volume Down'
                WHEN p.yoy_growth_pct < 0 AND v.vol_yoy_pct > 0 THEN 'Price Down, Volume Up' ELSE 'Aligned' END AS divergence
    FROM mpv p JOIN vel v ON p.county = v.county AND p.year = v.year"""
    q["premium_by_zone"] = sql_with(cfg, "ms", extra=[("z", f"""
    SELECT zone, year, count(*) AS n,
           quantile_cont(CAST(price_eur AS DOUBLE), 0.5) FILTER (vat_exclusive) AS fresh, quantile_cont(CAST(price_eur AS DOUBLE), 0.5) FILTER (NOT vat_exclusive) AS old
    FROM (SELECT *, {ZONE} AS zone FROM (SELECT *, {POSTCODE} AS postcode FROM ms WHERE county = '{cfg.focus_place}') p
          WHERE postcode IS NOT NULL) d
    GROUP BY zone, year""")]) + f"""
    SELECT zone, year, n AS transactions, {RI('fresh')} AS new_build_median, {RI('old')} AS second_hand_median,
           {R('(fresh - old) / nullif(old, 0) * 100.0', 1)} AS new_build_premium_pct
    FROM z"""
    q["market_direction"] = sql_with(cfg, "ms", extra=[("mpv", _pulse_value_cte(cfg))]) + f"""
    SELECT year, national_median, avg_yoy, CASE WHEN avg_yoy IS NULL THEN 'Insufficient Data' WHEN avg_yoy > 1 THEN 'Rising'
           WHEN avg_yoy < -1 THEN 'Falling' ELSE 'Stable' END AS direction
    FROM (SELECT year, {RI('quantile_cont(median_price, 0.5)')} AS national_median, {R(MEAN_R('yoy_growth_pct', 1), 1)} AS avg_yoy
          FROM mpv GROUP BY year) n"""

    # --- key findings ---
    q["top_momentum"] = sql_with(cfg, "ms", extra=[("mm", _monthly_cte()), ("sig", _signals_cte())]) + """
    SELECT county, momentum_3m, signal FROM sig WHERE momentum_3m IS NOT NULL
    ORDER BY momentum_3m DESC, county LIMIT 3"""
    q["top_unaffordable"] = sql_with(cfg, "aff", extra=[("rk", _ranking_cte(cfg))]) + f"""
    SELECT county, median_price, years_salary_to_buy, affordability_status FROM rk
    WHERE year = {lt} AND years_salary_to_buy IS NOT NULL
    ORDER BY years_salary_to_buy DESC, county LIMIT {cfg.top_k}"""
    q["top_heat"] = heat + f"SELECT rank, county, heat_index, market_temperature FROM heat WHERE rank <= {cfg.top_k}"
    snap = sql_with(cfg, "ms", extra=[("pc", _postcode_cte(cfg)), ("snap", _snapshot_cte(cfg))])
    q["postcode_spread"] = snap + """
    SELECT * FROM (SELECT 'highest' AS position, postcode, zone, median_price, transactions FROM snap
                   ORDER BY median_price DESC, postcode LIMIT 3)
    UNION ALL
    SELECT * FROM (SELECT 'lowest' AS position, postcode, zone, median_price, transactions FROM snap
                   ORDER BY median_price ASC, postcode LIMIT 3)"""
    q["top_premium"] = sql_with(cfg, "ms", extra=[("bt", _by_type_cte()), ("nvs", _nvs_cte())]) + f"""
    SELECT county, second_hand_median, new_build_median, new_build_premium_pct, premium_signal FROM nvs
    WHERE year = {lt} AND new_build_premium_pct IS NOT NULL
    ORDER BY new_build_premium_pct DESC, county LIMIT {cfg.top_k}"""
    q["cannot_afford"] = sql_with(cfg, "aff", extra=[("st", _stress_cte(cfg))]) + f"""
    SELECT county, median_price, max_affordable_price, gap_pct, ftb_status FROM st
    WHERE year = {lt} AND ftb_status LIKE '%Cannot%'
    ORDER BY county LIMIT {cfg.top_k}"""
    q["top_investment"] = inv + f"""
    SELECT rank, county, composite_investment_score, investment_tier, median_price_latest, price_growth_pct,
           rental_yield_est_pct
    FROM inv ORDER BY rank ASC NULLS LAST, county LIMIT {cfg.top_k}"""
    # --- the same rows in their order ---
    for name, base, order in (("ordered_pulse", q["market_pulse"], "county, year"), ("ordered_premium", q["new_build_premium_vat"], "new_build_premium_pct DESC NULLS FIRST, county, year"),
                              ("ordered_growth", f"SELECT county, year, yoy_growth_pct FROM ({q['market_pulse']})", "yoy_growth_pct DESC NULLS FIRST, county, year")):
        q[name] = f"SELECT *, row_number() OVER (ORDER BY {order}) AS ordinal FROM ({base}) o"
    q["stored_score_ranking"], q["stored_score_tiers"] = q["risk_adjusted_ranking"], q["tier_summary"]
    return q
