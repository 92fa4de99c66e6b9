"""Job parameters: places, periods, thresholds and rates in one place.

Every job takes a ``Config``; nothing below is hard-coded inside a job.
The defaults describe the synthetic driver tables (see ``sources.synthetic``);
``Config.register()`` gives the values a real yearly sale register uses.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    # --- places -------------------------------------------------------------
    focus_place: str = "NATION_0"          # the "capital" market compared with the rest
    commuter_places: tuple[str, ...] = ("NATION_1", "NATION_2", "NATION_3", "NATION_4", "NATION_5")

    # --- periods ------------------------------------------------------------
    base_year: int = 1995
    latest_year: int = 2000

    # --- transaction cleaning -----------------------------------------------
    min_price: float = 10_000.0            # strict lower bound
    max_price: float = 5_000_000.0         # strict upper bound

    # --- postcode job ------------------------------------------------------
    postcode_min_sales: int = 20           # minimum sales per postcode-year, before growth
    # --- SQL new-build premium job ------------------------------------------
    new_build_min_sales: int = 10          # HAVING count(new) > this

    # --- latest complete month ----------------------------------------------
    # A month is complete if it has sales on at least this share of the days that the median month has.
    complete_share: float = 0.8

    # --- mortgage stress test -----------------------------------------------
    stress_rate: float = 0.06
    lti_limit: float = 4.0
    deposit_pct: float = 0.10
    savings_rate: float = 0.15
    term_years: int = 30

    # --- undervalued screen -------------------------------------------------
    undervalued_min_growth: float = 30.0
    undervalued_min_deficit: float = 45.0

    # --- investment tiers (cut-offs on the composite score) -----------------
    tier_cutoffs: tuple[tuple[float, str], ...] = ((60.0, "Tier 1"), (40.0, "Tier 2"))
    tier_default: str = "Tier 3"

    # --- top-k reports ------------------------------------------------------
    top_k: int = 5

    # --- quantiles ------------------------------------------------------------
    # Exact PERCENTILE_CONT (two reads).  False opts in to interpolation within the
    # histogram's buckets (one read, 0.2 % of the value); never implicit.
    exact_quantiles: bool = True

    def with_(self, **kw) -> "Config":
        return replace(self, **kw)

    @staticmethod
    def register() -> "Config":
        """Parameters for a real yearly sale register (2020-2024, capital = Dublin)."""
        return Config(
            focus_place="Dublin",
            commuter_places=("Kildare", "Meath", "Wicklow", "Louth", "Westmeath"),
            base_year=2020,
            latest_year=2024,
        )


DEFAULT = Config()

# Parameters the SQL-checked test queries run with on the synthetic tables
# (synthetic prices barely grow and postcode-years are small; SURVEY §7.3).
TEST = Config(postcode_min_sales=2, undervalued_min_growth=0.0, undervalued_min_deficit=45.0)
