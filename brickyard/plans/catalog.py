"""Registry of every job as ``(spark, sf_dir) -> DataFrame`` over the driver tables.

The same names key the DuckDB oracle SQL in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import Config, TEST
from ..operators.order import order_columns, with_ordinal
from ..sources import schemas
from ..sources.tables import DerivedSources
from . import afford, findings, ingest, invest, market, supply

Job = Callable[[DerivedSources, Config], DataFrame]
_JOBS: dict[str, Job] = {}


def job(name: str):
    def deco(fn: Job) -> Job:
        _JOBS[name] = fn
        return fn
    return deco


# --- canonical tables -------------------------------------------------------
@job("clean_transactions")
def _clean(src, cfg):
    return schemas.for_jobs(src.tx())


@job("load_profile")
def _profile(src, cfg):
    return src.load_profile()


@job("register_cleaning")
def _reg(src, cfg):
    return schemas.for_jobs(ingest.register_cleaning(src.customer(), cfg))


@job("register_load")
def _reg_load(src, cfg):
    return schemas.for_jobs(ingest.register_load(src.customer(), cfg))


@job("register_manifest")
def _reg_manifest(src, cfg):
    # a file's size depends on how its parts were written
    return ingest.register_manifest(src.customer(), cfg).drop("bytes")


@job("affordability_table")
def _aff(src, cfg):
    return src.aff()


@job("supply_demand_table")
def _sd(src, cfg):
    return src.sd()


# --- market ---------------------------------------------------------------
@job("market_pulse")
def _mp(src, cfg):
    return market.market_pulse(src.profile(), cfg)


@job("market_pulse_value")
def _mpv(src, cfg):
    return market.market_pulse_value(src.profile(), cfg)


@job("focus_vs_rest")
def _fvr(src, cfg):
    return market.focus_vs_rest(src.side(), cfg)


@job("regional_trends")
def _rt(src, cfg):
    return market.regional_trends(src.side(), cfg)


@job("monthly_momentum")
def _mm(src, cfg):
    return market.monthly_momentum(src.month_profile(), cfg)


@job("monthly_momentum_sql")
def _mm_sql(src, cfg):
    return market.monthly_momentum_sql(src.month_profile(), cfg)


@job("momentum_signals")
def _ms_sig(src, cfg):
    return market.momentum_signals(market.monthly_momentum(src.month_profile(), cfg), cfg)


@job("velocity_annual")
def _va(src, cfg):
    return market.velocity_annual(src.profile(), cfg)


@job("velocity_monthly")
def _vm(src, cfg):
    return market.velocity_monthly(src.month_profile(), cfg)


@job("property_type")
def _pt(src, cfg):
    return market.property_type(src.type_profile(), cfg)


@job("new_vs_secondhand")
def _nvs(src, cfg):
    return market.new_vs_secondhand(market.property_type(src.type_profile(), cfg), cfg)


@job("new_build_premium_vat")
def _nbv(src, cfg):
    return market.new_build_premium_vat(src.side(), cfg)


@job("new_premium_avg")
def _npa(src, cfg):
    return market.new_premium_avg(src.ms(), cfg)


@job("postcode_annual")
def _pa(src, cfg):
    return market.postcode_annual(src.side(), cfg)


@job("postcode_snapshot")
def _ps(src, cfg):
    return market.postcode_snapshot(market.postcode_annual(src.side(), cfg), cfg)


@job("monthly_volume")
def _mv(src, cfg):
    return market.monthly_volume(src.month_profile(), cfg)


@job("seasonality")
def _sea(src, cfg):
    return market.seasonality(src.side(), cfg)


@job("seasonal_pattern")
def _sp(src, cfg):
    return market.seasonal_pattern(market.seasonality(src.side(), cfg), cfg)


@job("price_distribution")
def _pd(src, cfg):
    return market.price_distribution(src.profile(), cfg)


# --- affordability -----------------------------------------------------------
@job("mortgage_stress")
def _mst(src, cfg):
    return afford.mortgage_stress(src.profile(), src.aff(), cfg)


@job("ftb_gap")
def _ftb(src, cfg):
    return afford.ftb_gap(src.aff(), cfg)


@job("affordability_ranking")
def _ar(src, cfg):
    return afford.affordability_ranking(src.aff(), cfg)


@job("affordability_deterioration")
def _ad(src, cfg):
    return afford.affordability_deterioration(src.aff(), cfg)


# --- supply -----------------------------------------------------------------
@job("supply_gap")
def _sg(src, cfg):
    return supply.supply_gap(src.sd(), cfg)


@job("supply_vs_growth")
def _svg(src, cfg):
    return supply.supply_vs_growth(src.sd(), src.aff(), cfg)


@job("commuter_belt")
def _cb(src, cfg):
    return supply.commuter_belt(src.profile(), src.aff(),
                                src.sd(), cfg)


# --- scores -----------------------------------------------------------------
def _inv(src, cfg):
    return src.scores()


@job("investment_scores_table")
def _inv_table(src, cfg):
    return _inv(src, cfg)


@job("investment_scorecard")
def _card(src, cfg):
    return invest.investment_scorecard(_inv(src, cfg), cfg)


@job("tier_summary")
def _tier(src, cfg):
    return invest.tier_summary(_inv(src, cfg), cfg)


@job("undervalued_median")
def _um(src, cfg):
    return invest.undervalued_median(_inv(src, cfg), cfg)


@job("undervalued_mean")
def _umean(src, cfg):
    return invest.undervalued_mean(_inv(src, cfg), cfg)


@job("risk_adjusted_ranking")
def _rar(src, cfg):
    return invest.risk_adjusted_ranking(_inv(src, cfg), cfg)


def _heat(src, cfg):
    return invest.heat_index(market.market_pulse_value(src.profile(), cfg), market.velocity_annual(src.profile(), cfg), cfg)


@job("heat_index")
def _hi(src, cfg):
    return _heat(src, cfg)


@job("national_summary")
def _ns(src, cfg):
    return invest.national_summary(market.market_pulse_value(src.profile(), cfg), cfg)


@job("national_latest")
def _nl(src, cfg):
    return invest.national_latest(market.market_pulse_value(src.profile(), cfg), cfg)


# --- key findings (top-k reports) -----------------------------------------------
@job("top_momentum")
def _tm(src, cfg):
    return findings.top_momentum(_ms_sig(src, cfg), cfg)


@job("top_unaffordable")
def _tu(src, cfg):
    return findings.top_unaffordable(_ar(src, cfg), cfg)


@job("top_heat")
def _th(src, cfg):
    return findings.top_heat(_heat(src, cfg), cfg)


@job("postcode_spread")
def _psp(src, cfg):
    return findings.postcode_spread(_ps(src, cfg), cfg)


@job("top_premium")
def _tp(src, cfg):
    return findings.top_premium(_nvs(src, cfg), cfg)


@job("cannot_afford")
def _ca(src, cfg):
    return findings.cannot_afford(_mst(src, cfg), cfg)


@job("top_investment")
def _ti(src, cfg):
    return findings.top_investment(_card(src, cfg), cfg)


# --- segments, complete months, ordered results, dimensions against facts --------
@job("property_segments")
def _seg(src, cfg):
    return market.property_segments(src.segment_profile(), cfg)


@job("segment_premium")
def _segp(src, cfg):
    return market.segment_premium(src.segment_profile(), cfg)


@job("complete_months")
def _months(src, cfg):
    return market.complete_months(src.side(), cfg)


@job("momentum_signals_complete")
def _ms_complete(src, cfg):
    return market.momentum_signals_complete(market.monthly_momentum(src.month_profile(), cfg), src.side(), cfg)


@job("ordered_pulse")
def _ordered_pulse(src, cfg):
    return with_ordinal(_mp(src, cfg), ORDER["market_pulse"])


@job("ordered_premium")
def _ordered_premium(src, cfg):
    return with_ordinal(_nbv(src, cfg), ORDER["new_build_premium_vat"])


@job("ordered_growth")
def _ordered_growth(src, cfg):
    return with_ordinal(_mp(src, cfg).select("county", "year", "yoy_growth_pct"), ("-yoy_growth_pct", "county", "year"))


@job("dimension_coverage")
def _coverage(src, cfg):
    return ingest.dimension_coverage(src.ms(), src.aff(), src.sd(), src.scores(), cfg)


@job("stored_score_ranking")
def _score_ranking(src, cfg):
    return invest.risk_adjusted_ranking(ingest.scores_from_file(src.at_rest("investment_scores"), cfg), cfg)


@job("stored_score_tiers")
def _score_tiers(src, cfg):
    return invest.tier_summary(ingest.scores_from_file(src.at_rest("investment_scores"), cfg), cfg)


@job("typed_tables")
def _typed(src, cfg):
    return ingest.typed_tables({name: src.at_rest(name) for name in schemas.TABLES})


# --- extensions: announced in the reference's text, not computed there ----------
@job("price_volume_divergence")
def _pvd(src, cfg):
    return market.price_volume_divergence(_mpv(src, cfg), _va(src, cfg), cfg)


@job("premium_by_zone")
def _pbz(src, cfg):
    return market.premium_by_zone(src.side(), cfg)


@job("market_direction")
def _md(src, cfg):
    return market.market_direction(_ns(src, cfg), cfg)


# Presentation order of each result at the sink (the reference's ORDER BY;
# "-col" = descending with NULLs first, as PostgreSQL sorts).  Jobs never rely
# on it; the large clean table is written unsorted.
ORDER: dict[str, tuple[str, ...]] = {
    "market_pulse": ("county", "year"), "market_pulse_value": ("county", "year"), "focus_vs_rest": ("year",),
    "regional_trends": ("region", "year"), "monthly_momentum": ("county", "sale_month"),
    "monthly_momentum_sql": ("county", "sale_month"), "momentum_signals": ("county",),
    "velocity_annual": ("county", "year"), "velocity_monthly": ("county", "year", "month"),
    "property_type": ("county", "year", "type_label"), "new_vs_secondhand": ("county", "year"),
    "new_build_premium_vat": ("-new_build_premium_pct", "county", "year"), "new_premium_avg": ("county", "year"),
    "postcode_annual": ("postcode", "year"), "postcode_snapshot": ("price_rank", "postcode"),
    "monthly_volume": ("year", "month"), "seasonality": ("year", "month"), "seasonal_pattern": ("month",),
    "price_distribution": ("county", "year"), "mortgage_stress": ("county", "year"), "ftb_gap": ("-gap_pct", "county"),
    "affordability_ranking": ("year", "-years_salary_to_buy", "county"),
    "affordability_deterioration": ("-yrs_salary_deterioration", "county"), "supply_gap": ("county", "year"),
    "supply_vs_growth": ("-price_growth_pct", "county"), "commuter_belt": ("county", "year"),
    "investment_scores_table": ("rank", "county"), "investment_scorecard": ("rank", "county"),
    "tier_summary": ("-avg_score",), "undervalued_median": ("county",),
    "undervalued_mean": ("-composite_investment_score", "county"),
    "risk_adjusted_ranking": ("-risk_adj_return_score", "county"), "heat_index": ("rank",),
    "national_summary": ("year",), "affordability_table": ("county", "year"), "supply_demand_table": ("county", "year"),
    "top_momentum": ("-momentum_3m", "county"), "top_unaffordable": ("-years_salary_to_buy", "county"),
    "top_heat": ("rank",), "postcode_spread": ("position", "-median_price", "postcode"),
    "price_volume_divergence": ("county", "year"), "premium_by_zone": ("zone", "year"), "market_direction": ("year",),
    "property_segments": ("county", "year", "segment"), "segment_premium": ("-house_premium_pct", "county", "year"), "complete_months": ("sale_month",),
    "momentum_signals_complete": ("county",), "ordered_pulse": ("ordinal",), "ordered_premium": ("ordinal",), "ordered_growth": ("ordinal",),
    "dimension_coverage": ("dimension",), "stored_score_ranking": ("-risk_adj_return_score", "county"), "stored_score_tiers": ("-avg_score",),
    "typed_tables": ("table_name", "position"),
    "top_premium": ("-new_build_premium_pct", "county"), "cannot_afford": ("county",), "top_investment": ("rank", "county"),
}


#: Jobs that read none of the canonical tables.
UNSTORED = frozenset({"register_cleaning", "register_load", "register_manifest"})


def ordered(name: str, df: DataFrame) -> DataFrame:
    keys = ORDER.get(name)
    return df.orderBy(*order_columns(keys)) if keys else df


def queries(cfg: Config = TEST, load_once: bool = True) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every job reading the driver tables under ``sf_dir``.

    ``load_once``: the canonical tables and shared aggregates are written once
    per session (``sources.tables.stored_for``) and every job reads them;
    otherwise each job derives them from the driver tables itself.
    """
    from ..sources.tables import stored_for
    if load_once:
        return {name: (lambda spark, sf_dir, _fn=fn, _open=DerivedSources if name in UNSTORED else stored_for:
                       _fn(_open(spark, sf_dir, cfg), cfg)) for name, fn in _JOBS.items()}
    return {name: (lambda spark, sf_dir, _fn=fn: _fn(DerivedSources(spark, sf_dir, cfg), cfg))
            for name, fn in _JOBS.items()}


def jobs_on(src: DerivedSources, cfg: Config = TEST) -> dict[str, Callable[[], DataFrame]]:
    """Every job bound to one set of sources (e.g. tables stored once by ``sources.tables.materialize``)."""
    return {name: (lambda _fn=fn: _fn(src, cfg)) for name, fn in _JOBS.items()}


def names() -> list[str]:
    return list(_JOBS)
