"""Whole runs: many scenarios expanded, translated, propagated, checked and rolled up at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import checked
from rippleflow.operators import checks, concord, leontief, macro, nature, volume
from rippleflow.operators.quality import quality_report
from rippleflow.plans.fixpoint import Propagator
from rippleflow.plans.joins import union_all
from rippleflow.schema import BANDS, RESULT_COLUMNS, SHOCK

SHOCK_COLUMNS = [f.name for f in SHOCK.fields]
SUPPORTED = {
    "price": ["carbon_price", "energy_price"],
    "volume": ["carbon_price", "energy_price", "productivity"],
}


@dataclass
class Build:
    """The tables a run reads, with the two propagators of its coefficients."""

    coeff: DataFrame
    output: DataFrame
    final_demand: DataFrame
    satellite: DataFrame
    price: Propagator
    quantity: Propagator
    ratings: DataFrame | None = None
    concordance: DataFrame | None = None
    elasticities: DataFrame | None = None

    @property
    def goods(self) -> DataFrame:
        return self.output.select("region", "sector")


def expand(shocks: DataFrame, years: DataFrame, channels: DataFrame | None = None,
           pathways: DataFrame | None = None) -> DataFrame:
    """Explicit shocks plus the stresses that physical state pathways imply."""
    if channels is None or pathways is None:
        return shocks.select(*SHOCK_COLUMNS)
    checks.require_empty(checks.broken(nature.unmatched_pathways(channels, pathways),
                                       "pathway_without_channel", F.col("channel_id")))
    states = nature.state_path(pathways, years)
    stresses = nature.stresses_from_states(channels, nature.severity_path(channels, states))
    return union_all([shocks.select(*SHOCK_COLUMNS), stresses.select(*SHOCK_COLUMNS)])


def exposure(build: Build, incidence: str = "total", rule: str = "weighted_mean",
             threshold: float = 0.0) -> DataFrame:
    """Exposure per good and service; direct incidence skips the propagation altogether."""
    scores = nature.sector_scores(build.ratings, build.concordance)
    direct = nature.goods_scores(scores, build.goods)
    checks.require_empty(union_all([
        checks.broken(nature.unrated_sectors(build.goods, build.concordance), "sector_unrated",
                      F.col("sector")),
        *([nature.exposure_violations(build.coeff, direct)] if incidence == "total" else [])]))
    if incidence == "direct":
        if rule != "weighted_mean" or threshold != 0.0:
            raise ValueError("rule and threshold have no effect under direct incidence")
        return nature.direct_exposure(direct)
    if incidence != "total":
        raise ValueError(f"incidence must be 'direct' or 'total', got {incidence!r}")
    if rule == "max":
        return nature.exposure_max(build.coeff, direct, threshold)
    if threshold != 0.0:
        raise ValueError("a link threshold only applies to the max rule")
    return nature.exposure_weighted(build.coeff, direct)


def translate_nature(build: Build, shocks: DataFrame, years: DataFrame, incidence: str,
                     rule: str = "weighted_mean", threshold: float = 0.0) -> DataFrame:
    """Replace nature stresses by the productivity shocks they cause."""
    exposed = exposure(build, incidence, rule, threshold)
    checks.require_empty(checks.stress_rules(shocks, exposed))
    delta = nature.stress_productivity(shocks, years, exposed)
    derived = nature.productivity_shocks(delta)
    return union_all([
        shocks.where("type <> 'nature_stress'").select(*SHOCK_COLUMNS),
        derived.select(*SHOCK_COLUMNS)])


def run(build: Build, shocks: DataFrame, years: DataFrame, model: str = "volume",
        channels: DataFrame | None = None, pathways: DataFrame | None = None,
        incidence: str | None = None, rule: str = "weighted_mean", threshold: float = 0.0,
        with_macro: bool = True, validate: bool = True) -> DataFrame:
    """Results of every scenario in ``shocks`` with macro rows appended.

    ``model`` is ``price`` or ``volume``. Rules are checked before the propagation; the result
    itself stays a lazy frame.
    """
    if model not in SUPPORTED:
        raise ValueError(f"model must be one of {sorted(SUPPORTED)}, got {model!r}")
    shocks = expand(shocks, years, channels, pathways).persist()
    has_nature = not shocks.where("type = 'nature_stress'").isEmpty()
    if validate:
        supported = SUPPORTED[model] + (["nature_stress"] if model == "volume" else [])
        checks.require_empty(union_all([
            checks.support_rules(shocks, supported), checks.shock_rules(shocks),
            checks.coverage_rules(shocks, build.goods),
            checks.gas_rules(shocks, build.satellite, build.goods),
            checks.year_rules(years.groupBy("scenario_id").agg(
                F.collect_list("year").alias("years")))]))
    if has_nature:
        shocks = translate_nature(
            build, shocks, years,
            incidence or nature.INCIDENCE_BY_MODEL[model],
            rule, threshold).persist()
    has_pins = not shocks.where("type = 'energy_price'").isEmpty()
    if validate and has_pins:
        checks.require_empty(checks.pin_rules(leontief.energy_pins(shocks, years, build.goods)))
    prices = leontief.price_run(
        build.price, shocks, years, build.goods, build.satellite, has_pins)
    out = prices
    if model == "volume":
        dp = prices.where("variable = 'price_change'").select(
            "scenario_id", "year", "region", "sector", "value")
        out = volume.volume_run(
            build.quantity, dp, build.final_demand, build.output, build.elasticities,
            volume.productivity_multiplier(shocks, years, build.goods))
    if with_macro:
        out = macro.append_macro(out, macro.value_added(build.coeff, build.output))
    if validate:
        out = out.withColumn("value", checked(
            F.col("value"), checks.not_finite("value") | ~F.col("scenario").isin(*BANDS),
            F.concat_ws(":", F.lit("result value or band"), *RESULT_COLUMNS)))
    return out


def derive_coarse(build: Build, sector_map: DataFrame, region_map: DataFrame) -> dict:
    """Coarse tables of a build and the conservation rows that must pass before they are stored."""
    b = concord.combined_bridge(build.goods, sector_map, region_map).persist()
    output = concord.aggregate_output(build.output, b).persist()
    demand = concord.aggregate_demand(build.final_demand, b, region_map).persist()
    coeff = concord.aggregate_coeff(build.coeff, build.output, b).persist()
    satellite = concord.aggregate_satellite(build.satellite, build.output, b).persist()
    conserved = concord.conservation(build.output, output, build.final_demand, demand)
    checks.require_empty(conserved.where("severity = 'fail'").select(
        F.lit("conservation").alias("rule"), F.col("name").alias("item")))
    return {"coeff": coeff, "output": output, "final_demand": demand, "satellite": satellite,
            "quality": union_all([quality_report(coeff, output, demand, satellite), conserved.select(
                "name", "severity", "value", "tolerance")])}
