"""From raw flows to stored builds: adapt, gate, report, save; aggregate, gate, save.

Nothing is published unless everything before it passed: structural rules and units are errors, and a
failing report or cells that are no numbers stop the store before its catalogue row. A run that stops
half way leaves files that no reader follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.operators import checks, concord, harmonise
from rippleflow.operators.leontief import price_links, quantity_links
from rippleflow.operators.quality import quality_report
from rippleflow.plans.fixpoint import Propagator, spectral_radius
from rippleflow.plans.scenario import Build, derive_coarse
from rippleflow.session import cut_lineage
from rippleflow.sources.store import BuildStore


@dataclass
class Raw:
    """What an adapter delivers: money flows, output, demand and emission amounts."""

    flows: DataFrame
    output: DataFrame
    final_demand: DataFrame
    stressors: DataFrame
    currency: str = "EUR"
    unit: str = "MEUR"


def adapt(raw: Raw) -> Build:
    """Coefficients and intensities of raw flows, gated by structure, productivity and units."""
    coeff = cut_lineage(harmonise.flows_to_coefficients(raw.flows, raw.output))
    satellite = cut_lineage(harmonise.ghg_account(raw.stressors, raw.output, raw.unit))
    build = Build(coeff, raw.output, raw.final_demand, satellite,
                  Propagator(price_links(coeff)), Propagator(quantity_links(coeff)))
    bound = spectral_radius(quantity_links(coeff)).first()["hi"]
    checks.require_empty(checks.structural_rules(
        coeff, raw.final_demand, build.goods, satellite, bound or 0.0).unionByName(
        checks.unit_rules(satellite, raw.currency, raw.unit, euro_only=True)))
    return build


def store_builds(store: BuildStore, build_id: str, raw: Raw, sector_map: DataFrame,
                 region_map: DataFrame, map_name: str = "custom", meta: dict | None = None,
                 base: int | None = None) -> tuple[str, str]:
    """The ids of the stored build and of its aggregated build, which is named by its maps."""
    build = adapt(raw)
    tables = {"coeff": build.coeff, "output": build.output, "final_demand": build.final_demand,
              "satellite": build.satellite}
    store.save(build_id, tables | {"quality": _report(build_id, quality_report(
        build.coeff, build.output, build.final_demand, build.satellite))}, meta=meta, base=base)
    one = build.coeff.sparkSession.range(1).select(F.lit(build_id).alias("build_id"))
    coarse_id = concord.coarse_build_ids(one, map_name, sector_map, region_map).first()["coarse_id"]
    coarse = derive_coarse(build, sector_map, region_map)
    store.save(coarse_id, coarse | {"quality": _report(coarse_id, coarse["quality"])},
               meta={**(meta or {}), "aggregation": map_name})
    return build_id, coarse_id


def _report(build_id: str, rows: DataFrame) -> DataFrame:
    return cut_lineage(rows.select(
        F.lit(build_id).alias("build_id"), "name", "severity", F.lit("").alias("message"), "value",
        "tolerance", F.lit(None).cast("map<string,double>").alias("detail")))
