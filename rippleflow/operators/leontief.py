"""Quantity and price propagation through the supply chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import label, split_label, with_label
from rippleflow.functions.paths import level_at
from rippleflow.operators.harmonise import CO2E, GWP100, total_by_label
from rippleflow.plans.fixpoint import Propagator, iterate
from rippleflow.plans.joins import union_all
from rippleflow.schema import RESULT_COLUMNS
from rippleflow.session import cut_lineage

PER_MILLION = 1e-6
TIERS = 3


def quantity_links(coeff: DataFrame) -> DataFrame:
    """Links along which demand pulls output: from the buyer to its supplier."""
    return coeff.select(label("j_region", "j_sector").alias("src"),
                        label("i_region", "i_sector").alias("dst"), F.col("a").alias("w"))


def price_links(coeff: DataFrame) -> DataFrame:
    """Links along which cost pushes prices: from the supplier to its buyer."""
    return coeff.select(label("i_region", "i_sector").alias("src"),
                        label("j_region", "j_sector").alias("dst"), F.col("a").alias("w"))


def gross_output(quantity: Propagator, final_demand: DataFrame, keys=()) -> DataFrame:
    """Output that satisfies ``final_demand(keys..., region, sector, value)``, all keys at once."""
    keys = list(keys)
    demand = final_demand.groupBy(*keys, label().alias("label")).agg(
        F.sum("value").alias("value"))
    return split_label(quantity.apply(demand, keys)).select(
        *keys, "region", "sector", F.col("value").alias("x"))


def covered_goods(shocks: DataFrame, goods: DataFrame) -> DataFrame:
    """Pairs of a shock and a good it applies to (an empty list covers everything).

    Coverage lists and goods are both written as patterns with ``*`` for "any", so the match is
    an equi-join; a shock matches a good through exactly one pattern.
    """
    def pattern(col):
        return F.explode(F.when(F.size(F.coalesce(col, F.array())) <= 0, F.array(F.lit("*")))
                         .otherwise(F.array_distinct(col)))

    asked = shocks.withColumn("p_sector", pattern(F.col("sectors"))).withColumn(
        "p_region", pattern(F.col("regions")))
    offered = goods.select(
        "region", "sector", F.explode(F.array(F.lit("*"), F.col("sector"))).alias("p_sector")
    ).withColumn("p_region", F.explode(F.array(F.lit("*"), F.col("region"))))
    return asked.join(offered, ["p_sector", "p_region"]).drop("p_sector", "p_region")


def shock_levels(shocks: DataFrame, years: DataFrame) -> DataFrame:
    """Shocks with one row per year of their scenario and the level in that year."""
    return shocks.join(years, "scenario_id").withColumn(
        "level", level_at(F.col("path"), F.col("year"), F.col("level")))


def gas_intensity(shocks: DataFrame, goods: DataFrame, satellite: DataFrame) -> DataFrame:
    """CO2-equivalent intensity each carbon shock sees on each good it covers."""
    weight = F.create_map(*[F.lit(v) for kv in {**GWP100, CO2E: 1.0}.items() for v in kv])
    asked = covered_goods(
        shocks.where("type = 'carbon_price'").select(
            "scenario_id", "shock_id", "gases", "sectors", "regions"), goods
    ).select("scenario_id", "shock_id", "region", "sector", F.explode("gases").alias("stressor"))
    return (
        asked.join(satellite.select("stressor", "region", "sector", "intensity"),
                   ["stressor", "region", "sector"])
        .groupBy("scenario_id", "shock_id", "region", "sector")
        .agg(F.sum(weight[F.col("stressor")] * F.col("intensity")).alias("intensity"))
    )


def carbon_cost(shocks: DataFrame, years: DataFrame, goods: DataFrame,
                satellite: DataFrame) -> DataFrame:
    """Direct cost share per scenario, year and good: each shock priced on its own, then summed."""
    price = shock_levels(
        shocks.where("type = 'carbon_price'").select("scenario_id", "shock_id", "level", "path"),
        years,
    ).select("scenario_id", "shock_id", "year", "level")
    return (
        gas_intensity(shocks, goods, satellite).join(price, ["scenario_id", "shock_id"])
        .groupBy("scenario_id", "year", "region", "sector")
        .agg(F.sum(F.col("level") * F.col("intensity") * F.lit(PER_MILLION)).alias("cost"))
    )


def energy_pins(shocks: DataFrame, years: DataFrame, goods: DataFrame) -> DataFrame:
    """Price changes fixed by energy-price shocks; ``spread`` > 0 flags a conflict."""
    energy = shocks.where("type = 'energy_price'").select(
        "scenario_id", "shock_id", "level", "path", "carrier", "sectors", "regions")
    hit = covered_goods(energy, goods).where(F.col("carrier") == F.col("sector"))
    return (
        shock_levels(hit, years).groupBy("scenario_id", "year", "region", "sector")
        .agg(F.max("level").alias("pin"), (F.max("level") - F.min("level")).alias("spread"))
    )


def price_change(price: Propagator, cost: DataFrame, keys=("scenario_id", "year")) -> DataFrame:
    """Full price change of every good reached by the cost vector."""
    solved = price.apply(with_label(cost.select(*keys, "region", "sector", "cost"), "cost"), keys)
    return split_label(solved)


def pinned_price_change(links: DataFrame, cost: DataFrame, pins: DataFrame,
                        keys=("scenario_id", "year")) -> DataFrame:
    """Price change when the goods in ``pins`` keep exactly their given change.

    A pinned good ignores its own cost and receives nothing from its suppliers, but passes its
    price on to its buyers.
    """
    keys = list(keys)
    seed = union_all([
        cost.select(*keys, label().alias("label"), F.col("cost"), F.lit(None).cast("double").alias("pin")),
        pins.select(*keys, label().alias("label"), F.lit(0.0).alias("cost"), "pin"),
    ]).groupBy(*keys, "label").agg(F.sum("cost").alias("cost"), F.max("pin").alias("pin"))
    seed = seed.select(
        *keys, "label", F.coalesce("pin", "cost").alias("value"),
        F.when(F.col("pin").isNull(), 1.0).otherwise(0.0).alias("open"))
    return split_label(iterate(links, seed, keys, damp="open"))


def decompose(price: Propagator, cost: DataFrame, keys=("scenario_id", "year"),
              tiers: int = TIERS) -> DataFrame:
    """Parts of the price change: direct, one row per upstream tier, and everything beyond.

    The remainder is the full propagation of the hop after the last tier, so no difference of
    large numbers is taken and the parts add up to the total.
    """
    keys = list(keys)
    # Each hop feeds the next one and its own part, so it is computed once and kept.
    hop = cut_lineage(with_label(cost.select(*keys, "region", "sector", "cost"), "cost"))
    parts = [hop.withColumn("part", F.lit("direct"))]
    for tier in range(1, tiers + 1):
        hop = cut_lineage(price.step(hop, keys))
        parts.append(hop.withColumn("part", F.lit(f"upstream_tier_{tier}")))
    beyond = price.apply(price.step(hop, keys), keys)
    parts.append(beyond.withColumn("part", F.lit("upstream_residual")))
    return split_label(union_all(parts))


def as_results(df: DataFrame, variable, value="value", band="central") -> DataFrame:
    """Shape rows into the results layout."""
    var = F.lit(variable) if isinstance(variable, str) else variable
    scen = F.lit(band) if isinstance(band, str) else band
    return df.select(
        "scenario_id", var.alias("variable"), "sector", "region",
        F.col("year").cast("int").alias("year"), scen.alias("scenario"),
        F.col(value).alias("value"))


def goods_by_year(goods: DataFrame, years: DataFrame) -> DataFrame:
    """Every good in every scenario year: the row frame of a full result."""
    return goods.select("region", "sector").join(years.select("scenario_id", "year"))


def price_run(price: Propagator, shocks: DataFrame, years: DataFrame, goods: DataFrame,
              satellite: DataFrame, has_pins: bool | None = None) -> DataFrame:
    """Complete price run in the results layout: total and parts for every good and year.

    Scenarios with energy shocks get an extra ``energy_price`` part, the difference the pins make.
    """
    keys = ["scenario_id", "year"]
    cost = carbon_cost(shocks, years, goods, satellite)
    zero = goods_by_year(goods, years).select(*keys, "region", "sector", F.lit(0.0).alias("cost"))
    cost = cut_lineage(union_all([cost, zero]).groupBy(*keys, "region", "sector").agg(
        F.sum("cost").alias("cost")))
    parts = decompose(price, cost, keys)
    names = ["direct", *[f"upstream_tier_{t}" for t in range(1, TIERS + 1)], "upstream_residual"]
    # A good no supplier reaches still reports every part, as zero.
    frame = zero.select(*keys, "region", "sector", F.lit(0.0).alias("value"),
                        F.explode(F.array(*[F.lit(n) for n in names])).alias("part"))
    parts = cut_lineage(union_all([parts, frame]).groupBy(
        *keys, "region", "sector", "part").agg(F.sum("value").alias("value")))
    total = parts.groupBy(*keys, "region", "sector").agg(F.sum("value").alias("value"))
    part_rows = as_results(parts, F.concat(F.lit("price_change_"), F.col("part")))
    if has_pins is None:
        has_pins = not shocks.where("type = 'energy_price'").isEmpty()
    if not has_pins:
        return union_all([as_results(total, "price_change"), part_rows])
    pins = energy_pins(shocks, years, goods)
    pinned_scenarios = shocks.where("type = 'energy_price'").select("scenario_id").distinct()
    seed = cost.join(pinned_scenarios, "scenario_id", "left_semi")
    full = pinned_price_change(price.links, seed, pins, keys)
    energy = union_all([
        full.select(*keys, "region", "sector", "value"),
        total.join(pinned_scenarios, "scenario_id", "left_semi").select(
            *keys, "region", "sector", (-F.col("value")).alias("value")),
    ]).groupBy(*keys, "region", "sector").agg(F.sum("value").alias("value"))
    final = union_all([
        full.select(*keys, "region", "sector", "value"),
        total.join(pinned_scenarios, "scenario_id", "left_anti").select(
            *keys, "region", "sector", "value"),
    ])
    return union_all([
        as_results(final, "price_change"), part_rows,
        as_results(energy, "price_change_energy_price"),
    ]).select(*RESULT_COLUMNS)


def direct_cost(shocks: DataFrame, years: DataFrame, satellite: DataFrame,
                goods: DataFrame, stressor: str = "CO2") -> DataFrame:
    """Cost without pass-through: intensity times the sum of all prices wherever one applies."""
    carbon = shocks.where("type = 'carbon_price'")
    price = carbon.groupBy("scenario_id").agg(F.sum("level").alias("price"))
    touched = covered_goods(
        carbon.select("scenario_id", "sectors", "regions"), goods
    ).select("scenario_id", "region", "sector").distinct()
    value = (
        satellite.where(F.col("stressor") == stressor)
        .join(touched, ["region", "sector"]).join(price, "scenario_id")
        .select("scenario_id", "region", "sector",
                (F.col("intensity") * F.col("price")).alias("value"))
    )
    zero = goods.select("region", "sector").join(years.select("scenario_id").distinct()).select(
        "scenario_id", "region", "sector", F.lit(0.0).alias("value"))
    per_good = union_all([value, zero]).groupBy("scenario_id", "region", "sector").agg(
        F.sum("value").alias("value"))
    return as_results(per_good.join(years, "scenario_id"), "price_change_direct_only")


def weighted_cost(cost: DataFrame, output: DataFrame, by: list[str],
                  home_region: str | None = None) -> DataFrame:
    """Output-weighted mean cost share per ``by`` (sector, or region and sector); 0 without output.

    ``home_region`` restricts the mean to one region's goods.
    """
    keys = ["scenario_id", "year"]
    goods = output if home_region is None else output.where(F.col("region") == home_region)
    joined = goods.join(cost, ["region", "sector"])
    den = goods.groupBy(*by).agg(F.sum("x").alias("x"))
    return (
        joined.groupBy(*keys, *by).agg(F.sum(F.col("cost") * F.col("x")).alias("num"))
        .join(den, by)
        .select(*keys, *by, F.when(F.col("x") > 0, F.col("num") / F.col("x"))
                .otherwise(0.0).alias("cost"))
    )


def unit_price(shocks: DataFrame) -> DataFrame:
    """The same carbon shocks at price 1 without a path: what remains is the covered intensity."""
    return shocks.where("type = 'carbon_price'").withColumn("level", F.lit(1.0)).withColumn(
        "path", F.lit(None).cast("map<int,double>"))


def demand_total(final_demand: DataFrame) -> DataFrame:
    return total_by_label(final_demand)
