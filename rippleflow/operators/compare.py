"""Benchmark-versus-scenario reporting over two long level tables.

Levels are (region, sector, variable, level), from any source. Variables used here: ``price``,
``demand`` (all final use), ``household`` (household part), ``output``, ``import``, ``export``,
``wage`` and ``factor_use`` (sector = factor), ``factor`` (per sector and factor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.plans.joins import union_all

# Published names of factor-price and factor-use changes.
FACTOR_PRICE_NAMES = {"LAB": "wage_change", "CAP": "capital_return_change"}


def level_change(base: DataFrame, scenario: DataFrame, keys=("region", "sector", "variable"),
                 trade_variables=("import", "export")) -> DataFrame:
    """level / base - 1 per key; trade variables report 0 on a base that is not positive."""
    keys = list(keys)
    joined = base.select(*keys, F.col("level").alias("l0")).join(
        scenario.select(*keys, F.col("level").alias("l1")), keys)
    return joined.select(
        *keys, F.when(F.col("variable").isin(*trade_variables) & (F.col("l0") <= 0), 0.0)
        .otherwise(F.try_divide("l1", "l0") - 1.0).alias("change"))


def _pivot(levels: DataFrame, names: list[str], suffix: str) -> DataFrame:
    return levels.where(F.col("variable").isin(*names)).groupBy("region", "sector").agg(*[
        F.sum(F.when(F.col("variable") == n, F.col("level")).otherwise(0.0)).alias(n + suffix)
        for n in names])


def gdp_measures(base: DataFrame, scenario: DataFrame, routes_base: DataFrame | None = None,
                 routes_scenario: DataFrame | None = None) -> DataFrame:
    """Volume GDP, current-price GDP and their ratio per region.

    Volume values scenario quantities at base prices. With route tables (origin, dest, sector,
    price, quantity) net exports join in, at base route prices for the volume and at the run's
    route prices for the current-price measure.
    """
    b = _pivot(base, ["price", "demand"], "0")
    s = _pivot(scenario, ["price", "demand"], "1")
    per = b.join(s, ["region", "sector"]).groupBy("region").agg(
        F.sum(F.col("price0") * F.col("demand0")).alias("base"),
        F.sum(F.col("price0") * F.col("demand1")).alias("volume"),
        F.sum(F.col("price1") * F.col("demand1")).alias("current"))
    if routes_base is not None and routes_scenario is not None:
        r = routes_base.select("origin", "dest", "sector", F.col("price").alias("p0"),
                               F.col("quantity").alias("q0")).join(
            routes_scenario.select("origin", "dest", "sector", F.col("price").alias("p1"),
                                   F.col("quantity").alias("q1")),
            ["origin", "dest", "sector"]).where("origin <> dest")
        ends = r.select(F.explode(F.array(
            F.struct(F.col("origin").alias("region"), F.lit(1.0).alias("sign")),
            F.struct(F.col("dest").alias("region"), F.lit(-1.0).alias("sign")))).alias("e"),
            "p0", "q0", "p1", "q1")
        net = ends.groupBy(F.col("e.region").alias("region")).agg(
            F.sum(F.col("e.sign") * F.col("p0") * F.col("q0")).alias("nx0"),
            F.sum(F.col("e.sign") * F.col("p0") * F.col("q1")).alias("nx_volume"),
            F.sum(F.col("e.sign") * F.col("p1") * F.col("q1")).alias("nx_current"))
        per = per.join(net, "region", "left").select(
            "region", (F.col("base") + F.coalesce("nx0", F.lit(0.0))).alias("base"),
            (F.col("volume") + F.coalesce("nx_volume", F.lit(0.0))).alias("volume"),
            (F.col("current") + F.coalesce("nx_current", F.lit(0.0))).alias("current"))
    return per.select(
        "region", (F.col("volume") / F.col("base") - 1.0).alias("gdp_change_real"),
        (F.col("current") / F.col("base") - 1.0).alias("gdp_change_nominal"),
        (F.col("current") / F.col("volume") - 1.0).alias("gdp_deflator_change"))


def utility_change(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Cobb-Douglas utility change per region, base household budget shares as exponents."""
    p0 = _pivot(base, ["price", "household"], "0")
    p1 = _pivot(scenario, ["household"], "1")
    spend = p0.withColumn("spend", F.col("price0") * F.col("household0"))
    total = spend.groupBy("region").agg(F.sum("spend").alias("total"))
    gamma = F.col("spend") / F.col("total")
    return spend.join(total, "region").join(p1, ["region", "sector"]).where(gamma > 0).groupBy(
        "region").agg((F.exp(F.sum(gamma * (F.log("household1") - F.log("household0")))) - 1.0)
                      .alias("welfare_change"))


def consumption_change(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Household consumption volume at base prices, per region."""
    joined = _pivot(base, ["price", "household"], "0").join(
        _pivot(scenario, ["household"], "1"), ["region", "sector"])
    return joined.groupBy("region").agg(
        (F.sum(F.col("price0") * F.col("household1"))
         / F.sum(F.col("price0") * F.col("household0")) - 1.0).alias("consumption_change"))


def covered_emissions(base: DataFrame, scenario: DataFrame, intensity: DataFrame) -> DataFrame:
    """Change of intensity-weighted output per region, absent where the base is nothing."""
    o = _pivot(base, ["output"], "0").join(_pivot(scenario, ["output"], "1"), ["region", "sector"])
    agg = o.join(intensity, ["region", "sector"]).groupBy("region").agg(
        F.sum(F.col("intensity") * F.col("output0")).alias("e0"),
        F.sum(F.col("intensity") * F.col("output1")).alias("e1"))
    return agg.where("e0 > 1e-15").select(
        "region", (F.col("e1") / F.col("e0") - 1.0).alias("covered_emissions_change"))


def value_added_changes(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Income (wage times use) and volume (use) change per sector.

    Both tables are (region, sector, factor, wage, quantity).
    """
    def agg(df, n):
        return df.groupBy("region", "sector").agg(
            F.sum(F.col("wage") * F.col("quantity")).alias("income" + n),
            F.sum("quantity").alias("volume" + n))

    return agg(base, "0").join(agg(scenario, "1"), ["region", "sector"]).select(
        "region", "sector", (F.col("income1") / F.col("income0") - 1.0).alias("gva_income_change"),
        (F.col("volume1") / F.col("volume0") - 1.0).alias("gva_volume_change"))


def factor_changes(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """(region, factor, variable, change): factor prices, their published names, factor use."""
    def agg(df, n):
        return df.groupBy("region", "factor").agg(
            F.max("wage").alias("wage" + n), F.sum("quantity").alias("use" + n))

    j = agg(base, "0").join(agg(scenario, "1"), ["region", "factor"])
    price = j.select("region", "factor", (F.col("wage1") / F.col("wage0") - 1.0).alias("change"))
    names = F.create_map(*[F.lit(v) for kv in FACTOR_PRICE_NAMES.items() for v in kv])
    named = price.withColumn("variable", F.try_element_at(names, F.col("factor"))).where(
        "variable IS NOT NULL")
    use = j.select(
        "region", "factor", (F.col("use1") / F.col("use0") - 1.0).alias("change"),
        F.when(F.col("factor") == "LAB", "employment_change").otherwise(
            F.concat(F.lit("factor_use_change_"), F.col("factor"))).alias("variable"))
    return union_all([
        price.withColumn("variable", F.lit("factor_price_change")), named, use
    ]).select("region", "factor", "variable", "change")


def shares_of_gdp(amounts: DataFrame, base_gdp: DataFrame) -> DataFrame:
    """Amounts (region, variable, amount) as shares of the region's own base GDP."""
    return amounts.join(base_gdp, "region").select(
        "region", "variable", (F.col("amount") / F.col("gdp")).alias("value"))


def foreign_savings_shift(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Level and point change of foreign savings (region, value) where it moved."""
    return base.select("region", F.col("value").alias("v0")).join(
        scenario.select("region", F.col("value").alias("v1")), "region").where(
        F.abs(F.col("v1") - F.col("v0")) > 1e-12).select(
        "region", F.col("v1").alias("foreign_savings_gdp_share"),
        (F.col("v1") - F.col("v0")).alias("foreign_savings_change_pp"))


def energy_output_change(base: DataFrame, scenario: DataFrame, energy: list[str]) -> DataFrame:
    """Output volume change of the energy sectors together, per region."""
    o = _pivot(base, ["output"], "0").join(_pivot(scenario, ["output"], "1"), ["region", "sector"])
    return o.where(F.col("sector").isin(*energy)).groupBy("region").agg(
        (F.sum("output1") / F.sum("output0") - 1.0).alias("energy_sector_output_volume_change"))


def sweep_bands(runs: DataFrame,
                variables=("volume_change", "import_change", "export_change")) -> DataFrame:
    """One row per (sector, variable) with a column per band of a sensitivity sweep, sorted."""
    return (
        runs.where(F.col("variable").isin(*variables)).groupBy("sector", "variable")
        .pivot("band", ["low", "central", "high"]).agg(F.first("value"))
        .orderBy("variable", "sector")
    )
