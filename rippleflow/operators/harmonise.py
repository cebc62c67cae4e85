"""From raw multi-regional tables to the harmonised long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import checked, demand_institution
from rippleflow.plans.joins import union_all
from rippleflow.schema import INSTITUTIONS
from rippleflow.session import literal_table

# Tonnes per unit of mass.
TONNES_PER_UNIT = {
    "kg": 1e-3, "t": 1.0, "tonnes": 1.0, "tonne": 1.0, "Mt": 1e6, "kt": 1e3, "g": 1e-6,
}
# 100-year warming potential per gas.
GWP100 = {"CO2": 1.0, "CH4": 28.0, "N2O": 265.0}
# Words that mark an extension as holding emissions.
EMISSION_HINTS = ("satellite", "emiss", "ghg")
CO2E = "CO2e"


def lookup_table(spark, values: dict, key: str, value: str) -> DataFrame:
    """A fixed dictionary as a two-column table."""
    return literal_table(
        spark, [(k, float(v)) for k, v in values.items()], f"{key} string, {value} double")


def axis(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct labels of one or more columns."""
    return df.select(*columns).distinct()


def flows_to_coefficients(flows: DataFrame, output: DataFrame) -> DataFrame:
    """a = z / x of the buying label, 0 where it has no positive output or no output row."""
    x = output.select(F.col("region").alias("j_region"), F.col("sector").alias("j_sector"), "x")
    return flows.join(x, ["j_region", "j_sector"], "left").select(
        "i_region", "i_sector", "j_region", "j_sector",
        F.when(F.col("x") > 0, F.col("z") / F.col("x")).otherwise(0.0).alias("a"))


def coefficients_to_flows(coeff: DataFrame, output: DataFrame) -> DataFrame:
    """z = a * x of the buying label."""
    x = output.select(F.col("region").alias("j_region"), F.col("sector").alias("j_sector"), "x")
    return coeff.join(x, ["j_region", "j_sector"]).select(
        "i_region", "i_sector", "j_region", "j_sector", (F.col("a") * F.col("x")).alias("z"))


def demand_by_region(demand_cells: DataFrame) -> DataFrame:
    """Sum demand categories within each consuming region."""
    return demand_cells.groupBy("region", "sector", "d_region").agg(F.sum("value").alias("value"))


def unaligned_producers(labels: DataFrame, demand: DataFrame) -> DataFrame:
    """Producer labels that have no final-demand row at all (an alignment error)."""
    return labels.select("region", "sector").join(demand, ["region", "sector"], "left_anti")


def demand_by_institution(demand_cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Final demand per consuming region and institution, every combination present.

    Exports are trade and drop out. An unknown category is an error (``unknown_categories`` lists
    them).
    """
    kind = demand_institution("category")
    known = demand_cells.withColumn("institution", checked(kind, kind.isNull(), F.concat(
        F.lit("unknown demand category: "), F.coalesce("category", F.lit("(none)"))))).where(
        F.col("institution").isin(*INSTITUTIONS))
    regions = labels.select(F.col("region").alias("d_region")).distinct()
    frame = labels.select("region", "sector").join(regions).select(
        "*", F.explode(F.array(*[F.lit(i) for i in INSTITUTIONS])).alias("institution"),
        F.lit(0.0).alias("value"))
    keys = ["region", "sector", "d_region", "institution"]
    return frame.unionByName(known.select(*keys, "value")).groupBy(*keys).agg(
        F.sum("value").alias("value"))


def unknown_categories(demand_cells: DataFrame) -> DataFrame:
    return demand_cells.where(demand_institution("category").isNull()).select("category").distinct()


def emission_rows(stressors: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Emission stressors with the gas they belong to.

    An extension counts when its name carries an emission hint. A stressor belongs to the gas its
    upper-cased name starts with, or to the gas an alias names for a part of its name.
    """
    hint = F.lit(False)
    for word in EMISSION_HINTS:
        hint = hint | F.lower("extension").contains(word)
    gases = []
    for gas in GWP100:
        rule = F.upper("stressor").startswith(gas)
        for part, target in (aliases or {}).items():
            if target == gas:
                rule = rule | F.col("stressor").contains(part)
        gases.append(F.when(rule, F.lit(gas)))
    return (
        stressors.where(hint)
        .withColumn("gas", F.explode(F.array_compact(F.array(*gases))))
    )


def unknown_units(emissions: DataFrame) -> DataFrame:
    known = list(TONNES_PER_UNIT)
    return emissions.where(F.col("unit").isNull() | ~F.trim("unit").isin(known)).select(
        "stressor", "unit").distinct()


def tonnes_per_unit(unit):
    """The factor of a mass unit; another unit is an error (``unknown_units`` lists them)."""
    factors = F.create_map(*[F.lit(v) for kv in TONNES_PER_UNIT.items()
                             for v in (kv[0], float(kv[1]))])
    factor = factors[F.trim(unit)]
    return checked(factor, factor.isNull(), F.concat(
        F.lit("unknown unit: "), F.coalesce(F.col(unit), F.lit("(none)"))))


def to_tonnes(emissions: DataFrame) -> DataFrame:
    """Tonnes per gas and label."""
    return emissions.groupBy("gas", "region", "sector").agg(
        F.sum(F.col("amount") * tonnes_per_unit("unit")).alias("tonnes"))


def ghg_account(stressors: DataFrame, output: DataFrame, unit: str,
                aliases: dict[str, str] | None = None) -> DataFrame:
    """Emission intensities per gas and in CO2 equivalents: tonnes per unit of gross output.

    One pass: the CO2e row is the warming-weighted copy of every gas row, added before the single
    aggregation. Labels without positive output get 0.
    """
    rows = emission_rows(stressors, aliases)
    gwp = F.create_map(*[F.lit(v) for kv in GWP100.items() for v in kv])
    tonnes = F.col("amount") * tonnes_per_unit("unit")
    both = F.explode(F.array(
        F.struct(F.col("gas").alias("stressor"), tonnes.alias("tonnes")),
        F.struct(F.lit(CO2E).alias("stressor"), (tonnes * gwp[F.col("gas")]).alias("tonnes"))))
    totals = (
        rows.select("region", "sector", both.alias("g")).select("region", "sector", "g.*")
        .groupBy("stressor", "region", "sector").agg(F.sum("tonnes").alias("tonnes"))
    )
    return totals.join(output, ["region", "sector"]).select(
        "stressor", "region", "sector",
        F.when(F.col("x") > 0, F.col("tonnes") / F.col("x")).otherwise(0.0).alias("intensity"),
        F.when(F.col("stressor") == CO2E, F.lit(f"tCO2e/{unit}"))
        .otherwise(F.lit(f"t/{unit}")).alias("unit"))


def total_by_label(final_demand: DataFrame) -> DataFrame:
    """Final demand per producing label over all consumers."""
    return final_demand.groupBy("region", "sector").agg(F.sum("value").alias("value"))


def complete(values: DataFrame, frame: DataFrame, keys: list[str], value: str = "value"):
    """Every row of ``frame`` with its value, 0 where absent (no outer join needed)."""
    zero = frame.select(*keys, F.lit(0.0).alias(value))
    return union_all([zero, values.select(*keys, value)]).groupBy(*keys).agg(
        F.sum(value).alias(value))
