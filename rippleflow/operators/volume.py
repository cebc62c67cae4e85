"""Production-volume response to price changes and productivity shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.functions.labels import checked, label
from rippleflow.operators.harmonise import total_by_label
from rippleflow.operators.leontief import as_results, covered_goods, gross_output, shock_levels
from rippleflow.plans.fixpoint import Propagator
from rippleflow.plans.joins import union_all
from rippleflow.schema import BANDS, ELASTICITY
from rippleflow.session import cut_lineage, literal_table

# The demand elasticity band of a good without an entry of its own.
DEFAULT_ELASTICITY = {"low": -0.8, "central": -0.5, "high": -0.2}

# Own-price demand elasticities of the coarse sectors, their basis and confidence.
COARSE_DEMAND_ELASTICITIES = [
    ("energy_coal", -0.9, -0.5, -0.3, "energy demand meta-analyses (coal is substitutable)", "medium"),
    ("energy_oil_gas", -0.8, -0.4, -0.2, "energy demand literature", "medium"),
    ("electricity", -0.5, -0.3, -0.1, "electricity demand studies (inelastic)", "medium"),
    ("agriculture", -0.6, -0.4, -0.2, "food demand systems (inelastic staples)", "medium"),
    ("mining", -0.9, -0.6, -0.3, "proxy from intermediate-substitution elasticities (derived)", "low"),
    ("chemicals", -1.0, -0.7, -0.4, "proxy from GTAP intermediate-substitution elasticities", "low"),
    ("metals", -1.1, -0.8, -0.5, "proxy from GTAP intermediate-substitution elasticities", "low"),
    ("minerals", -0.9, -0.6, -0.3, "proxy from GTAP intermediate-substitution elasticities", "low"),
    ("manufacturing", -1.3, -0.9, -0.6, "manufactured-goods demand (elastic)", "medium"),
    ("construction", -0.7, -0.5, -0.3, "investment-good demand", "low"),
    ("transport", -1.0, -0.6, -0.3, "transport demand studies", "medium"),
    ("water_waste", -0.4, -0.2, -0.1, "utility demand (very inelastic)", "low"),
    ("trade", -1.2, -0.8, -0.5, "trade-service demand", "low"),
    ("services", -1.0, -0.7, -0.4, "services demand", "medium"),
    ("other", -0.8, -0.5, -0.2, "residual bucket", "default"),
]


def default_elasticities(spark: SparkSession) -> DataFrame:
    """The demand elasticities of a run that brings none, over the coarse sectors."""
    return literal_table(spark, COARSE_DEMAND_ELASTICITIES, ELASTICITY)


def elasticity_by_sector(sectors: DataFrame, elasticities: DataFrame) -> DataFrame:
    """(sector, low, central, high, source, confidence, is_default) with the default band filled in."""
    e = elasticities.withColumnRenamed("key", "sector")
    joined = sectors.select("sector").distinct().join(e, "sector", "left")
    missing = F.col("central").isNull()
    return joined.select(
        "sector",
        *[F.coalesce(F.col(b), F.lit(DEFAULT_ELASTICITY[b])).alias(b) for b in BANDS],
        F.when(missing, F.lit("default")).otherwise(F.coalesce("source", F.lit("unspecified")))
        .alias("source"),
        F.when(missing, F.lit("default")).otherwise(F.coalesce("confidence", F.lit("medium")))
        .alias("confidence"),
        missing.alias("is_default"))


def demand_response(price_ratio, elasticity):
    """Relative demand change of a price ratio 1 + dp at constant elasticity.

    A ratio that is not positive is an error (``non_positive_prices`` lists the goods).
    """
    return checked(F.pow(price_ratio, elasticity) - 1.0, price_ratio <= 0.0, F.concat(
        F.lit("price ratio is not positive: "), price_ratio.cast("string")))


def non_positive_prices(prices: DataFrame) -> DataFrame:
    """Goods whose price ratio is not positive: the response is undefined there."""
    return prices.where(1.0 + F.col("value") <= 0.0)


def productivity_multiplier(shocks: DataFrame, years: DataFrame, goods: DataFrame,
                            floor: float = 0.0) -> DataFrame:
    """Product of (1 + level) over the shocks covering a good, per scenario and year."""
    prod = shocks.where("type = 'productivity'").select(
        "scenario_id", "shock_id", "level", "path", "sectors", "regions")
    hit = shock_levels(covered_goods(prod, goods), years)
    return hit.groupBy("scenario_id", "year", "region", "sector").agg(
        F.greatest(F.product(1.0 + F.col("level")), F.lit(floor)).alias("multiplier"))


def volume_run(quantity: Propagator, prices: DataFrame, final_demand: DataFrame,
               output: DataFrame, elasticities: DataFrame, multiplier: DataFrame) -> DataFrame:
    """Volume results per band from ``prices(scenario_id, year, region, sector, value)``.

    The three bands are rows, so the quantity system is solved once for all bands, years and
    scenarios together.
    """
    keys = ["scenario_id", "year"]
    demand = total_by_label(final_demand).select("region", "sector", checked(
        F.col("value"), F.col("value") < 0, F.concat(F.lit("negative final demand: "), label()))
        .alias("y"))
    output = output.withColumn("x", checked(
        F.col("x"), F.col("x") <= 0, F.concat(F.lit("no positive output: "), label())))
    band = F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).alias("elasticity")) for b in BANDS])).alias("b")
    multiplier = cut_lineage(multiplier)
    response = cut_lineage(
        prices.select(*keys, "region", "sector", F.col("value").alias("dp"))
        .join(elasticity_by_sector(output, elasticities), "sector")
        .select(*keys, "region", "sector", "dp", band)
        .select(*keys, "region", "sector", "dp", "b.band", "b.elasticity")
        .withColumn("dy", demand_response(1.0 + F.col("dp"), F.col("elasticity")))
    )
    new_demand = response.join(demand, ["region", "sector"]).select(
        *keys, "band", "region", "sector", (F.col("y") * (1.0 + F.col("dy"))).alias("value"))
    new_output = gross_output(quantity, new_demand, [*keys, "band"]).withColumnRenamed("x", "x1")
    volume = (
        new_output.join(output, ["region", "sector"])
        .join(multiplier, [*keys, "region", "sector"], "left")
        .select(*keys, "band", "region", "sector",
                ((1.0 + (F.col("x1") - F.col("x")) / F.col("x"))
                 * F.coalesce("multiplier", F.lit(1.0)) - 1.0).alias("value"))
    )
    central = response.where("band = 'central'")
    hit = multiplier.where("multiplier <> 1.0").withColumn("value", F.col("multiplier") - 1.0)
    return union_all([
        as_results(response, "final_demand_change", "dy", F.col("band")),
        as_results(volume, "volume_change", "value", F.col("band")),
        as_results(central, "price_change", "dp"),
        as_results(central, "elasticity_used", "elasticity"),
        as_results(hit, "productivity_change", "value"),
    ])


def bad_volume_inputs(final_demand: DataFrame, output: DataFrame) -> DataFrame:
    """Labels with negative total final demand or without positive output."""
    y = total_by_label(final_demand)
    return union_all([
        y.where("value < 0").select("region", "sector", F.lit("negative_demand").alias("rule")),
        output.where("x <= 0").select("region", "sector", F.lit("no_output").alias("rule")),
    ])


def elasticity_provenance(goods: DataFrame, elasticities: DataFrame) -> DataFrame:
    """One row per sector: the band applied, where it came from, and how many goods use it."""
    per_sector = elasticity_by_sector(goods, elasticities)
    n = goods.groupBy("sector").agg(F.count("*").alias("n_goods"))
    return per_sector.join(n, "sector")
