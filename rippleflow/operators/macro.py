"""Macro aggregates: value added, GDP and the deflator, nominal and real."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import checked, label
from rippleflow.operators.leontief import as_results
from rippleflow.plans.joins import union_all
from rippleflow.schema import ECONOMY
from rippleflow.session import cut_lineage

WEIGHT_FLOOR = 1e-12
NEGATIVE_TOLERANCE = 1e-9
MACRO_VARIABLES = ("gva_change", "gva_change_real", "gdp_change", "gdp_change_real", "deflator")


def input_shares(coeff: DataFrame) -> DataFrame:
    """Intermediate input share of every buying label (column sums)."""
    return coeff.groupBy(
        F.col("j_region").alias("region"), F.col("j_sector").alias("sector")
    ).agg(F.sum("a").alias("share"))


def raw_value_added(coeff: DataFrame, output: DataFrame) -> DataFrame:
    """x * (1 - input share) per label, before any clipping."""
    return output.join(input_shares(coeff), ["region", "sector"], "left").select(
        "region", "sector", "x", F.coalesce("share", F.lit(0.0)).alias("share"),
        (F.col("x") * (1.0 - F.coalesce("share", F.lit(0.0)))).alias("va"))


def value_added(coeff: DataFrame, output: DataFrame) -> DataFrame:
    """Base-year value added per good; rounding-sized negatives become 0, larger ones are an error
    (``negative_value_added`` lists them)."""
    raw = raw_value_added(coeff, output)
    scale = raw.agg(F.greatest(F.sum(F.abs("va")), F.lit(1.0)).alias("scale"))
    return raw.join(scale).select("region", "sector", checked(
        F.greatest("va", F.lit(0.0)), F.col("va") < -NEGATIVE_TOLERANCE * F.col("scale"),
        F.concat(F.lit("negative value added: "), label())).alias("va"))


def negative_value_added(coeff: DataFrame, output: DataFrame) -> DataFrame:
    """Goods whose value added is negative beyond rounding (fatal for macro reporting)."""
    raw = raw_value_added(coeff, output)
    scale = raw.agg(F.greatest(F.sum(F.abs("va")), F.lit(1.0)).alias("scale"))
    return raw.join(scale).where(
        F.col("va") < -NEGATIVE_TOLERANCE * F.col("scale")).drop("scale")


def gva_nominal(results: DataFrame, va: DataFrame) -> DataFrame:
    """Per good, year and band: price change, nominal value-added change and the weight.

    Bands come from the volume rows; prices are central and reused in every band. Without volume
    rows a run has the central band only. Goods without a row count as unchanged.
    """
    keys = ["scenario_id", "year"]
    moves = cut_lineage(results.where(F.col("variable").isin("price_change", "volume_change")))
    price = moves.where("variable = 'price_change'").select(
        *keys, "region", "sector", F.col("value").alias("p"))
    volume = moves.where("variable = 'volume_change'").select(
        *keys, "region", "sector", F.col("scenario").alias("band"), F.col("value").alias("q"))
    years = moves.where("variable = 'price_change'").select(*keys).distinct()
    # Bands are a property of the scenario's volume response as a whole.
    band_list = volume.groupBy("scenario_id").agg(F.collect_set("band").alias("bands"))
    frame = years.join(band_list, "scenario_id", "left").select(
        *keys, F.explode(F.coalesce("bands", F.array(F.lit("central")))).alias("band"))
    return (
        va.join(frame)
        .join(price, [*keys, "region", "sector"], "left")
        .join(volume, [*keys, "region", "sector", "band"], "left")
        .withColumn("p", F.coalesce("p", F.lit(0.0)))
        .withColumn("nominal", (1.0 + F.col("p")) * (1.0 + F.coalesce("q", F.lit(0.0))) - 1.0)
        .select(*keys, "band", "region", "sector", "va", "p", "nominal")
    )


def gdp_by_region(moves: DataFrame) -> DataFrame:
    """Value-added weighted deflator and GDP change per region, year and band."""
    agg = moves.groupBy("scenario_id", "year", "band", "region").agg(
        F.sum("va").alias("w"), F.sum(F.col("va") * F.col("p")).alias("wp"),
        F.sum(F.col("va") * F.col("nominal")).alias("wn"))
    ok = F.col("w") > WEIGHT_FLOOR
    return agg.select(
        "scenario_id", "year", "band", "region",
        F.when(ok, F.col("wp") / F.col("w")).otherwise(0.0).alias("deflator"),
        F.when(ok, F.col("wn") / F.col("w")).otherwise(0.0).alias("gdp_change"),
    ).withColumn(
        "gdp_change_real", (1.0 + F.col("gdp_change")) / (1.0 + F.col("deflator")) - 1.0)


def macro_rows(results: DataFrame, va: DataFrame) -> DataFrame:
    """All macro rows of a run in the results layout."""
    moves = cut_lineage(gva_nominal(results, va))
    gdp = gdp_by_region(moves)
    region_rows = gdp.select(
        "scenario_id", "year", "band", "region", F.lit(ECONOMY).alias("sector"),
        F.explode(F.create_map(
            F.lit("deflator"), F.col("deflator"), F.lit("gdp_change"), F.col("gdp_change"),
            F.lit("gdp_change_real"), F.col("gdp_change_real"))).alias("variable", "value"))
    good_rows = moves.join(
        gdp.select("scenario_id", "year", "band", "region", "deflator"),
        ["scenario_id", "year", "band", "region"],
    ).select(
        "scenario_id", "year", "band", "region", "sector",
        F.explode(F.create_map(
            F.lit("gva_change"), F.col("nominal"), F.lit("gva_change_real"),
            (1.0 + F.col("nominal")) / (1.0 + F.col("deflator")) - 1.0,
        )).alias("variable", "value"))
    return as_results(
        region_rows.unionByName(good_rows), F.col("variable"), "value", F.col("band"))


def append_macro(results: DataFrame, va: DataFrame) -> DataFrame:
    """Add the macro rows once: scenarios without price rows or with macro rows stay as they are."""
    results = cut_lineage(results)
    flags = results.groupBy("scenario_id").agg(
        F.max(F.col("variable") == "price_change").alias("priced"),
        F.max(F.col("variable").isin(*MACRO_VARIABLES)).alias("done"))
    due = flags.where("priced AND NOT done").select("scenario_id")
    return union_all([
        results, macro_rows(results.join(due, "scenario_id", "left_semi"), va)])
