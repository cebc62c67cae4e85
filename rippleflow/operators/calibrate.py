"""Share tables read off a SAM: coefficients, factor and budget shares, CES, trade and energy nests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.plans.joins import union_all
from rippleflow.session import cut_lineage

ONE = 1e-12
# Default substitution elasticities of the energy nest.
ENERGY_NEST_ELASTICITIES = {"kle_m": 0.5, "kl_e": 0.5, "energy": 1.5}


def gdp(sam: DataFrame, sectors: list[str], factors: list[str]) -> DataFrame:
    """Total value added of the SAM, one row."""
    return sam.where(F.col("row_acct").isin(*factors) & F.col("col_acct").isin(*sectors)).agg(
        F.sum("value").alias("gdp"))


def normalised(sam: DataFrame, sectors: list[str], factors: list[str]) -> DataFrame:
    """All cells as shares of GDP, so magnitudes are of order one."""
    return cut_lineage(sam.join(gdp(sam, sectors, factors)).select(
        "row_acct", "col_acct", (F.col("value") / F.col("gdp")).alias("value")))


def calibration_shares(sam: DataFrame, sectors: list[str], factors: list[str],
                       household: str = "HOH") -> DataFrame:
    """(parameter, item, sector, value): everything a Cobb-Douglas calibration reads.

    input_coefficient ax, value_added_share, factor_share beta, budget_share gamma, endowment,
    output level.
    """
    m = normalised(sam, sectors, factors)
    row, col, v = F.col("row_acct"), F.col("col_acct"), F.col("value")
    cost = m.where(col.isin(*sectors) & row.isin(*sectors, *factors))
    per_sector = cost.groupBy("col_acct").agg(
        F.sum("value").alias("x"),
        F.sum(F.when(row.isin(*factors), v).otherwise(0.0)).alias("va"))
    cells = cost.join(per_sector, "col_acct")

    def rows(df, name, item, sector, value):
        return df.select(F.lit(name).alias("parameter"), item.alias("item"),
                         sector.alias("sector"), value.alias("value"))

    none = F.lit("")
    fd = m.where((col == household) & row.isin(*sectors))
    fd_total = fd.agg(F.sum("value").alias("t"))
    return union_all([
        rows(cells.where(row.isin(*sectors)), "input_coefficient", row, col, v / F.col("x")),
        rows(cells.where(row.isin(*factors)), "factor_share", row, col, v / F.col("va")),
        rows(per_sector, "value_added_share", none, F.col("col_acct"), F.col("va") / F.col("x")),
        rows(per_sector, "output", none, F.col("col_acct"), F.col("x")),
        rows(fd.join(fd_total), "budget_share", none, row, v / F.col("t")),
        rows(cost.where(row.isin(*factors)).groupBy("row_acct").agg(F.sum("value").alias("value")),
             "endowment", row, none, F.col("value")),
    ])


def institution_parameters(sam: DataFrame, sectors: list[str], factors: list[str],
                           household="HOH", government="GOV", savings="SAVINV") -> DataFrame:
    """(parameter, sector, value): demand shares of government and investment with their rates.

    An institution without benchmark spending takes the household's shares. The tax rate is on
    factor income, the savings rate on income net of tax.
    """
    m = normalised(sam, sectors, factors)
    row, col, v = F.col("row_acct"), F.col("col_acct"), F.col("value")
    names = {household: "hh", government: "gov", savings: "inv"}
    wide = m.where(row.isin(*sectors)).groupBy("row_acct").agg(*[
        F.sum(F.when(col == acct, v).otherwise(0.0)).alias(n) for acct, n in names.items()])
    total = wide.agg(*[F.sum(n).alias(f"{n}_total") for n in names.values()])
    flows = m.agg(
        F.coalesce(F.sum(F.when((row == government) & (col == household), v)), F.lit(0.0))
        .alias("tax"),
        F.coalesce(F.sum(F.when((row == savings) & (col == household), v)), F.lit(0.0))
        .alias("saving"),
        F.sum(F.when(row.isin(*factors) & col.isin(*sectors), v)).alias("income"))
    both = wide.join(total)
    hh = F.col("hh") / F.col("hh_total")
    shares = union_all([
        both.select(F.lit(f"{label}_share").alias("parameter"), F.col("row_acct").alias("sector"),
                    F.when(F.col(f"{n}_total") > 0, F.col(n) / F.col(f"{n}_total"))
                    .otherwise(hh).alias("value"))
        for n, label in (("gov", "government"), ("inv", "investment"))])
    rates = flows.select(F.explode(F.create_map(
        F.lit("tax_rate"), F.col("tax") / F.col("income"),
        F.lit("savings_rate"), F.col("saving") / (F.col("income") - F.col("tax")),
    )).alias("parameter", "value")).select("parameter", F.lit("").alias("sector"), "value")
    return shares.unionByName(rates)


def _group_total(df: DataFrame, keys: list[str], **aggs) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def ces_shares(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """CES shares and the scale that makes unit cost 1, per group of positive input values.

    ``inputs`` is (keys..., input, value, sigma). Shares are proportional to value^(1/sigma); at
    sigma 1 they are the value shares and the scale is the Cobb-Douglas one.
    """
    pos = _group_total(inputs.where("value > 0"), keys, __t=F.sum("value")).withColumn(
        "v", F.col("value") / F.col("__t"))
    cobb = F.abs(F.col("sigma") - 1.0) < ONE
    pos = pos.withColumn("w", F.when(cobb, F.col("v")).otherwise(
        F.pow("v", 1.0 / F.col("sigma"))))
    pos = _group_total(pos, keys, __w=F.sum("w")).withColumn("share", F.col("w") / F.col("__w"))
    scale = pos.groupBy(*keys).agg(
        F.first("sigma").alias("sigma_k"),
        F.sum(-F.col("share") * F.log("share")).alias("entropy"),
        F.sum(F.pow("share", F.col("sigma"))).alias("power"))
    scale = scale.select(
        *keys, F.when(F.abs(F.col("sigma_k") - 1.0) < ONE, F.exp("entropy")).otherwise(
            F.pow("power", 1.0 / (1.0 - F.col("sigma_k")))).alias("scale"))
    return pos.join(scale, keys).select(*keys, "input", "share", "scale")


def value_added_ces(sam: DataFrame, sectors: list[str], factors: list[str],
                    sigma: float) -> DataFrame:
    """CES factor shares and scale of every sector's value added."""
    f = sam.where(F.col("row_acct").isin(*factors) & F.col("col_acct").isin(*sectors)).select(
        F.col("col_acct").alias("sector"), F.col("row_acct").alias("input"), "value",
        F.lit(float(sigma)).alias("sigma"))
    return ces_shares(f, ["sector"])


def _trade_shares(parts: DataFrame, keys: list[str], exponent, curvature) -> DataFrame:
    """Shares proportional to value^exponent and scale total / (sum share*value^k)^(1/k)."""
    pos = parts.where("value > 0").withColumn("w", F.pow("value", exponent)).withColumn(
        "k", curvature)
    pos = _group_total(pos, keys, __w=F.sum("w")).withColumn("share", F.col("w") / F.col("__w"))
    scale = pos.groupBy(*keys).agg(
        F.sum("value").alias("total"), F.first("k").alias("kk"),
        F.sum(F.col("share") * F.pow("value", F.col("k"))).alias("inner"))
    scale = scale.select(*keys, (F.col("total") / F.pow("inner", 1.0 / F.col("kk"))).alias("scale"))
    return pos.join(scale, keys).select(*keys, "partner", "share", "scale")


def armington_shares(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares over the domestic variety and every import origin.

    ``parts`` is (keys..., partner, value, sigma) with partner ``domestic`` or an origin; sigma
    must not be 1.
    """
    s = F.col("sigma")
    return _trade_shares(parts, keys, 1.0 / s, (s - 1.0) / s)


def cet_shares(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares over domestic sales and every export destination (convex frontier)."""
    s = F.col("sigma")
    return _trade_shares(parts, keys, -1.0 / s, (s + 1.0) / s)


def trade_elasticity_rules(parts: DataFrame) -> DataFrame:
    """Trade elasticities must be positive and differ from 1."""
    s = F.col("sigma")
    return parts.where(s.isNull() | F.isnan(s) | (s <= 0) | (F.abs(s - 1.0) < 1e-9)).select(
        F.lit("trade_elasticity").alias("rule"), F.col("partner").alias("item"))


def supply_parts(trade: DataFrame, sigma: float) -> DataFrame:
    """What each region buys of a sector: its own variety and every origin's."""
    return trade.select(
        F.col("dest").alias("region"), "sector",
        F.when(F.col("origin") == F.col("dest"), "domestic").otherwise(F.col("origin"))
        .alias("partner"), "value", F.lit(float(sigma)).alias("sigma"))


def sales_parts(trade: DataFrame, omega: float) -> DataFrame:
    """What each region sells of a sector: at home and to every destination."""
    return trade.select(
        F.col("origin").alias("region"), "sector",
        F.when(F.col("origin") == F.col("dest"), "domestic").otherwise(F.col("dest"))
        .alias("partner"), "value", F.lit(float(omega)).alias("sigma"))


def energy_nest(sam: DataFrame, sectors: list[str], factors: list[str], energy: list[str],
                elasticities: dict[str, float] | None = None) -> DataFrame:
    """(nest, sector, input, share, scale): outer KLE/M, middle KL/E, energy mix, materials mix.

    The materials row carries fixed coefficients (share of the materials bundle, scale 1).
    """
    e = {**ENERGY_NEST_ELASTICITIES, **(elasticities or {})}
    row, col, v = F.col("row_acct"), F.col("col_acct"), F.col("value")
    cells = sam.where(col.isin(*sectors) & row.isin(*sectors, *factors)).withColumn(
        "role", F.when(row.isin(*factors), "KL").when(row.isin(*energy), "E").otherwise("M"))
    by_role = cells.groupBy(F.col("col_acct").alias("sector"), "role").agg(
        F.sum("value").alias("value"))
    outer = by_role.groupBy(
        "sector", F.when(F.col("role") == "M", "M").otherwise("KLE").alias("input")
    ).agg(F.sum("value").alias("value"))

    def nest(df, name, sigma):
        return ces_shares(df.withColumn("sigma", F.lit(float(sigma))), ["sector"]).select(
            F.lit(name).alias("nest"), "sector", "input", "share", "scale")

    commodity = cells.where("role <> 'KL'").select(
        F.col("col_acct").alias("sector"), F.col("row_acct").alias("input"), "role", "value")
    mats = commodity.where("role = 'M' AND value > 0")
    mats = _group_total(mats, ["sector"], __t=F.sum("value")).select(
        F.lit("materials").alias("nest"), "sector", "input",
        (F.col("value") / F.col("__t")).alias("share"), F.lit(1.0).alias("scale"))
    return union_all([
        nest(outer, "outer", e["kle_m"]),
        nest(by_role.where("role <> 'M'").withColumnRenamed("role", "input"), "middle", e["kl_e"]),
        nest(commodity.where("role = 'E'").drop("role"), "energy", e["energy"]),
        mats,
    ])


def energy_ratios(sam: DataFrame, sectors: list[str], factors: list[str],
                  energy: list[str]) -> DataFrame:
    """Benchmark composites per unit of their parent: kle and mat per output, kl and e per KLE."""
    row = F.col("row_acct")
    v = F.col("value")
    t = sam.where(F.col("col_acct").isin(*sectors) & row.isin(*sectors, *factors)).groupBy(
        F.col("col_acct").alias("sector")).agg(
        F.sum("value").alias("x"),
        F.sum(F.when(row.isin(*factors), v).otherwise(0.0)).alias("kl"),
        F.sum(F.when(row.isin(*energy), v).otherwise(0.0)).alias("e"))
    kle = F.col("kl") + F.col("e")

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return t.select("sector", ratio(kle, F.col("x")).alias("kle0"),
                    ratio(F.col("x") - kle, F.col("x")).alias("mat0"),
                    ratio(F.col("kl"), kle).alias("kl0"), ratio(F.col("e"), kle).alias("e0"))


def foreign_savings(sam: DataFrame, rest: str = "ROW", payer: str = "HOH") -> DataFrame:
    """Imports minus exports next to the transfer the SAM records, and their gap."""
    row, col, v = F.col("row_acct"), F.col("col_acct"), F.col("value")

    def total(rule):
        return F.coalesce(F.sum(F.when(rule, v)), F.lit(0.0))

    return sam.agg(
        total((row == rest) & col.startswith("c_")).alias("imports"),
        total(row.startswith("a_") & (col == rest)).alias("exports"),
        (total((row == payer) & (col == rest)) - total((row == rest) & (col == payer)))
        .alias("transfer"),
    ).select("imports", "exports", (F.col("imports") - F.col("exports")).alias("foreign_savings"),
             "transfer",
             (F.col("transfer") - (F.col("imports") - F.col("exports"))).alias("gap"))
