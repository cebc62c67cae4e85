"""Queries on fixed points with known answers, rule listings and small comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.functions.labels import label, split_label
from rippleflow.operators import compare, concord, harmonise, nature, panel, quality, sam, volume
from rippleflow.operators.leontief import price_links, quantity_links
from rippleflow.plans.fixpoint import Propagator, spectral_bounds
from rippleflow.plans.joins import union_all
from rippleflow.session import literal_table
from rippleflow.workload import inputs, q_flows, q_nature
from rippleflow.workload.common import (
    economy_sql, multiset_sql, parts_sql, r6, rounded, values, with_sql,
)
from rippleflow.workload.economy import economy, read

SLOW = [0.99, 0.9995]
SCALES = [1e12, 1.0]


def fixed_point_scales(spark, d):
    """Demand and a million million times the demand in one pass, by both strategies: output."""
    e = economy(spark, d)
    scale = literal_table(spark, [(s,) for s in SCALES], "factor double")
    seed = e.final_demand.groupBy(label().alias("label")).agg(F.sum("value").alias("y")).join(
        scale).select("factor", "label", (F.col("y") * F.col("factor")).alias("value"))
    links = quantity_links(e.coeff)
    rows = []
    for name, budget in (("square", 1e9), ("walk", 0)):
        got = split_label(Propagator(links, squaring_budget=budget).apply(seed, ["factor"]))
        rows.append(got.select(F.lit(name).alias("strategy"), "factor", "region", "sector",
                               (F.col("value") / F.col("factor")).alias("x")))
    return rounded(union_all(rows), "x", digits=7)


def _with_input_share(coeff, share):
    """The same cells scaled so that every column adds up to ``share``."""
    total = coeff.groupBy("j_region", "j_sector").agg(F.sum("a").alias("s"))
    return coeff.join(total, ["j_region", "j_sector"]).withColumn(
        "a", F.col("a") * share / F.col("s"))


def fixed_point_slow(spark, d):
    """Input shares of 0.99 and 0.9995: one unit of cost on every good costs 100 and 2,000."""
    e = economy(spark, d)
    rows = []
    for share in SLOW:
        links = price_links(_with_input_share(e.coeff, F.lit(share)))
        ones = e.output.select(label().alias("label"), F.lit(1.0).alias("value"))
        rows.append(split_label(Propagator(links).apply(ones)).select(
            F.lit(share).alias("share"), "region", "sector", "value"))
    return rounded(union_all(rows), "value", digits=6)


def spectral_parts(spark, d):
    """Regions without trade are parts of their own: 1.2 in one, 0.5 in the others."""
    e = economy(spark, d)
    own = e.coeff.where("i_region = j_region")
    share = F.when(F.col("j_region") == "ASIA", 1.2).otherwise(0.5)
    got = spectral_bounds(quantity_links(_with_input_share(own, share))).groupBy(
        F.split("system", ":")[0].alias("region")).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    return rounded(got.select(
        "region", "lo", "hi",
        F.when(F.col("hi") < 1, "pass").otherwise("fail").alias("severity")), "lo", "hi", digits=6)


def unaligned_producers(spark, d):
    """Producers none of whose demand cells reaches the mean, if smaller cells are not reported."""
    e = economy(spark, d)
    mean = e.final_demand.agg(F.avg("value").alias("mean"))
    reported = e.final_demand.join(mean).where(F.col("value") > 1.6 * F.col("mean"))
    return harmonise.unaligned_producers(e.output, reported)


def bad_volume_inputs(spark, d):
    """Demand and output with the mean taken off everywhere."""
    e = economy(spark, d)
    demand = harmonise.total_by_label(e.final_demand)
    y = demand.agg(F.avg("value").alias("mean"))
    x = e.output.agg(F.avg("x").alias("mean"))
    return volume.bad_volume_inputs(
        demand.join(y).select("region", "sector", (F.col("value") - F.col("mean")).alias("value")),
        e.output.join(x).select("region", "sector", (F.col("x") - F.col("mean")).alias("x")))


def unmapped_ratings(spark, d):
    """Sectors and processes that a concordance of above-average weights leaves without partner."""
    e = economy(spark, d)
    full = inputs.type_brand(spark, d)
    mean = full.agg(F.avg("weight").alias("mean"))
    part = full.join(mean).where(F.col("weight") > 1.1 * F.col("mean")).select(
        "source", "target", "weight")
    few = part.where("source IN ('ECONOMY', 'LARGE')")
    rated = q_nature.ratings(spark, d).join(
        part.where("source = 'PROMO'").select(F.col("target").alias("process")), "process",
        "left_anti")
    return union_all([
        nature.unrated_sectors(e.output, few).select(
            F.lit("sector").alias("kind"), F.col("sector").alias("item")),
        nature.unknown_processes(part, rated).select(
            F.lit("process").alias("kind"), F.col("process").alias("item"))])


def rest_of_world(spark, d):
    """Two regions under the codes of world-rest blocks."""
    e = economy(spark, d)
    code = F.when(F.col("region") == "ASIA", "wa").when(
        F.col("region") == "AFRICA", "RoW Africa").otherwise(F.col("region"))
    return rounded(quality.rest_of_world_check(e.final_demand.withColumn("region", code)), "value")


def sweep_bands(spark, d):
    """Volume changes of one region in one year as a column per band."""
    runs = q_flows.volume_response(spark, d).where(
        "variable = 'volume_change' AND scenario_id = 'flat' AND region = 'ASIA'").select(
        "sector", "variable", F.col("scenario").alias("band"), "value")
    return compare.sweep_bands(runs)


def active_routes(spark, d):
    """Routes with more trade than the mean."""
    e = economy(spark, d)
    trade = concord.trade_by_route(e.flows, e.final_demand)
    mean = trade.agg(F.avg("value").alias("mean"))
    return sam.active_routes(trade.join(mean).withColumn("share", F.col("value") - F.col("mean")))


def scale_rules(spark, d):
    """Scales from output: its distance to the mean, for known and unknown factors and regions."""
    e = economy(spark, d)
    x = e.output.groupBy("region").agg(F.sum("x").alias("x"))
    endowment = x.select("region", F.lit("CAP").alias("factor"), F.col("x").alias("value"))
    mean = x.agg(F.avg("x").alias("mean"))
    scale = x.join(mean).select(
        F.when(F.col("region") == "ASIA", "LAND").otherwise("CAP").alias("factor"),
        F.when(F.col("region") == "EUROPE", "ATLANTIS").otherwise(F.col("region")).alias("region"),
        (F.col("x") - F.col("mean")).alias("scale"))
    return panel.scale_rules(endowment, scale)


def foreign_savings_shift(spark, d):
    """Shares of the regions in output, of finished against open lines."""
    def share(linestatus):
        x = economy(spark, d, linestatus=linestatus).output.groupBy("region").agg(
            F.sum("x").alias("x"))
        return x.join(x.agg(F.sum("x").alias("all"))).select(
            "region", (F.col("x") / F.col("all")).alias("value"))

    return rounded(compare.foreign_savings_shift(share("F"), share("O")),
                   "foreign_savings_gdp_share", "foreign_savings_change_pp")


def label_bridge(spark, d):
    """The map of part types to groups, for the types above mean output only."""
    e = economy(spark, d)
    x = e.output.groupBy("sector").agg(F.sum("x").alias("x"))
    used = x.join(x.agg(F.avg("x").alias("mean"))).where("x > mean").select(
        F.col("sector").alias("source"))
    return concord.bridge(inputs.sector_groups(spark, d), used)


def default_elasticity_set(spark, d):
    """The default band of the coarse sector that each part size stands for."""
    names = F.array(*[F.lit(row[0]) for row in volume.COARSE_DEMAND_ELASTICITIES])
    parts = read(spark, d, "part").groupBy(F.element_at(names, (F.col("p_size") % 15 + 1).cast(
        "int")).alias("sector")).agg(F.count("*").alias("n_parts"))
    found = volume.elasticity_by_sector(parts, volume.default_elasticities(spark))
    return found.join(parts, "sector").drop("is_default")


def coarse_build_id(spark, d):
    """Ids of the builds of two line states, aggregated by the group and region maps."""
    builds = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("build_id")).distinct()
    return concord.coarse_build_ids(builds, "custom", inputs.sector_groups(spark, d),
                                    inputs.nation_map(spark, d))


QUERIES = {f.__name__: f for f in (
    default_elasticity_set, coarse_build_id, fixed_point_scales, fixed_point_slow, spectral_parts, unaligned_producers, bad_volume_inputs,
    unmapped_ratings, rest_of_world, sweep_bands, active_routes, scale_rules,
    foreign_savings_shift, label_bridge)}

_E = with_sql(economy_sql())

ORACLES = {
    "default_elasticity_set": "WITH " + values(
        "e", "sector, low, central, high, source, confidence, pos",
        [(*row, i) for i, row in enumerate(volume.COARSE_DEMAND_ELASTICITIES)]) + """
SELECT sector, low, central, high, source, confidence, count(*) AS n_parts
FROM part JOIN e ON p_size % 15 = pos GROUP BY ALL""",
    "coarse_build_id": f"""
WITH sg AS (SELECT DISTINCT p_type AS source, m.target, m.weight FROM part, LATERAL (VALUES
  ('goods', CASE WHEN p_type = 'SMALL' THEN 0.25 WHEN p_type IN ('LARGE','MEDIUM','STANDARD') THEN 1.0 ELSE 0.0 END),
  ('other', CASE WHEN p_type = 'SMALL' THEN 0.75 WHEN p_type IN ('LARGE','MEDIUM','STANDARD') THEN 0.0 ELSE 1.0 END))
  AS m(target, weight) WHERE m.weight > 0),
maps AS (SELECT {parts_sql("'sector'", 'source', 'target', "format('{:.10f}', weight::DOUBLE)")} AS t FROM sg
 UNION ALL SELECT {parts_sql("'region'", 'n_name', 'r_name', "'1.0000000000'")} FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT substring(sha256(count(*)::VARCHAR || '|' || {multiset_sql('t')}), 1, 8) AS h FROM maps)
SELECT DISTINCT l_linestatus AS build_id, l_linestatus || '-custom-' || h AS coarse_id FROM lineitem, h""",
    "fixed_point_scales": _E + "," + values("s", "factor", [(s,) for s in SCALES]) + f"""
SELECT strategy, factor, region, sector, {r6('x', 7)} AS x FROM x, s, (VALUES ('square'), ('walk')) AS t(strategy)""",
    "fixed_point_slow": _E + "," + values("s", "share", [(s,) for s in SLOW]) + f"""
SELECT share, region, sector, {r6('1 / (1 - share)', 6)} AS value FROM x, s""",
    "spectral_parts": _E + """
SELECT region, CASE region WHEN 'ASIA' THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END AS lo, CASE region WHEN 'ASIA' THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END AS hi,
 CASE region WHEN 'ASIA' THEN 'fail' ELSE 'pass' END AS severity FROM (SELECT DISTINCT region FROM x)""",
    "unaligned_producers": _E + """
SELECT region, sector FROM x WHERE (region, sector) NOT IN (
 SELECT (region, sector) FROM fd WHERE value > 1.6 * (SELECT avg(value) FROM fd))""",
    "bad_volume_inputs": _E + """,
y AS (SELECT region, sector, sum(value) AS y FROM fd GROUP BY 1, 2)
SELECT region, sector, 'negative_demand' AS rule FROM y WHERE y < (SELECT avg(y) FROM y)
UNION ALL SELECT region, sector, 'no_output' FROM x WHERE x <= (SELECT avg(x) FROM x)""",
    "unmapped_ratings": with_sql(economy_sql(), inputs.SCORES_SQL) + """,
part_ AS (SELECT source, target FROM conc WHERE weight > 1.1 * (SELECT avg(weight) FROM conc)),
rated AS (SELECT DISTINCT process FROM rt WHERE process NOT IN (SELECT target FROM part_ WHERE source = 'PROMO'))
SELECT 'sector' AS kind, sector AS item FROM (SELECT DISTINCT sector FROM x)
 WHERE sector NOT IN (SELECT source FROM part_ WHERE source IN ('ECONOMY', 'LARGE'))
UNION ALL SELECT 'process', target FROM (SELECT DISTINCT target FROM part_) WHERE target NOT IN (SELECT process FROM rated)""",
    "rest_of_world": _E + f""",
s AS (SELECT sum(value) FILTER (region IN ('ASIA', 'AFRICA')) / sum(value) AS v FROM fd)
SELECT 'rest_of_world_share' AS name, CASE WHEN v < 0.35 THEN 'pass' ELSE 'warn' END AS severity,
 {r6('v')} AS value, 0.35::DOUBLE AS tolerance FROM s""",
    "sweep_bands": q_flows._VOL_BASE + f"""
SELECT sector, 'volume_change' AS variable, {r6("max(value) FILTER (band = 'low')")} AS low,
 {r6("max(value) FILTER (band = 'central')")} AS central, {r6("max(value) FILTER (band = 'high')")} AS high
FROM vol WHERE scenario_id = 'flat' AND region = 'ASIA' GROUP BY 1""",
    "active_routes": _E + """,
t AS (SELECT origin, dest, sector, sum(value) AS v FROM (
 SELECT i_region AS origin, j_region AS dest, i_sector AS sector, z AS value FROM z
 UNION ALL SELECT region, d_region, sector, value FROM fd) WHERE origin <> dest GROUP BY 1, 2, 3)
SELECT origin, sector, dest FROM t WHERE v > (SELECT avg(v) FROM t WHERE v <> 0)""",
    "scale_rules": _E + """,
t AS (SELECT region, sum(x) AS x FROM x GROUP BY 1),
s AS (SELECT CASE region WHEN 'ASIA' THEN 'LAND' ELSE 'CAP' END AS factor,
 CASE region WHEN 'EUROPE' THEN 'ATLANTIS' ELSE region END AS region, x - (SELECT avg(x) FROM t) AS scale FROM t)
SELECT 'unknown_factor' AS rule, factor || ':' || region AS item FROM s WHERE factor = 'LAND'
UNION ALL SELECT 'unknown_region', factor || ':' || region FROM s WHERE region NOT IN (SELECT region FROM t)
UNION ALL SELECT 'scale_not_positive', factor || ':' || region FROM s WHERE scale <= 0""",
    "foreign_savings_shift": with_sql(economy_sql()) + f""",
t AS (SELECT o_region AS region, sum(ext) FILTER (ls = 'F') AS f, sum(ext) FILTER (ls = 'O') AS o FROM fl GROUP BY 1),
s AS (SELECT region, f / sum(f) OVER () AS f, o / sum(o) OVER () AS o FROM t)
SELECT region, {r6('o')} AS foreign_savings_gdp_share, {r6('o - f')} AS foreign_savings_change_pp FROM s WHERE abs(o - f) > 1e-12""",
    "label_bridge": with_sql(economy_sql()) + """,
t AS (SELECT sector, sum(x) AS x FROM x GROUP BY 1)
SELECT m.target, t.sector AS source, m.weight FROM t, LATERAL (VALUES
  ('goods', CASE WHEN sector = 'SMALL' THEN 0.25 WHEN sector IN ('LARGE','MEDIUM','STANDARD') THEN 1.0 ELSE 0.0 END),
  ('other', CASE WHEN sector = 'SMALL' THEN 0.75 WHEN sector IN ('LARGE','MEDIUM','STANDARD') THEN 0.0 ELSE 1.0 END))
  AS m(target, weight) WHERE x > (SELECT avg(x) FROM t) AND m.weight > 0""",
}
