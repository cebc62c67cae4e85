"""Queries on result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.functions.labels import label
from rippleflow.operators import leontief, views
from rippleflow.plans import scenario
from rippleflow.plans.joins import union_all
from rippleflow.session import cut_lineage
from rippleflow.workload import q_flows
from rippleflow.workload.common import economy_sql, elasticities, r6, rounded, shocks, with_sql, years
from rippleflow.workload.economy import economy


def _make(spark, d):
    e = economy(spark, d)
    s, y = shocks(spark, "flat", "supply"), years(spark, "flat", "supply")
    run = scenario.run(build_of(spark, d), s, y, "volume")
    # The parts of the price change as the price model reports them.
    cost = leontief.carbon_cost(s, y, e.output, e.satellite)
    parts = leontief.decompose(e.price_propagator, cost)
    part_rows = leontief.as_results(parts, F.concat(F.lit("price_change_"), F.col("part")))
    return cut_lineage(union_all([run, part_rows]))


def build_of(spark, d):
    e = economy(spark, d)
    return scenario.Build(e.coeff, e.output, e.final_demand, e.satellite, e.price_propagator,
                          e.quantity_propagator, elasticities=elasticities(spark))


def results(spark, d):
    e = economy(spark, d)
    return e._memo("results", lambda: _make(spark, d))


def _equilibrium_like(spark, d):
    """The same rows under the names an equilibrium run uses."""
    names = {"gdp_change": "gdp_change_nominal", "deflator": "gdp_deflator_change",
             "gva_change_real": "gva_volume_change", "final_demand_change": "import_change",
             "volume_change": "export_change", "price_change": "factor_price_change",
             "gdp_change_real": "welfare_change", "elasticity_used": "exchange_rate_change"}
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return results(spark, d).where("scenario = 'central'").withColumn(
        "variable", F.coalesce(F.try_element_at(table, F.col("variable")), F.col("variable")))


def run_results(spark, d):
    return rounded(results(spark, d), "value")


def headline(spark, d):
    return rounded(views.headline(results(spark, d)), "value")


def variables(spark, d):
    return views.variables(results(spark, d))


def presence(spark, d):
    return views.presence(results(spark, d)).withColumn("form", F.lit("volume")).unionByName(
        views.presence(_equilibrium_like(spark, d)).withColumn("form", F.lit("equilibrium")))


def waterfall(spark, d):
    return rounded(views.waterfall(results(spark, d), "ASIA", "LARGE"), "value")


def decomposed_goods(spark, d):
    return views.decomposed_goods(results(spark, d))


def summary_stats(spark, d):
    r = results(spark, d)
    out = [views.summary(r, v).withColumn("variable", F.lit(v))
           for v in ("price_change", "volume_change", "gva_change")]
    return rounded(union_all(out), "mean", "max", "min")


def volume_envelope(spark, d):
    return rounded(views.volume_envelope(results(spark, d)), "low", "central", "high")


def gdp_table(spark, d):
    return rounded(views.gdp_table(results(spark, d)), "gdp_change", "deflator", "gdp_change_real")


def gva_table(spark, d):
    return rounded(views.gva_table(results(spark, d)).unionByName(
        views.gva_table(_equilibrium_like(spark, d)).withColumn("scenario_id", F.concat(
            F.lit("eq:"), "scenario_id"))), "gva_nominal", "gva_real")


def trade_table(spark, d):
    return rounded(views.trade_table(_equilibrium_like(spark, d)), "import_change", "export_change")


def factor_and_rate_tables(spark, d):
    r = _equilibrium_like(spark, d)
    f = views.factor_price_table(r).select("scenario_id", "region", "year", "factor",
                                           F.col("factor_price_change").alias("value"))
    x = views.exchange_rate_table(r).groupBy("scenario_id", "region", "year").agg(
        F.max("exchange_rate_change").alias("value")).withColumn("factor", F.lit("rate"))
    return rounded(f.unionByName(x), "value")


def welfare_table(spark, d):
    return rounded(views.welfare_table(_equilibrium_like(spark, d)), "welfare_change", "carbon_revenue")


def macro_headline(spark, d):
    a = views.macro_headline(results(spark, d)).withColumn("form", F.lit("volume"))
    b = views.macro_headline(_equilibrium_like(spark, d)).withColumn("form", F.lit("equilibrium"))
    return rounded(a.unionByName(b), "nominal", "real", "deflator")


def topk(spark, d):
    return rounded(views.top_k(results(spark, d), "volume_change", 12), "value")


def frame_slice(spark, d):
    e = economy(spark, d)
    cells = e.coeff.select(label("i_region", "i_sector").alias("row"),
                           label("j_region", "j_sector").alias("col"), F.col("a").alias("value"))
    return rounded(views.frame_slice(cells, "asia", "e"), "value")


def frame_slice_shown(spark, d):
    """What a display with room for 50 cells shows, and how many columns it leaves out."""
    e = economy(spark, d)
    cells = e.coeff.select(label("i_region", "i_sector").alias("row"),
                           label("j_region", "j_sector").alias("col"), F.col("a").alias("value"))
    return rounded(views.frame_slice(cells, "asia", "e", cell_limit=50), "value")


def frame_labels(spark, d):
    return views.frame_labels(economy(spark, d).coeff)


def volume_series(spark, d):
    return rounded(views.volume_series(results(spark, d)), "value")


QUERIES = {f.__name__: f for f in (
    run_results, headline, variables, presence, waterfall, decomposed_goods, summary_stats,
    volume_envelope, gdp_table, gva_table, trade_table, factor_and_rate_tables, welfare_table,
    macro_headline, topk, frame_slice, frame_slice_shown, frame_labels, volume_series)}

_SLICE = with_sql(economy_sql()) + """,
c AS (SELECT i_region || ':' || i_sector AS row, j_region || ':' || j_sector AS col, a AS value FROM coeff),
h AS (SELECT * FROM c WHERE contains(lower(row), 'asia') AND contains(lower(col), 'e'))"""
_RES = q_flows._VOL_BASE + "," + q_flows._MACRO + """,
res AS MATERIALIZED (SELECT scenario_id, 'final_demand_change' AS variable, sector, region, year, band AS scenario, dy AS value FROM resp
 UNION ALL SELECT scenario_id, 'volume_change', sector, region, year, band, value FROM vol
 UNION ALL SELECT scenario_id, 'price_change', sector, region, year, band, dp FROM resp WHERE band = 'central'
 UNION ALL SELECT scenario_id, 'elasticity_used', sector, region, year, band, e FROM resp WHERE band = 'central'
 UNION ALL SELECT scenario_id, 'productivity_change', sector, region, year, 'central', m - 1 FROM mult WHERE m <> 1
 UNION ALL SELECT scenario_id, 'gva_change', sector, region, year, band, nominal FROM mv
 UNION ALL SELECT scenario_id, 'gva_change_real', sector, region, year, band, (1 + nominal) / (1 + deflator) - 1 FROM mv
  JOIN gdp USING (scenario_id, year, band, region)
 UNION ALL SELECT scenario_id, v.variable, '__economy__', region, year, band, v.value FROM gdp, LATERAL (VALUES
  ('deflator', deflator), ('gdp_change', gdp_change), ('gdp_change_real', (1 + gdp_change) / (1 + deflator) - 1)) AS v(variable, value)
 UNION ALL SELECT scenario_id, 'price_change_' || part, sector, region, year, 'central', value FROM part),
ce AS (SELECT * FROM res WHERE scenario = 'central')"""


def _q(select: str) -> str:
    return _RES + " " + select


_GVA = """SELECT {sid} AS scenario_id, region, sector, year, {n} AS gva_nominal, {r} AS gva_real FROM
 (SELECT scenario_id, region, sector, year, max(CASE WHEN variable = 'gva_change' THEN value END) AS n,
  max(CASE WHEN variable = 'gva_change_real' THEN value END) AS r FROM ce WHERE variable IN ('gva_change', 'gva_change_real') GROUP BY 1, 2, 3, 4)"""
_G3 = """(SELECT scenario_id, region, year, max(CASE WHEN variable = 'gdp_change' THEN value END) AS n,
 max(CASE WHEN variable = 'gdp_change_real' THEN value END) AS r, max(CASE WHEN variable = 'deflator' THEN value END) AS d
 FROM ce WHERE sector = '__economy__' GROUP BY 1, 2, 3)"""

ORACLES = {
    "run_results": _q(f"SELECT scenario_id, variable, sector, region, year, scenario, {r6('value')} AS value FROM res"),
    "headline": _q(f"SELECT scenario_id, region, sector, year, scenario, {r6('value')} AS value FROM res WHERE variable = 'price_change'"),
    "variables": _q("SELECT DISTINCT variable FROM res"),
    "presence": _q("""SELECT bool_or(variable = 'volume_change') AS has_volume, bool_or(variable IN ('gdp_change', 'gdp_change_real')) AS has_macro,
 false AS has_trade, false AS has_factor_prices, false AS has_welfare, 'volume' AS form FROM res UNION ALL
 SELECT false, false, true, true, true, 'equilibrium' FROM (SELECT count(*) FROM res)"""),
    "waterfall": _q(f"""SELECT substring(variable, 14) AS part, CAST(list_position(['direct', 'upstream_tier_1', 'upstream_tier_2',
 'upstream_tier_3', 'upstream_residual'], substring(variable, 14)) AS BIGINT) AS pos, {r6('avg(value)')} AS value FROM res
 WHERE region = 'ASIA' AND sector = 'LARGE' AND variable LIKE 'price_change_%' GROUP BY variable"""),
    "decomposed_goods": _q("SELECT DISTINCT region, sector FROM res WHERE starts_with(variable, 'price_change_')"),
    "summary_stats": _q(f"""SELECT count(*) AS goods, {r6('avg(value)')} AS mean, {r6('max(value)')} AS max, {r6('min(value)')} AS min,
 variable FROM ce WHERE variable IN ('price_change', 'volume_change', 'gva_change') GROUP BY variable"""),
    "volume_envelope": _q(f"""SELECT scenario_id, region, sector, year, {r6("max(CASE WHEN band = 'low' THEN value END)")} AS low,
 {r6("max(CASE WHEN band = 'central' THEN value END)")} AS central, {r6("max(CASE WHEN band = 'high' THEN value END)")} AS high
 FROM vol GROUP BY 1, 2, 3, 4"""),
    "gdp_table": _q(f"SELECT scenario_id, region, year, {r6('n')} AS gdp_change, {r6('d')} AS deflator, {r6('r')} AS gdp_change_real FROM {_G3}"),
    "gva_table": _q(_GVA.format(sid="scenario_id", n=r6("n"), r=r6("r")) + " UNION ALL " + _GVA.format(
        sid="'eq:' || scenario_id", n=r6("n"), r=r6("r"))),
    "trade_table": _q(f"""SELECT scenario_id, region, sector, year, {r6("max(CASE WHEN variable = 'final_demand_change' THEN value END)")} AS import_change,
 {r6("max(CASE WHEN variable = 'volume_change' THEN value END)")} AS export_change FROM ce
 WHERE variable IN ('final_demand_change', 'volume_change') GROUP BY 1, 2, 3, 4"""),
    "factor_and_rate_tables": _q(f"""SELECT scenario_id, region, year, sector AS factor, {r6('value')} AS value FROM ce WHERE variable = 'price_change'
 UNION ALL SELECT scenario_id, region, year, 'rate', {r6('max(value)')} FROM ce WHERE variable = 'elasticity_used' GROUP BY 1, 2, 3"""),
    "welfare_table": _q(f"SELECT scenario_id, region, year, {r6('r')} AS welfare_change, CAST(NULL AS DOUBLE) AS carbon_revenue FROM {_G3}"),
    "macro_headline": _q(f"""SELECT scenario_id, region, year, {r6('n')} AS nominal, {r6('r')} AS real, {r6('d')} AS deflator, 'volume' AS form FROM {_G3}
 UNION ALL SELECT scenario_id, region, year, {r6('n')}, CAST(NULL AS DOUBLE), {r6('d')}, 'equilibrium' FROM {_G3}"""),
    "topk": _q(f"""SELECT scenario_id, region, sector, year, {r6('value')} AS value FROM (SELECT * FROM vol ORDER BY value DESC, scenario_id, region, sector, year LIMIT 12)"""),
    "frame_slice": _SLICE + f" SELECT row, col, {r6('value')} AS value FROM h",
    "frame_slice_shown": _SLICE + f""", k AS (SELECT greatest(1, floor(50 / count(DISTINCT row))) AS room, count(DISTINCT col) AS cols FROM h)
SELECT row, col, {r6('value')} AS value, (SELECT CAST(greatest(cols - room, 0) AS BIGINT) FROM k) AS columns_left_out
FROM h QUALIFY dense_rank() OVER (ORDER BY col) <= (SELECT room FROM k)""",
    "frame_labels": with_sql(economy_sql()) + " SELECT region || ':' || sector AS label, region, sector FROM x",
    "volume_series": _q(f"""SELECT scenario_id, region || ':' || sector AS good, year, scenario, {r6('value')} AS value FROM ce WHERE variable = 'volume_change'"""),
}
