"""Queries on flows, emissions, prices, volumes and macro aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.functions.labels import demand_institution, label
from rippleflow.operators import harmonise, leontief, macro, volume
from rippleflow.plans.joins import union_all
from rippleflow.workload.common import (
    COST_SQL, COVERED, ELASTICITIES, PARTS, economy_sql, elasticities, r6, rounded, shock_sql,
    shocks, values, with_sql, years,
)
from rippleflow.workload.economy import economy

KEYS = ["scenario_id", "year"]


def leontief_output(spark, d):
    e = economy(spark, d)
    return rounded(leontief.gross_output(e.quantity_propagator, e.final_demand), "x")


def leontief_output_nation(spark, d):
    e = economy(spark, d, "nation")
    return rounded(leontief.gross_output(e.quantity_propagator, e.final_demand), "x")


def label_axes(spark, d):
    e = economy(spark, d)
    flat = e.output.select(label().alias("label"))
    from rippleflow.functions.labels import split_label
    return split_label(flat).withColumn("label", label())


def flow_identity(spark, d):
    """Coefficients to flows and back, next to the flows they came from."""
    e = economy(spark, d)
    z = harmonise.coefficients_to_flows(e.coeff, e.output)
    back = harmonise.flows_to_coefficients(z, e.output)
    return rounded(z.join(back, ["i_region", "i_sector", "j_region", "j_sector"]), "z", "a")


def final_demand_by_region(spark, d):
    e = economy(spark, d)
    return rounded(harmonise.demand_by_region(e.demand_cells), "value")


def demand_categories(spark, d):
    e = economy(spark, d)
    return rounded(e.demand_cells.groupBy("category").agg(F.sum("value").alias("value")).withColumn(
        "institution", demand_institution("category")), "value")


def final_demand_by_institution(spark, d):
    e = economy(spark, d)
    return rounded(harmonise.demand_by_institution(e.demand_cells, e.output), "value")


def stressor_tonnes(spark, d):
    e = economy(spark, d)
    return rounded(harmonise.to_tonnes(harmonise.emission_rows(e.stressors)), "tonnes", digits=3)


def ghg_account(spark, d):
    e = economy(spark, d)
    return rounded(e.satellite, "intensity")


def carbon_cost(spark, d):
    e = economy(spark, d)
    return rounded(leontief.carbon_cost(shocks(spark), years(spark), e.output, e.satellite),
                   "cost", digits=9)


def price_change(spark, d):
    e = economy(spark, d)
    cost = leontief.carbon_cost(shocks(spark, "flat", "path"), years(spark, "flat", "path"),
                                e.output, e.satellite)
    return rounded(leontief.price_change(e.price_propagator, cost), "value", digits=8)


def price_decompose(spark, d):
    e = economy(spark, d)
    cost = leontief.carbon_cost(shocks(spark, "flat", "path"), years(spark, "flat", "path"),
                                e.output, e.satellite)
    return rounded(leontief.decompose(e.price_propagator, cost), "value", digits=8)


def price_pinned(spark, d):
    e = economy(spark, d)
    s, y = shocks(spark, "energy"), years(spark, "energy")
    cost = leontief.carbon_cost(s, y, e.output, e.satellite)
    pins = leontief.energy_pins(s, y, e.output)
    return rounded(leontief.pinned_price_change(e.price_propagator.links, cost, pins), "value",
                   digits=8)


def price_run(spark, d):
    e = economy(spark, d)
    s, y = shocks(spark, "flat", "energy"), years(spark, "flat", "energy")
    return rounded(leontief.price_run(e.price_propagator, s, y, e.output, e.satellite, True),
                   "value", digits=8)


def energy_pins(spark, d):
    e = economy(spark, d)
    return leontief.energy_pins(shocks(spark), years(spark), e.output)


def direct_cost(spark, d):
    e = economy(spark, d)
    s, y = shocks(spark, "flat", "path"), years(spark, "flat", "path")
    return rounded(leontief.direct_cost(s, y, e.satellite, e.output), "value", digits=4)


def covered_goods(spark, d):
    e = economy(spark, d)
    return leontief.covered_goods(shocks(spark).select(
        "scenario_id", "shock_id", "sectors", "regions"), e.output).select(
        "scenario_id", "shock_id", "region", "sector")


def sector_cost_weighted(spark, d):
    e = economy(spark, d)
    cost = leontief.carbon_cost(shocks(spark), years(spark), e.output, e.satellite)
    closed = leontief.weighted_cost(cost, e.output, ["sector"]).select(
        F.lit("closed").alias("form"), *KEYS, F.lit("").alias("region"), "sector", "cost")
    home = leontief.weighted_cost(cost, e.output, ["sector"], home_region="ASIA").select(
        F.lit("open").alias("form"), *KEYS, F.lit("ASIA").alias("region"), "sector", "cost")
    multi = leontief.weighted_cost(cost, e.output, ["region", "sector"]).select(
        F.lit("multi").alias("form"), *KEYS, "region", "sector", "cost")
    return rounded(union_all([closed, home, multi]), "cost", digits=9)


def sector_intensity(spark, d):
    """The same mean with every price set to one."""
    e = economy(spark, d)
    unit = leontief.unit_price(shocks(spark, "path"))
    cost = leontief.carbon_cost(unit, years(spark, "path"), e.output, e.satellite)
    return rounded(leontief.weighted_cost(cost, e.output, ["sector"]), "cost", digits=10)


def elasticity_lookup(spark, d):
    e = economy(spark, d)
    return volume.elasticity_provenance(e.output, elasticities(spark))


def productivity_multiplier(spark, d):
    e = economy(spark, d)
    return rounded(volume.productivity_multiplier(
        shocks(spark, "supply"), years(spark, "supply"), e.output), "multiplier")


def _volume(spark, d):
    e = economy(spark, d)
    s, y = shocks(spark, "flat", "supply"), years(spark, "flat", "supply")
    cost = leontief.carbon_cost(s, y, e.output, e.satellite)
    dp = leontief.price_change(e.price_propagator, cost)
    return volume.volume_run(
        e.quantity_propagator, dp, e.final_demand, e.output, elasticities(spark),
        volume.productivity_multiplier(s, y, e.output))


def volume_response(spark, d):
    return rounded(_volume(spark, d), "value", digits=8)


def value_added(spark, d):
    e = economy(spark, d)
    return rounded(macro.value_added(e.coeff, e.output), "va")


def macro_gva(spark, d):
    e = economy(spark, d)
    rows = macro.macro_rows(_volume(spark, d), macro.value_added(e.coeff, e.output))
    return rounded(rows.where("variable LIKE 'gva%'"), "value", digits=8)


def macro_gdp(spark, d):
    e = economy(spark, d)
    rows = macro.macro_rows(_volume(spark, d), macro.value_added(e.coeff, e.output))
    return rounded(rows.where("sector = '__economy__'"), "value", digits=8)


def macro_append_once(spark, d):
    """Appending twice adds the macro rows once: row counts per variable and band."""
    e = economy(spark, d)
    va = macro.value_added(e.coeff, e.output)
    s, y = shocks(spark, "flat"), years(spark, "flat")
    cost = leontief.carbon_cost(s, y, e.output, e.satellite)
    base = leontief.as_results(leontief.price_change(e.price_propagator, cost), "price_change")
    twice = macro.append_macro(macro.append_macro(base, va), va)
    return twice.groupBy("variable", "scenario").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    leontief_output, leontief_output_nation, label_axes, flow_identity, final_demand_by_region,
    demand_categories, final_demand_by_institution, stressor_tonnes, ghg_account, covered_goods,
    carbon_cost, price_change, price_decompose, energy_pins, price_pinned, price_run, direct_cost,
    sector_cost_weighted, sector_intensity, elasticity_lookup, productivity_multiplier,
    volume_response, value_added, macro_gva, macro_gdp, macro_append_once)}

_QIT = """
qit AS (SELECT 0 AS step, region, sector, sum(value) AS term FROM fd GROUP BY 1, 2, 3 UNION ALL
  SELECT q.step + 1, c.i_region, c.i_sector, sum(c.a * q.term) FROM qit q
  JOIN coeff c ON c.j_region = q.region AND c.j_sector = q.sector WHERE q.step < {steps}
  GROUP BY 1, 2, 3)"""


def _output_sql(grain, steps):
    return with_sql(economy_sql(grain), _QIT.format(steps=steps)) + (
        f" SELECT region, sector, {r6('sum(term)')} AS x FROM qit GROUP BY 1, 2")


_INST = ("CASE WHEN category ILIKE '%export%' THEN 'export' WHEN category ILIKE '%government%' "
         "THEN 'government' WHEN category ILIKE '%household%' OR category ILIKE '%npish%' THEN "
         "'household' ELSE 'investment' END")

_PINNED = """
pin AS (SELECT s.scenario_id, s.year, g.region, g.sector, max(s.level) AS pin
  FROM shock s JOIN x g ON g.sector = s.carrier AND """ + COVERED + """
  WHERE s.type = 'energy_price' GROUP BY 1, 2, 3, 4),
seed AS MATERIALIZED (SELECT y.scenario_id, y.year, x.region, x.sector, coalesce(p.pin, c.cost, 0.0) AS v,
  p.pin IS NOT NULL AS fixed FROM yr y CROSS JOIN x
  LEFT JOIN cost c USING (scenario_id, year, region, sector)
  LEFT JOIN pin p USING (scenario_id, year, region, sector)),
fit AS (SELECT 0 AS step, scenario_id, year, region, sector, v AS term FROM seed UNION ALL
  SELECT f.step + 1, f.scenario_id, f.year, c.j_region, c.j_sector, sum(c.a * f.term)
  FROM fit f JOIN coeff c ON c.i_region = f.region AND c.i_sector = f.sector
  JOIN seed s ON s.scenario_id = f.scenario_id AND s.year = f.year AND s.region = c.j_region
  AND s.sector = c.j_sector AND NOT s.fixed WHERE f.step < 60 GROUP BY 1, 2, 3, 4, 5),
full_p AS MATERIALIZED (SELECT scenario_id, year, region, sector, sum(term) AS value FROM fit GROUP BY 1, 2, 3, 4)"""

_ELAST = values("el", "sector, low, central, high, source, confidence", ELASTICITIES)
_BANDS = """
es AS (SELECT x.sector, coalesce(el.low, -0.8) AS low, coalesce(el.central, -0.5) AS central,
  coalesce(el.high, -0.2) AS high, coalesce(el.source, 'default') AS source,
  coalesce(el.confidence, 'default') AS confidence, el.sector IS NULL AS is_default,
  count(*) AS n_goods FROM x LEFT JOIN el USING (sector) GROUP BY ALL)"""
_MULT = f"""
mult AS (SELECT s.scenario_id, s.year, g.region, g.sector, greatest(product(1 + s.level), 0.0) AS m
  FROM shock s JOIN x g ON {COVERED} WHERE s.type = 'productivity' GROUP BY 1, 2, 3, 4)"""
_VOL = """
resp AS (SELECT d.scenario_id, d.year, d.region, d.sector, b.band, d.value AS dp, b.e,
  pow(1 + d.value, b.e) - 1 AS dy FROM dp d JOIN es USING (sector),
  LATERAL (VALUES ('low', es.low), ('central', es.central), ('high', es.high)) AS b(band, e)),
y0 AS (SELECT region, sector, sum(value) AS y FROM fd GROUP BY 1, 2),
vit AS (SELECT 0 AS step, scenario_id, year, band, region, sector, y * (1 + dy) AS term
  FROM resp JOIN y0 USING (region, sector) UNION ALL
  SELECT v.step + 1, v.scenario_id, v.year, v.band, c.i_region, c.i_sector, sum(c.a * v.term)
  FROM vit v JOIN coeff c ON c.j_region = v.region AND c.j_sector = v.sector WHERE v.step < 60
  GROUP BY 1, 2, 3, 4, 5, 6),
x1 AS (SELECT scenario_id, year, band, region, sector, sum(term) AS x1 FROM vit GROUP BY ALL),
vol AS MATERIALIZED (SELECT scenario_id, year, band, region, sector, (1 + (x1 - x) / x) * coalesce(m, 1.0) - 1 AS value
  FROM x1 JOIN x USING (region, sector) LEFT JOIN mult USING (scenario_id, year, region, sector))"""
_MACRO = """
va AS (SELECT x.region, x.sector, greatest(x.x * (1 - coalesce(s.s, 0)), 0.0) AS va FROM x
  LEFT JOIN (SELECT j_region AS region, j_sector AS sector, sum(a) AS s FROM coeff GROUP BY 1, 2) s
  USING (region, sector)),
mv AS MATERIALIZED (SELECT v.scenario_id, v.year, v.band, v.region, v.sector, va.va, dp.value AS p,
  (1 + dp.value) * (1 + v.value) - 1 AS nominal FROM vol v
  JOIN dp USING (scenario_id, year, region, sector) JOIN va USING (region, sector)),
gdp AS (SELECT scenario_id, year, band, region, sum(va * p) / sum(va) AS deflator,
  sum(va * nominal) / sum(va) AS gdp_change FROM mv GROUP BY 1, 2, 3, 4)"""
_VOL_BASE = with_sql(economy_sql(), shock_sql("flat", "supply"), COST_SQL, _ELAST, _BANDS, _MULT,
                     _VOL)

ORACLES = {
    "leontief_output": _output_sql("region", 60),
    "leontief_output_nation": _output_sql("nation", 200),
    "label_axes": with_sql(economy_sql()) + (
        " SELECT concat_ws(':', region, sector) AS label, region, sector FROM x"),
    "flow_identity": with_sql(economy_sql()) + (
        f" SELECT i_region, i_sector, j_region, j_sector, {r6('z')} AS z, {r6('a')} AS a FROM coeff"),
    "final_demand_by_region": with_sql(economy_sql()) + (
        f" SELECT region, sector, d_region, {r6('value')} AS value FROM fd"),
    "demand_categories": with_sql(economy_sql()) + (
        f" SELECT category, {r6('sum(value)')} AS value, {_INST} AS institution FROM cat GROUP BY category"),
    "final_demand_by_institution": with_sql(economy_sql()) + f"""
SELECT g.region, g.sector, r.region AS d_region, i.institution,
  {r6('coalesce(sum(c.value), 0)')} AS value FROM x g CROSS JOIN (SELECT DISTINCT region FROM x) r
CROSS JOIN (VALUES ('household'), ('government'), ('investment')) i(institution)
LEFT JOIN (SELECT *, {_INST} AS institution FROM cat) c ON c.region = g.region
  AND c.sector = g.sector AND c.d_region = r.region AND c.institution = i.institution
GROUP BY 1, 2, 3, 4""",
    "stressor_tonnes": with_sql(economy_sql()) + f"""
SELECT s.gas, region, sector, {r6('s.t', 3)} AS tonnes FROM tons,
LATERAL (VALUES ('CO2', co2), ('CH4', ch4), ('N2O', n2o)) AS s(gas, t)""",
    "ghg_account": with_sql(economy_sql()) + (
        f" SELECT stressor, region, sector, {r6('intensity')} AS intensity, unit FROM sat"),
    "covered_goods": with_sql(economy_sql(), shock_sql()) + f"""
SELECT DISTINCT s.scenario_id, s.shock_id, g.region, g.sector FROM shock s JOIN x g ON {COVERED}""",
    "carbon_cost": with_sql(economy_sql(), shock_sql(), COST_SQL) + (
        f" SELECT scenario_id, year, region, sector, {r6('cost', 9)} AS cost FROM cost"),
    "price_change": with_sql(economy_sql(), shock_sql("flat", "path"), COST_SQL) + (
        f" SELECT scenario_id, year, region, sector, {r6('value', 8)} AS value FROM dp"),
    "price_decompose": with_sql(economy_sql(), shock_sql("flat", "path"), COST_SQL) + (
        f" SELECT scenario_id, year, region, sector, part, {r6('value', 8)} AS value FROM part"),
    "energy_pins": with_sql(economy_sql(), shock_sql()) + f"""
SELECT s.scenario_id, s.year, g.region, g.sector, max(s.level) AS pin,
  max(s.level) - min(s.level) AS spread FROM shock s JOIN x g ON g.sector = s.carrier AND {COVERED}
WHERE s.type = 'energy_price' GROUP BY 1, 2, 3, 4""",
    "price_pinned": with_sql(economy_sql(), shock_sql("energy"), COST_SQL, _PINNED) + (
        f" SELECT scenario_id, year, region, sector, {r6('value', 8)} AS value FROM full_p"),
    "price_run": with_sql(economy_sql(), shock_sql("flat", "energy"), COST_SQL, _PINNED, values(
        "pname", "part", [(p,) for p in PARTS])) + f""",
rows AS (SELECT y.scenario_id, 'price_change_' || n.part AS variable, x.sector, x.region, y.year,
  coalesce(p.value, 0.0) AS value FROM yr y CROSS JOIN x CROSS JOIN pname n
  LEFT JOIN part p ON p.scenario_id = y.scenario_id AND p.year = y.year AND p.region = x.region
  AND p.sector = x.sector AND p.part = n.part
 UNION ALL SELECT scenario_id, 'price_change', sector, region, year, value FROM dp
  WHERE scenario_id = 'flat'
 UNION ALL SELECT scenario_id, 'price_change', sector, region, year, value FROM full_p
  WHERE scenario_id = 'energy'
 UNION ALL SELECT f.scenario_id, 'price_change_energy_price', f.sector, f.region, f.year,
  f.value - dp.value FROM full_p f JOIN dp USING (scenario_id, year, region, sector)
  WHERE f.scenario_id = 'energy')
SELECT scenario_id, variable, sector, region, year, 'central' AS scenario, {r6('value', 8)} AS value
FROM rows""",
    "direct_cost": with_sql(economy_sql(), shock_sql("flat", "path")) + f""",
price AS (SELECT * FROM (VALUES ('flat', 100.0), ('path', 40.0)) t(scenario_id, price))
SELECT y.scenario_id, 'price_change_direct_only' AS variable, g.sector, g.region, y.year,
  'central' AS scenario, {r6('''CASE WHEN EXISTS (SELECT 1 FROM shock s WHERE
  s.scenario_id = y.scenario_id AND ''' + COVERED + ''') THEN sat.intensity * p.price ELSE 0.0 END''', 4)} AS value
FROM yr y JOIN price p USING (scenario_id) CROSS JOIN x g
JOIN sat ON sat.stressor = 'CO2' AND sat.region = g.region AND sat.sector = g.sector""",
    "sector_cost_weighted": with_sql(economy_sql(), shock_sql(), COST_SQL) + f""",
f AS (SELECT y.scenario_id, y.year, x.region, x.sector, x.x, c.cost FROM
  (SELECT DISTINCT scenario_id, year FROM cost) y CROSS JOIN x
  LEFT JOIN cost c USING (scenario_id, year, region, sector))
SELECT 'closed' AS form, scenario_id, year, '' AS region, sector,
  {r6('sum(cost * x) / sum(x)', 9)} AS cost FROM f GROUP BY 1, 2, 3, 4, 5 HAVING count(cost) > 0
UNION ALL SELECT 'open', scenario_id, year, 'ASIA', sector, {r6('sum(cost * x) / sum(x)', 9)}
FROM f WHERE region = 'ASIA' GROUP BY 1, 2, 3, 4, 5 HAVING count(cost) > 0
UNION ALL SELECT 'multi', scenario_id, year, region, sector, {r6('cost', 9)} FROM f
WHERE cost IS NOT NULL""",
    "sector_intensity": with_sql(economy_sql(), shock_sql("path").replace(
        "CAST(50.0 AS DOUBLE)", "1.0").replace("CAST(75.0 AS DOUBLE)", "1.0").replace(
        "CAST(100.0 AS DOUBLE)", "1.0").replace("CAST(30.0 AS DOUBLE)", "1.0"), COST_SQL) + f"""
SELECT c.scenario_id, c.year, c.sector, {r6('sum(c.cost * x.x) / max(t.x)', 10)} AS cost FROM cost c
JOIN x USING (region, sector) JOIN (SELECT sector, sum(x) AS x FROM x GROUP BY 1) t USING (sector)
GROUP BY 1, 2, 3""",
    "elasticity_lookup": with_sql(economy_sql(), _ELAST, _BANDS) + " SELECT * FROM es",
    "productivity_multiplier": with_sql(economy_sql(), shock_sql("supply"), _MULT) + (
        f" SELECT scenario_id, year, region, sector, {r6('m')} AS multiplier FROM mult"),
    "volume_response": _VOL_BASE + f""",
rows AS (SELECT scenario_id, 'final_demand_change' AS variable, sector, region, year, band, dy AS v
 FROM resp UNION ALL SELECT scenario_id, 'volume_change', sector, region, year, band, value FROM vol
 UNION ALL SELECT scenario_id, 'price_change', sector, region, year, band, dp FROM resp
 WHERE band = 'central' UNION ALL SELECT scenario_id, 'elasticity_used', sector, region, year, band,
 e FROM resp WHERE band = 'central' UNION ALL SELECT scenario_id, 'productivity_change', sector,
 region, year, 'central', m - 1 FROM mult WHERE m <> 1)
SELECT scenario_id, variable, sector, region, year, band AS scenario, {r6('v', 8)} AS value FROM rows""",
    "value_added": with_sql(economy_sql()) + f"""
SELECT x.region, x.sector, {r6('greatest(x.x * (1 - coalesce(s.s, 0)), 0)')} AS va FROM x
LEFT JOIN (SELECT j_region AS region, j_sector AS sector, sum(a) AS s FROM coeff GROUP BY 1, 2) s
USING (region, sector)""",
    "macro_gva": _VOL_BASE + "," + _MACRO + f"""
SELECT scenario_id, 'gva_change' AS variable, sector, region, year, band AS scenario,
  {r6('nominal', 8)} AS value FROM mv
UNION ALL SELECT scenario_id, 'gva_change_real', sector, region, year, band,
  {r6('(1 + nominal) / (1 + deflator) - 1', 8)} FROM mv JOIN gdp
  USING (scenario_id, year, band, region)""",
    "macro_gdp": _VOL_BASE + "," + _MACRO + f"""
SELECT scenario_id, v.variable, '__economy__' AS sector, region, year, band AS scenario,
  {r6('v.value', 8)} AS value FROM gdp, LATERAL (VALUES ('deflator', deflator),
  ('gdp_change', gdp_change), ('gdp_change_real', (1 + gdp_change) / (1 + deflator) - 1))
  AS v(variable, value)""",
    "macro_append_once": with_sql(economy_sql()) + """,
n AS (SELECT count(*) AS g, count(DISTINCT region) AS r FROM x)
SELECT v.variable, 'central' AS scenario, v.n FROM n, LATERAL (VALUES ('price_change', g),
 ('gva_change', g), ('gva_change_real', g), ('deflator', r), ('gdp_change', r),
 ('gdp_change_real', r)) AS v(variable, n)""",
}
