"""Queries on SAM construction, balancing, calibration shares and benchmark comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.operators import calibrate, compare, sam
from rippleflow.operators.harmonise import demand_by_institution
from rippleflow.plans.joins import union_all
from rippleflow.workload.common import economy_sql, r6, rounded, with_sql
from rippleflow.workload.economy import economy

SECTORS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FACTORS = ["CAP", "LAB"]
ENERGY = ["ECONOMY", "PROMO"]


def _closed(spark, d, institutions=True):
    e = economy(spark, d)
    split = demand_by_institution(e.demand_cells, e.output) if institutions else None
    return e._memo(f"closed_sam_{institutions}",
                   lambda: sam.closed_sam(e.flows, e.final_demand, split))


def sam_closed(spark, d):
    return rounded(union_all([
        _closed(spark, d).withColumn("form", F.lit("institutions")),
        _closed(spark, d, False).withColumn("form", F.lit("household"))]), "value", digits=10)


def sam_open(spark, d):
    e = economy(spark, d)
    return rounded(union_all([
        sam.open_sam(e.flows, e.final_demand, "ASIA").withColumn("form", F.lit("measured")),
        sam.open_sam(e.flows, e.final_demand, "ASIA", measured=False).withColumn(
            "form", F.lit("imputed"))]), "value", digits=7)


def sam_multi(spark, d):
    e = economy(spark, d)
    return rounded(sam.multi_sam(e.flows, e.final_demand), "value", digits=9)


def sam_imbalance(spark, d):
    """The imputed open SAM is not balanced; the measured one is."""
    e = economy(spark, d)
    out = [sam.imbalance(sam.open_sam(e.flows, e.final_demand, "ASIA", measured=m)).withColumn(
        "form", F.lit("measured" if m else "imputed")) for m in (True, False)]
    return rounded(union_all(out), "gap")


def _uneven(spark, d):
    """Region-to-region sales with a boosted row, as a matrix that needs balancing."""
    e = economy(spark, d)
    m = sam.trade_cube(e.flows, e.final_demand).groupBy("origin", "dest").agg(
        F.sum("value").alias("value")).select(
        F.col("origin").alias("row_acct"), F.col("dest").alias("col_acct"),
        (F.col("value") * F.when(F.col("origin") == "ASIA", 1.5).otherwise(1.0)).alias("value"))
    return m


def sam_ras(spark, d):
    m = _uneven(spark, d)
    return rounded(sam.ras(m, sam.mean_targets(m)), "value", digits=7)


def sam_quality(spark, d):
    e = economy(spark, d)
    acc = sam.sector_accounts(e.flows, e.final_demand)
    return rounded(sam.sam_quality(_closed(spark, d), sam.SamLayout.closed(SECTORS),
                                   sam.closed_source(acc)), "value", digits=6)


def trade_components(spark, d):
    """Regions connected by links above a share that cuts the graph into pieces."""
    e = economy(spark, d)
    t = sam.trade_cube(e.flows, e.final_demand)
    cut = t.where("origin <> dest").agg(F.percentile("value", 0.93).alias("c")).first()["c"]
    return sam.components(t, e.output, cut)


def account_axes(spark, d):
    e = economy(spark, d)
    acct = sam.account_totals(sam.multi_sam(e.flows, e.final_demand)).select("account")
    return sam.multi_axes(acct)


def closed_sectors(spark, d):
    m = _closed(spark, d)
    return sam.closed_sectors(m, sam.account_totals(m).select("account"))


def calibration_shares(spark, d):
    return rounded(calibrate.calibration_shares(_closed(spark, d), SECTORS, FACTORS), "value")


def institution_parameters(spark, d):
    return rounded(calibrate.institution_parameters(_closed(spark, d), SECTORS, FACTORS), "value")


def ces_shares(spark, d):
    m = _closed(spark, d)
    return rounded(union_all([
        calibrate.value_added_ces(m, SECTORS, FACTORS, s).withColumn("sigma", F.lit(s))
        for s in (1.0, 0.5)]), "share", "scale")


def armington_shares(spark, d):
    e = economy(spark, d)
    t = sam.trade_cube(e.flows, e.final_demand)
    return rounded(calibrate.armington_shares(calibrate.supply_parts(t, 2.0), ["region", "sector"]),
                   "share", "scale", digits=7)


def cet_shares(spark, d):
    e = economy(spark, d)
    t = sam.trade_cube(e.flows, e.final_demand)
    return rounded(calibrate.cet_shares(calibrate.sales_parts(t, 2.0), ["region", "sector"]),
                   "share", "scale", digits=7)


def energy_nest_shares(spark, d):
    return rounded(calibrate.energy_nest(_closed(spark, d), SECTORS, FACTORS, ENERGY),
                   "share", "scale", digits=7)


def energy_ratios(spark, d):
    return rounded(calibrate.energy_ratios(_closed(spark, d), SECTORS, FACTORS, ENERGY),
                   "kle0", "mat0", "kl0", "e0")


def foreign_savings(spark, d):
    e = economy(spark, d)
    return rounded(calibrate.foreign_savings(sam.open_sam(e.flows, e.final_demand, "ASIA")),
                   "imports", "exports", "foreign_savings", "transfer", "gap", digits=7)


# -- benchmark versus scenario: lines with status F against lines with status O -------------------

def _levels(spark, d, status):
    """Price = money per piece, demand and household = pieces, output = money."""
    e = economy(spark, d, linestatus=status)
    c = e.cells.groupBy(F.col("o_place").alias("region"), F.col("o_sector").alias("sector")).agg(
        F.sum("value").alias("v"), F.sum("quantity").alias("q"),
        F.sum(F.when(F.col("returnflag") != "R", F.col("quantity")).otherwise(0.0)).alias("fd"),
        F.sum(F.when((F.col("returnflag") != "R") & (F.col("segment") == "HOUSEHOLD"),
                     F.col("quantity")).otherwise(0.0)).alias("hh"),
        F.sum(F.when(F.col("o_place") != F.col("d_place"), F.col("quantity")).otherwise(0.0))
        .alias("ex"))
    return c.select("region", "sector", F.explode(F.create_map(
        F.lit("price"), F.col("v") / F.col("q"), F.lit("demand"), F.col("fd"),
        F.lit("household"), F.col("hh"), F.lit("output"), F.col("v") / 1e6,
        F.lit("export"), F.col("ex"))).alias("variable", "level"))


def _pair(spark, d):
    return _levels(spark, d, "F"), _levels(spark, d, "O")


def level_change(spark, d):
    return rounded(compare.level_change(*_pair(spark, d)), "change")


def gdp_measures(spark, d):
    return rounded(compare.gdp_measures(*_pair(spark, d)), "gdp_change_real",
                   "gdp_change_nominal", "gdp_deflator_change")


def utility_index(spark, d):
    b, s = _pair(spark, d)
    return rounded(compare.utility_change(b, s).join(compare.consumption_change(b, s), "region"),
                   "welfare_change", "consumption_change", digits=7)


def covered_emissions(spark, d):
    b, s = _pair(spark, d)
    e = economy(spark, d)
    intensity = e.satellite.where("stressor = 'CO2e'").select("region", "sector", "intensity")
    return rounded(compare.covered_emissions(b, s, intensity).join(
        compare.energy_output_change(b, s, ENERGY), "region"),
        "covered_emissions_change", "energy_sector_output_volume_change")


def _factors(spark, d, status):
    """Wage = money per piece, quantity = pieces, factor by return flag."""
    e = economy(spark, d, linestatus=status)
    f = F.when(F.col("returnflag") == "R", "CAP").otherwise("LAB")
    c = e.cells.groupBy(F.col("o_place").alias("region"), F.col("o_sector").alias("sector"),
                        f.alias("factor")).agg(F.sum("value").alias("v"), F.sum("quantity").alias("quantity"))
    w = c.groupBy("region", "factor").agg((F.sum("v") / F.sum("quantity")).alias("wage"))
    return c.join(w, ["region", "factor"]).select("region", "sector", "factor", "wage", "quantity")


def gva_changes(spark, d):
    return rounded(compare.value_added_changes(_factors(spark, d, "F"), _factors(spark, d, "O")),
                   "gva_income_change", "gva_volume_change")


def factor_changes(spark, d):
    return rounded(compare.factor_changes(_factors(spark, d, "F"), _factors(spark, d, "O")), "change")


def gdp_shares(spark, d):
    e = economy(spark, d)
    amounts = e.cells.groupBy(F.col("o_place").alias("region"), F.col("segment").alias("variable")) \
        .agg(F.sum("value").alias("amount"))
    base = amounts.groupBy("region").agg(F.sum("amount").alias("gdp"))
    return rounded(compare.shares_of_gdp(amounts, base), "value")


QUERIES = {f.__name__: f for f in (
    sam_closed, sam_open, sam_multi, sam_imbalance, sam_ras, sam_quality, trade_components,
    account_axes, closed_sectors, calibration_shares, institution_parameters, ces_shares,
    armington_shares, cet_shares, energy_nest_shares, energy_ratios, foreign_savings, level_change,
    gdp_measures, utility_index, covered_emissions, gva_changes, factor_changes, gdp_shares)}

_E = with_sql(economy_sql())
_INST = ("CASE WHEN category ILIKE '%government%' THEN 'GOV' WHEN category ILIKE '%household%' OR "
         "category ILIKE '%npish%' THEN 'HOH' ELSE 'SAVINV' END")
_CL = _E + f""",
acc AS MATERIALIZED (SELECT s.sector, coalesce(o.v, 0) + f.v AS x, f.v AS fd, coalesce(o.v, 0) + f.v - coalesce(i.v, 0) AS va
  FROM (SELECT DISTINCT sector FROM x) s LEFT JOIN (SELECT i_sector AS sector, sum(z) AS v FROM z GROUP BY 1) o USING (sector)
  LEFT JOIN (SELECT j_sector AS sector, sum(z) AS v FROM z GROUP BY 1) i USING (sector)
  JOIN (SELECT sector, sum(value) AS v FROM fd GROUP BY 1) f USING (sector)),
core AS (SELECT i_sector AS r, j_sector AS c, sum(z) AS v FROM z GROUP BY 1, 2 UNION ALL
  SELECT f.f, sector, f.s * va FROM acc, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) UNION ALL
  SELECT 'HOH', f.f, f.s * sum(va) FROM acc, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) GROUP BY f.f, f.s),
ins AS (SELECT sector, {_INST} AS inst, sum(value) AS v FROM cat GROUP BY 1, 2),
cl AS MATERIALIZED (SELECT * FROM core UNION ALL SELECT sector, inst, v FROM ins UNION ALL
  SELECT inst, 'HOH', sum(v) FROM ins WHERE inst <> 'HOH' GROUP BY 1),
ch AS (SELECT * FROM core UNION ALL SELECT sector, 'HOH', fd FROM acc)"""


def _open_sql(measured: bool, name: str) -> str:
    fd = ("SELECT sector, sum(value) AS fd, sum(CASE WHEN region <> 'ASIA' THEN value ELSE 0 END) AS mf FROM fd "
          "WHERE d_region = 'ASIA' GROUP BY 1" if measured else
          "SELECT sector, sum(value) AS fd, 0.0 AS mf FROM fd WHERE region = 'ASIA' GROUP BY 1")
    imp = "mu + mf" if measured else "mu / u * (u + fd)"
    return f"""
{name}a AS MATERIALIZED (SELECT sector, xx.x, u, fd, {imp} AS m, u + fd - ({imp}) AS dm, xx.x - (u + fd - ({imp})) AS e,
  xx.x - p AS va FROM (SELECT sector, x FROM x WHERE region = 'ASIA') xx
  JOIN (SELECT i_sector AS sector, sum(z) AS u, sum(CASE WHEN i_region <> 'ASIA' THEN z ELSE 0 END) AS mu FROM z
   WHERE j_region = 'ASIA' GROUP BY 1) USING (sector)
  JOIN (SELECT j_sector AS sector, sum(z) AS p FROM z WHERE j_region = 'ASIA' GROUP BY 1) USING (sector)
  JOIN ({fd}) USING (sector)),
{name} AS MATERIALIZED (SELECT 'a_' || sector AS r, 'c_' || sector AS c, dm AS v FROM {name}a UNION ALL
  SELECT 'a_' || sector, 'ROW', greatest(e, 0) FROM {name}a WHERE e > 0 UNION ALL SELECT 'ROW', 'c_' || sector, m FROM {name}a UNION ALL
  SELECT 'c_' || sector, 'HOH', fd FROM {name}a UNION ALL
  SELECT 'c_' || i_sector, 'a_' || j_sector, sum(z) FROM z WHERE j_region = 'ASIA' GROUP BY 1, 2 UNION ALL
  SELECT f.f, 'a_' || sector, f.s * va FROM {name}a, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) UNION ALL
  SELECT 'HOH', f.f, f.s * sum(va) FROM {name}a, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) GROUP BY f.f, f.s UNION ALL
  SELECT CASE WHEN g > 0 THEN 'HOH' ELSE 'ROW' END, CASE WHEN g > 0 THEN 'ROW' ELSE 'HOH' END, abs(g) FROM
   (SELECT sum(m) - sum(greatest(e, 0)) AS g FROM {name}a))"""


_OP = _E + "," + _open_sql(True, "om") + "," + _open_sql(False, "oi")
_CUBE = """
cube AS MATERIALIZED (SELECT origin, sector, dest, sum(v) AS v FROM (SELECT i_region AS origin, i_sector AS sector,
  j_region AS dest, z AS v FROM z UNION ALL SELECT region, sector, d_region, value FROM fd) GROUP BY 1, 2, 3)"""
_MU = _E + "," + _CUBE + """,
ma AS MATERIALIZED (SELECT region, sector, x.x - p.p AS va FROM x JOIN (SELECT j_region AS region, j_sector AS sector, sum(z) AS p
  FROM z GROUP BY 1, 2) p USING (region, sector)),
ca AS MATERIALIZED (SELECT region, sum(v) AS ca FROM (SELECT origin AS region, v FROM cube WHERE origin <> dest UNION ALL
  SELECT dest, -v FROM cube WHERE origin <> dest) GROUP BY 1),
mu AS MATERIALIZED (SELECT r, c, sum(v) AS v FROM (
  SELECT 'a_' || origin || '_' || sector AS r, 'c_' || dest || '_' || sector AS c, v FROM cube UNION ALL
  SELECT 'c_' || d_region || '_' || sector, 'HOH_' || d_region, value FROM fd UNION ALL
  SELECT 'c_' || j_region || '_' || i_sector, 'a_' || j_region || '_' || j_sector, z FROM z UNION ALL
  SELECT f.f || '_' || region, 'a_' || region || '_' || sector, f.s * va FROM ma, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) UNION ALL
  SELECT 'HOH_' || region, f.f || '_' || region, f.s * va FROM ma, LATERAL (VALUES ('CAP', 0.4), ('LAB', 0.6)) f(f, s) UNION ALL
  SELECT 'HOH_' || b.region, 'HOH_' || l.region, -b.ca * l.ca / (SELECT sum(ca) FROM ca WHERE ca > 0) FROM ca l, ca b
   WHERE l.ca > 0 AND b.ca < 0) GROUP BY 1, 2 HAVING sum(v) <> 0)"""


def _cells(name, form=None, digits=7):
    f = f", '{form}' AS form" if form else ""
    return f"SELECT r AS row_acct, c AS col_acct, {r6('sum(v)', digits)} AS value{f} FROM {name} GROUP BY r, c HAVING sum(v) <> 0"


def _gap(name, form):
    return (f"SELECT account, {r6('sum(v)')} AS gap, '{form}' AS form FROM (SELECT r AS account, v FROM {name} "
            f"UNION ALL SELECT c, -v FROM {name}) GROUP BY 1")


def _ras_sql(rounds):
    ctes = [economy_sql(), _CUBE, """
s0 AS MATERIALIZED (SELECT origin AS r, dest AS c, sum(v) * CASE WHEN origin = 'ASIA' THEN 1.5 ELSE 1 END AS v FROM cube GROUP BY 1, 2),
tg AS MATERIALIZED (SELECT a, sum(v) / 2 AS t FROM (SELECT r AS a, v FROM s0 UNION ALL SELECT c, v FROM s0) GROUP BY 1)"""]
    for i in range(rounds):
        ctes.append(f"""
h{i} AS (SELECT r, c, v * t / sum(v) OVER (PARTITION BY r) AS v FROM s{i} JOIN tg ON a = r),
s{i + 1} AS MATERIALIZED (SELECT r, c, v * t / sum(v) OVER (PARTITION BY c) AS v FROM h{i} JOIN tg ON a = c)""")
    return with_sql(*ctes) + f" SELECT r AS row_acct, c AS col_acct, {r6('v', 7)} AS value FROM s{rounds}"


_IN = ", ".join(f"'{s}'" for s in SECTORS)
_CAL = _CL + f""",
m AS MATERIALIZED (SELECT r, c, v / (SELECT sum(v) FROM cl WHERE r IN ('CAP', 'LAB') AND c IN ({_IN})) AS v FROM
  (SELECT r, c, sum(v) AS v FROM cl GROUP BY 1, 2)),
ps AS MATERIALIZED (SELECT c, sum(v) AS x, sum(CASE WHEN r IN ('CAP', 'LAB') THEN v ELSE 0 END) AS va FROM m WHERE c IN ({_IN})
  GROUP BY 1)"""


def _ces_sql(source: str, keys: str, sigma: str) -> str:
    """share and scale of groups in ``source(keys, input, value)``."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""(WITH v AS (SELECT *, value / sum(value) OVER (PARTITION BY {keys}) AS vs FROM {source} WHERE value > 0),
 w AS (SELECT *, CASE WHEN {sigma} = 1.0 THEN vs ELSE pow(vs, 1 / {sigma}) END AS wt FROM v),
 s AS (SELECT *, wt / sum(wt) OVER (PARTITION BY {keys}) AS share FROM w),
 t AS (SELECT {keys}, CASE WHEN {sigma} = 1.0 THEN exp(sum(-share * ln(share))) ELSE
  pow(sum(pow(share, {sigma})), 1 / (1 - {sigma} + CASE WHEN {sigma} = 1.0 THEN 1 ELSE 0 END)) END AS scale FROM s GROUP BY {keys})
 SELECT a.*, b.scale FROM s a JOIN t b ON {on})"""


def _trade_sql(key: str, other: str, exponent: str, k: str) -> str:
    return _E + "," + _CUBE + f""",
p AS (SELECT {key} AS region, sector, CASE WHEN origin = dest THEN 'domestic' ELSE {other} END AS partner, v FROM cube WHERE v > 0),
s AS (SELECT *, pow(v, {exponent}) / sum(pow(v, {exponent})) OVER (PARTITION BY region, sector) AS share FROM p),
t AS (SELECT region, sector, sum(v) / pow(sum(share * pow(v, {k})), 1 / {k}) AS scale FROM s GROUP BY 1, 2)
SELECT s.region, s.sector, partner, {r6('share', 7)} AS share, {r6('scale', 7)} AS scale FROM s JOIN t USING (region, sector)"""


_LV = """
lv AS MATERIALIZED (SELECT ls, o_region AS region, o_sector AS sector, sum(ext) * 1e6 / sum(qty) AS price,
  sum(CASE WHEN rf <> 'R' THEN qty ELSE 0 END) AS demand,
  sum(CASE WHEN rf <> 'R' AND segment = 'HOUSEHOLD' THEN qty ELSE 0 END) AS household, sum(ext) AS output,
  sum(CASE WHEN o_region <> d_region THEN qty ELSE 0 END) AS export FROM fl GROUP BY 1, 2, 3),
b0 AS (SELECT * FROM lv WHERE ls = 'F'), b1 AS (SELECT * FROM lv WHERE ls = 'O'),
bb AS MATERIALIZED (SELECT region, sector, b0.price AS p0, b1.price AS p1, b0.demand AS d0, b1.demand AS d1,
  b0.household AS h0, b1.household AS h1, b0.output AS o0, b1.output AS o1, b0.export AS e0, b1.export AS e1
  FROM b0 JOIN b1 USING (region, sector))"""
_FC = """
fc AS MATERIALIZED (SELECT ls, o_region AS region, o_sector AS sector, CASE rf WHEN 'R' THEN 'CAP' ELSE 'LAB' END AS factor,
  sum(ext) * 1e6 AS v, sum(qty) AS q FROM fl GROUP BY 1, 2, 3, 4),
wg AS MATERIALIZED (SELECT ls, region, factor, sum(v) / sum(q) AS w, sum(q) AS q FROM fc GROUP BY 1, 2, 3)"""

ORACLES = {
    "sam_closed": _CL + " " + _cells("cl", "institutions", 10) + " UNION ALL " + _cells("ch", "household", 10),
    "sam_open": _OP + " " + _cells("om", "measured") + " UNION ALL " + _cells("oi", "imputed"),
    "sam_multi": _MU + " " + _cells("mu", digits=9),
    "sam_imbalance": _OP + " " + _gap("om", "measured") + " UNION ALL " + _gap("oi", "imputed"),
    "sam_ras": _ras_sql(12),
    "sam_quality": _E + """
SELECT name, severity, CAST(value AS DOUBLE) AS value, CAST(tolerance AS DOUBLE) AS tolerance FROM (VALUES
 ('sam_balanced', 'pass', 0.0, 1e-6), ('preserves_final_demand', 'pass', 0.0, 1e-6),
 ('preserves_value_added', 'pass', 0.0, 1e-6), ('preserves_gross_output', 'pass', 0.0, 1e-6),
 ('non_negative_cells', 'pass', 0.0, NULL), ('value_added_clip', 'pass', 0.0, NULL),
 ('assumed_capital_share', 'pass', 0.4, NULL)) t(name, severity, value, tolerance) WHERE (SELECT count(*) FROM x) > 0""",
    "trade_components": _E + "," + _CUBE + """,
cut AS (SELECT quantile_cont(v, 0.93) AS c FROM cube WHERE origin <> dest),
lk AS MATERIALIZED (SELECT DISTINCT origin AS a, dest AS b FROM cube WHERE origin <> dest AND v >= (SELECT c FROM cut) UNION
  SELECT DISTINCT dest, origin FROM cube WHERE origin <> dest AND v >= (SELECT c FROM cut)),
rc AS (SELECT DISTINCT region AS a, region AS b FROM x UNION SELECT rc.a, lk.b FROM rc JOIN lk ON lk.a = rc.b)
SELECT b AS region, min(a) AS component FROM rc GROUP BY 1""",
    "account_axes": _E + " SELECT 'a_' || region || '_' || sector AS account, region, sector FROM x",
    "closed_sectors": _E + " SELECT DISTINCT sector FROM x",
    "calibration_shares": _CAL + f"""
SELECT CASE WHEN r IN ('CAP', 'LAB') THEN 'factor_share' ELSE 'input_coefficient' END AS parameter, r AS item, c AS sector,
 {r6("v / CASE WHEN r IN ('CAP', 'LAB') THEN va ELSE x END")} AS value FROM m JOIN ps USING (c)
UNION ALL SELECT 'value_added_share', '', c, {r6('va / x')} FROM ps UNION ALL SELECT 'output', '', c, {r6('x')} FROM ps
UNION ALL SELECT 'budget_share', '', r, {r6('v / sum(v) OVER ()')} FROM m WHERE c = 'HOH' AND r IN ({_IN})
UNION ALL SELECT 'endowment', r, '', {r6('sum(v)')} FROM m WHERE r IN ('CAP', 'LAB') GROUP BY r""",
    "institution_parameters": _CAL + f""",
rt AS (SELECT sum(CASE WHEN r = 'GOV' THEN v END) AS tax, sum(CASE WHEN r = 'SAVINV' THEN v END) AS sav FROM m WHERE c = 'HOH')
SELECT CASE c WHEN 'GOV' THEN 'government_share' ELSE 'investment_share' END AS parameter, r AS sector,
 {r6('v / sum(v) OVER (PARTITION BY c)')} AS value FROM m WHERE c IN ('GOV', 'SAVINV') AND r IN ({_IN})
UNION ALL SELECT 'tax_rate', '', {r6('tax')} FROM rt UNION ALL SELECT 'savings_rate', '', {r6('sav / (1 - tax)')} FROM rt""",
    "ces_shares": _CAL + f""",
src AS (SELECT c AS sector, r AS input, v AS value, g.sigma FROM m, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) g(sigma)
  WHERE r IN ('CAP', 'LAB') AND c IN ({_IN}))
SELECT sector, input, {r6('share')} AS share, {r6('scale')} AS scale, sigma FROM
{_ces_sql("src", "sector, sigma", "sigma")}""",
    "armington_shares": _trade_sql("dest", "origin", "0.5", "0.5"),
    "cet_shares": _trade_sql("origin", "dest", "-0.5", "1.5"),
    "energy_nest_shares": _CAL + f""",
rl AS (SELECT c AS sector, CASE WHEN r IN ('CAP', 'LAB') THEN 'KL' WHEN r IN ('ECONOMY', 'PROMO') THEN 'E' ELSE 'M' END AS role,
  r, v FROM m WHERE c IN ({_IN})),
o AS (SELECT 'outer' AS nest, 0.5 AS sigma, sector, CASE role WHEN 'M' THEN 'M' ELSE 'KLE' END AS input, sum(v) AS value FROM rl GROUP BY 1, 2, 3, 4
 UNION ALL SELECT 'middle', 0.5, sector, role, sum(v) FROM rl WHERE role <> 'M' GROUP BY 1, 2, 3, 4
 UNION ALL SELECT 'energy', 1.5, sector, r, v FROM rl WHERE role = 'E')
SELECT nest, sector, input, {r6('share', 7)} AS share, {r6('scale', 7)} AS scale FROM
 {_ces_sql("o", "nest, sigma, sector", "sigma")}
UNION ALL SELECT 'materials', sector, r, {r6('v / sum(v) OVER (PARTITION BY sector)', 7)}, CAST(1.0 AS DOUBLE) FROM rl WHERE role = 'M'""",
    "energy_ratios": _CAL + f"""
SELECT c AS sector, {r6('(va + e) / x')} AS kle0, {r6('1 - (va + e) / x')} AS mat0, {r6('va / (va + e)')} AS kl0,
 {r6('e / (va + e)')} AS e0 FROM ps JOIN (SELECT c, sum(v) AS e FROM m WHERE r IN ('ECONOMY', 'PROMO') AND c IN ({_IN}) GROUP BY 1) USING (c)""",
    "foreign_savings": _OP + f"""
SELECT {r6('sum(m)', 7)} AS imports, {r6('sum(e)', 7)} AS exports, {r6('sum(m) - sum(e)', 7)} AS foreign_savings,
 {r6('sum(m) - sum(e)', 7)} AS transfer, CAST(0.0 AS DOUBLE) AS gap FROM oma""",
    "level_change": _E + "," + _LV + f"""
SELECT region, sector, t.variable, {r6('t.b / t.a - 1')} AS change FROM bb, LATERAL (VALUES ('price', p0, p1),
 ('demand', d0, d1), ('household', h0, h1), ('output', o0, o1), ('export', e0, e1)) t(variable, a, b)""",
    "gdp_measures": _E + "," + _LV + f"""
SELECT region, {r6('sum(p0 * d1) / sum(p0 * d0) - 1')} AS gdp_change_real, {r6('sum(p1 * d1) / sum(p0 * d0) - 1')}
 AS gdp_change_nominal, {r6('sum(p1 * d1) / sum(p0 * d1) - 1')} AS gdp_deflator_change FROM bb GROUP BY 1""",
    "utility_index": _E + "," + _LV + f""",
g AS (SELECT *, p0 * h0 / sum(p0 * h0) OVER (PARTITION BY region) AS g FROM bb)
SELECT region, {r6('exp(sum(g * (ln(h1) - ln(h0)))) - 1', 7)} AS welfare_change,
 {r6('sum(p0 * h1) / sum(p0 * h0) - 1', 7)} AS consumption_change FROM g GROUP BY 1""",
    "covered_emissions": _E + "," + _LV + f"""
SELECT region, {r6('sum(s.intensity * o1) / sum(s.intensity * o0) - 1')} AS covered_emissions_change,
 {r6("sum(CASE WHEN sector IN ('ECONOMY', 'PROMO') THEN o1 END) / sum(CASE WHEN sector IN ('ECONOMY', 'PROMO') THEN o0 END) - 1")}
 AS energy_sector_output_volume_change FROM bb JOIN sat s USING (region, sector) WHERE s.stressor = 'CO2e' GROUP BY 1""",
    "gva_changes": _E + "," + _FC + f""",
g AS (SELECT fc.ls, region, sector, sum(w * fc.q) AS inc, sum(fc.q) AS vol FROM fc JOIN wg USING (ls, region, factor) GROUP BY 1, 2, 3)
SELECT region, sector, {r6('b.inc / a.inc - 1')} AS gva_income_change, {r6('b.vol / a.vol - 1')} AS gva_volume_change
FROM g a JOIN g b USING (region, sector) WHERE a.ls = 'F' AND b.ls = 'O'""",
    "factor_changes": _E + "," + _FC + f"""
SELECT region, factor, t.variable, {r6('t.v')} AS change FROM wg a JOIN wg b USING (region, factor), LATERAL (VALUES
 ('factor_price_change', b.w / a.w - 1), (CASE factor WHEN 'LAB' THEN 'wage_change' ELSE 'capital_return_change' END, b.w / a.w - 1),
 (CASE factor WHEN 'LAB' THEN 'employment_change' ELSE 'factor_use_change_CAP' END, b.q / a.q - 1)) t(variable, v)
WHERE a.ls = 'F' AND b.ls = 'O'""",
    "gdp_shares": _E + f"""
SELECT o_region AS region, segment AS variable, {r6('sum(ext) / sum(sum(ext)) OVER (PARTITION BY o_region)')} AS value
FROM fl GROUP BY 1, 2""",
}
