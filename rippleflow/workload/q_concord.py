"""Queries on concordances and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.functions.labels import (
    coarse_region, coarse_sector, is_rest_of_world, numeric_key,
)
from rippleflow.operators import concord
from rippleflow.plans.joins import union_all
from rippleflow.workload import inputs
from rippleflow.workload.common import economy_sql, r6, rounded, with_sql
from rippleflow.workload.economy import economy, read


def _coarse(spark, d):
    e = economy(spark, d, "nation")
    b = concord.combined_bridge(e.output, inputs.sector_groups(spark, d), inputs.nation_map(spark, d))
    return e, b


def orphans(spark, d):
    labels = read(spark, d, "part").select(F.col("p_type").alias("source")).distinct()
    return concord.orphans(inputs.sector_groups(spark, d).where("source <> 'PROMO'"), labels)


def bridge(spark, d):
    e, b = _coarse(spark, d)
    return rounded(b, "weight")


def aggregate_coeff(spark, d):
    e, b = _coarse(spark, d)
    return rounded(concord.aggregate_coeff(e.coeff, e.output, b), "a")


def aggregate_output(spark, d):
    e, b = _coarse(spark, d)
    return rounded(concord.aggregate_output(e.output, b), "x", digits=10)


def aggregate_demand(spark, d):
    e, b = _coarse(spark, d)
    return rounded(concord.aggregate_demand(e.final_demand, b, inputs.nation_map(spark, d)),
                   "value", digits=10)


def aggregate_institutions(spark, d):
    from rippleflow.operators.harmonise import demand_by_institution
    e, b = _coarse(spark, d)
    split = demand_by_institution(e.demand_cells, e.output)
    return rounded(concord.aggregate_demand(split, b, inputs.nation_map(spark, d), ["institution"]),
                   "value", digits=10)


def aggregate_satellite(spark, d):
    e, b = _coarse(spark, d)
    return rounded(concord.aggregate_satellite(e.satellite, e.output, b), "intensity", digits=5)


def aggregation_conserves(spark, d):
    e, b = _coarse(spark, d)
    return rounded(concord.conservation(
        e.output, concord.aggregate_output(e.output, b), e.final_demand,
        concord.aggregate_demand(e.final_demand, b, inputs.nation_map(spark, d))), "value")


def coarse_map(spark, d):
    """Coarse sector of part names, coarse region of two-letter nation codes, rest-of-world test."""
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct().select(
        F.lit("sector").alias("kind"), "name", coarse_sector("name").alias("target"),
        F.lit(False).alias("rest"))
    codes = ["US", "CN", "WA", "WF", "AT", "ZA", "KR", "AU", "WM", "XX"]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), F.col("n_nationkey") % 10 + 1)
    regions = read(spark, d, "nation").select(code.alias("name")).distinct().select(
        F.lit("region").alias("kind"), "name", coarse_region("name").alias("target"),
        is_rest_of_world("name").alias("rest"))
    return names.unionByName(regions)


def numeric_keys(spark, d):
    return inputs.product_codes(spark, d).unionByName(inputs.industry_codes(spark, d)).select(
        "name", "code", numeric_key(F.col("code")).alias("num"))


def prefix_rollback(spark, d):
    return concord.product_industries(inputs.product_codes(spark, d), inputs.industry_codes(spark, d))


def _resolved(spark, d):
    return concord.resolve_crosswalk(inputs.crosswalk(spark, d), inputs.rated_processes(spark, d))


def crosswalk_resolution(spark, d):
    return _resolved(spark, d)


def equal_weight_concordance(spark, d):
    return rounded(concord.equal_weight_concordance(_resolved(spark, d)), "weight")


def crosswalk_audit(spark, d):
    return concord.crosswalk_audit(_resolved(spark, d).where("sector <> 'Brand#1' OR process IS NULL"))


def _gappy(spark, d):
    return inputs.type_brand(spark, d).where("source NOT IN ('ECONOMY', 'STANDARD')")


def sibling_fill(spark, d):
    return rounded(concord.sibling_fill(_gappy(spark, d), inputs.industry_codes(spark, d)), "weight")


def sibling_audit(spark, d):
    return concord.fill_audit(_gappy(spark, d), inputs.industry_codes(spark, d))


def supply_shares(spark, d):
    return rounded(concord.supply_shares(inputs.supply_table(spark, d)), "weight")


def _weights(spark, d):
    shares = concord.supply_shares(inputs.supply_table(spark, d)).where("product NOT LIKE 'Brand#2%'")
    cand = concord.product_industries(inputs.product_codes(spark, d), inputs.industry_codes(spark, d))
    return concord.product_weights(_gappy(spark, d), cand, shares), cand


def product_weights(spark, d):
    return rounded(_weights(spark, d)[0], "weight")


def product_bridge(spark, d):
    return rounded(concord.bridge_to_products(_gappy(spark, d), _weights(spark, d)[0]), "weight")


def bridge_methods(spark, d):
    w, cand = _weights(spark, d)
    missing = concord.uncovered_products(cand, w)
    return concord.bridge_method_counts(w).unionByName(missing.groupBy(
        F.lit("uncovered").alias("method")).agg(F.count("*").alias("n_products")))


def compose_concordance(spark, d):
    groups = inputs.sector_groups(spark, d).where("weight > 0.5").select(
        "source", F.col("target").alias("grp"))
    return rounded(concord.compose_concordance(_gappy(spark, d), groups), "weight")


def omitted_members(spark, d):
    groups = inputs.sector_groups(spark, d).where("weight > 0.5").select(
        "source", F.col("target").alias("grp"))
    return concord.omitted_members(_gappy(spark, d), groups)


def bilateral_trade(spark, d):
    e = economy(spark, d)
    return rounded(concord.trade_by_route(e.flows, e.final_demand), "value")


def dust_folding(spark, d):
    e = economy(spark, d)
    return concord.fold_dust(e.flows, e.final_demand, e.output, materiality=0.0065)


QUERIES = {f.__name__: f for f in (
    orphans, bridge, aggregate_coeff, aggregate_output, aggregate_demand, aggregate_institutions,
    aggregate_satellite, aggregation_conserves, coarse_map, numeric_keys, prefix_rollback,
    crosswalk_resolution, equal_weight_concordance, crosswalk_audit, sibling_fill, sibling_audit,
    supply_shares, product_weights, product_bridge, bridge_methods, compose_concordance,
    omitted_members, bilateral_trade, dust_folding)}

_GROUPS = """
sg AS (SELECT DISTINCT p_type AS source, m.target, m.weight FROM part, LATERAL (VALUES
  ('goods', CASE WHEN p_type = 'SMALL' THEN 0.25 WHEN p_type IN ('LARGE','MEDIUM','STANDARD') THEN 1.0 ELSE 0.0 END),
  ('other', CASE WHEN p_type = 'SMALL' THEN 0.75 WHEN p_type IN ('LARGE','MEDIUM','STANDARD') THEN 0.0 ELSE 1.0 END))
  AS m(target, weight) WHERE m.weight > 0),
rm AS (SELECT n_name AS source, r_name AS target FROM nation JOIN region ON r_regionkey = n_regionkey)"""
_AGG = with_sql(economy_sql("nation"), _GROUPS) + """,
br AS MATERIALIZED (SELECT x.region, x.sector, rm.target AS t_region, sg.target AS t_sector,
  CAST(sg.weight AS DOUBLE) AS weight FROM x JOIN sg ON sg.source = x.sector JOIN rm ON rm.source = x.region),
cx AS MATERIALIZED (SELECT t_region AS region, t_sector AS sector, sum(weight * x) AS x FROM x JOIN br
  USING (region, sector) GROUP BY 1, 2)"""
_CDEM = """
cd AS MATERIALIZED (SELECT b.t_region AS region, b.t_sector AS sector, rm.target AS d_region, sum(weight * value)
  AS value FROM fd JOIN br b USING (region, sector) JOIN rm ON rm.source = fd.d_region GROUP BY 1, 2, 3)"""
_INST = ("CASE WHEN category ILIKE '%government%' THEN 'government' WHEN category ILIKE '%household%'"
         " OR category ILIKE '%npish%' THEN 'household' ELSE 'investment' END")
_XW = """
xw AS (SELECT DISTINCT p_brand AS sector, concat_ws('_', 'A', p_size % 4, p_size % 12, p_size) AS code,
  lower(p_name) AS name_key FROM part),
pr AS (SELECT DISTINCT process FROM (
  SELECT CASE WHEN p_size % 4 < 3 THEN concat_ws('_', 'A', p_size % 4) END AS process FROM part UNION ALL
  SELECT CASE WHEN p_size % 12 > 6 THEN concat_ws('_', 'A', p_size % 4, p_size % 12) END FROM part UNION ALL
  SELECT CASE WHEN p_size = 20 THEN concat_ws('_', 'A', p_size % 4, p_size % 12, p_size) END FROM part UNION ALL
  SELECT CASE WHEN p_name LIKE 'red%' THEN 'A_9 — ' || p_name END FROM part) WHERE process IS NOT NULL),
rs AS MATERIALIZED (SELECT xw.sector, xw.code, coalesce(
  (SELECT max(process) FROM pr WHERE process LIKE '% — %' AND lower(split_part(process, ' — ', 2)) = xw.name_key),
  (SELECT arg_max(process, len(process)) FROM pr WHERE process NOT LIKE '% — %' AND
    (xw.code = process OR starts_with(xw.code, process || '_')))) AS process FROM xw)"""
_EQ = """
pairs AS (SELECT DISTINCT sector AS source, process AS target FROM rs WHERE process IS NOT NULL)"""
_GAPPY = inputs.CONC_SQL + """,
gp AS (SELECT * FROM conc WHERE source NOT IN ('ECONOMY', 'STANDARD'))"""
_FILL = f"""
ik2 AS (SELECT name AS source, {inputs.numeric_sql('code')} AS num FROM ic),
gaps AS (SELECT * FROM ik2 WHERE source NOT IN (SELECT source FROM gp))"""
_PW = inputs.SUPPLY_SQL + "," + inputs.CAND_SQL + "," + _GAPPY + """,
cov AS (SELECT DISTINCT source FROM gp),
seen AS (SELECT s.* FROM shr s WHERE product NOT LIKE 'Brand#2%' AND product IN (SELECT product FROM cand)),
obs AS (SELECT product, industry, weight / sum(weight) OVER (PARTITION BY product) AS weight FROM seen
  WHERE industry IN (SELECT source FROM cov)),
eq AS (SELECT product, industry, 1.0 / count(*) OVER (PARTITION BY product) AS weight FROM cand
  WHERE industry IN (SELECT source FROM cov)),
pw AS MATERIALIZED (SELECT product, industry, weight, 'supply-share' AS method, '' AS reason FROM obs UNION ALL
  SELECT product, industry, weight, 'code-prefix-fallback', CASE WHEN product IN (SELECT product FROM seen)
  THEN 'supplying industries are uncovered' ELSE 'product has no market supply' END FROM eq
  WHERE product NOT IN (SELECT product FROM obs))"""


def _sector_case() -> str:
    from rippleflow.functions.labels import COARSE_SECTOR_KEYWORDS
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(name), '{w}')" for w in words) + f" THEN '{target}'"
        for target, words in COARSE_SECTOR_KEYWORDS)
    return f"CASE {arms} ELSE 'other' END"


def _fold_sql(rounds: int, materiality: float) -> str:
    """The folding loop unrolled: each step relabels routes and merges the top dusty pair."""
    ctes = [economy_sql(), f"""
routes AS MATERIALIZED (SELECT origin, dest, sector, sum(v) AS v FROM (
  SELECT i_region AS origin, j_region AS dest, i_sector AS sector, z AS v FROM z UNION ALL
  SELECT region, d_region, sector, value FROM fd) WHERE origin <> dest GROUP BY 1, 2, 3),
thr AS (SELECT {materiality} * greatest(sum(value), 1.0) AS t FROM fd),
m0 AS MATERIALIZED (SELECT DISTINCT region, region AS grp FROM x)"""]
    for i in range(rounds):
        ctes.append(f"""
r{i} AS (SELECT a.grp AS go, b.grp AS gd, sector, sum(v) AS v FROM routes JOIN m{i} a ON a.region = origin
  JOIN m{i} b ON b.region = dest WHERE a.grp <> b.grp GROUP BY 1, 2, 3),
t{i} AS MATERIALIZED (SELECT go, gd FROM r{i} GROUP BY 1, 2 HAVING bool_or(v > 0 AND v < (SELECT t FROM thr))
  ORDER BY sum(v) DESC, go, gd LIMIT 1),
m{i + 1} AS MATERIALIZED (SELECT region, coalesce((SELECT gd FROM t{i} WHERE go = grp), grp) AS grp FROM m{i})""")
    return with_sql(*ctes) + f""" SELECT region, string_agg(region, '+' ORDER BY region)
OVER (PARTITION BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS grp FROM m{rounds}"""


ORACLES = {
    "orphans": "SELECT 'PROMO' AS source FROM part WHERE p_type = 'PROMO' GROUP BY 1",
    "bridge": _AGG + f" SELECT region, sector, t_region, t_sector, {r6('weight')} AS weight FROM br",
    "aggregate_coeff": _AGG + f"""
SELECT bi.t_region AS i_region, bi.t_sector AS i_sector, bj.t_region AS j_region, bj.t_sector AS j_sector,
  {r6('sum(bi.weight * bj.weight * z.z) / max(cx.x)')} AS a FROM z
JOIN br bi ON bi.region = z.i_region AND bi.sector = z.i_sector
JOIN br bj ON bj.region = z.j_region AND bj.sector = z.j_sector
JOIN cx ON cx.region = bj.t_region AND cx.sector = bj.t_sector GROUP BY 1, 2, 3, 4""",
    "aggregate_output": _AGG + f" SELECT region, sector, {r6('x', 10)} AS x FROM cx",
    "aggregate_demand": _AGG + "," + _CDEM + (
        f" SELECT region, sector, d_region, {r6('value', 10)} AS value FROM cd"),
    "aggregate_institutions": _AGG + f""",
full_i AS (SELECT g.region, g.sector, r.region AS d_region, i.institution FROM x g CROSS JOIN
  (SELECT DISTINCT region FROM x) r CROSS JOIN (VALUES ('household'), ('government'), ('investment')) i(institution)),
sp AS (SELECT f.*, coalesce(c.v, 0) AS value FROM full_i f LEFT JOIN (SELECT region, sector, d_region,
  {_INST} AS institution, sum(value) AS v FROM cat GROUP BY 1, 2, 3, 4) c USING (region, sector, d_region, institution))
SELECT b.t_region AS region, b.t_sector AS sector, rm.target AS d_region, institution,
  {r6('sum(weight * value)', 10)} AS value FROM sp JOIN br b USING (region, sector)
JOIN rm ON rm.source = sp.d_region GROUP BY 1, 2, 3, 4""",
    "aggregate_satellite": _AGG + f"""
SELECT stressor, t_region AS region, t_sector AS sector, {r6('sum(weight * intensity * x.x) / max(cx.x)', 5)}
  AS intensity, unit FROM sat JOIN x USING (region, sector) JOIN br USING (region, sector)
JOIN cx ON cx.region = t_region AND cx.sector = t_sector GROUP BY 1, 2, 3, 5""",
    "aggregation_conserves": _AGG + "," + _CDEM + f""",
t AS (SELECT 'aggregation_conserves_output' AS name, (SELECT sum(x) FROM x) AS a, (SELECT sum(x) FROM cx) AS b
  UNION ALL SELECT 'aggregation_conserves_final_demand', (SELECT sum(value) FROM fd), (SELECT sum(value) FROM cd))
SELECT name, CASE WHEN abs(a - b) <= 1e-8 + 1e-4 * abs(b) THEN 'pass' ELSE 'fail' END AS severity,
  {r6('abs(a - b) / abs(a)')} AS value, CAST(1e-4 AS DOUBLE) AS tolerance FROM t""",
    "coarse_map": f"""
SELECT 'sector' AS kind, name, {_sector_case()} AS target, false AS rest FROM (SELECT DISTINCT p_name AS name FROM part)
UNION ALL SELECT 'region', name, CASE WHEN name IN ('US', 'CN') THEN name WHEN name IN ('WA', 'KR', 'AU')
 THEN 'RoW_Asia' WHEN name IN ('WF', 'ZA') THEN 'RoW_Africa' WHEN name = 'AT' THEN 'RoW_Europe'
 WHEN name = 'WM' THEN 'RoW_MiddleEast' ELSE 'RoW_Other' END, name LIKE 'W%' FROM (SELECT DISTINCT
 ['US','CN','WA','WF','AT','ZA','KR','AU','WM','XX'][n_nationkey % 10 + 1] AS name FROM nation)""",
    "numeric_keys": "WITH " + inputs.CODES_SQL + f"""
SELECT name, code, {inputs.numeric_sql('code')} AS num FROM (SELECT * FROM pc UNION ALL SELECT * FROM ic)""",
    "prefix_rollback": "WITH " + inputs.CAND_SQL + " SELECT product, industry FROM cand",
    "crosswalk_resolution": "WITH " + _XW + " SELECT sector, code, process FROM rs",
    "equal_weight_concordance": "WITH " + _XW + "," + _EQ + f"""
SELECT source, target, {r6('1.0 / count(*) OVER (PARTITION BY source)')} AS weight FROM pairs""",
    "crosswalk_audit": "WITH " + _XW + """,
rx AS (SELECT * FROM rs WHERE sector <> 'Brand#1' OR process IS NULL),
known AS (SELECT DISTINCT sector, process FROM rx WHERE process IS NOT NULL)
SELECT 'multi_process' AS kind, sector AS item, string_agg(process, ',' ORDER BY process) AS detail FROM known
GROUP BY sector HAVING count(*) > 1 UNION ALL
SELECT DISTINCT 'unresolved', sector, '' FROM rx WHERE sector NOT IN (SELECT sector FROM known) UNION ALL
SELECT 'rollback', code, string_agg(DISTINCT process, ',' ORDER BY process) FROM rx WHERE process <> code GROUP BY code""",
    "sibling_fill": "WITH " + inputs.CODES_SQL + "," + _GAPPY + "," + _FILL + f"""
SELECT g.source, c.target, {r6('sum(c.weight) / sum(sum(c.weight)) OVER (PARTITION BY g.source)')} AS weight
FROM gaps g JOIN ik2 s ON s.num = g.num JOIN gp c ON c.source = s.source GROUP BY 1, 2""",
    "sibling_audit": "WITH " + inputs.CODES_SQL + "," + _GAPPY + "," + _FILL + """
SELECT g.source, string_agg(DISTINCT s.source, ',' ORDER BY s.source) AS siblings FROM gaps g JOIN ik2 s
ON s.num = g.num WHERE s.source IN (SELECT source FROM gp) GROUP BY 1""",
    "supply_shares": "WITH " + inputs.SUPPLY_SQL + f"""
SELECT product, industry, {r6('weight')} AS weight FROM shr""",
    "product_weights": "WITH " + _PW + f"""
SELECT product, industry, {r6('weight')} AS weight, method, reason FROM pw""",
    "product_bridge": "WITH " + _PW + f"""
SELECT p.product AS source, c.target, {r6('sum(p.weight * c.weight) / sum(sum(p.weight * c.weight)) OVER (PARTITION BY p.product)')}
 AS weight FROM pw p JOIN gp c ON c.source = p.industry GROUP BY p.product, c.target""",
    "bridge_methods": "WITH " + _PW + """
SELECT method, count(DISTINCT product) AS n_products FROM pw GROUP BY 1 UNION ALL
SELECT 'uncovered', count(*) FROM (SELECT DISTINCT product FROM cand WHERE product NOT IN
 (SELECT product FROM pw)) HAVING count(*) > 0""",
    "compose_concordance": "WITH " + _GAPPY + "," + _GROUPS + f"""
SELECT sg.target AS source, gp.target, {r6('sum(gp.weight) / sum(sum(gp.weight)) OVER (PARTITION BY sg.target)')} AS weight
FROM gp JOIN sg ON sg.source = gp.source AND sg.weight > 0.5 GROUP BY sg.target, gp.target""",
    "omitted_members": "WITH " + _GAPPY + "," + _GROUPS + """
SELECT sg.target AS grp, sg.source FROM sg WHERE sg.weight > 0.5 AND sg.source NOT IN (SELECT source FROM gp)""",
    "bilateral_trade": with_sql(economy_sql()) + f"""
SELECT origin, dest, sector, {r6('sum(v)')} AS value FROM (
 SELECT i_region AS origin, j_region AS dest, i_sector AS sector, z AS v FROM z UNION ALL
 SELECT region, d_region, sector, value FROM fd) WHERE origin <> dest GROUP BY 1, 2, 3""",
    "dust_folding": _fold_sql(5, 0.0065),
}
