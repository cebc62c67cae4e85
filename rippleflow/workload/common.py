"""Shared pieces of the registered queries: scenario tables and the SQL text of the economy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow import schema
from rippleflow.session import literal_table
from rippleflow.workload.economy import CATEGORY_OF_SEGMENT


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    """Round to fixed digits and turn a negative zero into zero."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c)
        for c in df.columns])


def r6(expr: str, digits: int = 8) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


# (scenario, shock, type, level, gases, carrier, service, sectors, regions, path)
SHOCKS = [
    ("flat", "c0", "carbon_price", 100.0, ["CO2"], None, None, [], [], None),
    ("path", "c0", "carbon_price", 10.0, ["CO2", "CH4"], None, None, ["LARGE", "SMALL"], [],
     {2020: 50.0, 2030: 100.0}),
    ("path", "c1", "carbon_price", 30.0, ["CO2e"], None, None, [], ["EUROPE", "ASIA"], None),
    ("energy", "c0", "carbon_price", 50.0, ["CO2"], None, None, [], [], None),
    ("energy", "e0", "energy_price", 0.3, None, "ECONOMY", None, [], ["ASIA", "AFRICA"], None),
    ("supply", "c0", "carbon_price", 20.0, ["CO2"], None, None, [], [], None),
    ("supply", "p0", "productivity", -0.1, None, None, None, ["LARGE"], [], None),
    ("supply", "p1", "productivity", -0.2, None, None, None, [], ["ASIA"],
     {2020: -0.2, 2030: -0.4}),
]
YEARS = {"flat": [2020], "path": [2020, 2025, 2035], "energy": [2020], "supply": [2020, 2025]}
# Levels of the shocks above per year, worked out by hand for the SQL side.
LEVELS = [
    ("flat", "c0", 2020, 100.0), ("path", "c0", 2020, 50.0), ("path", "c0", 2025, 75.0),
    ("path", "c0", 2035, 100.0), ("path", "c1", 2020, 30.0), ("path", "c1", 2025, 30.0),
    ("path", "c1", 2035, 30.0), ("energy", "c0", 2020, 50.0), ("energy", "e0", 2020, 0.3),
    ("supply", "c0", 2020, 20.0), ("supply", "c0", 2025, 20.0), ("supply", "p0", 2020, -0.1),
    ("supply", "p0", 2025, -0.1), ("supply", "p1", 2020, -0.2), ("supply", "p1", 2025, -0.3),
]
ELASTICITIES = [
    ("ECONOMY", -0.8, -0.4, -0.2, "survey", "medium"),
    ("LARGE", -1.3, -0.9, -0.6, "survey", "medium"),
    ("SMALL", -1.0, -0.7, -0.4, "survey", "low"),
    ("PROMO", -0.5, -0.3, -0.1, "survey", "high"),
]


def shocks(spark: SparkSession, *scenarios: str) -> DataFrame:
    rows = [s for s in SHOCKS if not scenarios or s[0] in scenarios]
    return literal_table(spark, rows, schema.SHOCK)


def years(spark: SparkSession, *scenarios: str) -> DataFrame:
    rows = [(s, y) for s, ys in YEARS.items() if not scenarios or s in scenarios for y in ys]
    return literal_table(spark, rows, schema.SCENARIO_YEAR)


def elasticities(spark: SparkSession) -> DataFrame:
    return literal_table(spark, ELASTICITIES, schema.ELASTICITY)


# -- SQL side ------------------------------------------------------------------------------------

def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, list):
        return "CAST([" + ", ".join(_lit(x) for x in v) + "] AS VARCHAR[])"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def shock_sql(*scenarios: str) -> str:
    """CTEs ``shock`` (one row per shock and year) and ``yr``."""
    rows = []
    for sc, sh, year, level in LEVELS:
        if scenarios and sc not in scenarios:
            continue
        s = next(x for x in SHOCKS if x[0] == sc and x[1] == sh)
        rows.append((sc, sh, s[2], year, level, s[4] or [], s[5], s[7], s[8]))
    yr = [(s, y) for s, ys in YEARS.items() if not scenarios or s in scenarios for y in ys]
    return (values("shock", "scenario_id, shock_id, type, year, level, gases, carrier, sectors, "
                   "regions", rows) + ", " + values("yr", "scenario_id, year", yr))


def lines_sql(where: str = "") -> str:
    """CTE ``fl``: every order line with its producer and consumer labels."""
    return f"""
anchor AS (SELECT l_orderkey AS ok, (min({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey,
  'e': l_extendedprice}})).p AS pk FROM lineitem GROUP BY l_orderkey),
fl AS (SELECT sn.n_name AS o_nation, sr.r_name AS o_region, p.p_type AS o_sector,
  cn.n_name AS d_nation, cr.r_name AS d_region, ap.p_type AS d_sector, c.c_mktsegment AS segment,
  l.l_returnflag AS rf, l.l_linestatus AS ls, l.l_extendedprice / 1e6 AS ext, l.l_quantity AS qty,
  l.l_discount AS disc, l.l_tax AS tax, p.p_brand AS o_brand
 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
 JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
 JOIN region sr ON sr.r_regionkey = sn.n_regionkey JOIN orders o ON o.o_orderkey = l.l_orderkey
 JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey
 JOIN region cr ON cr.r_regionkey = cn.n_regionkey JOIN anchor a ON a.ok = l.l_orderkey
 JOIN part ap ON ap.p_partkey = a.pk {where})"""


def economy_sql(grain: str = "region", where: str = "") -> str:
    """CTEs of the economy: fl, z, fd, x, coeff, sat (no leading WITH)."""
    g = grain
    category = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_OF_SEGMENT.items())
    return lines_sql(where) + f""",
z AS MATERIALIZED (SELECT o_{g} AS i_region, o_sector AS i_sector, d_{g} AS j_region, d_sector AS j_sector,
  sum(ext) AS z FROM fl WHERE rf = 'R' GROUP BY 1, 2, 3, 4),
fd AS MATERIALIZED (SELECT o_{g} AS region, o_sector AS sector, d_{g} AS d_region, sum(ext) AS value FROM fl
  WHERE rf <> 'R' GROUP BY 1, 2, 3),
cat AS (SELECT o_{g} AS region, o_sector AS sector, d_{g} AS d_region,
  CASE segment {category} END AS category, sum(ext) AS value FROM fl WHERE rf <> 'R'
  GROUP BY 1, 2, 3, 4),
x AS MATERIALIZED (SELECT o_{g} AS region, o_sector AS sector, sum(ext) AS x FROM fl GROUP BY 1, 2),
coeff AS MATERIALIZED (SELECT z.*, z.z / x.x AS a FROM z JOIN x ON x.region = z.j_region
  AND x.sector = z.j_sector),
tons AS (SELECT o_{g} AS region, o_sector AS sector, sum(qty * (1 + tax)) AS co2,
  sum(qty * disc) AS ch4, sum(qty * tax) AS n2o FROM fl GROUP BY 1, 2),
gwp(gas, w) AS (VALUES ('CO2', 1.0), ('CH4', 28.0), ('N2O', 265.0), ('CO2e', 1.0)),
sat AS MATERIALIZED (SELECT s.stressor, region, sector, s.t / x.x AS intensity,
  CASE WHEN s.stressor = 'CO2e' THEN 'tCO2e/MEUR' ELSE 't/MEUR' END AS unit
  FROM tons JOIN x USING (region, sector),
  LATERAL (VALUES ('CO2', co2), ('CH4', ch4), ('N2O', n2o), ('CO2e', co2 + 28 * ch4 + 265 * n2o))
  AS s(stressor, t))"""


COVERED = ("(len(s.sectors) = 0 OR list_contains(s.sectors, g.sector)) AND "
           "(len(s.regions) = 0 OR list_contains(s.regions, g.region))")

COST_SQL = f"""
cost AS MATERIALIZED (SELECT s.scenario_id, s.year, g.region, g.sector,
  sum(s.level * gwp.w * g.intensity * 1e-6) AS cost
  FROM (SELECT *, unnest(gases) AS gas FROM shock WHERE type = 'carbon_price') s
  JOIN sat g ON g.stressor = s.gas AND {COVERED} JOIN gwp ON gwp.gas = s.gas
  GROUP BY 1, 2, 3, 4),
pit AS (SELECT 0 AS step, scenario_id, year, region, sector, cost AS term FROM cost UNION ALL
  SELECT p.step + 1, p.scenario_id, p.year, c.j_region, c.j_sector, sum(c.a * p.term)
  FROM pit p JOIN coeff c ON c.i_region = p.region AND c.i_sector = p.sector WHERE p.step < 60
  GROUP BY 1, 2, 3, 4, 5),
part AS (SELECT scenario_id, year, region, sector,
  CASE step WHEN 0 THEN 'direct' WHEN 1 THEN 'upstream_tier_1' WHEN 2 THEN 'upstream_tier_2'
  WHEN 3 THEN 'upstream_tier_3' ELSE 'upstream_residual' END AS part, sum(term) AS value
  FROM pit GROUP BY 1, 2, 3, 4, 5),
dp AS MATERIALIZED (SELECT scenario_id, year, region, sector, sum(value) AS value FROM part GROUP BY 1, 2, 3, 4)"""

def parts_sql(*parts: str) -> str:
    """The SQL of ``hashing.joined_parts`` for parts that are not missing."""
    return " || ".join(f"length({p}) || ':' || {p}" for p in parts)


def multiset_sql(text: str) -> str:
    """The SQL of ``hashing.multiset_sum``."""
    return " || '-' || ".join(
        f"sum(('0x' || substring(sha256({text}), {1 + 15 * lane}, 15))::BIGINT::HUGEINT)::VARCHAR"
        for lane in range(4))


PARTS = ["direct", "upstream_tier_1", "upstream_tier_2", "upstream_tier_3", "upstream_residual"]


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes)
