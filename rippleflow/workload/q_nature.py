"""Queries on dependencies, exposure, stress, physical states and capital panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow import schema
from rippleflow.functions.hashing import content_hash, map_hash
from rippleflow.functions.paths import level_at
from rippleflow.operators import nature, panel
from rippleflow.plans.joins import union_all
from rippleflow.session import literal_table
from rippleflow.workload import inputs
from rippleflow.workload.common import (
    COVERED, economy_sql, multiset_sql, parts_sql, r6, rounded, values, with_sql,
)
from rippleflow.workload.economy import economy, read

STRESSES = [
    ("drought", "w", "nature_stress", 0.4, None, None, "click", [], [], None),
    ("drought", "q", "nature_stress", 0.5, None, None, "view", ["LARGE", "PROMO"], ["ASIA"], None),
    ("slow", "p", "nature_stress", 0.6, None, None, "purchase", [], ["EUROPE", "ASIA"],
     {2030: 0.2, 2040: 0.6}),
]
STRESS_YEARS = [("drought", 2030), ("slow", 2025), ("slow", 2035), ("slow", 2045)]
STRESS_LEVELS = [("drought", 2030, "w", 0.4), ("drought", 2030, "q", 0.5), ("slow", 2025, "p", 0.2),
                 ("slow", 2035, "p", 0.4), ("slow", 2045, "p", 0.6)]


def ratings(spark, d):
    return nature.clean_ratings(inputs.raw_ratings(spark, d))


def score_matrix(spark, d):
    return rounded(nature.score_matrix(ratings(spark, d)), "score")


def data_coverage(spark, d):
    return rounded(nature.data_coverage(ratings(spark, d)), "coverage")


def _scores(spark, d):
    return nature.sector_scores(ratings(spark, d), inputs.type_brand(spark, d))


def sector_scores(spark, d):
    return rounded(_scores(spark, d), "score", "nd_share")


def nd_mask(spark, d):
    return nature.nd_mask(_scores(spark, d), 0.15)


def _direct(spark, d):
    return nature.goods_scores(_scores(spark, d), economy(spark, d).output)


def goods_scores(spark, d):
    return rounded(_direct(spark, d), "score")


def exposure_weighted(spark, d):
    e = economy(spark, d)
    return rounded(nature.exposure_weighted(e.coeff, _direct(spark, d)), "exposure")


def exposure_max(spark, d):
    e = economy(spark, d)
    return rounded(nature.exposure_max(e.coeff, _direct(spark, d), threshold=0.02), "exposure")


def exposure_parts(spark, d):
    e = economy(spark, d)
    direct = _direct(spark, d)
    total = nature.exposure_weighted(e.coeff, direct)
    return rounded(nature.exposure_parts(direct, total), "direct", "total", "upstream")


def _stress(spark):
    return (literal_table(spark, STRESSES, schema.SHOCK),
            literal_table(spark, STRESS_YEARS, schema.SCENARIO_YEAR))


def stress_productivity(spark, d):
    s, y = _stress(spark)
    return rounded(nature.stress_productivity(s, y, nature.direct_exposure(_direct(spark, d))),
                   "delta")


def stress_collapsed(spark, d):
    s, y = _stress(spark)
    return rounded(nature.stress_collapsed(s, y, nature.direct_exposure(_direct(spark, d))), "delta")


def nature_stamp(spark, d):
    s, _ = _stress(spark)
    return nature.nature_stamp(_scores(spark, d), s)


def _daily(spark, d):
    """Index of daily event value per type, first day = 100."""
    ev = read(spark, d, "events").groupBy(
        F.col("event_type").alias("channel_id"), F.dayofmonth("ts").alias("day")
    ).agg(F.sum("value").alias("v"))
    first = ev.groupBy("channel_id").agg(F.min_by("v", "day").alias("v0"))
    return ev.join(first, "channel_id").select(
        "channel_id", "day", (100.0 * F.col("v") / F.col("v0")).alias("state"))


def _channels(spark, d):
    names = read(spark, d, "events").select(F.col("event_type").alias("channel_id")).distinct()
    bent = F.col("channel_id").isin("click", "view")
    return names.select(
        "channel_id", F.concat(F.lit("m_"), "channel_id").alias("mechanism"),
        F.array("channel_id").alias("services"), F.lit(100.0).alias("baseline"),
        F.lit(0.8).alias("sensitivity"), F.when(bent, 0.9).alias("threshold"),
        F.lit(2.0).alias("exponent"))


def state_severity(spark, d):
    states = _daily(spark, d).select(
        F.lit("obs").alias("scenario_id"), "channel_id", F.col("day").alias("year"), "state")
    return rounded(nature.severity_path(_channels(spark, d), states), "state", "severity", digits=7)


def _pathways(spark, d):
    """Observed daily states as explicit points, every other day missing, slow recovery."""
    pts = _daily(spark, d).where("day % 2 = 1 AND day > 1").groupBy("channel_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("day").cast("int"), F.col("state"))))).alias("states"))
    explicit = pts.select(
        F.lit("obs").alias("scenario_id"), "channel_id", F.lit(100.0).alias("baseline"), "states",
        F.lit(None).cast("double").alias("degradation_rate"),
        F.lit(None).cast("int").alias("start_year"), F.lit(1.5).alias("recovery_rate"))
    rate = pts.select(
        F.lit("rate").alias("scenario_id"), "channel_id", F.lit(100.0).alias("baseline"),
        F.lit(None).cast("map<int,double>").alias("states"),
        F.length("channel_id").cast("double").alias("degradation_rate"), F.lit(3).alias("start_year"),
        F.lit(None).cast("double").alias("recovery_rate"))
    return union_all([explicit, rate])


def _days(spark):
    return spark.range(1, 31).select(F.explode(F.array(F.lit("obs"), F.lit("rate"))).alias(
        "scenario_id"), F.col("id").cast("int").alias("year"))


def recovery_lag(spark, d):
    return rounded(nature.state_path(_pathways(spark, d), _days(spark)), "state", digits=7)


def state_stresses(spark, d):
    """Peak severity per service of the stresses the pathways imply."""
    states = nature.state_path(_pathways(spark, d), _days(spark))
    ch = _channels(spark, d)
    s = nature.stresses_from_states(ch, nature.severity_path(ch, states))
    return rounded(s.select("scenario_id", "service", "level", F.size("path").alias("n_years")),
                   "level", digits=7)


def path_levels(spark, d):
    """Shock paths built from yearly order totals, read between, before and after their points."""
    pts = read(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")
    ).agg((F.sum("o_totalprice") / 1e6).alias("v")).where("y % 2 = 1")
    path = pts.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("y").cast("int"), F.col("v"))))).alias("path"))
    out = path.select("k", "path", F.explode(F.sequence(F.lit(1994), F.lit(2003))).alias("year"))
    return rounded(out.select("k", "year", level_at(F.col("path"), F.col("year"), F.lit(0.0))
                              .alias("level")), "level", digits=5)


def capital_path(spark, d):
    buyer = read(spark, d, "customer").join(
        read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = read(spark, d, "orders").join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    p = o.groupBy(F.col("n_name").alias("key"), F.year("o_orderdate").alias("year")).agg(
        (F.sum("o_totalprice") / 1e6).alias("investment")).withColumn(
        "retirement", F.when(F.col("year") == 1998, 0.1).otherwise(0.0))
    k0 = buyer.groupBy(F.col("n_name").alias("key")).agg(
        (F.sum(F.greatest("c_acctbal", F.lit(0.0))) / 1e4).alias("k0"))
    return rounded(panel.capital_path(p, k0), "capital_stock", "capital_growth", digits=7)


def benchmark_capital(spark, d):
    """Stock from capital income (40 % of orders) and the growth investment (30 %) implies."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"),
                                      F.col("o_custkey") == F.col("c_custkey"))
    t = o.groupBy(F.col("c_mktsegment").alias("region")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    stock = panel.benchmark_capital(t.select("region", (F.col("v") * 0.4).alias("income")))
    inv = t.select("region", (F.col("v") * 0.03).alias("investment"))
    return rounded(stock.join(panel.implied_growth(stock, inv), "region"), "stock", "growth",
                   digits=7)


def trend_index(spark, d):
    y = read(spark, d, "orders").select(F.year("o_orderdate").alias("year"),
                                        F.col("o_orderstatus").alias("status")).distinct()
    g = literal_table(spark, [("labour", 0.01), ("tfp", 0.005)], "name string, g double")
    return rounded(panel.trend_index(y, g, ["status"]), "index")


def endowment_scale(spark, d):
    e = economy(spark, d)
    endow = e.output.groupBy("region").agg(F.sum("x").alias("x")).select(
        "region", F.explode(F.create_map(F.lit("CAP"), F.col("x") * 0.4, F.lit("LAB"),
                                         F.col("x") * 0.6)).alias("factor", "value"))
    scale = literal_table(spark, [("CAP", None, 1.2), ("LAB", "ASIA", 0.9)],
                                  "factor string, region string, scale double")
    return rounded(panel.scale_endowments(endow, scale), "value", digits=7)


def mapping_hash(spark, d):
    """Content hash of the nation to region map and of every label."""
    m = map_hash(inputs.nation_map(spark, d), ["source", "target"]).select(
        F.lit("nation_map").alias("item"), "content_hash")
    e = economy(spark, d)
    rows = e.output.select(F.concat_ws(":", "region", "sector").alias("item"),
                           content_hash(F.concat_ws("|", "region", "sector")).alias("content_hash"))
    return m.unionByName(rows)


QUERIES = {f.__name__: f for f in (
    ratings, score_matrix, data_coverage, sector_scores, nd_mask, goods_scores, exposure_weighted,
    exposure_max, exposure_parts, stress_productivity, stress_collapsed, nature_stamp,
    state_severity, recovery_lag, state_stresses, path_levels, capital_path, benchmark_capital,
    trend_index, endowment_scale, mapping_hash)}

_SC = with_sql(economy_sql(), inputs.SCORES_SQL)
_DIR = _SC + """,
dr AS MATERIALIZED (SELECT x.region, x.sector, s.service, coalesce(sc.score, 0.0) AS score FROM x
  CROSS JOIN (SELECT DISTINCT service FROM sc) s LEFT JOIN sc ON sc.sector = x.sector AND sc.service = s.service)"""
_EXP = _DIR + """,
eit AS (SELECT 0 AS step, region, sector, service, score AS term FROM dr UNION ALL
  SELECT e.step + 1, c.j_region, c.j_sector, e.service, sum((1 - d.score) * c.a * e.term) FROM eit e
  JOIN coeff c ON c.i_region = e.region AND c.i_sector = e.sector
  JOIN dr d ON d.region = c.j_region AND d.sector = c.j_sector AND d.service = e.service
  WHERE e.step < 60 GROUP BY 1, 2, 3, 4),
ex AS (SELECT region, sector, service, sum(term) AS e FROM eit GROUP BY 1, 2, 3)"""
_STR = values("st", "scenario_id, shock_id, service, sectors, regions",
              [(s[0], s[1], s[6], s[7], s[8]) for s in STRESSES]) + "," + values(
    "lv", "scenario_id, year, shock_id, level", STRESS_LEVELS)
_DELTA = _DIR + "," + _STR + f""",
dl AS MATERIALIZED (SELECT s.scenario_id, lv.year, g.region, g.sector, product(1 - lv.level * g.score) - 1 AS delta
  FROM st s JOIN lv USING (scenario_id, shock_id) JOIN dr g ON g.service = s.service AND {COVERED}
  GROUP BY 1, 2, 3, 4)"""
_DAILY = """
ev AS (SELECT event_type AS channel_id, CAST(day(ts) AS INTEGER) AS day, sum(value) AS v FROM events GROUP BY 1, 2),
dly AS MATERIALIZED (SELECT channel_id, day, 100.0 * v / first_value(v) OVER (PARTITION BY channel_id ORDER BY day) AS state FROM ev)"""


def _severity(state):
    lin = f"0.8 * least(1.0, greatest(0.0, (100 - {state}) / 100))"
    return (f"least(1.0, greatest(0.0, CASE WHEN channel_id IN ('click', 'view') AND "
            f"greatest(0.0, {state} / 100) < 0.9 THEN {lin} + (1 - {lin}) * "
            f"pow((0.9 - greatest(0.0, {state} / 100)) / 0.9, 2) ELSE {lin} END))")


_LAG = "WITH RECURSIVE " + _DAILY + """,
yr AS (SELECT unnest(range(1, 31)) AS year),
ch AS (SELECT DISTINCT channel_id FROM ev),
pt AS (SELECT channel_id, day, state FROM dly WHERE day % 2 = 1 AND day > 1),
rw AS MATERIALIZED (SELECT c.channel_id, CAST(y.year AS INTEGER) AS year, CASE WHEN lo.day IS NULL THEN 100.0
  WHEN hi.day IS NULL THEN lo.state WHEN hi.day = lo.day THEN lo.state
  ELSE lo.state + (y.year - lo.day) / CAST(hi.day - lo.day AS DOUBLE) * (hi.state - lo.state) END AS s
  FROM ch c CROSS JOIN yr y
  LEFT JOIN pt lo ON lo.channel_id = c.channel_id AND lo.day = (SELECT max(day) FROM pt p WHERE p.channel_id = c.channel_id AND p.day <= y.year)
  LEFT JOIN pt hi ON hi.channel_id = c.channel_id AND hi.day = (SELECT min(day) FROM pt p WHERE p.channel_id = c.channel_id AND p.day >= y.year)),
lg AS (SELECT channel_id, year, s AS state FROM rw WHERE year = 1 UNION ALL
  SELECT r.channel_id, r.year, CASE WHEN r.s >= l.state THEN least(r.s, l.state + 1.5) ELSE r.s END
  FROM lg l JOIN rw r ON r.channel_id = l.channel_id AND r.year = l.year + 1),
sp AS MATERIALIZED (SELECT 'obs' AS scenario_id, channel_id, year, state FROM lg UNION ALL
  SELECT 'rate', channel_id, CAST(year AS INTEGER), greatest(0.0, 100.0 - len(channel_id) * greatest(0, year - 3)) FROM ch CROSS JOIN yr)"""

ORACLES = {
    "ratings": "WITH " + inputs.RATINGS_SQL + " SELECT process, service, materiality FROM rt",
    "score_matrix": "WITH " + inputs.RATINGS_SQL + """
SELECT p.process, s.service, CAST(coalesce(rt.score, 0.0) AS DOUBLE) AS score, coalesce(rt.nd, false) AS no_data
FROM (SELECT DISTINCT process FROM rt) p CROSS JOIN (SELECT DISTINCT service FROM rt) s
LEFT JOIN rt USING (process, service)""",
    "data_coverage": "WITH " + inputs.RATINGS_SQL + f"""
SELECT {r6('avg(CASE WHEN nd THEN 0.0 ELSE 1.0 END)')} AS coverage FROM rt""",
    "sector_scores": _SC + f"""
SELECT sector, service, {r6('score')} AS score, {r6('nd_share')} AS nd_share FROM sc""",
    "nd_mask": _SC + " SELECT sector, service FROM sc WHERE nd_share >= 0.15 - 1e-12",
    "goods_scores": _DIR + f" SELECT region, sector, service, {r6('score')} AS score FROM dr",
    "exposure_weighted": _EXP + f" SELECT region, sector, service, {r6('e')} AS exposure FROM ex",
    "exposure_max": _DIR + f""",
rc AS (SELECT region AS fr, sector AS fs, region AS tr, sector AS ts FROM x UNION
  SELECT rc.fr, rc.fs, c.j_region, c.j_sector FROM rc JOIN coeff c ON c.i_region = rc.tr AND c.i_sector = rc.ts
  WHERE c.a > 0.02)
SELECT rc.tr AS region, rc.ts AS sector, d.service, {r6('max(least(d.score, 1.0))')} AS exposure FROM rc
JOIN dr d ON d.region = rc.fr AND d.sector = rc.fs GROUP BY 1, 2, 3""",
    "exposure_parts": _EXP + f"""
SELECT region, sector, service, {r6('score')} AS direct, {r6('e')} AS total, {r6('e - score')} AS upstream
FROM ex JOIN dr USING (region, sector, service)""",
    "stress_productivity": _DELTA + f"""
SELECT scenario_id, year, region, sector, {r6('delta')} AS delta FROM dl
QUALIFY max(-delta) OVER (PARTITION BY scenario_id, region, sector) >= 1e-9""",
    "stress_collapsed": _DELTA + f""",
m AS (SELECT scenario_id, year, sector, sum(delta) / (SELECT count(*) FROM x WHERE x.sector = dl.sector) AS d
  FROM dl GROUP BY 1, 2, 3)
SELECT scenario_id, year, sector, {r6('d')} AS delta FROM m
QUALIFY max(-d) OVER (PARTITION BY scenario_id, sector) >= 1e-9""",
    "nature_stamp": _SC + """
SELECT service, sector, round(nd_share, 4) AS nd_share, nd_share >= 1 - 1e-9 AS fully_unknown FROM sc
WHERE service IN ('click', 'view', 'purchase') AND nd_share > 1e-9""",
    "state_severity": "WITH " + _DAILY + f"""
SELECT 'obs' AS scenario_id, channel_id, day AS year, {r6('state', 7)} AS state,
 {r6(_severity('state'), 7)} AS severity FROM dly""",
    "recovery_lag": _LAG + f"""
SELECT scenario_id, channel_id, year, {r6('state', 7)} AS state FROM sp""",
    "state_stresses": _LAG + f"""
SELECT scenario_id, channel_id AS service, {r6('max(' + _severity('state') + ')', 7)} AS level,
 CAST(count(*) AS INTEGER) AS n_years FROM sp GROUP BY 1, 2 HAVING max({_severity('state')}) > 1e-12""",
    "path_levels": f"""
WITH pt AS (SELECT o_orderpriority AS k, CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) / 1e6 AS v
  FROM orders GROUP BY 1, 2 HAVING y % 2 = 1),
q AS (SELECT k, CAST(year AS INTEGER) AS year FROM (SELECT DISTINCT k FROM pt), (SELECT unnest(range(1994, 2004)) AS year)),
b AS (SELECT q.*, (SELECT max(y) FROM pt WHERE pt.k = q.k AND y <= q.year) AS lo,
  (SELECT min(y) FROM pt WHERE pt.k = q.k AND y >= q.year) AS hi FROM q)
SELECT b.k, b.year, {r6('''CASE WHEN lo IS NULL THEN h.v WHEN hi IS NULL OR hi = lo THEN l.v
 ELSE l.v + (b.year - lo) / CAST(hi - lo AS DOUBLE) * (h.v - l.v) END''', 5)} AS level
FROM b LEFT JOIN pt l ON l.k = b.k AND l.y = lo LEFT JOIN pt h ON h.k = b.k AND h.y = hi""",
    "capital_path": f"""
WITH RECURSIVE inv AS MATERIALIZED (SELECT n_name AS key, CAST(year(o_orderdate) AS INTEGER) AS year,
  sum(o_totalprice) / 1e6 AS i, row_number() OVER (PARTITION BY n_name ORDER BY year(o_orderdate)) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2, year(o_orderdate)),
k AS (SELECT n_name AS key, CAST(0 AS BIGINT) AS n, 0 AS year, sum(greatest(c_acctbal, 0)) / 1e4 AS k, 0.0::DOUBLE AS g
  FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 UNION ALL
  SELECT k.key, i.n, i.year, 0.95 * (CASE WHEN i.year = 1998 THEN 0.9 ELSE 1.0 END) * k.k + i.i,
  (0.95 * (CASE WHEN i.year = 1998 THEN 0.9 ELSE 1.0 END) * k.k + i.i) / k.k - 1 FROM k JOIN inv i
  ON i.key = k.key AND i.n = k.n + 1)
SELECT key, year, {r6('k', 7)} AS capital_stock, {r6('g', 7)} AS capital_growth FROM k WHERE n > 0""",
    "benchmark_capital": f"""
WITH t AS (SELECT c_mktsegment AS region, sum(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT region, {r6('v * 0.4 / 0.09', 7)} AS stock, {r6('v * 0.03 / (v * 0.4 / 0.09) - 0.05', 7)} AS growth FROM t""",
    "trend_index": f"""
WITH y AS (SELECT DISTINCT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY year) - 1 AS i FROM y)
SELECT status, name, year, {r6('pow(1 + g, i)')} AS index FROM p CROSS JOIN
 (VALUES ('labour', CAST(0.01 AS DOUBLE)), ('tfp', CAST(0.005 AS DOUBLE))) t(name, g)""",
    "endowment_scale": with_sql(economy_sql()) + f""",
t AS (SELECT region, sum(x) AS x FROM x GROUP BY 1)
SELECT region, 'CAP' AS factor, {r6('x * 0.4 * 1.2', 7)} AS value FROM t UNION ALL
SELECT region, 'LAB', {r6("x * 0.6 * CASE WHEN region = 'ASIA' THEN 0.9 ELSE 1.0 END", 7)} FROM t""",
    "mapping_hash": with_sql(economy_sql()) + f"""
SELECT 'nation_map' AS item, substring(sha256((SELECT count(*)::VARCHAR || '|' || {multiset_sql(parts_sql('n_name', 'r_name'))}
 FROM nation JOIN region ON r_regionkey = n_regionkey)), 1, 12) AS content_hash UNION ALL
SELECT region || ':' || sector, substring(sha256(region || '|' || sector), 1, 12) FROM x""",
}
