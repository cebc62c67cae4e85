"""Queries on validation rules and quality metrics, run on tables with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from rippleflow.functions.hashing import table_fingerprint
from rippleflow.functions.labels import label
from rippleflow.operators import calibrate, checks, leontief, macro, nature, quality, sam
from rippleflow.operators.harmonise import demand_by_institution
from rippleflow.plans.joins import union_all
from rippleflow.session import literal_table
from rippleflow.workload import inputs
from rippleflow.workload.common import (
    economy_sql, multiset_sql, parts_sql, r6, rounded, shocks, with_sql,
)
from rippleflow.workload.economy import economy, read


def quality_report(spark, d):
    e = economy(spark, d)
    return rounded(quality.quality_report(e.coeff, e.output, e.final_demand, e.satellite),
                   "value", digits=7)


def quality_nation(spark, d):
    e = economy(spark, d, "nation")
    n = e.output.agg(F.count("*").alias("n"))
    return rounded(union_all([
        quality.column_sum_check(e.coeff), quality.satellite_checks(e.satellite, n),
        quality.negative_share_check(e.coeff, n)]), "value", digits=7)


def _small_report(e):
    n = e.output.agg(F.count("*").alias("n"))
    return union_all([quality.column_sum_check(e.coeff),
                      quality.satellite_checks(e.satellite, n),
                      quality.plausibility_checks(e.output, e.final_demand)])


def drift(spark, d):
    return rounded(quality.drift(_small_report(economy(spark, d, linestatus="F")),
                                 _small_report(economy(spark, d, linestatus="O"))), "value", digits=7)


def report_roll_up(spark, d):
    return quality.roll_up(_small_report(economy(spark, d, "nation")))


def negative_value_added(spark, d):
    e = economy(spark, d, "nation")
    return rounded(macro.negative_value_added(e.coeff, e.output), "x", "share", "va")


def violations_labels(spark, d):
    """Part names are not unique labels."""
    c = read(spark, d, "part").select(F.lit("parts").alias("name"), F.col("p_name").alias("label"))
    return checks.label_rules(c)


def violations_alignment(spark, d):
    """Cells of one region renamed, demand of one good doubled."""
    e = economy(spark, d)
    coeff = e.coeff.withColumn("i_region", F.when(
        (F.col("i_region") == "ASIA") & (F.col("j_sector") == "LARGE"), "ATLANTIS")
        .otherwise(F.col("i_region")))
    fd = e.final_demand.unionByName(e.final_demand.where("region = 'EUROPE' AND sector = 'PROMO'"))
    return checks.alignment_rules(coeff, fd, e.output).distinct()


def violations_axes(spark, d):
    e = economy(spark, d)
    return checks.axis_rules(e.output.where("NOT (region = 'ASIA' AND sector = 'LARGE')"),
                             e.output.where("region <> 'EUROPE'").select("region"),
                             e.output.select("sector"))


def violations_demand_shape(spark, d):
    e = economy(spark, d)
    return checks.demand_shape_rules(e.final_demand.where("d_region <> 'ASIA'"),
                                     e.output.where("region <> 'EUROPE'"), "by_region")


def violations_institutions(spark, d):
    """Household demand of one consumer turned negative, investment of another doubled."""
    e = economy(spark, d)
    split = demand_by_institution(e.demand_cells, e.output).withColumn("value", F.when(
        (F.col("d_region") == "ASIA") & (F.col("institution") == "household"), -F.col("value"))
        .when((F.col("d_region") == "EUROPE") & (F.col("institution") == "investment"),
              F.col("value") * 2).otherwise(F.col("value")))
    n = e.output.count()
    return checks.institution_rules(split, e.final_demand, n)


def violations_elasticities(spark, d):
    """Bands read off part types: some positive, some out of order, some without a source."""
    t = read(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(
        (F.avg("p_size") - 25.5).alias("m"), F.count("*").alias("n"))
    e = t.select("key", (F.col("m") - 1).alias("low"), F.col("m").alias("central"),
                 (F.col("m") + F.when(F.col("n") % 3 == 0, -2).otherwise(1)).alias("high"),
                 F.when(F.col("n") % 2 == 0, "survey").alias("source"),
                 F.lit("low").alias("confidence"))
    return checks.elasticity_rules(e)


def violations_concordance(spark, d):
    c = inputs.type_brand(spark, d).withColumn("weight", F.when(
        F.col("source") == "LARGE", F.col("weight") * 1.1).when(
        (F.col("source") == "SMALL") & (F.col("target") == "Brand#3"), -F.col("weight"))
        .otherwise(F.col("weight")))
    return checks.concordance_rules(c)


def violations_results(spark, d):
    from rippleflow.workload.q_views import results
    r = results(spark, d).where("variable = 'price_change' AND scenario_id = 'flat'")
    bad = union_all([
        r, r.where("sector = 'LARGE'"),
        r.where("sector = 'SMALL'").withColumn("scenario", F.lit("median")),
        r.where("sector = 'PROMO'").withColumn("value", F.lit(float("nan"))).withColumn(
            "year", F.lit(1999))])
    return checks.result_rules(bad)


BAD_SHOCKS = [
    ("b", "0", "carbon_price", -5.0, ["CO2"], None, None, [], [], None),
    ("b", "1", "carbon_price", 5.0, [], None, None, [], [], None),
    ("b", "2", "carbon_price", 5.0, ["CO2", "CO2"], None, None, [], [], None),
    ("b", "3", "carbon_price", 5.0, ["CO2e", "CO2"], None, None, [], [], {2020: -1.0}),
    ("b", "4", "energy_price", -1.5, None, " ", None, [], [], None),
    ("b", "5", "productivity", -0.5, None, None, None, [], [], {2020: -2.0}),
    ("b", "6", "nature_stress", 1.5, None, None, "", [], [], None),
    ("b", "7", "magic", 1.0, None, None, None, [], [], None),
    ("b", "8", "carbon_price", 5.0, ["SF6", "CH4"], None, None, ["NOWHERE"], ["ASIA"], None),
    ("b", "9", "energy_price", 0.1, None, "COAL", None, [], ["MARS"], None),
]


def violations_shocks(spark, d):
    """Every parameter rule once, next to the coverage and gas rules of the build."""
    from rippleflow import schema
    e = economy(spark, d)
    s = literal_table(spark, BAD_SHOCKS, schema.SHOCK).unionByName(shocks(spark))
    sat = e.satellite.withColumn("intensity", F.when(
        (F.col("stressor") == "CH4") & (F.col("region") == "ASIA"), -1.0).otherwise(F.col("intensity")))
    return union_all([checks.shock_rules(s), checks.coverage_rules(s, e.output),
                      checks.gas_rules(s, sat, e.output),
                      checks.support_rules(s, ["carbon_price", "energy_price"])])


def violations_units(spark, d):
    e = economy(spark, d)
    sat = e.satellite.withColumn("unit", F.when(F.col("stressor") == "N2O", "kg/MEUR")
                                 .otherwise(F.col("unit")))
    return checks.unit_rules(sat, "USD", "MUSD", euro_only=True)


def violations_admissible(spark, d):
    e = economy(spark, d)
    c = e.coeff.withColumn("a", F.when(F.col("a") > 0.025, -F.col("a")).otherwise(F.col("a")))
    return checks.admissible_rules(c, 0.5)


def violations_exposure(spark, d):
    e = economy(spark, d, "nation")
    direct = e.output.select("region", "sector", F.lit("s").alias("service"), (F.col("x") / 10).alias("score"))
    return nature.exposure_violations(e.coeff, direct).distinct()


def violations_pins(spark, d):
    from rippleflow import schema
    e = economy(spark, d)
    s = literal_table(spark, [
        ("p", "0", "energy_price", 0.3, None, "LARGE", None, [], [], None),
        ("p", "1", "energy_price", 0.2, None, "LARGE", None, [], ["ASIA", "AFRICA"], None),
    ], schema.SHOCK)
    y = literal_table(spark, [("p", 2020)], schema.SCENARIO_YEAR)
    return checks.pin_rules(leontief.energy_pins(s, y, e.output))


def violations_ratings(spark, d):
    raw = inputs.raw_ratings(spark, d)
    return checks.ratings_rules(raw.unionByName(raw.where("service = 'view' AND process = 'Brand#7'")))


def violations_stresses(spark, d):
    from rippleflow import schema
    from rippleflow.workload.q_nature import STRESSES, _direct
    extra = [("drought", "w2", "nature_stress", 0.1, None, None, "click", ["SMALL"], [], None),
             ("drought", "x", "nature_stress", 0.1, None, None, "honey", [], [], None),
             ("drought", "y", "nature_stress", 0.1, None, None, "view", ["NOWHERE"], [], None)]
    s = literal_table(spark, STRESSES + extra, schema.SHOCK)
    return checks.stress_rules(s, nature.direct_exposure(_direct(spark, d))).unionByName(
        checks.region_scope_rules(s))


def violations_supply_shares(spark, d):
    from rippleflow.operators import concord
    shares = concord.supply_shares(inputs.supply_table(spark, d)).withColumn("weight", F.when(
        F.col("product") == "Brand#5", F.col("weight") * 2).otherwise(F.col("weight")))
    part = read(spark, d, "part")
    products = part.where("p_brand <> 'Brand#1'").select(F.col("p_brand").alias("product")).unionByName(
        literal_table(spark, [("Brand#99",)], "product string"))
    zero = literal_table(spark, [("Brand#3",)], "product string")
    industries = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("industry"))
    return checks.supply_share_rules(shares, zero, products, industries)


def label_classification(spark, d):
    """Which vocabulary the part types sold by each brand family belong to."""
    labels = read(spark, d, "part").select(
        F.col("p_brand").alias("build"), F.col("p_type").alias("sector")).distinct().where(
        "NOT (build LIKE 'Brand#1%' AND sector IN ('SMALL', 'PROMO')) AND "
        "NOT (build LIKE 'Brand#2%' AND sector <> 'LARGE')")
    vocab = read(spark, d, "part").select(F.col("p_type").alias("sector")).distinct()
    a = vocab.where("sector IN ('LARGE', 'MEDIUM', 'STANDARD', 'ECONOMY')")
    b = vocab.where("sector IN ('LARGE', 'SMALL', 'PROMO')")
    return checks.classify_labels(labels, a, b, ["build"])


def double_counting(spark, d):
    ev = read(spark, d, "events").select(F.col("event_type").alias("mechanism")).distinct()
    return checks.double_counting(ev.where("mechanism <> 'error'"),
                                  ev.where("mechanism IN ('error', 'view', 'click')"))


def violations_sam(spark, d):
    """The closed SAM with one cell negated and one account undeclared."""
    from rippleflow.workload.q_sam import FACTORS, SECTORS, _closed
    m = _closed(spark, d).withColumn("value", F.when(
        (F.col("row_acct") == "LARGE") & (F.col("col_acct") == "SMALL"), -F.col("value"))
        .otherwise(F.col("value")))
    acct = sam.account_totals(m).where("account <> 'GOV'").select("account")
    need = literal_table(spark, [(a,) for a in [*SECTORS, *FACTORS, "HOH", "ROW"]], "account string")
    return checks.sam_rules(m, acct, need)


def violations_topology(spark, d):
    """Government receives from a sector and saves; savings no longer match investment."""
    from rippleflow.workload.q_sam import FACTORS, SECTORS, _closed
    m = _closed(spark, d)
    extra = m.where("row_acct = 'GOV' AND col_acct = 'HOH'").select(
        F.explode(F.array(F.struct(F.lit("GOV").alias("r"), F.lit("LARGE").alias("c")),
                          F.struct(F.lit("SAVINV").alias("r"), F.lit("GOV").alias("c")))).alias("k"),
        "value").select(F.col("k.r").alias("row_acct"), F.col("k.c").alias("col_acct"), "value")
    m = m.withColumn("value", F.when((F.col("row_acct") == "SAVINV") & (F.col("col_acct") == "HOH"),
                                     F.col("value") * 1.5).otherwise(F.col("value")))
    return checks.topology_rules(m.unionByName(extra), SECTORS, FACTORS, "HOH")


def benchmark_replication(spark, d):
    from rippleflow.workload.q_sam import _levels
    keys = ["region", "sector", "variable"]
    return rounded(checks.replication(_levels(spark, d, "F"), _levels(spark, d, "O"), keys), "error",
                   digits=5)


def violations_dust(spark, d):
    e = economy(spark, d)
    t = sam.trade_cube(e.flows, e.final_demand)
    cut = e.final_demand.agg((F.sum("value") * 0.0065).alias("t")).first()["t"]
    return checks.dust_rules(t, cut)


def carbon_share_table(spark, d):
    e = economy(spark, d)
    shares = e.satellite.where("stressor = 'CO2' AND sector <> 'PROMO'").select(
        "region", "sector", (F.col("intensity") * 1e-6).alias("share"))
    return rounded(checks.carbon_share(shares, e.output.select("region", "sector")), "share", digits=10)


def fingerprint(spark, d):
    """Order-free fingerprint of the coefficient table by buying region, six decimals."""
    e = economy(spark, d)
    cells = e.coeff.select("j_region", label("i_region", "i_sector").alias("row"),
                           label("j_region", "j_sector").alias("col"), "a")
    return table_fingerprint(cells, ["row", "col"], ["a"], 6, ["j_region"])


def trade_elasticity_check(spark, d):
    e = economy(spark, d)
    parts = calibrate.supply_parts(sam.trade_cube(e.flows, e.final_demand), 2.0).withColumn(
        "sigma", F.when(F.col("sector") == "LARGE", 1.0).otherwise(F.col("sigma")))
    return calibrate.trade_elasticity_rules(parts).groupBy("rule", "item").agg(
        F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    quality_report, quality_nation, drift, report_roll_up, negative_value_added, violations_labels,
    violations_alignment, violations_axes, violations_demand_shape, violations_institutions,
    violations_elasticities, violations_concordance, violations_results, violations_shocks,
    violations_units, violations_admissible, violations_exposure, violations_pins,
    violations_ratings, violations_stresses, violations_supply_shares, label_classification,
    double_counting, violations_sam, violations_topology, benchmark_replication, violations_dust,
    carbon_share_table, fingerprint, trade_elasticity_check)}

_E = with_sql(economy_sql())
_N = with_sql(economy_sql("nation"))
_CS = "cs AS MATERIALIZED (SELECT j_region AS region, j_sector AS sector, sum(a) AS s FROM coeff GROUP BY 1, 2)"


def _report(pre):
    """name, value rows of the small report, from CTEs coeff, x, fd, sat."""
    return f"""SELECT 'column_sums_lt_one' AS name, max(s) AS value, max(s) < 1 AS ok, 'warn' AS bad, 1.0 AS tol FROM
 (SELECT sum(a) AS s FROM coeff GROUP BY j_region, j_sector) UNION ALL
 SELECT 'satellite_coverage_GHG', 1.0, true, 'warn', 0.5 UNION ALL SELECT 'satellite_nonneg_GHG', 0.0, true, 'warn', 0.01{pre}"""


def _drift_sql():
    def block(n, ls):
        return f"""
b{n} AS MATERIALIZED (WITH RECURSIVE {economy_sql('region', f"WHERE l.l_linestatus = '{ls}'")} {_report(
 " UNION ALL SELECT 'gross_output_positive', 0.0, true, 'warn', NULL UNION ALL SELECT 'final_demand_present', (SELECT sum(value) FROM fd), true, 'fail', NULL")})"""
    return ("WITH " + block(1, "F") + "," + block(0, "O") + f"""
SELECT 'drift_' || name AS name, CASE WHEN abs(b1.value - b0.value) / abs(b0.value) > 0.1 THEN 'warn' ELSE 'pass' END AS severity,
 {r6('abs(b1.value - b0.value) / abs(b0.value)', 7)} AS value, CAST(0.1 AS DOUBLE) AS tolerance FROM b1 JOIN b0 USING (name) WHERE b0.value <> 0""")


ORACLES = {
    "quality_report": _E + f""",
pv AS (SELECT 0 AS step, region, sector, CAST(1.0 AS DOUBLE) AS v FROM x UNION ALL SELECT p.step + 1, c.i_region, c.i_sector, sum(c.a * p.v) * 3
 FROM pv p JOIN coeff c ON c.j_region = p.region AND c.j_sector = p.sector WHERE p.step < 40 GROUP BY 1, 2, 3),
rho AS (SELECT sum(CASE WHEN step = 40 THEN v END) / sum(CASE WHEN step = 39 THEN v END) / 3 AS r FROM pv)
SELECT name, CASE WHEN ok THEN 'pass' ELSE bad END AS severity, {r6('CAST(value AS DOUBLE)', 7)} AS value, CAST(tol AS DOUBLE) AS tolerance FROM (
 SELECT 'spectral_radius' AS name, r AS value, r < 1 AS ok, 'fail' AS bad, 1.0 AS tol FROM rho UNION ALL {_report('')}
 UNION ALL SELECT 'negative_coefficient_share', 0.0, true, 'warn', 0.02
 UNION ALL SELECT 'gross_output_positive', 0.0, true, 'warn', NULL UNION ALL SELECT 'final_demand_present', sum(value), true, 'fail', NULL FROM fd)""",
    "quality_nation": _N + f"""
SELECT name, CASE WHEN ok THEN 'pass' ELSE bad END AS severity, {r6('CAST(value AS DOUBLE)', 7)} AS value, CAST(tol AS DOUBLE) AS tolerance
FROM ({_report('')} UNION ALL SELECT 'negative_coefficient_share', 0.0, true, 'warn', 0.02)""",
    "drift": _drift_sql(),
    "report_roll_up": _N + """,
w AS (SELECT CASE WHEN max(s) < 1 THEN 0 ELSE 1 END AS w FROM (SELECT sum(a) AS s FROM coeff GROUP BY j_region, j_sector))
SELECT 5 - w AS pass, CAST(w AS BIGINT) AS warn, CAST(0 AS BIGINT) AS fail, CASE WHEN w > 0 THEN 'warn' ELSE 'pass' END AS worst, true AS passed FROM
 (SELECT CAST(w AS BIGINT) AS w FROM w)""",
    "negative_value_added": _N + "," + _CS + f""",
v AS (SELECT region, sector, x, s AS share, x * (1 - s) AS va FROM x JOIN cs USING (region, sector))
SELECT region, sector, {r6('x')} AS x, {r6('share')} AS share, {r6('va')} AS va FROM v
WHERE va < -1e-9 * greatest((SELECT sum(abs(va)) FROM v), 1.0)""",
    "violations_labels": "SELECT 'duplicate_label' AS rule, 'parts:' || p_name AS item FROM part GROUP BY p_name HAVING count(*) > 1",
    "violations_alignment": _E + """
SELECT DISTINCT 'row_label' AS rule, 'ATLANTIS:' || i_sector AS item FROM coeff WHERE i_region = 'ASIA' AND j_sector = 'LARGE'
UNION ALL SELECT 'duplicate_demand', region || ':' || sector || ':' || d_region FROM fd WHERE region = 'EUROPE' AND sector = 'PROMO'""",
    "violations_axes": _E + """
SELECT 'missing_label' AS rule, region || ':' || sector AS item FROM x WHERE region = 'ASIA' AND sector = 'LARGE'
UNION ALL SELECT 'unexpected_label', region || ':' || sector FROM x WHERE region = 'EUROPE'""",
    "violations_demand_shape": _E + """
SELECT DISTINCT 'consumer_missing' AS rule, region AS item FROM x WHERE region = 'ASIA' UNION ALL
SELECT DISTINCT 'consumer_unknown', d_region FROM fd WHERE d_region = 'EUROPE'""",
    "violations_institutions": _E + """,
t AS (SELECT region, sector, d_region, sum(CASE WHEN category ILIKE '%household%' OR category ILIKE '%npish%' THEN value ELSE 0 END) AS h,
 sum(CASE WHEN category ILIKE '%government%' THEN value ELSE 0 END) AS g,
 sum(CASE WHEN category ILIKE '%formation%' OR category ILIKE '%inventor%' THEN value ELSE 0 END) AS i, sum(value) AS f FROM cat GROUP BY 1, 2, 3),
n AS (SELECT d_region, abs(sum(value) / (SELECT count(*) FROM x)) AS m FROM fd GROUP BY 1),
s AS (SELECT t.*, region || ':' || sector || ':' || t.d_region AS item, greatest(abs(f), m, 1.0) AS sc,
 CASE WHEN t.d_region = 'ASIA' THEN -h ELSE h END AS h2, CASE WHEN t.d_region = 'EUROPE' THEN 2 * i ELSE i END AS i2 FROM t JOIN n USING (d_region))
SELECT 'negative_household' AS rule, item FROM s WHERE h2 < -1e-9 * sc UNION ALL
SELECT 'negative_total', item FROM s WHERE h2 + g + i2 < -1e-9 * sc UNION ALL
SELECT 'exceeds_final_demand', item FROM s WHERE h2 + g + i2 > f + 1e-6 * sc""",
    "violations_elasticities": """
WITH t AS (SELECT p_brand AS key, avg(p_size) - 25.5 AS m, count(*) AS n FROM part GROUP BY 1)
SELECT 'elasticity_order' AS rule, key AS item FROM t WHERE n % 3 = 0 UNION ALL
SELECT 'elasticity_metadata', key FROM t WHERE n % 2 = 1 UNION ALL
SELECT 'elasticity_sign', key FROM t WHERE m + CASE WHEN n % 3 = 0 THEN -2 ELSE 1 END > 0""",
    "violations_concordance": """
SELECT 'weight_sum' AS rule, p_type AS item FROM part WHERE p_type IN ('LARGE', 'SMALL') GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'weight_negative', 'SMALL' FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#3'""",
    "violations_results": _E + """,
k AS (SELECT region, sector, 'flat:price_change:' || sector || ':' || region || ':' AS p FROM x)
SELECT 'result_duplicate' AS rule, p || '2020:central' AS item FROM k WHERE sector = 'LARGE' UNION ALL
SELECT 'result_band', p || '2020:median' FROM k WHERE sector = 'SMALL' UNION ALL
SELECT 'result_not_finite', p || '1999:central' FROM k WHERE sector = 'PROMO'""",
    "violations_shocks": """
SELECT rule, item FROM (VALUES ('price_negative', 'b:0'), ('gases_empty', 'b:1'), ('gases_duplicate', 'b:2'), ('price_negative', 'b:3'),
 ('gases_mixed', 'b:3'), ('carrier_blank', 'b:4'), ('change_below_minus_one', 'b:4'), ('delta_below_minus_one', 'b:5'),
 ('service_blank', 'b:6'), ('severity_range', 'b:6'), ('unknown_type', 'b:7'), ('unknown_sector', 'b:NOWHERE'),
 ('unknown_region', 'b:MARS'), ('unknown_carrier', 'b: '), ('unknown_carrier', 'b:COAL'), ('gas_missing', 'b:SF6'),
 ('gas_without_factor', 'b:SF6'), ('gas_negative', 'path:CH4'), ('unsupported_shock', 'b:productivity'), ('unsupported_shock', 'b:nature_stress'),
 ('unsupported_shock', 'b:magic'), ('unsupported_shock', 'supply:productivity')) t(rule, item) WHERE (SELECT count(*) FROM lineitem) > 0""",
    "violations_units": """
SELECT rule, item FROM (VALUES ('satellite_unit', 'N2O=kg/MEUR'), ('monetary_unit', 'USD/MUSD')) t(rule, item)
WHERE (SELECT count(*) FROM lineitem) > 0""",
    "violations_admissible": _E + """
SELECT 'negative_coefficient' AS rule, concat_ws(':', i_region, i_sector, j_region, j_sector) AS item FROM coeff WHERE a > 0.025""",
    "violations_exposure": _N + "," + _CS + """
SELECT 'input_share' AS rule, region || ':' || sector AS item FROM cs WHERE s >= 1 UNION ALL
SELECT 'score', region || ':' || sector FROM x WHERE x / 10 > 1 + 1e-9""",
    "violations_pins": _E + """
SELECT 'pin_conflict' AS rule, 'p:2020:' || region || ':LARGE' AS item FROM x WHERE sector = 'LARGE' AND region IN ('ASIA', 'AFRICA')""",
    "violations_ratings": "WITH " + inputs.RATINGS_SQL + """,
rr AS (SELECT * FROM raw_rt UNION ALL SELECT * FROM raw_rt WHERE service = 'view' AND process = 'Brand#7')
SELECT 'rating_class' AS rule, concat_ws(':', process, service, materiality) AS item FROM rr WHERE materiality = 'N/A' UNION ALL
SELECT 'rating_duplicate', process || ':' || service FROM rr GROUP BY process, service HAVING count(*) > 1""",
    "violations_stresses": """
SELECT rule, item FROM (VALUES ('service_unknown', 'drought:x'), ('stress_reaches_nothing', 'drought:y'), ('stress_twice', 'drought:click'),
 ('region_scoped', 'drought:q'), ('region_scoped', 'slow:p')) t(rule, item) WHERE (SELECT count(*) FROM lineitem) > 0""",
    "violations_supply_shares": "WITH " + inputs.SUPPLY_SQL + """
SELECT 'product_twice' AS rule, 'Brand#3' AS item FROM shr GROUP BY 1, 2 UNION ALL
SELECT DISTINCT 'product_unknown', product FROM shr WHERE product = 'Brand#1' UNION ALL
SELECT 'product_missing', 'Brand#99' FROM shr GROUP BY 1, 2 UNION ALL
SELECT DISTINCT 'industry_unknown', industry FROM shr WHERE industry = 'PROMO' UNION ALL
SELECT DISTINCT 'share_sum', product FROM shr WHERE product = 'Brand#5'""",
    "label_classification": """
WITH l AS (SELECT DISTINCT p_brand AS build, p_type AS sector FROM part WHERE NOT (p_brand LIKE 'Brand#1%' AND p_type IN ('SMALL', 'PROMO'))
 AND NOT (p_brand LIKE 'Brand#2%' AND p_type <> 'LARGE')),
f AS (SELECT build, count(*) AS n, count(*) FILTER (sector IN ('LARGE', 'MEDIUM', 'STANDARD', 'ECONOMY')) AS n_a,
 count(*) FILTER (sector IN ('LARGE', 'SMALL', 'PROMO')) AS n_b, CAST(0 AS BIGINT) AS n_unknown FROM l GROUP BY 1)
SELECT *, CASE WHEN n_a = n AND n_b = n THEN 'ambiguous' WHEN n_a = n THEN 'a' WHEN n_b = n THEN 'b' ELSE 'mixed' END AS status FROM f""",
    "double_counting": "SELECT DISTINCT 'mechanism_twice' AS rule, event_type AS item FROM events WHERE event_type IN ('view', 'click')",
    "violations_sam": _E + """
SELECT rule, item FROM (VALUES ('account_missing', 'ROW'), ('account_undeclared', 'GOV'), ('cell_negative', 'LARGE<-SMALL'),
 ('account_unbalanced', 'LARGE'), ('account_unbalanced', 'SMALL')) t(rule, item) WHERE (SELECT count(*) FROM x) > 0""",
    "violations_topology": _E + """
SELECT rule, item FROM (VALUES ('government_receipt', 'GOV<-LARGE'), ('government_outlay', 'SAVINV<-GOV'),
 ('savings_unbalanced', 'SAVINV')) t(rule, item) WHERE (SELECT count(*) FROM x) > 0""",
    "violations_dust": _E + """,
c AS (SELECT origin, dest, sector, sum(v) AS v FROM (SELECT i_region AS origin, j_region AS dest, i_sector AS sector, z AS v FROM z
 UNION ALL SELECT region, d_region, sector, value FROM fd) GROUP BY 1, 2, 3)
SELECT 'dust_route' AS rule, concat_ws(':', origin, dest, sector) AS item FROM c WHERE origin <> dest AND v > 0 AND v < 0.0065 * (SELECT sum(value) FROM fd)""",
    "carbon_share_table": _E + f"""
SELECT region, sector, {r6("CASE WHEN sector = 'PROMO' THEN 0.0 ELSE intensity * 1e-6 END", 10)} AS share FROM sat WHERE stressor = 'CO2'""",
    "fingerprint": _E + f"""
, t AS (SELECT j_region, {parts_sql("i_region || ':' || i_sector", "j_region || ':' || j_sector", "printf('%.6f', round(a, 6))")} AS t FROM coeff)
SELECT j_region, count(*) AS n_rows, {multiset_sql('t')} AS fingerprint FROM t GROUP BY 1""",
    "trade_elasticity_check": _E + """
SELECT 'trade_elasticity' AS rule, CASE WHEN origin = dest THEN 'domestic' ELSE origin END AS item, count(*) AS n FROM
 (SELECT i_region AS origin, j_region AS dest, i_sector AS sector FROM z UNION SELECT region, d_region, sector FROM fd)
 WHERE sector = 'LARGE' GROUP BY 1, 2""",
}
from rippleflow.workload.q_sam import _LV  # noqa: E402

ORACLES["benchmark_replication"] = _E + "," + _LV + f"""
SELECT t.variable, {r6('max(abs(t.a - t.b))', 5)} AS error FROM bb, LATERAL (VALUES ('price', p0, p1), ('demand', d0, d1),
 ('household', h0, h1), ('output', o0, o1), ('export', e0, e1)) t(variable, a, b) GROUP BY 1"""
