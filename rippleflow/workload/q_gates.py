"""Queries on damped solves, reach, and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleflow.functions.labels import label
from rippleflow.operators import sam
from rippleflow.plans.fixpoint import iterate
from rippleflow.plans.graphs import spread
from rippleflow.workload.common import economy_sql, r6, rounded, with_sql
from rippleflow.workload.economy import economy
from rippleflow.workload.q_sam import _CUBE, _uneven

STEEP = 1.2
PIN_AT, PIN = 40, 7.0


def _numbered(goods: DataFrame, *parts: str) -> DataFrame:
    """Labels with their place in the order of names, from 1, within ``parts``."""
    order = Window.partitionBy(*parts).orderBy("region", "sector")
    return goods.withColumn("label", label()).withColumn("n", F.row_number().over(order))


def _next_links(numbered: DataFrame, *parts: str) -> DataFrame:
    """Links from each label to the next one, and from the last to none."""
    after = numbered.select(*parts, F.col("label").alias("dst"), (F.col("n") - 1).alias("n"))
    return numbered.withColumnRenamed("label", "src").join(after, [*parts, "n"])


def pinned_chain(spark, d):
    """A cost of 1 on every good of a steep chain, one of them pinned: logarithms of the prices."""
    goods = _numbered(economy(spark, d, "nation").output.select("region", "sector").distinct())
    links = _next_links(goods).select("src", "dst", F.lit(STEEP).alias("w"))
    here = F.col("n") == PIN_AT
    seed = goods.select("label", F.when(here, PIN).otherwise(1.0).alias("value"),
                        F.when(here, 0.0).otherwise(1.0).alias("open"))
    solved = iterate(links, seed, damp="open")
    return rounded(solved.select("label", F.ln("value").alias("log_price")), "log_price", digits=8)


def upstream_peak(spark, d):
    """Largest output among the goods before each one on a chain of all goods."""
    goods = _numbered(economy(spark, d, "nation").output.select("region", "sector", "x"))
    links = _next_links(goods).select("src", "dst")
    return rounded(spread(links, goods.select("label", F.col("x").alias("value"))), "value", digits=7)


def support_conflicts(spark, d):
    """Why sales between chosen pairs of regions can't be scaled to all regions' totals."""
    e = economy(spark, d)
    t = sam.trade_cube(e.flows, e.final_demand).groupBy("origin", "dest").agg(F.sum("value").alias("value"))
    totals = t.groupBy(F.col("origin").alias("account")).agg(F.sum("value").alias("target"))
    pairs = (F.col("origin") == "AFRICA") & (F.col("dest") == "AMERICA") | (
        F.col("origin") == "ASIA") & F.col("dest").isin("ASIA", "EUROPE") | (
        F.col("origin") == "EUROPE") & (F.col("dest") == "EUROPE")
    cells = t.where(pairs).select(
        F.col("origin").alias("row_acct"), F.col("dest").alias("col_acct"), "value")
    return sam.support_conflicts(cells, totals)


def balanced_report(spark, d):
    """A matrix that needs balancing: what its report says about the adjustment."""
    e = economy(spark, d)
    balanced, moved = sam.balance(_uneven(spark, d))
    source = sam.closed_source(sam.sector_accounts(e.flows, e.final_demand))
    rows = sam.sam_quality(balanced, sam.SamLayout.open(), source, moved, attribution="imputed")
    return rounded(rows.where("name IN ('sam_balanced', 'balancing_adjustment', 'open_fd_attribution')"),
                   "value", digits=6)


QUERIES = {f.__name__: f for f in (
    pinned_chain, upstream_peak, support_conflicts, balanced_report)}

_NATION_LABELS = """
labels AS (SELECT region || ':' || sector AS label, x, row_number() OVER (ORDER BY region, sector) AS n FROM x)"""


def _balanced_sql(steps: int = 12) -> str:
    ctes = [economy_sql(), _CUBE, """
s0 AS MATERIALIZED (SELECT origin AS r, dest AS c, sum(v) * CASE WHEN origin = 'ASIA' THEN 1.5 ELSE 1 END AS v FROM cube GROUP BY 1, 2),
tg AS MATERIALIZED (SELECT a, sum(v) / 2 AS t FROM (SELECT r AS a, v FROM s0 UNION ALL SELECT c, v FROM s0) GROUP BY 1)"""]
    for i in range(steps):
        ctes.append(f"""
h{i} AS (SELECT r, c, v * t / sum(v) OVER (PARTITION BY r) AS v FROM s{i} JOIN tg ON a = r),
s{i + 1} AS MATERIALIZED (SELECT r, c, v * t / sum(v) OVER (PARTITION BY c) AS v FROM h{i} JOIN tg ON a = c)""")
    return with_sql(*ctes) + f""",
moved AS (SELECT r, sum(abs(b.v - a.v)) / sum(b.v) AS m FROM s0 a JOIN s{steps} b USING (r, c) GROUP BY 1)
SELECT 'sam_balanced' AS name, 'pass' AS severity, (SELECT 0.0 * max(m) FROM moved) AS value, CAST(1e-6 AS DOUBLE) AS tolerance
UNION ALL SELECT 'balancing_adjustment', CASE WHEN max(m) <= {sam.ADJUSTMENT_LIMIT} THEN 'pass' ELSE 'warn' END,
 {r6('max(m)', 6)}, CAST({sam.ADJUSTMENT_LIMIT} AS DOUBLE) FROM moved
UNION ALL SELECT 'open_fd_attribution', 'warn', NULL, NULL"""


ORACLES = {
    "pinned_chain": with_sql(economy_sql("nation")) + "," + _NATION_LABELS + f"""
SELECT label, {r6(f"ln(CASE WHEN n < {PIN_AT} THEN (pow({STEEP}, n) - 1) / ({STEEP} - 1) ELSE {PIN} * pow({STEEP}, n - {PIN_AT}) + (pow({STEEP}, n - {PIN_AT}) - 1) / ({STEEP} - 1) END)")} AS log_price
FROM labels""",
    "upstream_peak": with_sql(economy_sql("nation")) + "," + _NATION_LABELS + f"""
SELECT label, {r6('max(x) OVER (ORDER BY n)', 7)} AS value FROM labels""",
    "support_conflicts": with_sql(economy_sql()) + "," + _CUBE + """,
t AS (SELECT origin AS account, sum(v) AS target FROM cube GROUP BY 1),
p(r, c, part) AS (VALUES ('AFRICA', 'AMERICA', 1), ('ASIA', 'ASIA', 2), ('ASIA', 'EUROPE', 2), ('EUROPE', 'EUROPE', 2)),
live AS (SELECT p.* FROM p JOIN (SELECT origin, dest, sum(v) AS v FROM cube GROUP BY 1, 2) s ON s.origin = p.r AND s.dest = p.c WHERE v > 0),
sums AS (SELECT part, (SELECT sum(target) FROM t WHERE account IN (SELECT r FROM live l WHERE l.part = q.part)) AS rows,
 (SELECT sum(target) FROM t WHERE account IN (SELECT c FROM live l WHERE l.part = q.part)) AS columns,
 (SELECT min(c) FROM live l WHERE l.part = q.part) AS item FROM (SELECT DISTINCT part FROM live) q)
SELECT 'row_without_cells' AS rule, account AS item FROM t WHERE target > 0 AND account NOT IN (SELECT r FROM live)
UNION ALL SELECT 'column_without_cells', account FROM t WHERE target > 0 AND account NOT IN (SELECT c FROM live)
UNION ALL SELECT 'targets_disagree', item FROM sums WHERE abs(rows - columns) > 1e-9 * greatest(rows, columns)""",
    "balanced_report": _balanced_sql(),
}
