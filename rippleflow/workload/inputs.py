"""Side inputs derived from the driver tables, on the DataFrame and on the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rippleflow.workload.economy import nation_regions, read

CLASSES = ["VH", "H", "M", "L", "VL", "ND", "N/A"]


def raw_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Process = brand, service = event type; the class follows from the brand's part keys."""
    service = read(spark, d, "events").select(F.col("event_type").alias("service")).distinct()
    service = service.withColumn("n", F.row_number().over(Window.orderBy("service")) - 1)
    brand = read(spark, d, "part").groupBy(F.col("p_brand").alias("process")).agg(
        F.sum("p_partkey").alias("k"))
    idx = F.pmod(F.col("k") + 3 * F.col("n"), F.lit(7)).cast("int")
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return brand.join(service).select(
        "process", "service", F.element_at(classes, idx + 1).alias("materiality"))


def type_brand(spark: SparkSession, d: str) -> DataFrame:
    """Concordance from part type to brand, weighted by retail price."""
    t = read(spark, d, "part").groupBy(
        F.col("p_type").alias("source"), F.col("p_brand").alias("target")
    ).agg(F.sum("p_retailprice").alias("weight"))
    from rippleflow.operators.concord import normalise
    return normalise(t, "source")


def supply_table(spark: SparkSession, d: str) -> DataFrame:
    """(product, industry, v): sales of every brand by part type."""
    line = read(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    packed = line.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return packed.join(part, packed.l_partkey == part.p_partkey).groupBy(
        F.col("p_brand").alias("product"), F.col("p_type").alias("industry")
    ).agg((F.sum("v") / 1e6).alias("v"))


def product_codes(spark: SparkSession, d: str) -> DataFrame:
    """(name, code): brands with codes such as p2.30.a."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return read(spark, d, "part").select("p_brand").distinct().select(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("p"), (n % 3 + 1).cast("string"), F.lit("."),
                 ((n % 7 + 1) * 10).cast("string"), F.lit(".a")).alias("code"))


def industry_codes(spark: SparkSession, d: str) -> DataFrame:
    """(name, code): part types with codes such as i2, i3.20.a and i1.a."""
    t = F.row_number().over(Window.orderBy("p_type"))
    return read(spark, d, "part").select("p_type").distinct().withColumn("t", t).select(
        F.col("p_type").alias("name"),
        F.concat(F.lit("i"), (F.col("t") % 3 + 1).cast("string"),
                 F.when(F.col("t") % 6 == 0, ".a")
                 .when(F.col("t") % 2 == 0,
                       F.concat(F.lit("."), (F.col("t") * 10).cast("string"), F.lit(".a")))
                 .otherwise("")).alias("code"))


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """(sector, code, class_name): brands with a size-based code path and the part name."""
    s = F.col("p_size")
    return read(spark, d, "part").select(
        F.col("p_brand").alias("sector"),
        F.concat_ws("_", F.lit("A"), (s % 4).cast("string"), (s % 12).cast("string"),
                    s.cast("string")).alias("code"),
        F.col("p_name").alias("class_name"))


def rated_processes(spark: SparkSession, d: str) -> DataFrame:
    """Rated codes of three depths, and named splits for some part names."""
    s = F.col("p_size")
    part = read(spark, d, "part")
    coded = part.select(F.explode(F.array(
        F.when(s % 4 < 3, F.concat_ws("_", F.lit("A"), (s % 4).cast("string"))),
        F.when(s % 12 > 6, F.concat_ws("_", F.lit("A"), (s % 4).cast("string"),
                                       (s % 12).cast("string"))),
        F.when(s == 20, F.concat_ws("_", F.lit("A"), (s % 4).cast("string"),
                                    (s % 12).cast("string"), s.cast("string"))),
        F.when(F.col("p_name").startswith("red"),
               F.concat_ws(" — ", F.lit("A_9"), F.col("p_name"))),
    )).alias("process"))
    return coded.where("process IS NOT NULL").distinct()


def nation_map(spark: SparkSession, d: str) -> DataFrame:
    return nation_regions(spark, d).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target"),
        F.lit(1.0).alias("weight"))


def sector_groups(spark: SparkSession, d: str) -> DataFrame:
    """Types split over two coarse groups: SMALL is shared, the rest goes to one side."""
    return read(spark, d, "part").select(F.col("p_type").alias("source")).distinct().select(
        "source", F.explode(F.when(F.col("source") == "SMALL", F.array(
            F.struct(F.lit("goods").alias("target"), F.lit(0.25).alias("weight")),
            F.struct(F.lit("other").alias("target"), F.lit(0.75).alias("weight"))))
            .when(F.col("source").isin("LARGE", "MEDIUM", "STANDARD"), F.array(
                F.struct(F.lit("goods").alias("target"), F.lit(1.0).alias("weight"))))
            .otherwise(F.array(F.struct(F.lit("other").alias("target"),
                                        F.lit(1.0).alias("weight"))))).alias("m")
    ).select("source", "m.target", "m.weight")


# -- SQL side ------------------------------------------------------------------------------------

RATINGS_SQL = """
svc AS (SELECT event_type AS service, row_number() OVER (ORDER BY event_type) - 1 AS n
  FROM (SELECT DISTINCT event_type FROM events)),
raw_rt AS MATERIALIZED (SELECT b.process, svc.service, ['VH','H','M','L','VL','ND','N/A'][1 + (b.k + 3 * svc.n) % 7]
  AS materiality FROM (SELECT p_brand AS process, CAST(sum(p_partkey) AS BIGINT) AS k FROM part
  GROUP BY 1) b CROSS JOIN svc),
rt AS MATERIALIZED (SELECT process, service, materiality, CASE materiality WHEN 'VH' THEN 1.0 WHEN 'H' THEN 0.8
  WHEN 'M' THEN 0.6 WHEN 'L' THEN 0.4 WHEN 'VL' THEN 0.2 ELSE 0.0 END AS score,
  materiality = 'ND' AS nd FROM raw_rt WHERE materiality <> 'N/A')"""

CONC_SQL = """
conc AS MATERIALIZED (SELECT source, target, w / sum(w) OVER (PARTITION BY source) AS weight FROM
  (SELECT p_type AS source, p_brand AS target, sum(p_retailprice) AS w FROM part GROUP BY 1, 2))"""

SCORES_SQL = RATINGS_SQL + "," + CONC_SQL + """,
sc AS MATERIALIZED (SELECT c.source AS sector, r.service, sum(c.weight * r.score) AS score,
  sum(CASE WHEN r.nd THEN c.weight ELSE 0 END) / max(t.total) AS nd_share FROM conc c
  JOIN rt r ON r.process = c.target JOIN (SELECT source, sum(weight) AS total FROM conc GROUP BY 1) t
  ON t.source = c.source GROUP BY 1, 2)"""

SUPPLY_SQL = """
sup AS MATERIALIZED (SELECT p_brand AS product, p_type AS industry, sum(l_extendedprice) / 1e6 AS v FROM lineitem
  JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
shr AS MATERIALIZED (SELECT product, industry, s / sum(s) OVER (PARTITION BY product) AS weight FROM
  (SELECT product, industry, v / sum(v) OVER (PARTITION BY product) AS s FROM sup) WHERE s >= 1e-4)"""

CODES_SQL = """
pc AS (SELECT name, 'p' || CAST(n % 3 + 1 AS VARCHAR) || '.' || CAST((n % 7 + 1) * 10 AS VARCHAR) || '.a' AS code
  FROM (SELECT DISTINCT p_brand AS name, CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) AS n FROM part)),
ic AS (SELECT name, 'i' || CAST(t % 3 + 1 AS VARCHAR) || CASE WHEN t % 6 = 0 THEN '.a'
  WHEN t % 2 = 0 THEN '.' || CAST(t * 10 AS VARCHAR) || '.a' ELSE '' END AS code FROM
  (SELECT name, row_number() OVER (ORDER BY name) AS t FROM (SELECT DISTINCT p_type AS name FROM part)))"""


def numeric_sql(code: str) -> str:
    run = f"regexp_extract(substring({code}, 2), '^\\d+(\\.\\d+)*')"
    return (f"array_to_string(list_transform(string_split({run}, '.'), lambda s: CASE WHEN len(s) > 1 "
            "THEN rtrim(s, '0') ELSE s END), '.')")


CAND_SQL = CODES_SQL + f""",
pk AS (SELECT name, substring(code, 2) AS base, {numeric_sql('code')} AS num FROM pc),
ik AS (SELECT name, substring(code, 2) AS base, {numeric_sql('code')} AS num FROM ic),
exact AS (SELECT pk.name AS product, ik.name AS industry FROM pk JOIN ik USING (base)),
roll AS (SELECT pk.name AS product, ik.name AS industry, len(ik.num) AS depth FROM pk JOIN ik
  ON (pk.num = ik.num OR starts_with(pk.num, ik.num || '.'))
  WHERE pk.name NOT IN (SELECT product FROM exact)),
cand AS (SELECT * FROM exact UNION ALL SELECT product, industry FROM roll QUALIFY
  depth = max(depth) OVER (PARTITION BY product))"""

