"""Readers for ratings, crosswalks, supply tables, wide flow tables and scenario files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow import schema
from rippleflow.operators.checks import Violation, require_empty
from rippleflow.operators.nature import clean_ratings

# Identifier columns of a wide ratings file, and its note columns' prefix.
RATING_ID_COLUMNS = ["ISIC Unique code", "ISIC Section", "ISIC Division", "ISIC Group",
                     "ISIC Class"]
NOTE_PREFIX = "ISIC level"
CROSSWALK_COLUMNS = ["EXIOBASE", "ISIC Rev. 4 Unique Code", "ISIC Rev 4. Class"]


def _clean_headers(df: DataFrame) -> DataFrame:
    """Strip spaces and a byte-order mark from column names."""
    return df.toDF(*[c.strip().lstrip("﻿").strip() for c in df.columns])


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tidy ratings: process, service, materiality."""
    return spark.read.csv(path, header=True, schema=schema.RATINGS)


def process_ids(raw: DataFrame, code: str = "ISIC Unique code") -> DataFrame:
    """Adds ``process``: the code, with the finest populated name only where the code repeats."""
    names = [c for c in ("ISIC Class", "ISIC Group", "ISIC Division") if c in raw.columns]

    def filled(c):
        text = F.trim(F.col(f"`{c}`"))
        return F.when((text != "") & (F.lower(text) != "nan"), text)

    name = F.coalesce(*[filled(c) for c in names], F.lit("")) if names else F.lit("")
    key = F.trim(F.col(f"`{code}`"))
    repeated = raw.select(key.alias("__key")).groupBy("__key").count().select(
        "__key", (F.col("count") > 1).alias("__repeated"))
    return raw.withColumn("__key", key).join(repeated, "__key").withColumn(
        "process", F.when(F.col("__repeated") & (name != ""), F.concat_ws(" — ", "__key", name))
        .otherwise(F.col("__key"))).drop("__key", "__repeated")


def ambiguous_processes(with_ids: DataFrame) -> DataFrame:
    return with_ids.groupBy("process").count().where("count > 1").select(
        F.lit("process_twice").alias("rule"), F.col("process").alias("item"))


def read_ratings_wide(spark: SparkSession, path: str,
                      code: str = "ISIC Unique code") -> DataFrame:
    """Wide ratings (one column per service) to tidy rows; blanks and not-applicable drop out."""
    raw = _clean_headers(spark.read.option("multiLine", True).csv(path, header=True))
    return melt_ratings(raw, code)


def melt_ratings(raw: DataFrame, code: str = "ISIC Unique code", check: bool = True) -> DataFrame:
    if code not in raw.columns:
        raise Violation(f"no process column {code!r}; columns start {raw.columns[:6]}")
    services = [c for c in raw.columns
                if c not in RATING_ID_COLUMNS and c != code and not c.startswith(NOTE_PREFIX)]
    with_ids = process_ids(raw, code)
    if check:
        require_empty(ambiguous_processes(with_ids))
    long = with_ids.select("process", *[f"`{c}`" for c in services]).unpivot(
        ["process"], services, "service", "materiality")
    return clean_ratings(long)


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Crosswalk CSV (latin-1) as (sector, code, class_name)."""
    raw = _clean_headers(spark.read.option("encoding", "ISO-8859-1").option("multiLine", True)
                         .csv(path, header=True))
    missing = [c for c in CROSSWALK_COLUMNS if c not in raw.columns]
    if missing:
        raise Violation(f"crosswalk misses columns {missing}")
    return raw.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in zip(
        CROSSWALK_COLUMNS, ("sector", "code", "class_name"), strict=True)])


def _read_two_level(spark: SparkSession, path: str):
    """Body of a tab-separated table with two header rows and two index columns, and its headers.

    Only the two header lines come to the driver; the body keeps its file splits.
    """
    head = [line.value.split("\t") for line in spark.read.text(path).limit(2).collect()]
    if len(head) < 2 or len(head[0]) != len(head[1]):
        raise Violation(f"{path}: two header rows of equal width expected")
    width = len(head[0])
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"c{i} string" for i in range(width)))
    first, second = head[0], head[1]
    is_header = (
        F.coalesce(F.col("c0"), F.lit("")) == first[0]) & (
        F.coalesce(F.col(f"c{width - 1}"), F.lit("")) == first[-1])
    is_second = (
        F.coalesce(F.col("c0"), F.lit("")) == second[0]) & (
        F.coalesce(F.col(f"c{width - 1}"), F.lit("")) == second[-1])
    return raw.where(~is_header & ~is_second), first, second, width


def _melt_two_level(raw: DataFrame, first, second, width: int) -> DataFrame:
    cells = F.array(*[F.struct(
        F.lit(first[i]).alias("col_1"), F.lit(second[i]).alias("col_2"),
        F.col(f"c{i}").cast("double").alias("v")) for i in range(2, width)])
    return raw.select(F.col("c0").alias("row_1"), F.col("c1").alias("row_2"),
                      F.explode(cells).alias("e")).select("row_1", "row_2", "e.*").where(
        "v IS NOT NULL")


def read_supply_table(spark: SparkSession, path: str) -> DataFrame:
    """(p_region, product, i_region, industry, v) from a two-level supply table."""
    return _melt_two_level(*_read_two_level(spark, path)).select(
        F.col("row_1").alias("p_region"), F.col("row_2").alias("product"),
        F.col("col_1").alias("i_region"), F.col("col_2").alias("industry"), "v")


def read_square_table(spark: SparkSession, path: str) -> DataFrame:
    """(i_region, i_sector, j_region, j_sector, value) from a two-level square table."""
    return _melt_two_level(*_read_two_level(spark, path)).select(
        F.col("row_1").alias("i_region"), F.col("row_2").alias("i_sector"),
        F.col("col_1").alias("j_region"), F.col("col_2").alias("j_sector"),
        F.col("v").alias("value"))


def read_demand_table(spark: SparkSession, path: str) -> DataFrame:
    """(region, sector, d_region, category, value) from a two-level final-demand table."""
    return _melt_two_level(*_read_two_level(spark, path)).select(
        F.col("row_1").alias("region"), F.col("row_2").alias("sector"),
        F.col("col_1").alias("d_region"), F.col("col_2").alias("category"),
        F.col("v").alias("value"))


def axis_mismatch(coeff: DataFrame) -> DataFrame:
    """Labels that occur on one axis of a square table only."""
    rows = coeff.select(F.col("i_region").alias("region"), F.col("i_sector").alias("sector")).distinct()
    cols = coeff.select(F.col("j_region").alias("region"), F.col("j_sector").alias("sector")).distinct()
    keys = ["region", "sector"]
    item = F.concat_ws(":", *keys).alias("item")
    return rows.join(cols, keys, "left_anti").select(F.lit("row_only").alias("rule"), item).unionByName(
        cols.join(rows, keys, "left_anti").select(F.lit("column_only").alias("rule"), item))


def scenario_shocks(raw: DataFrame) -> DataFrame:
    """Shock rows from scenario documents (name, years, shocks[...]), many scenarios at once."""
    s = F.col("s")
    fields = set(raw.schema["shocks"].dataType.elementType.names)

    def get(name, cast):
        return s[name].cast(cast) if name in fields else F.lit(None).cast(cast)

    level = F.coalesce(*[get(n, "double") for n in ("price", "change", "delta", "severity")])
    none = F.array().cast("array<string>")
    gases = F.coalesce(get("gases", "array<string>"),
                       F.when(s["type"] == "carbon_price", F.array(F.lit("CO2"))), none)
    path_type = dict(raw.select(F.explode("shocks").alias("s")).select("s.*").dtypes).get("path")
    if path_type is None:
        path = F.lit(None).cast("map<int,double>")
    elif path_type.startswith("map"):
        path = s["path"].cast("map<int,double>")
    else:
        # Inferred as a struct with one field per year: read it back as a map.
        path = F.from_json(F.to_json(s["path"]), "map<string,double>").cast("map<int,double>")
    return raw.select(F.col("name").alias("scenario_id"),
                      F.posexplode("shocks").alias("n", "s")).select(
        "scenario_id", F.concat(F.lit("s"), F.col("n").cast("string")).alias("shock_id"),
        s["type"].alias("type"), level.alias("level"), gases.alias("gases"),
        get("carrier", "string").alias("carrier"), get("service", "string").alias("service"),
        F.coalesce(get("coverage_sectors", "array<string>"), none).alias("sectors"),
        F.coalesce(get("coverage_regions", "array<string>"), none).alias("regions"),
        path.alias("path"))


def scenario_years(raw: DataFrame) -> DataFrame:
    """(scenario_id, year), sorted and distinct years per scenario."""
    return raw.select(F.col("name").alias("scenario_id"),
                      F.explode(F.array_sort(F.col("years").cast("array<int>"))).alias("year"))


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Shocks and years of every JSON scenario document under ``path``."""
    raw = spark.read.option("multiLine", True).json(path)
    return scenario_shocks(raw), scenario_years(raw)


def read_shares_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Supply-share documents: (year, product, industry, weight) and (year, product) without supply."""
    raw = spark.read.option("multiLine", True).schema(
        "provenance struct<sut_year:int,sut_version:string,source_version:string,"
        "zero_supply_products:array<string>>, shares map<string,map<string,double>>").json(path)
    year = F.col("provenance.sut_year").alias("year")
    shares = raw.select(year, F.explode("shares").alias("product", "w")).select(
        "year", "product", F.explode("w").alias("industry", "weight"))
    zero = raw.select(year, F.explode("provenance.zero_supply_products").alias("product"))
    return shares, zero


def shares_for_year(shares: DataFrame, wanted: int, default: int) -> DataFrame:
    """Shares of the wanted year, or of the default year with ``fallback`` set."""
    has = shares.where(F.col("year") == wanted).select(
        F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("n"))
    chosen = F.when(F.col("n") > 0, F.lit(wanted)).otherwise(F.lit(default))
    return shares.where(F.col("year").isin(wanted, default)).join(has).where(
        F.col("year") == chosen).select(
        "year", "product", "industry", "weight", (F.col("n") == 0).alias("fallback"))
