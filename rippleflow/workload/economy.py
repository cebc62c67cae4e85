"""The economy every registered query runs on, derived from the driver's order tables.

Producer label = (supplier place, part type); consumer label = (customer place, part type of the
order's first line). Returned lines are intermediate flows, all other lines are final demand, so
gross output equals intermediate plus final sales exactly. Money is in millions (MEUR).

The line table is scanned once and shuffled once by order: a window finds the first line of each
order where the lines already lie, and the join with the orders uses the same partitioning and
order of rows. Lines take their part's type with them to that window, so the type of the first line
needs no lookup of its own; parts that are too many to broadcast cost one more shuffle of the lines. ``cells`` aggregates the lines to the label cube, whose size is bounded by the number
of places, types and segments whatever the number of lines. Everything else derives from that cube.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rippleflow.plans.fixpoint import Propagator
from rippleflow.plans.joins import BROADCAST_BYTES, lookup_join
from rippleflow.session import cut_lineage

MILLION = 1e6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines summed to (producer nation, type) x (consumer nation, type) x segment x flags."""
    line = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = (
        read(spark, sf_dir, "supplier")
        .select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
        .join(nation, "n_nationkey")
        .select("s_suppkey", F.col("n_name").alias("o_nation"))
    )
    buyer = (
        read(spark, sf_dir, "customer")
        .select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
        .join(nation, "n_nationkey")
        .select("c_custkey", F.col("c_mktsegment").alias("segment"),
                F.col("n_name").alias("d_nation"))
    )
    order = lookup_join(
        read(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")),
        buyer, "c_custkey").select("l_orderkey", "segment", "d_nation")
    # A line of an unknown part may still be the first of its order, so it goes after the window.
    kinds = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("o_sector"),
                        F.lit(True).alias("known"))
    wide = lookup_join(line, kinds, "l_partkey", how="left")
    # The first line of an order is its smallest (line number, part).
    first_line = F.min(F.struct("l_linenumber", "l_partkey", "o_sector", "known")).over(
        Window.partitionBy("l_orderkey"))
    wide = wide.withColumn("first", first_line).where("known AND first.known").withColumn(
        "d_sector", F.col("first.o_sector")).drop("first", "known", "l_partkey", "l_linenumber").join(
        order, "l_orderkey")
    # Two short columns: as many suppliers are broadcast as the bytes of a broadcast allow.
    wide = lookup_join(wide.withColumnRenamed("l_suppkey", "s_suppkey"), supplier, "s_suppkey",
                       rows=BROADCAST_BYTES // 64)
    return wide.groupBy(
        "o_nation", "o_sector", "d_nation", "d_sector", "segment",
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
    ).agg(
        F.sum("l_extendedprice").alias("value"),
        F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_quantity") * (1 + F.col("l_tax"))).alias("taxed_quantity"),
        F.sum(F.col("l_quantity") * F.col("l_discount")).alias("discount_quantity"),
        F.sum(F.col("l_quantity") * F.col("l_tax")).alias("tax_quantity"),
    )


@dataclass
class Economy:
    """Long tables of one build. ``grain`` is the place level, ``nation`` or ``region``.

    Tables are checkpoints and not caches: a cached table keeps all shuffle partitions, however few
    rows it has, and every later job on it sends the driver a result of each.
    """

    cells: DataFrame
    _cache: dict = field(default_factory=dict)

    def _memo(self, name, make):
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    @property
    def flows(self) -> DataFrame:
        """Intermediate flows (i_region, i_sector, j_region, j_sector, z)."""
        return self._memo("flows", lambda: cut_lineage(
            self.cells.where("returnflag = 'R'")
            .groupBy(F.col("o_place").alias("i_region"), F.col("o_sector").alias("i_sector"),
                     F.col("d_place").alias("j_region"), F.col("d_sector").alias("j_sector"))
            .agg((F.sum("value") / MILLION).alias("z"))))

    @property
    def demand_cells(self) -> DataFrame:
        """Final demand by consuming region and demand category text."""
        category = F.create_map(*[F.lit(v) for kv in CATEGORY_OF_SEGMENT.items() for v in kv])
        return self.cells.where("returnflag <> 'R'").groupBy(
            F.col("o_place").alias("region"), F.col("o_sector").alias("sector"),
            F.col("d_place").alias("d_region"), category[F.col("segment")].alias("category"),
        ).agg((F.sum("value") / MILLION).alias("value"))

    @property
    def final_demand(self) -> DataFrame:
        """Final demand (region, sector, d_region, value)."""
        return self._memo("fd", lambda: cut_lineage(
            self.cells.where("returnflag <> 'R'")
            .groupBy(F.col("o_place").alias("region"), F.col("o_sector").alias("sector"),
                     F.col("d_place").alias("d_region"))
            .agg((F.sum("value") / MILLION).alias("value"))))

    @property
    def output(self) -> DataFrame:
        """Gross output (region, sector, x)."""
        return self._memo("x", lambda: cut_lineage(
            self.cells.groupBy(F.col("o_place").alias("region"), F.col("o_sector").alias("sector"))
            .agg((F.sum("value") / MILLION).alias("x"))))

    @property
    def coeff(self) -> DataFrame:
        """Technical coefficients a = z / x of the buying label."""
        from rippleflow.operators.harmonise import flows_to_coefficients

        return self._memo(
            "coeff", lambda: cut_lineage(flows_to_coefficients(self.flows, self.output))
        )

    @property
    def stressors(self) -> DataFrame:
        """Raw emission flows (extension, stressor, unit, region, sector, amount)."""
        t = self.cells.groupBy(
            F.col("o_place").alias("region"), F.col("o_sector").alias("sector")
        ).agg(
            F.sum(F.col("taxed_quantity") * 1000.0).alias("co2"),
            F.sum("discount_quantity").alias("ch4"),
            F.sum(F.col("tax_quantity") * 0.001).alias("n2o"),
            F.sum("quantity").alias("nox"),
        )
        rows = F.array(
            F.struct(F.lit("air_emissions").alias("extension"),
                     F.lit("CO2 - combustion - air").alias("stressor"),
                     F.lit("kg").alias("unit"), F.col("co2").alias("amount")),
            F.struct(F.lit("air_emissions").alias("extension"),
                     F.lit("CH4 - other - air").alias("stressor"),
                     F.lit("t").alias("unit"), F.col("ch4").alias("amount")),
            F.struct(F.lit("air_emissions").alias("extension"),
                     F.lit("N2O - other - air").alias("stressor"),
                     F.lit("kt").alias("unit"), F.col("n2o").alias("amount")),
            F.struct(F.lit("air_emissions").alias("extension"),
                     F.lit("NOX - other - air").alias("stressor"),
                     F.lit("g").alias("unit"), F.col("nox").alias("amount")),
        )
        return t.select("region", "sector", F.explode(rows).alias("r")).select(
            "r.extension", "r.stressor", "r.unit", "region", "sector", "r.amount"
        )

    @property
    def satellite(self) -> DataFrame:
        """Emission intensities (stressor, region, sector, intensity, unit), t per MEUR."""
        from rippleflow.operators.harmonise import ghg_account

        return self._memo(
            "sat", lambda: cut_lineage(ghg_account(self.stressors, self.output, "MEUR"))
        )

    @property
    def price_propagator(self) -> Propagator:
        from rippleflow.operators.leontief import price_links

        return self._memo("price", lambda: Propagator(price_links(self.coeff)))

    @property
    def quantity_propagator(self) -> Propagator:
        from rippleflow.operators.leontief import quantity_links

        return self._memo("quantity", lambda: Propagator(quantity_links(self.coeff)))


# Which demand category text each market segment stands for.
CATEGORY_OF_SEGMENT = {
    "HOUSEHOLD": "Final consumption expenditure by households",
    "FURNITURE": "Final consumption by NPISH",
    "AUTOMOBILE": "Final consumption by government",
    "BUILDING": "Gross fixed capital formation",
    "MACHINERY": "Changes in inventories",
}

_STORED: dict[tuple, DataFrame] = {}
_BUILDS: dict[tuple, Economy] = {}


def _stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = cut_lineage(line_cells(spark, sf_dir))
    return _STORED[key]


def economy(spark: SparkSession, sf_dir: str, grain: str = "region",
            linestatus: str | None = None) -> Economy:
    """The build of one table folder; built once per session like a stored build."""
    key = (spark.sparkContext.applicationId, sf_dir, grain, linestatus)
    if key in _BUILDS:
        return _BUILDS[key]
    cells = _stored_cells(spark, sf_dir)
    if linestatus is not None:
        cells = cells.where(F.col("linestatus") == linestatus)
    if grain == "nation":
        cells = cells.withColumn("o_place", F.col("o_nation")).withColumn(
            "d_place", F.col("d_nation"))
    else:
        place = nation_regions(spark, sf_dir)
        cells = (
            cells.join(place.select(
                F.col("n_name").alias("o_nation"), F.col("r_name").alias("o_place")), "o_nation")
            .join(place.select(
                F.col("n_name").alias("d_nation"), F.col("r_name").alias("d_place")), "d_nation")
        )
    _BUILDS[key] = Economy(cells)
    return _BUILDS[key]


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_name, r_name): the nation to region map."""
    region = read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return read(spark, sf_dir, "nation").join(region, "n_regionkey").select("n_name", "r_name")
