"""Tables read off a long result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleflow.functions.labels import label
from rippleflow.schema import BANDS, ECONOMY

# Parts of a price change in supply-chain order.
PART_ORDER = ["direct", "upstream_tier_1", "upstream_tier_2", "upstream_tier_3",
              "upstream_residual"]
# Macro variables shown per region, in column order.
MACRO_VARIABLES = ["gdp_change", "deflator", "gdp_change_real", "gdp_change_nominal",
                   "gdp_deflator_change", "real_consumption_change"]
#: How many cells an interactive table shows.
CELL_LIMIT = 200_000


def headline(results: DataFrame, variable: str = "price_change") -> DataFrame:
    """One row per good, largest change first."""
    return results.where(F.col("variable") == variable).select(
        "scenario_id", "region", "sector", "year", "scenario", "value").orderBy(F.desc("value"))


def variables(results: DataFrame) -> DataFrame:
    return results.select("variable").distinct().orderBy("variable")


def presence(results: DataFrame) -> DataFrame:
    """One row of flags: which kinds of rows a result holds."""
    v = F.col("variable")

    def any_of(*names):
        return F.coalesce(F.bool_or(v.isin(*names)), F.lit(False))

    return results.agg(
        any_of("volume_change").alias("has_volume"),
        any_of("gdp_change", "gdp_change_real", "real_consumption_change").alias("has_macro"),
        any_of("import_change", "export_change", "exchange_rate_change").alias("has_trade"),
        any_of("factor_price_change").alias("has_factor_prices"),
        any_of("welfare_change", "carbon_revenue").alias("has_welfare"))


def waterfall(results: DataFrame, region: str, sector: str, year: int | None = None) -> DataFrame:
    """Parts of one good's price change in supply-chain order; absent parts are skipped."""
    names = [f"price_change_{p}" for p in PART_ORDER]
    rows = results.where((F.col("region") == region) & (F.col("sector") == sector)
                         & F.col("variable").isin(*names))
    if year is not None:
        rows = rows.where(F.col("year") == year)
    pos = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("variable"))
    return rows.groupBy(F.col("variable").substr(F.lit(14), F.lit(100)).alias("part"),
                        pos.alias("pos")).agg(F.avg("value").alias("value")).orderBy("pos")


def decomposed_goods(results: DataFrame) -> DataFrame:
    return results.where(F.col("variable").startswith("price_change_")).select(
        "region", "sector").distinct().orderBy("region", "sector")


def summary(results: DataFrame, variable: str = "price_change") -> DataFrame:
    """Count, mean, max and min; the central band only when the variable has one."""
    rows = results.where(F.col("variable") == variable)
    central = F.col("scenario") == "central"
    agg = rows.agg(
        F.bool_or(central).alias("has_central"),
        *[f.alias(n) for n, f in {
            "n_c": F.count_if(central), "n_a": F.count("*"),
            "mean_c": F.avg(F.when(central, F.col("value"))), "mean_a": F.avg("value"),
            "max_c": F.max(F.when(central, F.col("value"))), "max_a": F.max("value"),
            "min_c": F.min(F.when(central, F.col("value"))), "min_a": F.min("value")}.items()])
    pick = lambda n: F.when(F.col("has_central"), F.col(n + "_c")).otherwise(F.col(n + "_a"))
    return agg.where("n_a > 0").select(
        pick("n").alias("goods"), pick("mean").alias("mean"), pick("max").alias("max"),
        pick("min").alias("min"))


def _wide(rows: DataFrame, keys: list[str], names, column="variable") -> DataFrame:
    """A pivot over known names as conditional means: one aggregation, no name lookup."""
    return rows.groupBy(*keys).agg(*[
        F.avg(F.when(F.col(column) == n, F.col("value"))).alias(n) for n in names])


def present_only(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Drop columns that are null everywhere (one small aggregate decides)."""
    flags = df.agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in names]).first()
    return df.select(*keys, *[n for n in names if flags[n]])


def volume_envelope(results: DataFrame) -> DataFrame:
    """Low, central and high volume change per good, biggest fall first."""
    keys = ["scenario_id", "region", "sector", "year"]
    return _wide(results.where("variable = 'volume_change'"), keys, BANDS, "scenario").orderBy(
        "central")


def gdp_table(results: DataFrame) -> DataFrame:
    """Macro variables per region and year, central band, columns that exist only."""
    keys = ["scenario_id", "region", "year"]
    rows = results.where((F.col("sector") == ECONOMY) & (F.col("scenario") == "central")
                         & F.col("variable").isin(*MACRO_VARIABLES))
    return present_only(_wide(rows, keys, MACRO_VARIABLES), MACRO_VARIABLES, keys)


def gva_table(results: DataFrame) -> DataFrame:
    """Nominal and real value-added change per good, worst real change first.

    The real column takes the first of the two names under which runs report it.
    """
    keys = ["scenario_id", "region", "sector", "year"]
    names = ["gva_change", "gva_change_real", "gva_volume_change"]
    rows = results.where((F.col("sector") != ECONOMY) & (F.col("scenario") == "central")
                         & F.col("variable").isin(*names))
    return _wide(rows, keys, names).select(
        *keys, F.col("gva_change").alias("gva_nominal"),
        F.coalesce("gva_change_real", "gva_volume_change").alias("gva_real")).orderBy("gva_real")


def trade_table(results: DataFrame) -> DataFrame:
    names = ["import_change", "export_change"]
    return _wide(results.where(F.col("variable").isin(*names)),
                 ["scenario_id", "region", "sector", "year"], names)


def exchange_rate_table(results: DataFrame) -> DataFrame:
    """Exchange-rate changes; empty for runs without an exchange rate."""
    return results.where("variable = 'exchange_rate_change'").select(
        "scenario_id", "region", "year", F.col("value").alias("exchange_rate_change"))


def factor_price_table(results: DataFrame) -> DataFrame:
    return results.where("variable = 'factor_price_change'").select(
        "scenario_id", "region", F.col("sector").alias("factor"), "year",
        F.col("value").alias("factor_price_change")).orderBy("factor_price_change")


def welfare_table(results: DataFrame) -> DataFrame:
    names = ["welfare_change", "carbon_revenue"]
    return _wide(results.where((F.col("sector") == ECONOMY) & F.col("variable").isin(*names)),
                 ["scenario_id", "region", "year"], names)


def macro_headline(results: DataFrame) -> DataFrame:
    """Nominal GDP, real GDP and deflator per region-year under whichever names a run uses."""
    keys = ["scenario_id", "region", "year"]
    names = ["gdp_change", "gdp_change_nominal", "gdp_change_real", "deflator",
             "gdp_deflator_change"]
    rows = results.where((F.col("sector") == ECONOMY) & (F.col("scenario") == "central")
                         & F.col("variable").isin(*names))
    style = rows.groupBy("scenario_id").agg(
        F.bool_or(F.col("variable") == "gdp_change_nominal").alias("own"))
    own = F.col("own")
    wide = _wide(rows, keys, names).join(style, "scenario_id")
    return wide.select(
        *keys, F.when(own, F.col("gdp_change_nominal")).otherwise(F.col("gdp_change"))
        .alias("nominal"), F.col("gdp_change_real").alias("real"),
        F.when(own, F.col("gdp_deflator_change")).otherwise(F.col("deflator")).alias("deflator"),
    ).where("nominal IS NOT NULL")


def top_k(results: DataFrame, variable: str, k: int) -> DataFrame:
    """The k largest values; ties break by label so the answer is stable."""
    return results.where(F.col("variable") == variable).select(
        "scenario_id", "region", "sector", "year", "value").orderBy(
        F.desc("value"), "scenario_id", "region", "sector", "year").limit(k)


def frame_slice(cells: DataFrame, row_query: str = "", col_query: str = "",
                cell_limit: int | None = None) -> DataFrame:
    """Cells (row, col, value) whose labels contain the queries.

    With ``cell_limit`` (``CELL_LIMIT`` for a display) whole columns up to that many cells, in label
    order; every row then says how many columns are left out (``columns_left_out``).
    """
    hit = cells.where(F.lower("row").contains(row_query.lower())
                      & F.lower("col").contains(col_query.lower()))
    if cell_limit is None:
        return hit
    n_rows = hit.select("row").distinct().agg(F.count("*").alias("n_rows"))
    cols = hit.select("col").distinct().withColumn(
        "pos", F.row_number().over(Window.orderBy("col"))).join(n_rows)
    room = F.greatest(F.lit(1), F.floor(F.lit(cell_limit) / F.greatest("n_rows", F.lit(1))))
    kept = cols.where(F.col("pos") <= room).select("col")
    left_out = cols.agg(F.count_if(F.col("pos") > room).alias("columns_left_out"))
    return hit.join(kept, "col", "left_semi").join(F.broadcast(left_out))


def frame_labels(coeff: DataFrame) -> DataFrame:
    """Distinct labels of a build with their region and sector, in order."""
    ends = F.explode(F.array(
        F.struct(F.col("i_region").alias("region"), F.col("i_sector").alias("sector")),
        F.struct(F.col("j_region").alias("region"), F.col("j_sector").alias("sector"))))
    return coeff.select(ends.alias("e")).select("e.*").distinct().select(
        label().alias("label"), "region", "sector").orderBy("label")


def volume_series(results: DataFrame) -> DataFrame:
    """Volume change per good as one sorted series: central band, or whatever there is."""
    rows = results.where("variable = 'volume_change'")
    has = rows.groupBy("scenario_id").agg(
        F.bool_or(F.col("scenario") == "central").alias("has_central"))
    return rows.join(has, "scenario_id").where(
        ~F.col("has_central") | (F.col("scenario") == "central")).select(
        "scenario_id", label().alias("good"), "year", "scenario", "value").orderBy("value")
