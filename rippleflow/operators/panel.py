"""Capital stocks, trends and endowment scaling over years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPRECIATION = 0.05
NET_RETURN = 0.04


def capital_next(stock, investment, depreciation=DEPRECIATION, retirement=0.0):
    """(1 - depreciation)(1 - retirement) K + I."""
    return (1.0 - depreciation) * (1.0 - retirement) * stock + investment


def capital_rules(panel: DataFrame) -> DataFrame:
    """Stock and investment are not negative, rates lie in [0, 1]."""
    rules = {
        "stock_negative": F.col("k0").isNull() | F.isnan("k0") | (F.col("k0") < 0),
        "investment_negative": F.col("investment").isNull() | F.isnan("investment")
        | (F.col("investment") < 0),
        "retirement_range": (F.col("retirement") < 0) | (F.col("retirement") > 1),
    }
    found = F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]))
    return panel.select(F.explode(found).alias("rule"), F.col("key").cast("string").alias("item"))


def benchmark_capital(income: DataFrame, net_return: float = NET_RETURN,
                      depreciation: float = DEPRECIATION) -> DataFrame:
    """Stock per region from its capital income: income / (net return + depreciation)."""
    if not (0.0 <= depreciation <= 1.0 and net_return >= 0.0 and net_return + depreciation > 0.0):
        raise ValueError(f"invalid rates: net_return {net_return}, depreciation {depreciation}")
    return income.groupBy("region").agg(
        (F.sum("income") / F.lit(net_return + depreciation)).alias("stock"))


def implied_growth(stock: DataFrame, investment: DataFrame,
                   depreciation: float = DEPRECIATION) -> DataFrame:
    """Growth the benchmark investment implies: I / K - depreciation."""
    inv = investment.groupBy("region").agg(F.sum("investment").alias("investment"))
    return stock.join(inv, "region").select(
        "region", (F.col("investment") / F.col("stock") - F.lit(depreciation)).alias("growth"))


def capital_path(panel: DataFrame, initial: DataFrame, keys=("key",),
                 depreciation: float = DEPRECIATION) -> DataFrame:
    """Stock after each year and its growth, the accumulation step folded over ordered years.

    ``panel`` is (keys..., year, investment, retirement); rows of one year add up first, so the
    folded array has one entry per distinct year. ``initial`` is (keys..., k0).
    """
    keys = list(keys)
    yearly = panel.groupBy(*keys, "year").agg(
        F.sum("investment").alias("investment"), F.max("retirement").alias("retirement"))
    steps = yearly.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("year", "investment", "retirement"))).alias("steps"))
    start = F.array(F.struct(F.lit(None).cast("int").alias("year"), F.col("k0").alias("stock"),
                             F.lit(0.0).alias("growth")))

    def advance(done, s):
        last = F.element_at(done, -1)["stock"]
        stock = capital_next(last, s["investment"], F.lit(depreciation),
                             F.coalesce(s["retirement"], F.lit(0.0)))
        return F.concat(done, F.array(F.struct(
            s["year"].cast("int").alias("year"), stock.alias("stock"),
            (F.try_divide(stock, last) - 1.0).alias("growth"))))

    return (
        steps.join(initial, keys)
        .select(*keys, F.explode(F.slice(
            F.aggregate("steps", start, advance), F.lit(2), F.size("steps"))).alias("p"))
        .select(*keys, F.col("p.year").alias("year"), F.col("p.stock").alias("capital_stock"),
                F.col("p.growth").alias("capital_growth"))
    )


def trend_index(years: DataFrame, growth: DataFrame, keys=()) -> DataFrame:
    """(1 + g)^i by the position of the year; ``growth`` is (name, g)."""
    order = Window.partitionBy(*keys).orderBy("year")
    return years.select(*keys, "year").distinct().withColumn(
        "pos", F.row_number().over(order) - 1).join(growth).select(
        *keys, "name", "year", F.pow(1.0 + F.col("g"), F.col("pos")).alias("index"))


def scale_endowments(endowment: DataFrame, scale: DataFrame) -> DataFrame:
    """Endowments (region, factor, value) times a scale table (factor, region or null, scale)."""
    from rippleflow.operators.checks import require_empty

    require_empty(scale_rules(endowment, scale))
    wide = scale.where("region IS NULL").select("factor", F.col("scale").alias("all_scale"))
    own = scale.where("region IS NOT NULL").select("factor", "region", F.col("scale").alias("own"))
    return endowment.join(wide, "factor", "left").join(own, ["factor", "region"], "left").select(
        "region", "factor",
        (F.col("value") * F.coalesce("all_scale", F.lit(1.0)) * F.coalesce("own", F.lit(1.0)))
        .alias("value"))


def scale_rules(endowment: DataFrame, scale: DataFrame) -> DataFrame:
    """Scaled factors and regions exist and scales are finite and positive."""
    factors = endowment.select("factor").distinct()
    regions = endowment.select("region").distinct()
    s = F.col("scale")
    item = F.concat_ws(":", "factor", "region")
    return (
        scale.join(factors, "factor", "left_anti").select(
            F.lit("unknown_factor").alias("rule"), item.alias("item"))
        .unionByName(scale.where("region IS NOT NULL").join(regions, "region", "left_anti").select(
            F.lit("unknown_region").alias("rule"), item.alias("item")))
        .unionByName(scale.where(s.isNull() | F.isnan(s) | (s <= 0) | (s == float("inf"))).select(
            F.lit("scale_not_positive").alias("rule"), item.alias("item")))
    )
