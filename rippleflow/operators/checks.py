"""Validation rules as violation tables.

Every rule returns rows (rule, item). An empty result means the rule holds; ``require_empty`` turns
a non-empty one into an error naming a few items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import label
from rippleflow.operators.harmonise import CO2E, GWP100
from rippleflow.operators.leontief import covered_goods
from rippleflow.operators.nature import COMBINED_WATER, MATERIALITY_SCALE, NO_DATA, WATER_PARTS
from rippleflow.plans.joins import union_all
from rippleflow.schema import BANDS, INSTITUTIONS, RESULT_COLUMNS

NEGATIVE_COEFFICIENT = -1e-9
NEGATIVE_INTENSITY = -1e-12
WEIGHT_TOLERANCE = 1e-6
BALANCE_TOLERANCE = 1e-6
REPLICATION_TOLERANCE = 1e-6


class Violation(ValueError):
    """A rule is broken; the message carries the first few items."""


def require_empty(violations: DataFrame, limit: int = 5) -> None:
    """Raise when there is any violation. Only ``limit`` rows reach the driver."""
    rows = violations.limit(limit).collect()
    if rows:
        raise Violation("; ".join(f"{r['rule']}: {r['item']}" for r in rows))


def broken(df: DataFrame, rule: str, item) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), item.cast("string").alias("item"))


def not_finite(col):
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def duplicates(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1")
    return broken(twice, rule, F.concat_ws(":", *keys))


# -- build tables --------------------------------------------------------------------------------

def label_rules(classification: DataFrame) -> DataFrame:
    """Labels of a classification (name, label) are unique."""
    return duplicates(classification, ["name", "label"], "duplicate_label")


def alignment_rules(coeff: DataFrame, final_demand: DataFrame, goods: DataFrame) -> DataFrame:
    """Cells and demand sit on known labels, are unique and finite."""
    known = goods.select(label().alias("item")).distinct()
    rows = coeff.select(label("i_region", "i_sector").alias("item"))
    cols = coeff.select(label("j_region", "j_sector").alias("item"))
    fd = final_demand.select(label().alias("item"))

    def unknown(df, rule):
        return broken(df.distinct().join(known, "item", "left_anti"), rule, F.col("item"))

    return union_all([
        unknown(rows, "row_label"), unknown(cols, "column_label"), unknown(fd, "demand_label"),
        duplicates(coeff, ["i_region", "i_sector", "j_region", "j_sector"], "duplicate_cell"),
        duplicates(final_demand, ["region", "sector", "d_region"], "duplicate_demand"),
        broken(coeff.where(not_finite("a")), "cell_not_finite", label("i_region", "i_sector")),
        broken(final_demand.where(not_finite("value")), "demand_not_finite", label()),
    ])


def axis_rules(goods: DataFrame, regions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Labels are exactly the product of the declared regions and sectors."""
    wanted = regions.select("region").distinct().join(sectors.select("sector").distinct()).select(
        "region", "sector")
    have = goods.select("region", "sector").distinct()
    return union_all([
        broken(wanted.join(have, ["region", "sector"], "left_anti"), "missing_label", label()),
        broken(have.join(wanted, ["region", "sector"], "left_anti"), "unexpected_label", label()),
    ])


def demand_shape_rules(final_demand: DataFrame, regions: DataFrame, kind: str) -> DataFrame:
    """by_region: consuming regions are exactly the build's; aggregate: none is named."""
    consumers = final_demand.select(F.col("d_region").alias("region")).distinct()
    if kind == "aggregate":
        return broken(consumers.where("region IS NOT NULL"), "aggregate_names_region",
                      F.col("region"))
    if kind != "by_region":
        raise ValueError(f"final demand kind must be aggregate or by_region, got {kind!r}")
    have = regions.select("region").distinct()
    return union_all([
        broken(have.join(consumers, "region", "left_anti"), "consumer_missing", F.col("region")),
        broken(consumers.where("region IS NOT NULL").join(have, "region", "left_anti"),
               "consumer_unknown", F.col("region")),
        broken(consumers.where("region IS NULL"), "consumer_null", F.lit("null")),
    ])


def institution_rules(split: DataFrame, final_demand: DataFrame, n_labels: int) -> DataFrame:
    """The institution split decomposes every (product, consuming region) cell of final demand.

    Household and government are not negative, the cell total is not negative and does not exceed
    the cell's final demand, each within a scale of max(|cell|, |mean of the consumer|, 1).
    """
    keys = ["region", "sector", "d_region"]
    mean = final_demand.groupBy("d_region").agg(
        F.abs(F.sum("value") / F.lit(float(n_labels))).alias("mean"))
    cell = split.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("institution") == i, F.col("value")).otherwise(0.0)).alias(i)
          for i in INSTITUTIONS], F.sum("value").alias("total"))
    both = (
        cell.join(final_demand.select(*keys, F.col("value").alias("fd")), keys, "left")
        .join(mean, "d_region", "left")
        .withColumn("fd", F.coalesce("fd", F.lit(0.0)))
        .withColumn("scale", F.greatest(F.abs("fd"), F.coalesce("mean", F.lit(0.0)), F.lit(1.0)))
        .withColumn("item", F.concat_ws(":", "region", "sector", "d_region"))
    )
    item = F.col("item")
    return union_all([
        broken(both.where(F.col("household") < -1e-9 * F.col("scale")), "negative_household", item),
        broken(both.where(F.col("government") < -1e-9 * F.col("scale")), "negative_government",
               item),
        broken(both.where(F.col("total") < -1e-9 * F.col("scale")), "negative_total", item),
        broken(both.where(F.col("total") > F.col("fd") + 1e-6 * F.col("scale")),
               "exceeds_final_demand", item),
        broken(split.where(not_finite("value")), "split_not_finite", label()),
        broken(split.where(~F.col("institution").isin(*INSTITUTIONS)), "unknown_institution",
               F.col("institution")),
        duplicates(split, [*keys, "institution"], "duplicate_split"),
    ])


def admissible_rules(coeff: DataFrame, upper_bound: float) -> DataFrame:
    """No negative coefficient, and a measured spectral radius under 1."""
    neg = broken(coeff.where(F.col("a") < NEGATIVE_COEFFICIENT), "negative_coefficient",
                 F.concat_ws(":", "i_region", "i_sector", "j_region", "j_sector"))
    one = coeff.sparkSession.range(1).where(F.lit(not upper_bound < 1.0))
    return neg.unionByName(broken(one, "not_productive", F.lit(str(upper_bound))))


def satellite_rules(satellite: DataFrame, goods: DataFrame) -> DataFrame:
    """Intensities sit on known labels and are finite."""
    return union_all([
        broken(satellite.select("region", "sector").distinct().join(
            goods, ["region", "sector"], "left_anti"), "satellite_label", label()),
        broken(goods.select("region", "sector").distinct().join(
            satellite, ["region", "sector"], "left_anti"), "satellite_missing", label()),
        broken(satellite.where(not_finite("intensity")), "satellite_not_finite", label()),
    ])


def structural_rules(coeff, final_demand, goods, satellite, upper_bound: float) -> DataFrame:
    """The gate of a build: alignment, productivity and satellites together."""
    one = coeff.sparkSession.range(1).where(F.lit(not upper_bound < 1.0))
    return union_all([
        alignment_rules(coeff, final_demand, goods),
        broken(one, "not_productive", F.lit(str(upper_bound))),
        satellite_rules(satellite, goods),
    ])


def unit_rules(satellite: DataFrame, currency: str, unit: str, euro_only: bool) -> DataFrame:
    """Money is in millions of the currency and every row is tonnes (or tCO2e) per that unit."""
    expected_unit = "MEUR" if euro_only else f"M{currency}"
    wanted = F.when(F.col("stressor") == CO2E, F.lit(f"tCO2e/{expected_unit}")).otherwise(
        F.lit(f"t/{expected_unit}"))
    bad_rows = satellite.where(F.col("unit").isNull() | (F.col("unit") != wanted)).select(
        "stressor", "unit").distinct()
    spark = satellite.sparkSession
    bad_money = unit != expected_unit or (euro_only and currency != "EUR")
    return union_all([
        broken(bad_rows, "satellite_unit", F.concat_ws("=", "stressor", "unit")),
        broken(spark.range(1).where(F.lit(bad_money)), "monetary_unit", F.lit(f"{currency}/{unit}")),
    ])


# -- parameter tables ----------------------------------------------------------------------------

def elasticity_rules(e: DataFrame, kind: str = "demand") -> DataFrame:
    """Finite ordered bands with source and confidence; demand elasticities are not positive."""
    out = [
        broken(e.where(not_finite("low") | not_finite("central") | not_finite("high")),
               "elasticity_not_finite", F.col("key")),
        broken(e.where((F.col("low") > F.col("central")) | (F.col("central") > F.col("high"))),
               "elasticity_order", F.col("key")),
        broken(e.where(F.col("source").isNull() | F.col("confidence").isNull()),
               "elasticity_metadata", F.col("key")),
    ]
    if kind == "demand":
        out.append(broken(e.where(F.col("high") > 0), "elasticity_sign", F.col("key")))
    return union_all(out)


def elasticity_fit_rules(sets: DataFrame, build_classification: str) -> DataFrame:
    """A volume run takes demand sets (kind, classification) that fit the build's sectors."""
    c = F.col("classification")
    fits = (c == "coarse-sectors") | (c == build_classification) | (
        c.startswith("coarse") & F.lit("coarse" in build_classification))
    return union_all([
        broken(sets.where(F.col("kind") != "demand"), "elasticity_kind", F.col("kind")),
        broken(sets.where(~fits), "elasticity_classification", c),
    ])


def concordance_rules(c: DataFrame) -> DataFrame:
    """Weights are finite, not negative and sum to 1 per source."""
    total = c.groupBy("source").agg(F.sum("weight").alias("s"))
    return union_all([
        broken(c.where(not_finite("weight")), "weight_not_finite", F.col("source")),
        broken(c.where(F.col("weight") < 0), "weight_negative", F.col("source")),
        broken(total.where(F.abs(F.col("s") - 1.0) > WEIGHT_TOLERANCE), "weight_sum",
               F.col("source")),
    ])


def result_rules(results: DataFrame) -> DataFrame:
    """Exact columns and types, finite values, unique keys, known bands."""
    have, want = set(results.columns), set(RESULT_COLUMNS)
    if have != want:
        raise Violation(f"result columns: missing {sorted(want - have)}, extra {sorted(have - want)}")
    types = dict(results.dtypes)
    if types["value"] not in ("double", "float") or types["year"] not in ("int", "bigint"):
        raise Violation(f"result types: value {types['value']}, year {types['year']}")
    keys = ["scenario_id", "variable", "sector", "region", "year", "scenario"]
    item = F.concat_ws(":", *keys)
    return union_all([
        broken(results.where(not_finite("value")), "result_not_finite", item),
        duplicates(results, keys, "result_duplicate"),
        broken(results.where(~F.col("scenario").isin(*BANDS)), "result_band", item),
    ])


def shock_rules(shocks: DataFrame) -> DataFrame:
    """Parameter rules of every shock type over a table of many scenarios."""
    item = F.concat_ws(":", "scenario_id", "shock_id")
    path = F.map_values(F.coalesce("path", F.expr("map()").cast("map<int,double>")))
    kind, level = F.col("type"), F.col("level")

    def any_path(rule):
        return F.exists(path, rule)

    def bad(v):
        return F.isnan(v) | (F.abs(v) == float("inf"))

    gases = F.coalesce("gases", F.array().cast("array<string>"))
    carbon, energy = kind == "carbon_price", kind == "energy_price"
    prod, nature = kind == "productivity", kind == "nature_stress"
    rules = {
        "level_not_finite": not_finite("level") | any_path(bad),
        "price_negative": carbon & ((level < 0) | any_path(lambda v: v < 0)),
        "gases_empty": carbon & (F.size(gases) <= 0),
        "gases_duplicate": carbon & (F.size(F.array_distinct(gases)) < F.size(gases)),
        "gases_mixed": carbon & F.array_contains(gases, CO2E) & (F.size(gases) > 1),
        "carrier_blank": energy & (F.trim(F.coalesce("carrier", F.lit(""))) == ""),
        "change_below_minus_one": energy & ((level < -1) | any_path(lambda v: v < -1)),
        "delta_below_minus_one": prod & ((level < -1) | any_path(lambda v: v < -1)),
        "service_blank": nature & (F.trim(F.coalesce("service", F.lit(""))) == ""),
        "severity_range": nature & (
            (level < 0) | (level > 1) | any_path(lambda v: (v < 0) | (v > 1))),
        "unknown_type": ~kind.isin("carbon_price", "energy_price", "productivity", "demand_shift",
                                   "trade_cost", "nature_stress"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return shocks.select(F.explode(found).alias("rule"), item.alias("item"))


def coverage_rules(shocks: DataFrame, goods: DataFrame) -> DataFrame:
    """Every named sector, region and carrier exists in the build."""
    sectors, regions = goods.select("sector").distinct(), goods.select("region").distinct()

    def unknown(df, col, axis_df, rule):
        return broken(df.join(axis_df, col, "left_anti").distinct(), rule,
                      F.concat_ws(":", "scenario_id", col))

    return union_all([
        unknown(shocks.select("scenario_id", F.explode("sectors").alias("sector")), "sector",
                sectors, "unknown_sector"),
        unknown(shocks.select("scenario_id", F.explode("regions").alias("region")), "region",
                regions, "unknown_region"),
        unknown(shocks.where("type = 'energy_price'").select(
            "scenario_id", F.col("carrier").alias("sector")), "sector", sectors,
            "unknown_carrier"),
    ])


def gas_rules(shocks: DataFrame, satellite: DataFrame, goods: DataFrame) -> DataFrame:
    """Requested gases exist, have a warming factor, and are not negative where covered."""
    asked = shocks.where("type = 'carbon_price'").select(
        "scenario_id", "shock_id", "sectors", "regions", F.explode("gases").alias("stressor"))
    present = satellite.select("stressor").distinct()
    item = F.concat_ws(":", "scenario_id", "stressor")
    covered = covered_goods(asked, goods).join(satellite, ["stressor", "region", "sector"])
    return union_all([
        broken(asked.join(present, "stressor", "left_anti"), "gas_missing", item),
        broken(asked.where(~F.col("stressor").isin(*GWP100, CO2E)), "gas_without_factor", item),
        broken(covered.where(F.col("intensity") < NEGATIVE_INTENSITY).select(
            "scenario_id", "stressor").distinct(), "gas_negative", item),
    ])


def support_rules(shocks: DataFrame, supported: list[str]) -> DataFrame:
    """Shock types a run cannot take."""
    return broken(shocks.where(~F.col("type").isin(*supported)).select("scenario_id", "type")
                  .distinct(), "unsupported_shock", F.concat_ws(":", "scenario_id", "type"))


def year_rules(scenario_years: DataFrame) -> DataFrame:
    """Scenario years (scenario_id, years array) are present and unique."""
    y = F.coalesce("years", F.array().cast("array<int>"))
    return union_all([
        broken(scenario_years.where(F.size(y) <= 0), "years_empty", F.col("scenario_id")),
        broken(scenario_years.where(F.size(F.array_distinct(y)) < F.size(y)), "years_duplicate",
               F.col("scenario_id")),
    ])


def pin_rules(pins: DataFrame) -> DataFrame:
    """The same good pinned to different values in one scenario year."""
    return broken(pins.where(F.col("spread") > 1e-12), "pin_conflict",
                  F.concat_ws(":", "scenario_id", "year", "region", "sector"))


# -- nature --------------------------------------------------------------------------------------

def ratings_rules(ratings: DataFrame) -> DataFrame:
    allowed = [*MATERIALITY_SCALE, NO_DATA]
    cls = F.upper(F.trim(F.coalesce("materiality", F.lit(""))))
    return union_all([
        broken(ratings.where(~cls.isin(*allowed)), "rating_class",
               F.concat_ws(":", "process", "service", "materiality")),
        duplicates(ratings, ["process", "service"], "rating_duplicate"),
    ])


def stress_rules(stresses: DataFrame, exposure: DataFrame,
                 allow_water_overlap: bool = False) -> DataFrame:
    """Stresses name known services, reach some good, and do not hit one good twice."""
    nature = stresses.where("type = 'nature_stress'")
    services = exposure.select("service").distinct()
    goods = exposure.select("region", "sector").distinct()
    item = F.concat_ws(":", "scenario_id", "shock_id")
    hit = covered_goods(
        nature.select("scenario_id", "shock_id", "service", "sectors", "regions"), goods)
    twice = hit.groupBy("scenario_id", "service", "region", "sector").agg(
        F.count("*").alias("n")).where("n > 1").select("scenario_id", "service").distinct()
    out = [
        broken(nature.join(services, "service", "left_anti"), "service_unknown", item),
        broken(nature.join(hit.select("scenario_id", "shock_id").distinct(),
                           ["scenario_id", "shock_id"], "left_anti"), "stress_reaches_nothing",
               item),
        broken(twice, "stress_twice", F.concat_ws(":", "scenario_id", "service")),
    ]
    if not allow_water_overlap:
        s = F.lower("service")
        water = hit.groupBy("scenario_id", "region", "sector").agg(
            F.max(s == COMBINED_WATER).alias("whole"), F.max(s.isin(*WATER_PARTS)).alias("part"))
        out.append(broken(water.where("whole AND part"), "water_overlap",
                          F.concat_ws(":", "scenario_id", "region", "sector")))
    return union_all(out)


def double_counting(nature: DataFrame, climate: DataFrame) -> DataFrame:
    """Mechanisms claimed by both channel sets (column ``mechanism``)."""
    return broken(nature.select("mechanism").intersect(climate.select("mechanism")),
                  "mechanism_twice", F.col("mechanism"))


def region_scope_rules(shocks: DataFrame) -> DataFrame:
    """Shocks with a region list cannot run on a model without regions."""
    scoped = shocks.where(F.col("type").isin("nature_stress", "productivity")
                          & (F.size("regions") > 0))
    return broken(scoped, "region_scoped", F.concat_ws(":", "scenario_id", "shock_id"))


def supply_share_rules(shares: DataFrame, zero_products: DataFrame, products: DataFrame,
                       industries: DataFrame) -> DataFrame:
    """Shares and zero-supply products split the product list exactly; weights are shares."""
    have = shares.select("product").distinct()
    zero = zero_products.select("product").distinct()
    known = products.select("product").distinct()
    total = shares.groupBy("product").agg(F.sum("weight").alias("s"))
    return union_all([
        broken(have.intersect(zero), "product_twice", F.col("product")),
        broken(have.union(zero).distinct().join(known, "product", "left_anti"), "product_unknown",
               F.col("product")),
        broken(known.join(have.union(zero), "product", "left_anti"), "product_missing",
               F.col("product")),
        broken(shares.select("industry").distinct().join(industries, "industry", "left_anti"),
               "industry_unknown", F.col("industry")),
        broken(shares.where(not_finite("weight") | (F.col("weight") < 0)), "share_invalid",
               F.col("product")),
        broken(total.where(F.abs(F.col("s") - 1) > WEIGHT_TOLERANCE), "share_sum",
               F.col("product")),
    ])


def classify_labels(labels: DataFrame, vocab_a: DataFrame, vocab_b: DataFrame,
                    keys=()) -> DataFrame:
    """Which of two vocabularies a build's sector labels belong to.

    Status: ``none`` (no label known), ``partial`` (some unknown), ``ambiguous`` (all in both),
    ``a`` or ``b`` (all in one), ``mixed`` (all known, no single vocabulary covers them).
    """
    flagged = (
        labels.join(vocab_a.select("sector", F.lit(True).alias("in_a")).distinct(), "sector", "left")
        .join(vocab_b.select("sector", F.lit(True).alias("in_b")).distinct(), "sector", "left")
        .withColumn("in_a", F.coalesce("in_a", F.lit(False)))
        .withColumn("in_b", F.coalesce("in_b", F.lit(False)))
    )
    agg = flagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"),
        F.count_if(~F.col("in_a") & ~F.col("in_b")).alias("n_unknown"))
    n = F.col("n")
    return agg.withColumn(
        "status",
        F.when(F.col("n_unknown") == n, "none").when(F.col("n_unknown") > 0, "partial")
        .when((F.col("n_a") == n) & (F.col("n_b") == n), "ambiguous")
        .when(F.col("n_a") == n, "a").when(F.col("n_b") == n, "b").otherwise("mixed"))


# -- SAMs and levels -----------------------------------------------------------------------------

def sam_rules(sam: DataFrame, accounts: DataFrame, required: DataFrame,
              tol: float = BALANCE_TOLERANCE) -> DataFrame:
    """Required accounts exist, cells sit on declared accounts once, are finite, >= 0, balanced."""
    from rippleflow.operators.sam import imbalance

    declared = accounts.select("account").distinct()
    used = sam.select(F.explode(F.array("row_acct", "col_acct")).alias("account")).distinct()
    return union_all([
        broken(required.join(declared, "account", "left_anti"), "account_missing",
               F.col("account")),
        broken(used.join(declared, "account", "left_anti"), "account_undeclared",
               F.col("account")),
        duplicates(accounts, ["account"], "account_duplicate"),
        duplicates(sam, ["row_acct", "col_acct"], "cell_duplicate"),
        broken(sam.where(not_finite("value")), "cell_not_finite",
               F.concat_ws("<-", "row_acct", "col_acct")),
        broken(sam.where(F.col("value") < -1e-9), "cell_negative",
               F.concat_ws("<-", "row_acct", "col_acct")),
        broken(imbalance(sam).where(F.abs("gap") > tol), "account_unbalanced", F.col("account")),
    ])


def topology_rules(sam: DataFrame, sectors: list[str], factors: list[str], household: str,
                   government: str = "GOV", savings: str = "SAVINV") -> DataFrame:
    """Flows calibration has a counterpart for: only supported payments to the institutions."""
    row, col, v = F.col("row_acct"), F.col("col_acct"), F.col("value")
    active = sam.where(F.abs(v) > 1e-9)
    cell = F.concat_ws("<-", "row_acct", "col_acct")
    bad_sources = [*sectors, *factors]
    sector_sum = sam.where(col.isin(*sectors)).groupBy("col_acct").agg(
        F.sum("value").alias("output"),
        F.sum(F.when(row.isin(*factors), v).otherwise(0.0)).alias("va"))

    def balance(acct):
        return sam.where(row.isin(acct) | col.isin(acct)).agg(
            F.sum(F.when((row == acct) & (col == household), v).otherwise(0.0)).alias("inflow"),
            F.sum(F.when((col == acct) & row.isin(*sectors), v).otherwise(0.0)).alias("outflow"),
        ).where(F.abs(F.col("inflow") - F.col("outflow"))
                > 1e-6 * F.greatest(F.lit(1.0), F.col("inflow")))

    return union_all([
        broken(active.where((row == government) & col.isin(*bad_sources, savings)),
               "government_receipt", cell),
        broken(active.where((col == government) & row.isin(household, savings)),
               "government_outlay", cell),
        broken(active.where((row == savings) & col.isin(*bad_sources)), "savings_receipt", cell),
        broken(active.where((row == household) & (col == savings)), "savings_outlay", cell),
        broken(balance(government), "government_unbalanced", F.lit(government)),
        broken(balance(savings), "savings_unbalanced", F.lit(savings)),
        broken(sector_sum.where("output <= 0"), "no_output", F.col("col_acct")),
        broken(sector_sum.where("va <= 0"), "no_value_added", F.col("col_acct")),
        broken(sam.where((col == household) & row.isin(*sectors) & (v < 0)), "demand_negative",
               cell),
    ])


def replication(levels: DataFrame, calibrated: DataFrame, keys: list[str]) -> DataFrame:
    """Largest absolute gap per variable between derived and calibrated levels."""
    return levels.select(*keys, F.col("level").alias("a")).join(
        calibrated.select(*keys, F.col("level").alias("b")), keys, "full").groupBy("variable").agg(
        F.max(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("error"))


def replication_rules(levels: DataFrame, calibrated: DataFrame, keys: list[str]) -> DataFrame:
    gap = replication(levels, calibrated, keys)
    return broken(gap.where(F.col("error") > REPLICATION_TOLERANCE), "not_replicating",
                  F.col("variable"))


def dust_rules(trade: DataFrame, threshold: float) -> DataFrame:
    """Trade routes (origin, dest, sector, value) that are positive but below the threshold."""
    return broken(trade.where((F.col("value") > 0) & (F.col("value") < threshold)
                              & (F.col("origin") != F.col("dest"))), "dust_route",
                  F.concat_ws(":", "origin", "dest", "sector"))


def carbon_share(shares: DataFrame, goods: DataFrame) -> DataFrame:
    """A supplied cost-share table on the model's goods, missing entries 0."""
    require_empty(carbon_share_rules(shares, goods))
    keys = goods.columns
    return goods.join(shares, keys, "left").select(
        *keys, F.coalesce("share", F.lit(0.0)).alias("share"))


def carbon_share_rules(shares: DataFrame, goods: DataFrame) -> DataFrame:
    keys = goods.columns
    item = F.concat_ws(":", *keys)
    return union_all([
        broken(shares.join(goods, keys, "left_anti"), "share_label", item),
        broken(shares.where(not_finite("share")), "share_not_finite", item),
        broken(shares.where(F.col("share") < 0), "share_negative", item),
    ])
