"""Weighted concordances and everything aggregated through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import base_code, checked, label, numeric_key, prefixes
from rippleflow.functions.hashing import map_hash
from rippleflow.operators.harmonise import (
    coefficients_to_flows, flows_to_coefficients,
)
from rippleflow.plans.joins import union_all
from rippleflow.session import cut_lineage, literal_table

SPLIT_MARK = " — "
SHARE_FLOOR = 1e-4
CONSERVATION_RTOL = 1e-4
MIN_MATERIALITY, MAX_MATERIALITY = 1e-6, 0.1


def normalise(df: DataFrame, keys, col: str = "weight") -> DataFrame:
    """Scale ``col`` to sum to 1 within ``keys``; groups without a positive total drop out.

    The totals are combined map-side and joined back, so no group is gathered in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = df.groupBy(*keys).agg(F.sum(col).alias("__total")).where("__total > 0")
    return df.join(total, keys).withColumn(col, F.col(col) / F.col("__total")).drop("__total")


# -- maps and bridges ----------------------------------------------------------------------------

def one_to_one(spark, mapping: dict[str, str]) -> DataFrame:
    """A concordance in which every source goes to one target with weight 1."""
    return literal_table(
        spark, [(s, t, 1.0) for s, t in mapping.items()], "source string, target string, weight double")


def one_to_one_from(df: DataFrame, source: str, target: str) -> DataFrame:
    return df.select(F.col(source).alias("source"), F.col(target).alias("target"),
                     F.lit(1.0).alias("weight")).distinct()


def orphans(concordance: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (column ``source``) the concordance does not map."""
    return labels.join(concordance, "source", "left_anti")


def bridge(concordance: DataFrame, labels: DataFrame) -> DataFrame:
    """The concordance restricted to the labels in use."""
    return concordance.join(labels, "source", "left_semi").select("target", "source", "weight")


def combined_bridge(goods: DataFrame, sector_map: DataFrame, region_map: DataFrame) -> DataFrame:
    """Weights from each (region, sector) to coarse (t_region, t_sector): product of the two maps.

    A label that a map leaves out is an error (``orphans`` lists them); leaving it out of the sums
    would lose its output.
    """
    s = sector_map.select(F.col("source").alias("sector"), F.col("target").alias("t_sector"),
                          F.col("weight").alias("ws"))
    r = region_map.select(F.col("source").alias("region"), F.col("target").alias("t_region"),
                          F.col("weight").alias("wr"))
    unmapped = F.col("ws").isNull() | F.col("wr").isNull()
    return goods.select("region", "sector").join(s, "sector", "left").join(
        r, "region", "left").select(
        "region", "sector", "t_region", "t_sector", checked(
            F.col("wr") * F.col("ws"), unmapped,
            F.concat(F.lit("label without a map: "), label())).alias("weight"))


# -- aggregation of a build ----------------------------------------------------------------------

def _rename(b: DataFrame, side: str) -> DataFrame:
    return b.select(
        F.col("region").alias(f"{side}_region"), F.col("sector").alias(f"{side}_sector"),
        F.col("t_region").alias(f"t_{side}_region"), F.col("t_sector").alias(f"t_{side}_sector"),
        F.col("weight").alias(f"w_{side}"))


def aggregate_output(output: DataFrame, b: DataFrame) -> DataFrame:
    return output.join(b, ["region", "sector"]).groupBy(
        F.col("t_region").alias("region"), F.col("t_sector").alias("sector")
    ).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))


def aggregate_flows(flows: DataFrame, b: DataFrame) -> DataFrame:
    """Flows through the bridge on both sides."""
    return (
        flows.join(_rename(b, "i"), ["i_region", "i_sector"])
        .join(_rename(b, "j"), ["j_region", "j_sector"])
        .groupBy(F.col("t_i_region").alias("i_region"), F.col("t_i_sector").alias("i_sector"),
                 F.col("t_j_region").alias("j_region"), F.col("t_j_sector").alias("j_sector"))
        .agg(F.sum(F.col("w_i") * F.col("w_j") * F.col("z")).alias("z"))
    )


def aggregate_coeff(coeff: DataFrame, output: DataFrame, b: DataFrame) -> DataFrame:
    """Coarse coefficients: recover flows, aggregate flows and output, divide again."""
    flows = aggregate_flows(coefficients_to_flows(coeff, output), b)
    return flows_to_coefficients(flows, aggregate_output(output, b))


def aggregate_demand(demand: DataFrame, b: DataFrame, region_map: DataFrame,
                     extra=()) -> DataFrame:
    """Final demand by producing and consuming region; ``extra`` keys (institution) stay."""
    r = region_map.select(F.col("source").alias("d_region"), F.col("target").alias("t_d_region"),
                          F.col("weight").alias("wd"))
    return demand.join(b, ["region", "sector"]).join(r, "d_region").groupBy(
        F.col("t_region").alias("region"), F.col("t_sector").alias("sector"),
        F.col("t_d_region").alias("d_region"), *extra,
    ).agg(F.sum(F.col("weight") * F.col("wd") * F.col("value")).alias("value"))


def aggregate_satellite(satellite: DataFrame, output: DataFrame, b: DataFrame) -> DataFrame:
    """Intensities through totals: times output, bridged, divided by coarse output."""
    totals = (
        satellite.join(output, ["region", "sector"]).join(b, ["region", "sector"])
        .groupBy("stressor", "unit", F.col("t_region").alias("region"),
                 F.col("t_sector").alias("sector"))
        .agg(F.sum(F.col("weight") * F.col("intensity") * F.col("x")).alias("total"))
    )
    return totals.join(aggregate_output(output, b), ["region", "sector"]).select(
        "stressor", "region", "sector",
        F.when(F.col("x") > 0, F.col("total") / F.col("x")).otherwise(0.0).alias("intensity"),
        "unit")


def conservation(fine_output: DataFrame, coarse_output: DataFrame, fine_demand: DataFrame,
                 coarse_demand: DataFrame, rtol: float = CONSERVATION_RTOL) -> DataFrame:
    """Quality rows: total output and total final demand survive the aggregation."""
    def total(df, col, name, side):
        return df.agg(F.sum(col).alias("v")).select(
            F.lit(name).alias("name"), F.lit(side).alias("side"), "v")

    rows = union_all([
        total(fine_output, "x", "aggregation_conserves_output", "fine"),
        total(coarse_output, "x", "aggregation_conserves_output", "coarse"),
        total(fine_demand, "value", "aggregation_conserves_final_demand", "fine"),
        total(coarse_demand, "value", "aggregation_conserves_final_demand", "coarse"),
    ]).groupBy("name").agg(
        F.max(F.when(F.col("side") == "fine", F.col("v"))).alias("fine"),
        F.max(F.when(F.col("side") == "coarse", F.col("v"))).alias("coarse"))
    gap = F.abs(F.col("fine") - F.col("coarse"))
    return rows.select(
        "name",
        F.when(gap <= 1e-8 + rtol * F.abs("coarse"), "pass").otherwise("fail").alias("severity"),
        F.when(F.col("fine") != 0, gap / F.abs("fine")).otherwise(0.0).alias("value"),
        F.lit(rtol).alias("tolerance"))


# -- crosswalks to rated processes ---------------------------------------------------------------

def resolve_crosswalk(crosswalk: DataFrame, processes: DataFrame) -> DataFrame:
    """Crosswalk rows (sector, code, class_name) with the rated process they resolve to.

    The class name of a split process wins; otherwise the longest prefix of the code that is rated
    on its own. Unresolved rows keep a null process.
    """
    rows = crosswalk.select(
        F.trim("sector").alias("sector"), F.trim("code").alias("code"),
        F.lower(F.trim("class_name")).alias("name_key")).distinct()
    is_split = F.col("process").contains(SPLIT_MARK)
    by_name = processes.where(is_split).select(
        F.lower(F.trim(F.split("process", SPLIT_MARK, 2)[1])).alias("name_key"),
        F.col("process").alias("named"))
    by_code = processes.where(~is_split).select(
        F.trim("process").alias("prefix"), F.trim("process").alias("coded"))
    tried = rows.select("*", F.explode_outer(prefixes(F.col("code"), "_")).alias("p")).select(
        "sector", "code", "name_key", F.col("p.prefix").alias("prefix"),
        F.col("p.depth").alias("depth"))
    best = (
        tried.join(by_code, "prefix", "left").groupBy("sector", "code", "name_key")
        .agg(F.max_by("coded", F.when(F.col("coded").isNotNull(), F.col("depth"))).alias("coded"))
    )
    return best.join(by_name, "name_key", "left").select(
        "sector", "code", F.coalesce("named", "coded").alias("process"))


def equal_weight_concordance(resolved: DataFrame) -> DataFrame:
    """Sector to its distinct processes, each with the same weight."""
    pairs = resolved.where("process IS NOT NULL").select(
        F.col("sector").alias("source"), F.col("process").alias("target")).distinct()
    return normalise(pairs.withColumn("weight", F.lit(1.0)), "source")


def crosswalk_audit(resolved: DataFrame) -> DataFrame:
    """Audit rows (kind, item, detail): several processes, nothing resolved, coarser level used."""
    known = resolved.where("process IS NOT NULL").select("sector", "process").distinct()
    several = known.groupBy("sector").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("process")), ",").alias("detail")
    ).where("n > 1").select(F.lit("multi_process").alias("kind"), F.col("sector").alias("item"),
                            "detail")
    none = resolved.select("sector").distinct().join(known, "sector", "left_anti").select(
        F.lit("unresolved").alias("kind"), F.col("sector").alias("item"), F.lit("").alias("detail"))
    rolled = resolved.where("process IS NOT NULL AND process <> code").select("code", "process") \
        .distinct().groupBy("code").agg(
            F.array_join(F.sort_array(F.collect_set("process")), ",").alias("detail")) \
        .select(F.lit("rollback").alias("kind"), F.col("code").alias("item"), "detail")
    return union_all([several, none, rolled])


def product_industries(products: DataFrame, industries: DataFrame) -> DataFrame:
    """Candidate industries of each product: same code, else the longest shared numeric prefix.

    Both inputs are (name, code).
    """
    p = products.select(F.trim("name").alias("product"), base_code(F.col("code")).alias("base"),
                        numeric_key(F.col("code")).alias("num"))
    i = industries.select(F.trim("name").alias("industry"), base_code(F.col("code")).alias("base"),
                          numeric_key(F.col("code")).alias("num"))
    exact = p.join(i.select("base", "industry"), "base").select("product", "industry")
    tried = p.join(exact, "product", "left_anti").select(
        "product", F.explode(prefixes(F.col("num"), ".")).alias("q")).select(
        "product", F.col("q.prefix").alias("num"), F.col("q.depth").alias("depth"))
    hits = tried.join(i.select("num", "industry"), "num")
    deepest = hits.groupBy("product").agg(F.max("depth").alias("depth"))
    rolled = hits.join(deepest, ["product", "depth"]).select("product", "industry")
    return exact.unionByName(rolled)


def sibling_fill(concordance: DataFrame, industries: DataFrame) -> DataFrame:
    """Weights for industries the concordance misses: the mean of covered industries with its key."""
    keyed = industries.select(F.trim("name").alias("source"),
                              numeric_key(F.col("code")).alias("num"))
    gaps = keyed.join(concordance, "source", "left_anti").select(
        F.col("source").alias("gap"), "num")
    siblings = keyed.join(concordance, "source").select("num", "target", "weight")
    by_key = siblings.groupBy("num", "target").agg(F.sum("weight").alias("weight"))
    return normalise(
        gaps.join(by_key, "num").select(F.col("gap").alias("source"), "target", "weight"), "source")


def complete_concordance(concordance: DataFrame, industries: DataFrame) -> DataFrame:
    return concordance.select("source", "target", "weight").unionByName(
        sibling_fill(concordance, industries))


def fill_audit(concordance: DataFrame, industries: DataFrame) -> DataFrame:
    """(source, siblings): which covered industries each filled one was averaged from."""
    keyed = industries.select(F.trim("name").alias("source"),
                              numeric_key(F.col("code")).alias("num"))
    gaps = keyed.join(concordance, "source", "left_anti")
    covered = keyed.join(concordance, "source", "left_semi").select(
        F.col("source").alias("sibling"), "num")
    return gaps.join(covered, "num").groupBy("source").agg(
        F.array_join(F.sort_array(F.collect_set("sibling")), ",").alias("siblings"))


def product_weights(concordance: DataFrame, candidates: DataFrame,
                    supply_shares: DataFrame | None) -> DataFrame:
    """Industry weights per product with the method and the reason for a fallback.

    Observed supply shares over covered industries come first; otherwise the covered candidates
    share equally.
    """
    covered = concordance.select(F.col("source").alias("industry")).distinct()
    products = candidates.select("product").distinct()
    equal = cut_lineage(normalise(
        candidates.join(covered, "industry", "left_semi").withColumn("weight", F.lit(1.0)),
        "product"))
    if supply_shares is None:
        return equal.select(
            "product", "industry", "weight", F.lit("code-prefix-fallback").alias("method"),
            F.lit("no supply shares loaded").alias("reason"))
    seen = supply_shares.join(products, "product", "left_semi")
    observed = cut_lineage(
        normalise(seen.join(covered, "industry", "left_semi"), "product"))
    fallback = (
        equal.join(observed, "product", "left_anti")
        .join(seen.select("product", F.lit(True).alias("has_supply")).distinct(), "product", "left")
    )
    return observed.select(
        "product", "industry", "weight", F.lit("supply-share").alias("method"),
        F.lit("").alias("reason"),
    ).unionByName(fallback.select(
        "product", "industry", "weight", F.lit("code-prefix-fallback").alias("method"),
        F.when(F.col("has_supply"), "supplying industries are uncovered")
        .otherwise("product has no market supply").alias("reason")))


def bridge_to_products(concordance: DataFrame, weights: DataFrame) -> DataFrame:
    """Process weights per product: the weighted mean of its industries' weights."""
    mixed = weights.select("product", F.col("industry").alias("source"),
                           F.col("weight").alias("share")).join(concordance, "source")
    return normalise(mixed.groupBy(F.col("product").alias("source"), "target").agg(
        F.sum(F.col("share") * F.col("weight")).alias("weight")), "source")


def uncovered_products(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    return candidates.select("product").distinct().join(weights, "product", "left_anti")


def bridge_method_counts(weights: DataFrame) -> DataFrame:
    """Number of products per weighting method."""
    return weights.select("product", "method").distinct().groupBy("method").agg(
        F.count("*").alias("n_products"))


def compose_concordance(fine: DataFrame, groups: DataFrame) -> DataFrame:
    """Concordance of coarse groups: members count equally, covered members only.

    ``groups`` is (source, grp).
    """
    return normalise(fine.join(groups, "source").groupBy(F.col("grp").alias("source"), "target")
                     .agg(F.sum("weight").alias("weight")), "source")


def omitted_members(fine: DataFrame, groups: DataFrame) -> DataFrame:
    """Group members the fine concordance does not cover (fatal under a completeness policy)."""
    return groups.join(fine, "source", "left_anti").select("grp", "source")


def supply_shares(supply: DataFrame, floor: float = SHARE_FLOOR) -> DataFrame:
    """Production shares per product from ``supply(product, industry, v)`` over all regions.

    Shares below ``floor`` are dropped and the rest renormalised.
    """
    v = supply.groupBy("product", "industry").agg(F.sum("v").alias("weight"))
    return normalise(normalise(v, "product").where(F.col("weight") >= floor), "product")


def zero_supply_products(supply: DataFrame) -> DataFrame:
    return supply.groupBy("product").agg(F.sum("v").alias("v")).where("v <= 0").select("product")


def coarse_build_ids(builds: DataFrame, concordance_id: str, sector_map: DataFrame,
                     region_map: DataFrame) -> DataFrame:
    """(build_id, coarse_id): ids of aggregated builds, named by the content of both maps.

    A changed map gives another id, so it never overwrites the build of the map before.
    """
    maps = union_all([m.select(F.lit(kind).alias("kind"), "source", "target",
                               F.format_number(F.col("weight"), 10).alias("w"))
                      for kind, m in (("sector", sector_map), ("region", region_map))])
    digest = map_hash(maps, ["kind", "source", "target", "w"], length=8)
    return builds.select("build_id").join(digest).select("build_id", F.concat_ws(
        "-", "build_id", F.lit(concordance_id), "content_hash").alias("coarse_id"))


# -- bilateral trade -----------------------------------------------------------------------------

def trade_by_route(flows: DataFrame, final_demand: DataFrame) -> DataFrame:
    """Trade per (origin, dest, sector) between different regions, intermediate plus final."""
    rows = flows.select(F.col("i_region").alias("origin"), F.col("j_region").alias("dest"),
                        F.col("i_sector").alias("sector"), F.col("z").alias("value")).unionByName(
        final_demand.select(F.col("region").alias("origin"), F.col("d_region").alias("dest"),
                            "sector", "value"))
    return rows.where("origin <> dest").groupBy("origin", "dest", "sector").agg(
        F.sum("value").alias("value")).where("value <> 0")


def fold_dust(flows: DataFrame, final_demand: DataFrame, regions: DataFrame,
              materiality: float = MIN_MATERIALITY) -> DataFrame:
    """(region, grp): regions merged until no route between groups is positive but too small.

    Each round relabels the (region-sized) route table, finds group pairs with a route under the
    threshold and merges the pair with the most trade; ties break by name. One row per round
    reaches the driver.
    """
    if not MIN_MATERIALITY <= materiality < MAX_MATERIALITY:
        raise ValueError(
            f"materiality must be in [{MIN_MATERIALITY:g}, {MAX_MATERIALITY:g}), got {materiality}")
    spark = flows.sparkSession
    routes = trade_by_route(flows, final_demand).persist()
    total = final_demand.agg(F.sum("value").alias("v")).first()["v"] or 0.0
    threshold = materiality * max(total, 1.0)
    group = {r["region"]: r["region"] for r in regions.select("region").distinct().collect()}
    for _ in range(len(group)):
        mapping = literal_table(spark, list(group.items()), "region string, grp string")
        merged = (
            routes.join(mapping.select(F.col("region").alias("origin"), F.col("grp").alias("go")),
                        "origin")
            .join(mapping.select(F.col("region").alias("dest"), F.col("grp").alias("gd")), "dest")
            .where("go <> gd").groupBy("go", "gd", "sector").agg(F.sum("value").alias("value"))
        )
        pair = (
            merged.groupBy("go", "gd").agg(
                F.sum("value").alias("trade"),
                F.max((F.col("value") > 0) & (F.col("value") < threshold)).alias("dusty"))
            .where("dusty").orderBy(F.desc("trade"), "go", "gd").limit(1).collect()
        )
        if not pair:
            break
        go, gd = pair[0]["go"], pair[0]["gd"]
        group = {r: (gd if g == go else g) for r, g in group.items()}
    routes.unpersist()
    members: dict[str, list[str]] = {}
    for r, g in group.items():
        members.setdefault(g, []).append(r)
    if len(members) < 2:
        raise ValueError("folding leaves a single region: no material trade between regions")
    rows = [(r, "+".join(sorted(m))) for m in members.values() for r in m]
    return literal_table(spark, rows, "region string, grp string")


