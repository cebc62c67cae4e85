"""Ecosystem-service dependencies: scores, exposure through the supply chain, stress, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import checked, label, split_label
from rippleflow.functions.paths import state_at
from rippleflow.operators.leontief import covered_goods, price_links, shock_levels
from rippleflow.plans.fixpoint import iterate
from rippleflow.plans.graphs import spread
from rippleflow.plans.joins import union_all

# Numeric scale of the materiality classes.
MATERIALITY_SCALE = {"VH": 1.0, "H": 0.8, "M": 0.6, "L": 0.4, "VL": 0.2}
NO_DATA = "ND"
NOT_APPLICABLE = ("N/A", "NA", "NAN", "")
BOUND_TOLERANCE = 1e-9
MIN_LOSS = 1e-9
# Which incidence suits a model (one that propagates by itself takes direct).
INCIDENCE_BY_MODEL = {"equilibrium": "direct", "price": "direct", "volume": "total"}
DEFAULT_INCIDENCE = "total"
# A combined water service and the services it already contains.
COMBINED_WATER = "water supply"
WATER_PARTS = ("water purification", "water flow regulation")


def materiality_score(cls, scale: dict[str, float] | None = None):
    """Score of a rated class; null for no-data and unknown tokens."""
    scale = scale or MATERIALITY_SCALE
    table = F.create_map(*[F.lit(v) for kv in scale.items() for v in kv])
    return F.try_element_at(table, F.upper(F.trim(cls)))


def is_no_data(cls):
    return F.upper(F.trim(cls)) == NO_DATA


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Upper-case classes; not-applicable and blank cells drop out, no-data cells stay."""
    m = F.upper(F.trim(F.coalesce("materiality", F.lit(""))))
    return ratings.withColumn("materiality", m).where(~F.col("materiality").isin(*NOT_APPLICABLE))


def score_matrix(ratings: DataFrame) -> DataFrame:
    """Dense process x service scores: absent pairs and no-data cells score 0."""
    grid = ratings.select("process").distinct().join(ratings.select("service").distinct())
    rated = ratings.select(
        "process", "service", F.coalesce(materiality_score(F.col("materiality")), F.lit(0.0))
        .alias("score"), is_no_data(F.col("materiality")).alias("no_data"))
    return union_all([
        grid.select("process", "service", F.lit(0.0).alias("score"), F.lit(False).alias("no_data")),
        rated,
    ]).groupBy("process", "service").agg(
        F.max("score").alias("score"), F.max("no_data").alias("no_data"))


def data_coverage(ratings: DataFrame) -> DataFrame:
    """Share of rated cells that hold data, 1 when there are none."""
    return ratings.agg(F.coalesce(
        F.avg(F.when(is_no_data(F.col("materiality")), 0.0).otherwise(1.0)), F.lit(1.0)
    ).alias("coverage"))


def sector_scores(ratings: DataFrame, concordance: DataFrame) -> DataFrame:
    """Weighted score and weighted no-data share per (sector, service).

    ``concordance`` maps a sector (source) to processes (target). Only rated cells are touched:
    an absent cell adds 0 to either sum, so sectors without any rated service are absent. A process
    without ratings is an error (``unknown_processes`` lists them).
    """
    rated = ratings.select("process").distinct().withColumn("rated", F.lit(True))
    w = concordance.select(F.col("source").alias("sector"), F.col("target").alias("process"),
                           "weight")
    w = w.join(rated, "process", "left").withColumn("weight", checked(
        F.col("weight"), F.col("rated").isNull(),
        F.concat(F.lit("process without ratings: "), F.col("process")))).drop("rated")
    total = w.groupBy("sector").agg(F.sum("weight").alias("total")).where("total > 0")
    hit = w.join(ratings, "process").groupBy("sector", "service").agg(
        F.sum(F.col("weight") * F.coalesce(
            materiality_score(F.col("materiality")), F.lit(0.0))).alias("score"),
        F.sum(F.when(is_no_data(F.col("materiality")), F.col("weight")).otherwise(0.0))
        .alias("nd"))
    return hit.join(total, "sector").select(
        "sector", "service", "score", (F.col("nd") / F.col("total")).alias("nd_share"))


def unrated_sectors(sectors: DataFrame, concordance: DataFrame) -> DataFrame:
    return sectors.select("sector").distinct().join(
        concordance.select(F.col("source").alias("sector")), "sector", "left_anti")


def unknown_processes(concordance: DataFrame, ratings: DataFrame) -> DataFrame:
    return concordance.select(F.col("target").alias("process")).distinct().join(
        ratings, "process", "left_anti")


def nd_mask(scores: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Cells whose no-data share reaches the threshold."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be in [0, 1], got {threshold!r}")
    return scores.where(F.col("nd_share") >= threshold - 1e-12).select("sector", "service")


def goods_scores(scores: DataFrame, goods: DataFrame) -> DataFrame:
    """Every region's good gets its sector's score; goods of unrated sectors get 0."""
    services = scores.select("service").distinct()
    zero = goods.select("region", "sector").join(services).withColumn("score", F.lit(0.0))
    known = goods.select("region", "sector").join(scores, "sector").select(
        "region", "sector", "service", "score")
    return zero.unionByName(known).groupBy("region", "sector", "service").agg(
        F.sum("score").alias("score"))


def exposure_violations(coeff: DataFrame, direct: DataFrame) -> DataFrame:
    """Inputs the propagation must not see: bad coefficients, bad scores, input shares >= 1."""
    bad_a = coeff.where(F.isnan("a") | F.col("a").isNull() | (F.col("a") < 0)
                        | (F.col("a") == float("inf"))).select(
        F.lit("coefficient").alias("rule"), label("j_region", "j_sector").alias("item"))
    s = F.col("score")
    bad_d = direct.where(s.isNull() | F.isnan(s) | (s < -BOUND_TOLERANCE)
                         | (s > 1 + BOUND_TOLERANCE)).select(
        F.lit("score").alias("rule"), label().alias("item"))
    bad_c = coeff.groupBy("j_region", "j_sector").agg(F.sum("a").alias("s")).where("s >= 1").select(
        F.lit("input_share").alias("rule"), label("j_region", "j_sector").alias("item"))
    return union_all([bad_a, bad_d, bad_c])


def exposure_weighted(coeff: DataFrame, direct: DataFrame, tol: float = 1e-13) -> DataFrame:
    """Exposure raised by the input-weighted exposure of suppliers, scaled by the headroom.

    E = D + (1 - D) * sum_i a_ij E_i, all services in one pass (the headroom is the damping).
    """
    d = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    seed = direct.select("service", label().alias("label"), d.alias("value"),
                         (1.0 - d).alias("headroom"))
    solved = iterate(price_links(coeff), seed, ["service"], damp="headroom", tol=tol)
    return split_label(solved).select(
        "region", "sector", "service",
        F.least(F.greatest("value", F.lit(0.0)), F.lit(1.0)).alias("exposure"))


def exposure_max(coeff: DataFrame, direct: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Exposure of the most exposed supplier reachable over links above ``threshold``."""
    if not (threshold >= 0.0 and threshold != float("inf")):
        raise ValueError(f"threshold must be finite and >= 0, got {threshold!r}")
    links = price_links(coeff.where(F.col("a") > threshold))
    seed = direct.select("service", label().alias("label"),
                         F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("value"))
    solved = spread(links, seed, ["service"], how="max")
    return split_label(solved).select(
        "region", "sector", "service", F.col("value").alias("exposure"))


def direct_exposure(direct: DataFrame) -> DataFrame:
    """Own scores only, for models that propagate by themselves."""
    return direct.select("region", "sector", "service", F.col("score").alias("exposure"))


def exposure_parts(direct: DataFrame, total: DataFrame) -> DataFrame:
    """Direct, total and upstream exposure side by side."""
    return direct.join(total, ["region", "sector", "service"]).select(
        "region", "sector", "service", F.col("score").alias("direct"),
        F.col("exposure").alias("total"), (F.col("exposure") - F.col("score")).alias("upstream"))


def stress_effects(stresses: DataFrame, years: DataFrame, exposure: DataFrame) -> DataFrame:
    """Surviving share of every stressed good per scenario and year: product over services."""
    goods = exposure.select("region", "sector").distinct()
    hit = shock_levels(covered_goods(
        stresses.where("type = 'nature_stress'").select(
            "scenario_id", "shock_id", "level", "path", "service", "sectors", "regions"), goods),
        years)
    return hit.join(exposure, ["region", "sector", "service"]).groupBy(
        "scenario_id", "year", "region", "sector"
    ).agg((F.product(1.0 - F.col("level") * F.col("exposure")) - 1.0).alias("delta"))


def stress_productivity(stresses: DataFrame, years: DataFrame, exposure: DataFrame,
                        min_loss: float = MIN_LOSS) -> DataFrame:
    """Productivity change per good and year; goods that never lose anything drop out."""
    delta = stress_effects(stresses, years, exposure)
    keep = delta.groupBy("scenario_id", "region", "sector").agg(
        F.max(-F.col("delta")).alias("loss")).where(F.col("loss") >= min_loss)
    return delta.join(keep, ["scenario_id", "region", "sector"], "left_semi")


def stress_collapsed(stresses: DataFrame, years: DataFrame, exposure: DataFrame,
                     min_loss: float = MIN_LOSS) -> DataFrame:
    """One change per sector: the mean over all its regions, unstressed ones included as 0."""
    delta = stress_effects(stresses, years, exposure)
    size = exposure.select("region", "sector").distinct().groupBy("sector").agg(
        F.count("*").alias("n"))
    mean = delta.groupBy("scenario_id", "year", "sector").agg(F.sum("delta").alias("s")).join(
        size, "sector").select(
        "scenario_id", "year", "sector", (F.col("s") / F.col("n")).alias("delta"))
    keep = mean.groupBy("scenario_id", "sector").agg(F.max(-F.col("delta")).alias("loss")).where(
        F.col("loss") >= min_loss)
    return mean.join(keep, ["scenario_id", "sector"], "left_semi")


def productivity_shocks(delta: DataFrame) -> DataFrame:
    """Per-good productivity shocks with a year path, in the shock layout."""
    per_good = delta.groupBy("scenario_id", "region", "sector").agg(
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("year").cast("int"), F.col("delta"))))).alias("path"))
    return per_good.select(
        "scenario_id", F.concat_ws(":", F.lit("nature"), "region", "sector").alias("shock_id"),
        F.lit("productivity").alias("type"),
        F.element_at(F.map_values("path"), 1).alias("level"),
        F.lit(None).cast("array<string>").alias("gases"),
        F.lit(None).cast("string").alias("carrier"), F.lit(None).cast("string").alias("service"),
        F.array("sector").alias("sectors"), F.array("region").alias("regions"), "path")


# -- physical states -----------------------------------------------------------------------------

def state_path(pathways: DataFrame, years: DataFrame) -> DataFrame:
    """Effective state per pathway and year, recovery lag applied.

    ``years`` shares the key columns of ``pathways`` (scenario_id). The years of one scenario are
    folded in order inside the row: falls act at once, rises are capped per year elapsed.
    """
    per = years.groupBy("scenario_id").agg(
        F.array_sort(F.collect_set(F.col("year").cast("int"))).alias("years"))
    base = pathways.join(per, "scenario_id")
    start = F.coalesce("start_year", F.element_at("years", 1))

    def raw(y):
        by_rate = F.greatest(
            F.lit(0.0),
            F.col("baseline") - F.col("degradation_rate") * F.greatest(F.lit(0), y - start))
        return F.when(F.col("states").isNotNull(),
                      state_at(F.col("states"), y, F.col("baseline"))).otherwise(by_rate)

    points = F.transform("years", lambda y: F.struct(y.alias("year"), raw(y).alias("state")))

    def follow(done, p):
        last = F.element_at(done, -1)
        cap = last["state"] + F.col("recovery_rate") * F.greatest(F.lit(1), p["year"] - last["year"])
        state = F.when(p["state"] >= last["state"], F.least(p["state"], cap)).otherwise(p["state"])
        return F.when(F.size(done) <= 0, F.array(p)).otherwise(F.concat(
            done, F.array(F.struct(p["year"].alias("year"), state.alias("state")))))

    lagged = F.aggregate("points", F.slice(F.col("points"), 1, 0), follow)
    out = base.withColumn("points", points).withColumn(
        "effective", F.when(F.col("recovery_rate").isNull(), F.col("points")).otherwise(lagged))
    return out.select("scenario_id", "channel_id", F.explode("effective").alias("e")).select(
        "scenario_id", "channel_id", F.col("e.year").alias("year"), F.col("e.state").alias("state"))


def severity(state, baseline, sensitivity, threshold, exponent):
    """Severity of a state: linear in the shortfall, with an optional convex part below a threshold."""
    shortfall = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (baseline - state) / baseline))
    linear = sensitivity * shortfall
    share = F.greatest(F.lit(0.0), state / baseline)
    depth = (threshold - share) / threshold
    bent = linear + (1.0 - linear) * F.pow(depth, exponent)
    raw = F.when(threshold.isNotNull() & (share < threshold), bent).otherwise(linear)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def severity_path(channels: DataFrame, states: DataFrame) -> DataFrame:
    """Severity per channel and year."""
    c = channels.select("channel_id", "baseline", "sensitivity", "threshold", "exponent")
    return states.join(c, "channel_id").select(
        "scenario_id", "channel_id", "year", "state",
        severity(F.col("state"), F.col("baseline"), F.col("sensitivity"), F.col("threshold"),
                 F.col("exponent")).alias("severity"))


def unmatched_pathways(channels: DataFrame, pathways: DataFrame) -> DataFrame:
    return pathways.join(channels, "channel_id", "left_anti").select("channel_id").distinct()


def stresses_from_states(channels: DataFrame, severities: DataFrame,
                         coverage: DataFrame | None = None) -> DataFrame:
    """One stress per service of every channel that degrades, in the shock layout.

    The level is the peak of the path. ``coverage`` (scenario_id, channel_id, sectors, regions)
    narrows where the stress applies.
    """
    per = severities.groupBy("scenario_id", "channel_id").agg(
        F.max("severity").alias("level"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col("year").cast("int"), F.col("severity"))))).alias("path"),
    ).where(F.col("level") > 1e-12)
    nothing = F.array().cast("array<string>")
    if coverage is None:
        per = per.withColumn("sectors", nothing).withColumn("regions", nothing)
    else:
        per = per.join(coverage, ["scenario_id", "channel_id"], "left").withColumn(
            "sectors", F.coalesce("sectors", nothing)).withColumn(
            "regions", F.coalesce("regions", nothing))
    return per.join(channels.select("channel_id", F.explode("services").alias("service")),
                    "channel_id").select(
        "scenario_id", F.concat_ws(":", "channel_id", "service").alias("shock_id"),
        F.lit("nature_stress").alias("type"), "level",
        F.lit(None).cast("array<string>").alias("gases"),
        F.lit(None).cast("string").alias("carrier"), "service", "sectors", "regions", "path")


def nature_stamp(scores: DataFrame, stresses: DataFrame) -> DataFrame:
    """No-data record of the stressed services: partial shares and fully unknown sectors."""
    asked = stresses.where("type = 'nature_stress'").select("service").distinct()
    return scores.join(asked, "service", "left_semi").where(F.col("nd_share") > 1e-9).select(
        "service", "sector", F.round("nd_share", 4).alias("nd_share"),
        (F.col("nd_share") >= 1 - 1e-9).alias("fully_unknown"))


def shock_coverage(delta: DataFrame) -> DataFrame:
    """Goods the derived productivity shocks touch."""
    return delta.select("scenario_id", label().alias("good")).distinct()
