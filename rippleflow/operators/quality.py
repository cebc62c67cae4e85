"""Quality metrics of a build, as rows (name, severity, value, tolerance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleflow.functions.labels import is_rest_of_world
from rippleflow.operators.harmonise import total_by_label
from rippleflow.operators.leontief import quantity_links
from rippleflow.operators.macro import input_shares
from rippleflow.plans.fixpoint import spectral_radius
from rippleflow.plans.joins import union_all

NEGATIVE_SHARE_LIMIT = 0.02
REST_OF_WORLD_LIMIT = 0.35
COVERAGE_FLOOR = 0.5
NEGATIVE_INTENSITY_LIMIT = 0.01
DRIFT_LIMIT = 0.10
SEVERITY_RANK = {"pass": 0, "warn": 1, "fail": 2}


def check(df: DataFrame, name: str, ok, bad: str, value="value", tolerance=None) -> DataFrame:
    """One check row from a one-row frame."""
    return df.select(
        F.lit(name).alias("name"), F.when(ok, "pass").otherwise(bad).alias("severity"),
        F.col(value).cast("double").alias("value"),
        F.lit(tolerance).cast("double").alias("tolerance"))


def spectral_radius_check(coeff: DataFrame) -> DataFrame:
    """The spectral radius must stay under 1.

    The value is the upper bound, which is 0 for a table without loops. A table whose bounds can't be
    brought to one side of 1 is an error, not a failure.
    """
    bounds = spectral_radius(quantity_links(coeff)).select(F.col("hi").alias("value"))
    return check(bounds, "spectral_radius", F.col("value") < 1.0, "fail", tolerance=1.0)


def column_sum_check(coeff: DataFrame) -> DataFrame:
    agg = input_shares(coeff).agg(F.max("share").alias("value"),
                                  F.count_if(F.col("share") >= 1.0).alias("over"))
    return check(agg, "column_sums_lt_one", F.col("over") == 0, "warn", tolerance=1.0)


def negative_share_check(coeff: DataFrame, n_labels: DataFrame) -> DataFrame:
    """Negative cells over all label pairs; absent cells count as non-negative."""
    agg = coeff.agg(F.count_if(F.col("a") < 0).alias("neg")).join(n_labels).select(
        (F.col("neg") / (F.col("n").cast("double") * F.col("n"))).alias("value"))
    return check(agg, "negative_coefficient_share", F.col("value") < NEGATIVE_SHARE_LIMIT, "warn",
                 tolerance=NEGATIVE_SHARE_LIMIT)


def rest_of_world_check(final_demand: DataFrame) -> DataFrame:
    rest = F.sum(F.when(is_rest_of_world("region"), F.col("value")).otherwise(0.0))
    total = F.sum("value")
    agg = final_demand.agg(F.when(total > 0, rest / total).otherwise(0.0).alias("value"))
    return check(agg, "rest_of_world_share", F.col("value") < REST_OF_WORLD_LIMIT, "warn",
                 tolerance=REST_OF_WORLD_LIMIT)


def satellite_checks(satellite: DataFrame, n_labels: DataFrame, name: str = "GHG") -> DataFrame:
    """Share of labels with any intensity, and share of negative intensities."""
    covered = satellite.groupBy("region", "sector").agg(F.sum(F.abs("intensity")).alias("s"))
    share = covered.agg(F.count_if(F.col("s") > 0).alias("k")).join(n_labels).select(
        (F.col("k") / F.col("n")).alias("value"))
    cells = satellite.agg(F.count_if(F.col("intensity") < 0).alias("neg"),
                          F.count_distinct("stressor").alias("rows")).join(n_labels)
    negative = cells.select((F.col("neg") / (F.col("rows") * F.col("n"))).alias("value"))
    return union_all([
        check(share, f"satellite_coverage_{name}", F.col("value") > COVERAGE_FLOOR, "warn",
              tolerance=COVERAGE_FLOOR),
        check(negative, f"satellite_nonneg_{name}", F.col("value") < NEGATIVE_INTENSITY_LIMIT,
              "warn", tolerance=NEGATIVE_INTENSITY_LIMIT),
    ])


def plausibility_checks(output: DataFrame, final_demand: DataFrame) -> DataFrame:
    out = output.agg(F.count_if(F.col("x") <= 0).cast("double").alias("value"))
    fd = final_demand.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return union_all([
        check(out, "gross_output_positive", F.col("value") == 0, "warn"),
        check(fd, "final_demand_present", F.col("value") > 0, "fail"),
    ])


def quality_report(coeff: DataFrame, output: DataFrame, final_demand: DataFrame,
                   satellite: DataFrame, satellite_name: str = "GHG") -> DataFrame:
    """All checks of one build."""
    n = output.agg(F.count("*").alias("n"))
    rows = [
        spectral_radius_check(coeff), column_sum_check(coeff), negative_share_check(coeff, n),
        satellite_checks(satellite, n, satellite_name), plausibility_checks(output, final_demand),
    ]
    if not output.where(is_rest_of_world("region")).isEmpty():
        rows.append(rest_of_world_check(final_demand))
    return union_all(rows)


def drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Relative change of the numeric checks two builds share; zero or missing bases are skipped."""
    prev = previous.select("name", F.col("value").alias("p")).where("p IS NOT NULL AND p <> 0")
    rel = F.abs(F.col("value") - F.col("p")) / F.abs("p")
    return current.where("value IS NOT NULL").join(prev, "name").select(
        F.concat(F.lit("drift_"), F.col("name")).alias("name"),
        F.when(rel > DRIFT_LIMIT, "warn").otherwise("pass").alias("severity"),
        rel.alias("value"), F.lit(DRIFT_LIMIT).alias("tolerance"))


def severity_rank(col="severity"):
    return F.when(F.col(col) == "fail", 2).when(F.col(col) == "warn", 1).otherwise(0)


def roll_up(report: DataFrame) -> DataFrame:
    """Counts per severity, the worst one and whether the report passes."""
    agg = report.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK],
                     F.coalesce(F.max(severity_rank()), F.lit(0)).alias("rank"))
    return agg.select(
        "pass", "warn", "fail",
        F.when(F.col("rank") == 2, "fail").when(F.col("rank") == 1, "warn").otherwise("pass")
        .alias("worst"),
        (F.col("rank") < 2).alias("passed"))


def worst_first(report: DataFrame) -> DataFrame:
    return report.orderBy(severity_rank().desc(), "name")
