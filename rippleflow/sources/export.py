"""Writers: results, slices, concordances, supply shares and bridge audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleflow.operators.concord import bridge_method_counts
from rippleflow.operators.views import frame_slice


def write_results(results: DataFrame, manifest: DataFrame, path: str) -> None:
    """Results as Parquet with their manifest: a side table and metadata on the value column."""
    first = manifest.select("run_id").first()
    tagged = results.withColumn("value", F.col("value").alias(
        "value", metadata={"run_id": first["run_id"] if first else ""}))
    tagged.write.mode("overwrite").parquet(f"{path}/results")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/manifest")


def write_results_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def write_manifest_json(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_slice_csv(cells: DataFrame, path: str, row_query: str = "", col_query: str = "") -> None:
    """A label-filtered slice of a frame as CSV."""
    frame_slice(cells, row_query, col_query).write.mode("overwrite").option(
        "header", True).csv(path)


def concordance_documents(concordance: DataFrame) -> DataFrame:
    """One document per source: {source, weights: {target: weight}} (targets of one source only)."""
    return concordance.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("target", "weight")))).alias("weights"))


def write_concordance(concordance: DataFrame, path: str) -> None:
    concordance_documents(concordance).write.mode("overwrite").json(path)


def read_concordance(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("source string, weights map<string,double>").json(path)
    return raw.select("source", F.explode("weights").alias("target", "weight"))


def write_supply_shares(shares: DataFrame, zero_products: DataFrame, path: str, *, year: int,
                        version: str, source_version: str) -> None:
    """Supply shares as one JSON document (product- and industry-sized) with its provenance."""
    per_product = shares.groupBy("product").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("industry", "weight")))).alias("w"))
    body = per_product.agg(F.map_from_entries(F.collect_list(
        F.struct("product", "w"))).alias("shares"))
    none = zero_products.agg(F.sort_array(F.collect_list("product")).alias("zero"))
    body.join(none).select(
        F.struct(F.lit(year).alias("sut_year"), F.lit(version).alias("sut_version"),
                 F.lit(source_version).alias("source_version"),
                 F.col("zero").alias("zero_supply_products")).alias("provenance"),
        "shares").coalesce(1).write.mode("overwrite").json(path)


def write_bridge_audit(weights: DataFrame, path: str) -> None:
    """Reviewable audit: per product its method, reason and rounded industry weights, plus counts."""
    entries = weights.groupBy("product", "method", "reason").agg(F.array_sort(F.collect_list(
        F.struct("industry", F.round("weight", 6).alias("weight")))).alias("industry_weights"))
    entries.write.mode("overwrite").json(f"{path}/entries")
    bridge_method_counts(weights).write.mode("overwrite").json(f"{path}/summary")
