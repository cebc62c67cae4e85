"""Mixing sources to target weights by Poisson replication.

Every source has a mean repetition rate: its share of the output, times the size of the output,
over its own size. A document's number of copies is the Poisson quantile of a seeded hash of its
id, so it is a function of the document and the rate alone. The copies are scattered and sorted by
a second hash, which is a global shuffle.

Defined cases: a missing source is a source of its own; a missing text has size 1 (sizes are UTF-8
bytes plus 1); rows with equal ids and equal texts get equal counts, each for itself; a row without
id is hashed by its text; sources of weight 0 vanish; an empty table gives an empty result. Result
columns (``source_key``, ``rate``, ``copies``, ``copy``, ``shuffle_key``) replace input columns of
the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleflow.llm.common import join_sized, null_safe_key, staged, unit_hash

#: One draw covers a rate up to this; a larger rate is a sum of independent draws.
RATE_PER_DRAW = 16.0
#: Beyond so many terms the tail of a rate of 16 is below 1e-30.
TERMS = 80


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float,
                 epochs: float) -> DataFrame:
    """Per source: the mean repetition rate. One row per source, from one pass over the texts."""
    sizes = staged(docs.groupBy(null_safe_key(F.col("source")).alias("source_key")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")), "source-sizes")
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source_key") == "=" + name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sizes.join(F.broadcast(total)).select(
        "source_key",
        F.when(F.col("all_weight") > 0,
               F.col("weight") / F.col("all_weight") * F.lit(float(epochs)) * F.col("all_size")
               / F.col("size")).otherwise(F.lit(0.0)).alias("rate"))


def distribution(rate: Column) -> Column:
    """The first terms of the distribution function of a Poisson variable of mean ``rate``."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(
            F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["c"])


def replicate(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0,
              epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Documents once per copy, in a global random order of partitions and rows."""
    rates = source_rates(docs, weights, default_weight, epochs).withColumn(
        "draws", F.greatest(F.ceil(F.col("rate") / RATE_PER_DRAW), F.lit(1)).cast("int")
    ).withColumn("cdf", distribution(F.col("rate") / F.col("draws")))
    identity = F.coalesce(F.col("doc_id").cast("string"),
                          F.concat(F.lit("#"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))

    def draw(total: Column, j: Column) -> Column:
        u = unit_hash(F.lit(seed), identity, j)
        return total + F.size(F.filter(F.col("cdf"), lambda c: c <= u))

    own = ["rate", "draws", "cdf", "copies", "copy", "shuffle_key"]
    counted = join_sized(docs.drop(*own).withColumn("source_key", null_safe_key(F.col("source"))),
                         rates, "source_key")
    counted = counted.withColumn("copies", F.aggregate(
        F.sequence(F.lit(0), F.col("draws") - 1), F.lit(0), draw)).drop("draws", "cdf")
    copies = counted.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copies.withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(
        "|", F.lit(seed), identity, F.lit("order"), F.col("copy").cast("string"))
        .cast("binary")), 1, 16))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key", "copy")
