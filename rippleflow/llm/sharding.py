"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash.
Pass two brings each bucket into a fixed order, shuffles it with a seeded Fisher-Yates shuffle and
writes it. Buckets one after another are a uniformly random order of all records; shards are equal
cuts of that order, so their row counts differ by one at most (law ``rows``).

The bucket of a record hashes its id and its text, so rows without id and repeated ids spread too;
only rows that are equal in both meet, and those that are equal in all columns are interchangeable.
A bucket is shuffled slice by slice when its rows outgrow the memory bound, which happens only if
equal rows pile up.

Defined cases: a missing text has size 1; an empty table gives an empty result; result columns
(``size``, ``shard``, ``slot``) replace input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rippleflow.llm.common import BROADCAST_ROWS, arrow_schema, shared_path, staged

BUCKET_BYTES = 32 << 20
#: A bucket beyond this many bytes in a task is shuffled in slices of this size.
SLICE_BYTES = 4 * BUCKET_BYTES


def fisher_yates(rows: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly random order of ``rows`` places."""
    order = np.arange(rows)
    # swap place i with one of the places 0 .. i, from the last to the first
    picks = rng.integers(0, np.arange(rows, 0, -1)) if rows else order
    for i, pick in zip(range(rows - 1, 0, -1), picks.tolist()):
        order[i], order[pick] = order[pick], order[i]
    return order


def external_shuffle(docs: DataFrame, shards: int, seed: int = 23,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All documents with ``size``, ``shard`` and ``slot``; rows lie in slot order per bucket."""
    own = ("size", "shard", "slot", "__bucket", "__rank")
    columns = [c for c in docs.columns if c.lower() not in own]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = rows.withColumn("__bucket", F.pmod(
        F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)).cast("int"))
    per_bucket = scattered.groupBy("__bucket").agg(F.count("*").alias("__rows"))
    # one short row per bucket, so this window holds total size / bucket size rows
    places = per_bucket.withColumn("__first", F.sum("__rows").over(
        Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    places = staged(places.select("__bucket", F.coalesce("__first", F.lit(0)).alias("__first")),
                    "shard-places")
    count = docs.count()
    if buckets <= BROADCAST_ROWS:
        places = F.broadcast(places)

    # the sort makes the order before the shuffle a function of the rows
    # each bucket is a partition of its own, where hashing the number would make some of them meet
    dealt = scattered.repartitionById(buckets, F.col("__bucket")).sortWithinPartitions(
        "__bucket", "doc_id", F.xxhash64(*[F.col(f"`{c}`") for c in columns if _hashable(docs, c)]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scattered.schema.fields)
    schema += ", __rank long"
    layout = arrow_schema(schema)

    def shuffled(held: list[pa.RecordBatch], bucket: int, start: int):
        table = pa.Table.from_batches(held)
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, bucket, start]))
        step = max(1, 16 * (1 << 20) * table.num_rows // max(1, table.nbytes))
        for at in range(0, table.num_rows, step):
            part = table.take(pa.array(order[at:at + step])).combine_chunks()
            rank = pa.array(np.arange(start + at, start + at + part.num_rows))
            for batch in part.append_column("__rank", rank).to_batches():
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(batch.columns, layout)], schema=layout)

    def run(batches):
        held, size, bucket, start = [], 0, None, 0
        for batch in batches:
            marks = batch.column(batch.num_columns - 1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and (marks[a] != bucket or size > SLICE_BYTES):
                    yield from shuffled(held, bucket, start)
                    start = start + sum(x.num_rows for x in held) if marks[a] == bucket else 0
                    held, size = [], 0
                bucket = int(marks[a])
                held.append(batch.slice(a, b - a))
                size += held[-1].nbytes
        if held:
            yield from shuffled(held, bucket, start)

    return (dealt.mapInArrow(run, schema).join(places, "__bucket")
            .withColumn("__place", F.col("__first") + F.col("__rank"))
            .withColumn("shard", _shard(shards, count))
            .withColumn("slot", F.col("__place") - _first(shards, count))
            .drop("__bucket", "__rank", "__first", "__place"))


def _shard(shards: int, count: int):
    """Whole-number cut: place p lies in shard floor(p * shards / count)."""
    return F.expr(f"CAST(__place * {shards}L DIV {max(count, 1)}L AS INT)")


def _first(shards: int, count: int):
    return F.expr(f"(shard * {count}L + {shards - 1}L) DIV {shards}L")


def _hashable(docs: DataFrame, column: str) -> bool:
    return "map<" not in docs.schema[column].dataType.simpleString()


def write_shards(docs: DataFrame, shards: int, path: str | None = None, **options) -> DataFrame:
    """Write one folder per shard, each file a run of slots, and return the written rows."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    shuffled = external_shuffle(docs, shards, **options)
    shuffled.write.partitionBy("shard").parquet(path)
    return spark.read.schema(shuffled.schema).parquet(path)
