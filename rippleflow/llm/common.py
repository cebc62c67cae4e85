"""Helpers shared by the operators of this folder.

Conventions of all operators here:

* a missing text counts as empty unless a docstring says otherwise;
* an input column that has the name of a result column is replaced by it;
* results are functions of the rows alone: hashes are seeded and orders have tie-breakers, so a
  task that runs again after the loss of an executor makes the same rows.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleflow.session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000
STEP_ROWS = 512


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's checkpoint folder, which all machines share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage like a checkpoint, is compressed, and lets later reads take single columns.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    That serves workers on the driver's machine and on machines with the same folders; elsewhere
    the package comes with the job, as with ``--py-files``.
    """
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def placed(query: Callable) -> Callable:
    """A query or stage that first makes the package known to Python workers."""

    @functools.wraps(query)
    def run(spark: SparkSession, *arguments):
        on_workers(spark)
        return query(spark, *arguments)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str
) -> DataFrame:
    """Apply ``fn`` to each step of an Arrow batch; it returns the result columns by name."""
    names = T._parse_datatype_string(schema).fieldNames()
    layout = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                got = fn(part)
                yield pa.RecordBatch.from_arrays(
                    [as_array(got[n], layout.field(n).type) for n in names], schema=layout)

    return df.mapInArrow(run, schema)


def steps(batch: pa.RecordBatch, rows: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in short parts, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("~"))
                              .cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(
        float(1 << 52))


def hash_sample(df: DataFrame, rows: int, seed: int, *columns: str) -> DataFrame:
    """About ``rows`` rows whose hash lies below a threshold, or all of a smaller table.

    A row's part in it depends on its own columns and the table's count, so no task or driver
    gathers more than its share; twice ``rows`` is a bound for all practical purposes.
    """
    total = df.count()
    if total <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 32))
    return df.where(share < F.lit(int(rows / total * (1 << 32))))


def null_safe_key(column: Column) -> Column:
    """A grouping key under which a missing value equals itself and no other value."""
    return F.when(column.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), column.cast("string")))


def join_sized(fact: DataFrame, dim: DataFrame, key: str | list[str], salts: int = 32,
               rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a lookup table, usually of one row per ``key`` (one column or several).

    The lookup side is broadcast only when at most ``rows`` rows are counted. Otherwise every fact
    row takes a salt from its other columns and the lookup rows are copied once per salt, so a key
    that holds a third of all rows spreads over ``salts`` tasks.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if dim.limit(rows + 1).count() <= rows:
        return fact.join(F.broadcast(dim), keys, "left")
    rest = [F.col(c) for c in fact.columns if c not in keys]
    salted = fact.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.lit(salts)).cast("int"))
    copies = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], "left").drop("__salt")
