"""Session helpers: a tuned local session and the checkpoint directory of iterative plans."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the submitter's session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rippleflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RIPPLEFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The directory the cluster names in ``spark.checkpoint.dir`` always wins. A local session
    without one gets a temporary folder; a cluster session without one is an error, because a
    folder on one machine does not survive the loss of that machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "iterative operators need a shared checkpoint folder: set spark.checkpoint.dir"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rippleflow-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, which all machines share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint directory and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value}')"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(v) for v in value) + ")"
    if isinstance(value, dict):
        return "map(" + ", ".join(_sql_literal(x) for kv in value.items() for x in kv) + ")"
    return repr(value)


def literal_table(spark: SparkSession, rows, schema) -> DataFrame:
    """A small parameter table as constants in the plan, so no Python worker serves its rows."""
    layout = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = ", ".join(f"c{i}" for i in range(len(layout)))
    casts = ", ".join(
        f"CAST(c{i} AS {f.dataType.simpleString()}) AS `{f.name}`"
        for i, f in enumerate(layout.fields))
    if not rows:
        return spark.sql("SELECT " + ", ".join(
            f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in layout.fields
        ) + " WHERE false")
    # Typed per cell: columns may mix nulls, empty lists and values.
    body = ", ".join(
        "(" + ", ".join(f"CAST({_sql_literal(v)} AS {f.dataType.simpleString()})"
                        for v, f in zip(row, layout.fields, strict=True)) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
