"""Joins that check sizes before broadcasting and that spread hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def broadcast_rows(df: DataFrame) -> int:
    """How many rows of this schema fit the byte bound of a broadcast, by the types' usual sizes."""
    width = sum(_width(f.dataType.simpleString()) for f in df.schema.fields)
    return min(BROADCAST_ROWS, BROADCAST_BYTES // (16 + width))


def _width(kind: str) -> int:
    if "<" in kind:
        return 256
    return {"string": 40, "binary": 256, "boolean": 1, "int": 4, "float": 4}.get(kind, 8)


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    rows = broadcast_rows(df) if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def lookup_join(fact: DataFrame, dim: DataFrame, key: str, *, rows: int | None = None,
                salts: int | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of ``fact`` with a table that has one row per ``key``.

    A lookup side that is measured to fit is broadcast. A larger one is joined by shuffle, whatever
    Spark makes of its files' sizes, and adaptive execution splits hot keys. With ``salts`` the split is part of the plan: fact rows
    spread over that many salts by a hash of the row and every lookup row is copied once per salt,
    which is for callers that know of hot keys. The fact side is never scanned to look for them.
    """
    if fits_broadcast(dim, rows):
        return fact.join(F.broadcast(dim), key, how)
    if salts is None:
        return fact.join(dim.hint("merge"), key, how)
    rest = [c for c in fact.columns if c != key]
    salt = F.pmod(F.xxhash64(*rest), F.lit(salts)) if rest else F.lit(0)
    copies = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return fact.withColumn("__salt", salt.cast("int")).join(
        copies, [key, "__salt"], how).drop("__salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of any number of frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)
