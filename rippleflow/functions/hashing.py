"""Content identities of rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(canonical: Column, length: int = 12) -> Column:
    """Leading hex digits of the SHA-256 of a canonical string."""
    return F.substring(F.sha2(canonical, 256), 1, length)


def joined_parts(*parts: Column) -> Column:
    """One text per row from which every part can be told: each with its length, ``~`` if missing."""
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("~"))
                      for p in parts])


def row_text(labels, values, decimals: int = 10) -> Column:
    """Canonical text of a row: its labels, then its values rounded to fixed decimals."""
    return joined_parts(
        *[F.col(c).cast("string") for c in labels],
        *[F.regexp_replace(F.format_number(F.round(F.col(c), decimals) + F.lit(0.0), decimals), ",", "")
          for c in values])


def multiset_sum(text: Column, lanes: int = 4) -> Column:
    """Aggregate: a hash of the multiset of ``text`` values, as sums of ``lanes`` parts of 60 bits of
    each row's SHA-256.

    Sums do not depend on the order of rows and combine before the shuffle, so no list of rows is
    gathered; repeated rows count. Two different tables agree by chance once in 2 to the 240.
    """
    digest = F.sha2(text, 256)
    return F.concat_ws("-", *[F.sum(F.conv(
        F.substring(digest, 1 + 15 * lane, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for lane in range(lanes)])


def table_fingerprint(df: DataFrame, labels, values, decimals: int = 10, keys=()) -> DataFrame:
    """Order-free fingerprint (n_rows, fingerprint) of a table of any size."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        multiset_sum(row_text(labels, values, decimals)).alias("fingerprint"))


def map_hash(df: DataFrame, parts, keys=(), length: int = 12) -> DataFrame:
    """Hash of a mapping table per ``keys``: of its number of rows and the sums of their hashes."""
    text = F.concat_ws("|", F.count("*").cast("string"),
                       multiset_sum(joined_parts(*[F.col(p).cast("string") for p in parts])))
    return df.groupBy(*keys).agg(content_hash(text, length).alias("content_hash"))
