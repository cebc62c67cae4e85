"""Rounds of join-and-aggregate along a link table, as one statement."""

from __future__ import annotations

from pyspark.sql import DataFrame


def names(columns, prefix="") -> str:
    return "".join(f"{prefix}`{c}`, " for c in columns)


def rounds(chain: DataFrame, state: DataFrame, keys, link_keys, count: int,
           outputs: str, small: bool) -> DataFrame:
    """``count`` rounds of join-and-aggregate along ``chain`` as one statement.

    A round joins the state to the chain at ``src`` and groups what arrives by ``dst``.
    """
    hint = "/*+ BROADCAST(c) */ " if small else ""
    on = "".join(f" AND c.`{k}` = s.`{k}`" for k in link_keys)
    parts = ["r0 AS (SELECT * FROM {state})"]
    for i in range(1, count + 1):
        parts.append(
            f"r{i} AS (SELECT {hint}{names(keys, 's.')}c.dst AS label, {outputs} "
            f"FROM {{chain}} c JOIN r{i - 1} s ON s.label = c.src{on} "
            f"GROUP BY {names(keys, 's.')}c.dst)")
    return chain.sparkSession.sql(
        "WITH " + ", ".join(parts) + f" SELECT * FROM r{count}", chain=chain, state=state)
