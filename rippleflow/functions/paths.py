"""Time paths held as year -> level maps, read without leaving the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(path: Column) -> Column:
    return F.array_sort(F.map_entries(path))


def _between(points: Column, year: Column) -> Column:
    """Linear interpolation inside the range of the points."""
    lo = F.element_at(F.filter(points, lambda p: p["key"] <= year), -1)
    hi = F.element_at(F.filter(points, lambda p: p["key"] >= year), 1)
    share = (year - lo["key"]) / (hi["key"] - lo["key"])
    return F.when(lo["key"] == hi["key"], lo["value"]).otherwise(
        lo["value"] + share * (hi["value"] - lo["value"]))


def level_at(path: Column, year: Column, default: Column) -> Column:
    """Level of a shock path: linear between points, flat outside, ``default`` without a path."""
    points = _points(path)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return (
        F.when(path.isNull() | (F.size(path) == 0), default)
        .when(year <= first["key"], first["value"])
        .when(year >= last["key"], last["value"])
        .otherwise(_between(points, year))
    )


def state_at(path: Column, year: Column, baseline: Column) -> Column:
    """Level of a physical state: the baseline before the first point, the last point after."""
    points = _points(path)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return (
        F.when((F.size(path) == 0) | (year < first["key"]), baseline)
        .when(year >= last["key"], last["value"])
        .otherwise(_between(points, year))
    )
