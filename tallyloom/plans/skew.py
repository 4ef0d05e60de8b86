"""Joins and group statistics that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import div

def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join for a left side that may have hot keys, with at most one copy of a hot key on the right.

    ``how`` may be inner, left, left_semi or left_anti. Nothing runs before the action: adaptive execution measures
    the exchange and deals the rows of an oversized left partition to several tasks, which it can for exactly these joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not support {how}")
    return left.join(right, list(keys), how)


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach aggregates of the row's group; null is a key like any other.

    Partial aggregation and a join that adaptive execution can split, instead of a window, so no task ever holds a
    whole group.
    """
    keys = list(keys)
    stats = df.groupBy(*[F.col(k).alias(f"_{k}_of") for k in keys]).agg(*[expr.alias(name) for name, expr in aggs.items()])
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}_of")) for k in keys])
    return df.join(stats, match, "inner").drop(*[f"_{k}_of" for k in keys])


def attach_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach one-row table aggregates to every row."""
    totals = df.agg(*[expr.alias(name) for name, expr in aggs.items()])
    return df.crossJoin(F.broadcast(totals))  # exactly one row


def range_join(
    points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: int, keys: Sequence[str] = (),
    small_ranges: bool = False,
) -> DataFrame:
    """Rows of ``points`` with the range ``start <= point < end`` that holds them.

    Ranges are listed under every cell of ``width`` they touch, which makes it an equi join on the cell. With
    ``small_ranges`` the caller has checked that the listed ranges are few, and they are broadcast.
    """
    cells = ranges.filter(F.col(end) > F.col(start)).withColumn(
        "_cell",
        F.explode(F.sequence(div(start, width), div(F.col(end) - 1, width))),
    )
    return (
        points.withColumn("_cell", div(point, width))
        .join(F.broadcast(cells) if small_ranges else cells, [*keys, "_cell"])
        .filter((F.col(start) <= F.col(point)) & (F.col(point) < F.col(end)))
        .drop("_cell")
    )
