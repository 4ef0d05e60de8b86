"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def div(a: Column | str, b: Column | int) -> Column:
    """Whole-number division without a detour over doubles."""
    return F.call_function("div", col(a), F.lit(b) if isinstance(b, int) else b)


def indices(length: Column) -> Column:
    """``[0, 1, ..., length-1]``, empty for length 0 (a plain sequence would count down)."""
    return F.when(length > 0, F.sequence(F.lit(0), length.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


BLOCK = 16


def _starts_inside(lengths: Column, at: Column) -> Column:
    """Exclusive prefix sums of a short array, beginning at ``at``."""
    return F.aggregate(
        lengths,
        F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"],
    )


def _starts(lengths: Column, levels: int) -> Column:
    if levels == 0:
        return _starts_inside(lengths, F.lit(0))

    def block(ls: Column, b: Column) -> Column:
        return F.slice(ls, b * BLOCK + 1, F.lit(BLOCK))

    def block_sums(ls: Column) -> Column:
        return F.transform(indices(F.ceil(F.size(ls) / BLOCK)), lambda b: F.aggregate(block(ls, b), F.lit(0), lambda a, x: a + x))

    def per_block(ls: Column, before: Column) -> Column:
        return F.flatten(F.transform(before, lambda at, b: _starts_inside(block(ls, b), at)))

    return let(lengths, lambda ls: let(_starts(block_sums(ls), levels - 1), lambda before: per_block(ls, before)))


def running_starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array in linear time.

    Totals of blocks, and of blocks of blocks, are summed once from the top, and each block begins at the sum before it. With
    four levels an array of a million has sixteen totals at the top. Blocks are short, as appending to an array copies it.
    """
    return _starts(lengths.cast("array<int>"), 4)
