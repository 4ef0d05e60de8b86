"""Deterministic order and exact global positions without moving all rows to one task.

Random order is replaced by ``md5(seed:id)``: reproducible on any partitioning. A global row number is
computed in two steps, a small table of counts per bucket and a window inside each bucket, so no window
ever sees the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import div
from .layout import input_splits
from .scratch import materialize

HASH_DIGITS = 3  # 16**3 buckets; raise for very large tables, the offsets table has 16**digits rows
BLOCK = 1 << 16


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """md5 hex of ``seed:col[:col...]``."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def identity(*cols: Column | str) -> Column:
    """128-bit hash that is equal exactly for equal tuples: each field goes in with a null tag or its length before it."""
    parts = []
    for c in cols:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts))


def hash_int(seed: int | str, *cols: Column | str) -> Column:
    """First 32 bits of the hash as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("bigint")


def hash_wide(seed: int | str, *cols: Column | str) -> Column:
    """First 60 bits of the hash as a non-negative bigint: enough to draw from any number of rows without a bias."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 15), 16, 10).cast("bigint")


def hash_unit(seed: int | str, *cols: Column | str) -> Column:
    """Uniform number in [0, 1) from the hash."""
    return hash_int(seed, *cols) / F.lit(float(1 << 32))


def with_hash_position(
    df: DataFrame, seed: int | str, key: Sequence[str], by: Sequence[str] = (), out: str = "pos",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """0-based position in hash order, global or per ``by``. ``key`` must identify the row."""
    by = list(by)
    hashed = df.withColumn("_h", hash_key(seed, *key)).withColumn("_bucket", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if not by:
        offsets = F.broadcast(offsets)  # at most 16**digits rows
    local = Window.partitionBy(*by, "_bucket").orderBy("_h", *key)
    return (
        hashed.join(offsets, [*by, "_bucket"])
        .withColumn(out, (F.col("_off") + F.row_number().over(local) - 1).cast("bigint"))
        .drop("_h", "_bucket", "_off")
    )


def running_sum(
    df: DataFrame, value: Column | str, order: str, by: Sequence[str] = (), out: str = "running",
    block: int = BLOCK,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one (exclusive), ordered by the integer column ``order``.

    ``order`` must be non-negative and unique inside ``by``. Rows are cut into blocks of ``block`` order
    values and blocks into blocks of blocks, so the largest sort in one task is ``block`` rows even when
    one group holds most of the table.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    rows = (
        df.withColumn("_v", value)
        .withColumn("_b1", div(order, block))
        .withColumn("_b2", div(order, block * block))
    )
    fine = rows.groupBy(*by, "_b2", "_b1").agg(F.sum("_v").alias("_s1"))
    coarse = fine.groupBy(*by, "_b2").agg(F.sum("_s1").alias("_s2"))

    def before(*keys: str, sort: str):
        return Window.partitionBy(*keys).orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)

    zero = F.lit(0)
    coarse = coarse.select(*by, "_b2", F.coalesce(F.sum("_s2").over(before(*by, sort="_b2")), zero).alias("_o2"))
    fine = fine.join(coarse, [*by, "_b2"]).select(
        *by, "_b1",
        (F.col("_o2") + F.coalesce(F.sum("_s1").over(before(*by, "_b2", sort="_b1")), zero)).alias("_o1"),
    )
    return (
        rows.join(fine, [*by, "_b1"])
        .withColumn(out, F.col("_o1") + F.coalesce(F.sum("_v").over(before(*by, "_b1", sort=order)), zero))
        .drop("_v", "_b1", "_b2", "_o1")
    )


def with_position(
    df: DataFrame, order: str, by: Sequence[str] = (), out: str = "pos", block: int = BLOCK
) -> DataFrame:
    """0-based dense position by the integer column ``order``, global or per ``by``."""
    return running_sum(df, F.lit(1), order, by, out, block).withColumn(out, F.col(out).cast("bigint"))


def in_sorted_parts(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """The rows dealt into parts ``_part`` that follow each other in that order, written once.

    The number of parts follows the size of the input, unless it is given. The cut values come from a sample, so the parts are written
    before anything counts them: all later passes see the same ones. Rows with one value of the order share a part;
    the caller adds a key to the order, or aggregates equal values first.
    """
    parts = parts or max(input_splits(df), df.sparkSession.sparkContext.defaultParallelism)
    dealt = df.repartitionByRange(parts, *[F.col(o) if isinstance(o, str) else o for o in order])
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "sorted")


def _before_parts(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each part the sums over the parts before it: one row for each part, so it may be broadcast."""
    totals = parts.groupBy("_part").agg(*[value.alias(f"_t_{name}") for name, value in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select("_part", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums]))


def first_rows(df: DataFrame, n: int, order: Sequence[Column | str], ties: Sequence[str] = ()) -> DataFrame:
    """The first n rows in any order, without a task that sorts n rows: parts are counted and only the one that n cuts is numbered.

    ``ties`` lists columns that order equal rows.
    """
    keys = [*order, *ties]
    parts = in_sorted_parts(df, *keys)
    placed = parts.join(_before_parts(parts, {"n": F.count(F.lit(1))}), "_part").filter(F.col("_o_n") < n)
    local = Window.partitionBy("_part").orderBy(*keys)
    return placed.withColumn("_rank", F.row_number().over(local)).filter(F.col("_o_n") + F.col("_rank") <= n).select(df.columns)


def range_running_sums(df: DataFrame, values: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running sums ``<value>_run`` by the distinct key ``order``, part by part of the sorted table."""
    parts = in_sorted_parts(df, order, parts=buckets)
    out = parts.join(_before_parts(parts, {v: F.sum(v) for v in values}), "_part")
    local = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        out = out.withColumn(f"{v}_run", F.col(f"_o_{v}") + F.sum(v).over(local))
    return out.drop("_part", *[f"_o_{v}" for v in values])


def with_halo(
    df: DataFrame, order: str, before: int, by: Sequence[str] = (), block: int = BLOCK
) -> DataFrame:
    """Cut dense positions into blocks and copy the last ``before`` rows of each block into the next one.

    Adds ``_blk`` and ``_halo``; a window of at most ``before`` preceding rows is exact inside ``_blk`` for
    rows with ``_halo = false``.
    """
    if not 0 <= before <= block:
        raise ValueError("the window must fit into one block")
    home = div(order, block)
    near_end = (F.col(order) % block) >= block - before
    return (
        df.withColumn("_home", home)
        .withColumn("_blk", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
        .withColumn("_halo", F.col("_blk") != F.col("_home"))
        .drop("_home")
    )
