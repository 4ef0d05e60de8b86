"""A Bloom filter as a table of fixed size, for joins whose large side mostly finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import div

CELLS = 1 << 24  # bits for each probe: at most CELLS / 64 rows of 16 bytes are broadcast, whatever the keys
PROBES = 2


def _cell(value: str, probe: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), F.col(value)), F.lit(cells))


def filter_words(keys: DataFrame, key: str, probe: int, cells: int = CELLS) -> DataFrame:
    """(_word, _mask): 64 cells in a row, the bits of those that some key falls into. Partial sums are made where the keys lie."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_cell") % 64).cast("int"))
    return keys.select(_cell(key, probe, cells).alias("_cell")).groupBy(div("_cell", 64).alias("_word")).agg(F.bit_or(bit).alias("_mask"))


def maybe_in(df: DataFrame, value: str, keys: DataFrame, key: str, cells: int = CELLS, probes: int = PROBES) -> DataFrame:
    """The rows of ``df`` whose ``value`` may be among ``keys``: every row that is, and a few others.

    Nothing of ``df`` is exchanged. With M keys about (M / cells) ** probes of the other rows pass; an exact join
    afterwards drops them, so too many keys cost time, never rows.
    """
    for probe in range(probes):
        words = filter_words(keys, key, probe, cells)
        probed = df.withColumn("_cell", _cell(value, probe, cells)).withColumn("_word", div("_cell", 64)).join(F.broadcast(words), "_word")
        bit = F.call_function("shiftrightunsigned", F.col("_mask"), (F.col("_cell") % 64).cast("int"))
        df = probed.filter(bit.bitwiseAND(F.lit(1)) == 1).select(df.columns)
    return df
