"""Physical layout helpers: how many tasks share the work, and which rows sit together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

SPLIT_BYTES = 64 << 20  # compressed input per task
MAX_TASKS = 32_768  # an exchange has tasks x tasks blocks; beyond this, tasks grow instead
UNKNOWN = 1 << 60  # Spark's size for a table without statistics


def input_splits(df: DataFrame) -> int:
    """Input size in splits, from the statistics of the scanned tables; nothing is executed.

    A table of unknown size counts as one split per shuffle partition of the session.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size >= UNKNOWN for size in sizes):
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(-(-sum(sizes) // SPLIT_BYTES), MAX_TASKS)


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when the input has fewer splits than the cluster has cores.

    Heavy per-row text work on one small file would otherwise run in one task. Large inputs have enough splits
    and pass through untouched, without an exchange.
    """
    return df.repartition(_cores(df), *keys) if input_splits(df) < _cores(df) else df


def colocate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the rows of a key into one task before they are exploded.

    What is made from a row (words, n-grams) can then be grouped by the key without another exchange, so the
    compact rows move instead of their many parts. The number of tasks follows the size of the input.
    """
    return df.repartition(max(input_splits(df), _cores(df)), *keys)
