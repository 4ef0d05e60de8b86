"""Standard errors of metrics that are functions of column sums (BLEU, chrF, F1, correlation), by resampling rows.

A replicate draws as many rows as there are, with replacement. Drawing rows one by one costs iterations times rows and an
exchange of all draws. Here equal rows are counted first and dealt into cells; how many draws fall into a cell is found
by halving: at each node of a binary tree over the cells a binomial number of the node's draws goes to the left half.
The generator of a node is seeded by the seed and the node, so every task that walks through a node gets the same
numbers, and a lost task gets them again. Inside a cell the draws are multinomial over its distinct rows, and only their
weighted sums leave the task: one row for each replicate.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize

# the functions below travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_ROWS = 4096  # distinct rows of a cell, on average
MOST_WEIGHTS = 1 << 22  # weights that a task holds at a time


def _generator(seed: int, level: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, level, node])


class Draws:
    """Draws of every replicate that fall into a cell: paths of the tree over the cells, from the root down."""

    def __init__(self, sizes: np.ndarray, iters: int, seed: int):
        self.levels = [sizes]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, self.levels[0].reshape(-1, 2).sum(axis=1))
        self.iters, self.seed = iters, seed
        self.path: list[tuple[int, np.ndarray]] = []  # the nodes of the last path and their draws

    def of(self, cell: int) -> np.ndarray:
        depth = len(self.levels) - 1
        for level in range(depth + 1):
            node = cell >> (depth - level)
            if level < len(self.path) and self.path[level][0] == node:
                continue
            del self.path[level:]
            if level == 0:
                draws = np.full(self.iters, self.levels[0][0], np.int64)
            else:
                parent, above = self.path[-1]
                both = self.levels[level - 1][parent]
                share = self.levels[level][2 * parent] / both if both else 0.0
                left = _generator(self.seed, level, parent).binomial(above, share)
                draws = above - left if node & 1 else left
            self.path.append((node, draws))
        return self.path[-1][1]


def resampled_sums(df: DataFrame, values: Sequence[str], iters: int, seed: int | str) -> DataFrame:
    """``replicate`` and, for each of the numeric columns ``values``, its sum over that replicate's rows.

    The driver gets one number for each cell, that is for each few thousand distinct rows. Null counts as 0. An empty
    table gives no rows.
    """
    number = seed if isinstance(seed, int) and seed >= 0 else crc32(str(seed).encode())
    plain = df.select(*[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(values)])
    names = plain.columns
    rows = materialize(plain.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "resample")
    distinct = rows.count()
    if distinct == 0:
        return df.sparkSession.createDataFrame([], ", ".join(["replicate int", *(f"`{v}` double" for v in values)]))
    cells = 1 << max(0, -(-distinct // CELL_ROWS) - 1).bit_length()
    placed = rows.withColumn("cell", F.pmod(F.xxhash64(*names), F.lit(cells)).cast("int"))
    sizes = np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes[r["cell"]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, sums = Draws(sizes, iters, number), np.zeros((iters, len(names)))
        depth = len(draws.levels)

        def close(cell: int, parts: list[np.ndarray]) -> None:
            table = np.concatenate(parts)
            hits, share, source = draws.of(cell), table[:, 0] / table[:, 0].sum(), _generator(number, depth, cell)
            step = max(1, MOST_WEIGHTS // len(table))
            for at in range(0, iters, step):
                sums[at : at + step] += source.multinomial(hits[at : at + step], share) @ table[:, 1:]

        current, held = None, []
        for batch in batches:
            at = np.asarray(batch.column("cell"))
            table = np.column_stack([np.asarray(batch.column(c), dtype=float) for c in ("n", *names)])
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and at[a] != current:
                    close(current, held)
                    held = []
                current = int(at[a])
                held.append(table[a:b])
        if held:
            close(current, held)
            columns = [pa.array(np.arange(iters, dtype=np.int32)), *(pa.array(c) for c in sums.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["replicate", *names])

    dealt = placed.repartition("cell").sortWithinPartitions("cell", *names)  # a fixed order inside a cell
    parts = dealt.mapInArrow(run, ", ".join(["replicate int", *(f"{c} double" for c in names)]))
    return parts.groupBy("replicate").agg(*[F.sum(c).alias(v) for c, v in zip(names, values)])


def stderr_of_sums(df: DataFrame, values: Sequence[str], statistic: Column, iters: int, seed: int | str) -> DataFrame:
    """Mean and standard error of ``statistic``, an expression over the sums of ``values``, among the replicates."""
    return resampled_sums(df, values, iters, seed).select(statistic.alias("_m")).agg(
        F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("stderr")
    )
