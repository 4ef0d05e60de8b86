"""Incremental forms of the mergeable metrics, numbered slices, the replay buffer and restartable reads."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import keep_latest

# the state function travels with its code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_folder(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def running_metrics(
    stream: DataFrame, keys: Sequence[str], by: Sequence[str], event_time: str | None = None, delay: str | None = None,
    **aggregates: Column,
) -> DataFrame:
    """Mergeable metrics over a stream in which rows may be delivered twice.

    Rows with the same ``keys`` count once. With an event time and a delay old keys leave the state; without
    them the state grows with the number of keys, so run such a stream to its end (``available now``).
    """
    if event_time and delay:
        once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    else:
        once = stream.dropDuplicates(list(keys))
    return once.groupBy(*by).agg(*[e.alias(n) for n, e in aggregates.items()])


def run_metrics(metrics: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything there is; the folder ``out`` ends with the complete result of the last batch."""

    def save(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = metrics.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).foreachBatch(save).start()
    query.awaitTermination()
    spark = metrics.sparkSession
    saved = spark.read.option("basePath", out).parquet(out)
    last = saved.agg(F.max("batch").alias("batch"))
    return saved.join(F.broadcast(last), "batch").drop("batch")


def write_slices(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Every micro-batch becomes a numbered slice ``iteration=0, 1, ...``; a repeated batch overwrites itself."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/iteration={batch}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return stream.sparkSession.read.option("basePath", out).parquet(out)


def append_new(stream: DataFrame, out: str, checkpoint: str) -> DataFrame | None:
    """Copy what is new since the checkpoint; after a restart with the same checkpoint no row comes twice."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start()
    query.awaitTermination()
    try:
        return stream.sparkSession.read.parquet(out)
    except AnalysisException:  # nothing was written yet
        return None


BUCKETS = 1024  # keys are dealt over so many states for each shard; a state holds the buffers of its keys


def _buffer_step(limit: int, columns: Sequence[str]):
    """State update of one bucket: keep the newest ``limit`` rows of each key, emit the buffers of the keys that got rows."""
    order, names = columns[0], ["_key", *columns]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(names, state.get))) if state.exists else None
        changed = []
        for batch in batches:
            changed.append(batch["_key"].drop_duplicates())
            rows = batch[names] if held is None else pd.concat([held, batch[names]])
            held = rows.sort_values(order, kind="stable").groupby("_key", dropna=False, sort=False).tail(limit)
        state.update(tuple(held[n].tolist() for n in names))
        out = held[held["_key"].isin(pd.concat(changed))].copy()
        out.insert(1, "_shard", key[1])
        out["_version"] = out.groupby("_key", dropna=False)[order].transform("max")
        yield out

    return step


def replay_buffer(
    stream: DataFrame, key: str, order: str, value: str, limit: int, shards: int = 8, buckets: int = BUCKETS
) -> DataFrame:
    """First-in first-out buffer of the newest ``limit`` rows per key, kept as stream state.

    A key is split over ``shards`` states by a hash of the order value, so a key with most of the rows does
    not land in one task; the newest rows of a key are among the newest of its shards. A state holds many keys, as a call
    for each key costs more than its rows. The output lists the buffer of every key and shard that got rows;
    ``buffer_contents`` reads the current one.
    """
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    # whole numbers travel as text, as pandas would round them beside a null
    as_text = isinstance(stream.schema[key].dataType, T.IntegralType)
    held = "string" if as_text else types[key]
    sharded = stream.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"), F.pmod(F.xxhash64(order), F.lit(shards)).cast("int").alias("_shard"),
        F.col(key).cast(held).alias("_key"), order, value,
    )
    buffers = sharded.groupBy("_bucket", "_shard").applyInPandasWithState(
        _buffer_step(limit, [order, value]),
        f"_key {held}, _shard int, {order} {types[order]}, {value} {types[value]}, _version {types[order]}",
        f"k array<{held}>, o array<{types[order]}>, v array<{types[value]}>", "append", "NoTimeout",
    )
    return buffers.withColumn("_key", F.col("_key").cast(types[key]))


def buffer_contents(log: DataFrame, key: str, order: str, value: str, limit: int) -> DataFrame:
    """The rows held now: the last version of every shard, then the newest ``limit`` of the key."""
    latest = log.groupBy("_key", "_shard").agg(F.max("_version").alias("_version"))
    held = log.join(latest, ["_key", "_shard", "_version"]).select(F.col("_key").alias(key), order, value).distinct()
    return keep_latest(held, limit, order, [key])
