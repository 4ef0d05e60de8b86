"""Importance resampling towards a target distribution over hashed word runs.

Text becomes numbers by Arrow kernels, a slice of the batch at a time: ``ascii_lower``, ``split_pattern_regex``,
``list_flatten`` and ``dictionary_encode`` give one dictionary index for each word. Runs of n words are the indices of
the runs of n - 1 words, shifted against the indices of the words; only distinct pairs of them are hashed (CRC-32 goes
on from the shorter run's value), then ``take`` spreads the gains and a segment reduction sums them for each text.

Counts for each bucket come from all texts of both tables; what the driver sees is one row for each bucket. Ranks come
from a range partitioned sort of narrow rows and the row counts of its parts, so no task orders the whole table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .common import byte_view, col, slices, tasks_for, text_of

#: What stands between words: ASCII without digits and small letters.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The dictionary index of every word, the number of the text it stands in, and the dictionary; null texts have no words."""
    raw, offsets = byte_view(texts)  # ascii_lower does not heed where a slice begins, so the slice is made whole first
    whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(raw.tobytes()))
    lists = pc.split_pattern_regex(pc.ascii_lower(whole), BREAKS)
    flat = pc.list_flatten(lists)
    at = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[code] > 0  # a break at an end leaves an empty piece
    return code[some], at[some], coded.dictionary.cast(pa.large_binary()).to_pylist()


def run_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every run of 1 to ``longest`` words, the number of the text it stands in, and the words of each text."""
    word, at, dictionary = word_codes(texts)
    run, crc = word, [zlib.crc32(w) for w in dictionary]
    kinds, places = [np.array(crc, np.int64)[run] % buckets], [at]
    for n in range(2, longest + 1):
        inside = at[: len(at) - n + 1] == at[n - 1 :]
        pair = run[: len(inside)] * max(len(dictionary), 1) + word[n - 1 :]
        distinct, run = np.unique(pair, return_inverse=True)
        crc = [zlib.crc32(b" " + dictionary[p % len(dictionary)], crc[p // len(dictionary)]) for p in distinct.tolist()]
        kinds.append((np.array(crc, np.int64)[run] % buckets)[inside])
        places.append(at[: len(inside)][inside])
    words = np.bincount(at, minlength=len(texts))
    if longest == 1:
        return kinds[0], places[0], words
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(kinds)[order], place[order], words


def bucket_counts(df: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                count += np.bincount(run_buckets(part.column("text"), longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    partial = df.select(text_of(df, text_col).alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s of S features in ``docs``, t of T in ``target``."""
    counts = []
    for df in (docs, target):
        count = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, text_col, longest, buckets).collect():  # at most one row for each bucket
            count[r["bucket"]] = r["n"]
        counts.append(count)
    s, t = (c.tolist() for c in counts)
    over, under = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * over / ((a + 1) * under))) for a, b in zip(s, t)], np.int64)


def with_weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """id, n_words, n_features and weight (floored mean of the gains of its features, 0 without any) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                kind, at, words = run_buckets(part.column("text"), longest, len(gain))
                features = np.bincount(at, minlength=part.num_rows)
                some = features > 0
                weight = np.zeros(part.num_rows, np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[kind], (np.cumsum(features) - features)[some]) // features[some]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(words), pa.array(features), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(col(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))
    schema = rows.select("id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return rows.mapInArrow(run, schema)


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((head + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, drawable: Column, order: list[Column]) -> DataFrame:
    """All columns, drawable, and position: the row's place (from 1) among the drawable rows in that order, over the whole table.

    A range partitioned sort; its parts are numbered where they lie and written, and only their row counts reach the driver.
    """
    first = [F.col("drawable").desc(), *order]
    parts = rows.withColumn("drawable", drawable)
    fields = parts.schema.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(at + 1, at + 1 + batch.num_rows, dtype=np.int64)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], [*fields, "part", "place"])

    dealt = parts.repartitionByRange(tasks_for(rows), *first).sortWithinPartitions(*first)
    placed = materialize(dealt.mapInArrow(number, parts.select("*").schema.add("part", "integer").add("place", "long")), "placed")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count_if("drawable").alias("n")).collect())  # one row for each part
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    table = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return placed.join(F.broadcast(table), "part").withColumn("position", F.when(F.col("drawable"), F.col("before") + F.col("place"))).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Every row's id, n_features, weight, score (weight plus noise) and rank among the drawn rows, else null.

    Drawn are floor(``percent`` * N / 100) of the N rows with at least ``least_words`` words: those with the highest
    scores, ties to the smaller id (null ids last). Null and empty texts have no features, weight 0 and a score, and are
    not drawn while ``least_words`` is above 0. A null id is hashed as an empty one. Repeated rows are rows of their
    own, with the same score and ranks next to each other. Without rows there is no row; an empty target gives every
    bucket t = 0. Other columns are ignored.
    """
    weighted = with_weights(docs, gains(docs, target, text_col, longest, buckets), id_col, text_col, longest)
    scored = materialize(weighted.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    draw = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    placed = ranked(scored, F.col("n_words") >= least_words, [F.col("score").desc(), F.col("id").asc_nulls_last()])
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("position") <= draw, F.col("position")).alias("rank"))
