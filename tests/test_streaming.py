"""Streams give the batch result, also after repeated delivery and restarts."""

import uuid

from pyspark.sql import functions as F

from tallyloom.operators.sampling import keep_latest
from tallyloom.streaming import incremental as inc


def folder(tmp_path, name):
    return str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def rows(spark, start, end):
    return spark.range(start, end).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 10).cast("double").alias("v"))


def as_set(df):
    return sorted(map(tuple, df.collect()))


def test_metrics_ignore_repeated_rows(spark, tmp_path):
    src = folder(tmp_path, "src")
    for _ in range(2):
        rows(spark, 0, 60).repartition(2).write.mode("append").parquet(src)
    stream = inc.stream_folder(spark, src, rows(spark, 0, 1).schema, 1)
    metrics = inc.running_metrics(stream, ["id", "k", "v"], ["k"], n=F.count(F.lit(1)), s=F.sum("v"))
    got = inc.run_metrics(metrics, folder(tmp_path, "out"), folder(tmp_path, "cp"))
    want = rows(spark, 0, 60).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert as_set(got.select("k", "n", "s")) == as_set(want)


def test_slices_are_numbered_and_complete(spark, tmp_path):
    src = folder(tmp_path, "src")
    for i in range(3):
        rows(spark, i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    got = inc.write_slices(inc.stream_folder(spark, src, rows(spark, 0, 1).schema, 1), folder(tmp_path, "out"), folder(tmp_path, "cp"))
    counts = {r["iteration"]: r["count"] for r in got.groupBy("iteration").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 10} and got.select("id").distinct().count() == 30


def test_restart_reads_only_what_is_new(spark, tmp_path):
    src, out, cp = (folder(tmp_path, n) for n in ("src", "out", "cp"))
    for i in range(2):
        rows(spark, i * 20, i * 20 + 20).write.mode("append").parquet(src)
        got = inc.append_new(inc.stream_folder(spark, src, rows(spark, 0, 1).schema), out, cp)
        assert sorted(r["id"] for r in got.collect()) == list(range(i * 20 + 20))


def test_replay_buffer_equals_batch_twin(spark, tmp_path):
    src = folder(tmp_path, "src")
    for i in range(3):
        rows(spark, i * 40, i * 40 + 40).coalesce(1).write.mode("append").parquet(src)
    stream = inc.stream_folder(spark, src, rows(spark, 0, 1).schema, 1)
    log = inc.append_new(inc.replay_buffer(stream, "k", "id", "v", 4, shards=3), folder(tmp_path, "out"), folder(tmp_path, "cp"))
    got = inc.buffer_contents(log, "k", "id", "v", 4)
    assert as_set(got.select("k", "id", "v")) == as_set(keep_latest(rows(spark, 0, 120), 4, "id", ["k"]).select("k", "id", "v"))
