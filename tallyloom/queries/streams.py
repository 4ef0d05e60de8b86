"""Streams over the events table: its rows arrive as files of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.scratch import scratch_path
from ..streaming import incremental as inc
from .metrics import rounded
from .registry import Tables, query


def arriving(t: Tables, parts: int, again: bool = False):
    """Folder with the events in ``parts`` files (twice with ``again``) and their schema."""
    folder = scratch_path(t.spark, "arriving")
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    for _ in range(2 if again else 1):
        rows.repartition(parts, "event_id").write.mode("append").parquet(folder)
    return folder, rows.schema


@query(
    "r1_running_metrics",
    "SELECT event_type, count(*) AS n, round(exp(-avg(-value / 100)), 7) AS ppl FROM events GROUP BY event_type",
)
def _(t: Tables):
    folder, schema = arriving(t, 3, again=True)
    metrics = inc.running_metrics(
        inc.stream_folder(t.spark, folder, schema, 2), ["event_id", "event_type", "value"], ["event_type"],
        n=F.count(F.lit(1)), ppl=F.exp(-F.sum(-F.col("value") / 100) / F.count(F.lit(1))),
    )
    return rounded(inc.run_metrics(metrics, scratch_path(t.spark, "metrics"), scratch_path(t.spark, "checkpoint")), 7)


@query("r2_numbered_slices", "SELECT event_id, event_type, true AS numbered FROM events")
def _(t: Tables):
    folder, schema = arriving(t, 4)
    stream = inc.stream_folder(t.spark, folder, schema, 1)
    slices = inc.write_slices(stream, scratch_path(t.spark, "slices"), scratch_path(t.spark, "checkpoint"))
    return slices.select("event_id", "event_type", F.col("iteration").between(0, 3).alias("numbered"))


@query(
    "r3_replay_buffer",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5",
)
def _(t: Tables):
    folder, schema = arriving(t, 3)
    buffer = inc.replay_buffer(inc.stream_folder(t.spark, folder, schema, 1), "user_id", "event_id", "value", 5, shards=2)
    log = inc.append_new(buffer, scratch_path(t.spark, "buffer"), scratch_path(t.spark, "checkpoint"))
    return inc.buffer_contents(log, "user_id", "event_id", "value", 5)


@query("r5_restart", "SELECT event_id, value FROM events")
def _(t: Tables):
    folder, schema = arriving(t, 2)
    out, checkpoint = scratch_path(t.spark, "copied"), scratch_path(t.spark, "checkpoint")
    inc.append_new(inc.stream_folder(t.spark, folder, schema, 1), out, checkpoint)
    # the second run starts where the first one ended
    copied = inc.append_new(inc.stream_folder(t.spark, folder, schema, 1), out, checkpoint)
    return copied.select("event_id", "value")
