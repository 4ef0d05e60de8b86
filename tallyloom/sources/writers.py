"""Sinks: token shards, array tables, JSON lines, size-limited parts, result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import shard_rows, split_by_size


def write_token_shards(df: DataFrame, path: str, max_tokens: int, order: str, tokens: str = "tokens") -> DataFrame:
    """Token stream in folders ``shard=00000, 00001, ...`` of at most ``max_tokens`` tokens each.

    One task writes one shard, in stream order; a shard is bounded by ``max_tokens``. Returns the table.
    """
    rows = shard_rows(df, max_tokens, order, tokens)
    rows.repartition("shard").sortWithinPartitions("shard", "at").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema("at bigint, tokens array<int>, shard string").parquet(path)


def write_sft_arrays(df: DataFrame, path: str, tokens: str = "tokens", mask: str = "label_mask") -> DataFrame:
    """Fixed-length rows with a token and a label-mask array."""
    rows = df.select(F.col(tokens).alias("tokens"), F.col(mask).alias("label_mask"))
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, one part per task; readers take the folder, so nothing is merged."""
    df.write.option("compression", compression).json(path)


def write_size_limited(df: DataFrame, path: str, limit: int, file: str, order: str, line: str) -> None:
    """Lines in parts of a size limit below ``file=.../part=...``, in line order.

    One task writes one part, which is bounded by the limit and one line.
    """
    parts = split_by_size(df, limit, file, order, line)
    parts.repartition(file, "part").sortWithinPartitions(file, "part", order).select(
        file, "part", line
    ).write.partitionBy(file, "part").text(path)


def append_results(df: DataFrame, path: str, stamp: str, parameters: dict[str, str] | None = None) -> None:
    """One row per (model, task) with the run stamp and run parameters, behind the rows already there."""
    rows = df.withColumn("date", F.lit(stamp))
    for name, value in (parameters or {}).items():
        rows = rows.withColumn(name, F.lit(value))
    rows.write.mode("append").parquet(path)


def metric_table(df: DataFrame, metric_type: str, keys: Sequence[str], columns: Sequence[str], metrics: str = "metrics") -> DataFrame:
    """Result table of one metric type: its inner metrics as columns. ``metrics`` is map<type, map<name, value>>."""
    inner = F.col(metrics)[metric_type]
    return df.filter(inner.isNotNull()).select(*keys, *[inner[c].alias(c) for c in columns])


def metric_columns(df: DataFrame, metrics: str = "metrics") -> dict[str, list[str]]:
    """Metric names per metric type, as found in the data (a handful of names)."""
    names = df.select(F.explode(metrics).alias("type", "inner")).select("type", F.explode(F.map_keys("inner")).alias("name"))
    found: dict[str, list[str]] = {}
    for row in names.distinct().orderBy("type", "name").collect():
        found.setdefault(row["type"], []).append(row["name"])
    return found


def write_metric_tables(df: DataFrame, path: str, keys: Sequence[str], metrics: str = "metrics") -> list[str]:
    """One parquet table per metric type below ``path``; returns the types."""
    found = metric_columns(df, metrics)
    for kind, columns in found.items():
        metric_table(df, kind, keys, columns, metrics).write.parquet(f"{path.rstrip('/')}/{kind}")
    return list(found)


def read_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """The saved table when it is there and not empty, else build it, save it and read it back."""
    try:
        saved = spark.read.parquet(path)
        if not saved.isEmpty():
            return saved
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder yet, or an empty one
            raise
    built = builder()
    built.write.mode("overwrite").parquet(path)
    return spark.read.schema(built.schema).parquet(path)
