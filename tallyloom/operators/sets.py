"""Concatenation with source numbers, id offsets, file lists and named mixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def concat(dfs: Sequence[DataFrame], out: str = "source_no") -> DataFrame:
    """All rows of all tables with the number of their table; columns go by name."""
    numbered = [df.withColumn(out, F.lit(i)) for i, df in enumerate(dfs)]
    result = numbered[0]
    for df in numbered[1:]:
        result = result.unionByName(df, allowMissingColumns=True)
    return result


def union_with_offset(dfs: Sequence[DataFrame], doc_id: str) -> DataFrame:
    """Ids of later tables continue behind the largest id of the tables before (max + 1)."""
    rows = concat(dfs)
    tops = rows.groupBy("source_no").agg((F.max(doc_id) + 1).alias("_span"))  # one row per table
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select("source_no", F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "source_no").withColumn(
        doc_id, (F.col(doc_id) + F.col("_offset")).cast("bigint")
    ).drop("_offset")


def map_key_difference(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Keys only left, only right and shared of two map columns."""
    a, b = F.map_keys(left), F.map_keys(right)
    return df.withColumns(
        {
            "only_left": F.array_sort(F.array_except(a, b)), "only_right": F.array_sort(F.array_except(b, a)),
            "shared": F.array_sort(F.array_intersect(a, b)),
        }
    )


def list_files(spark: SparkSession, prefixes: Sequence[str], glob: str | None = None) -> DataFrame:
    """Distinct files below any of the prefixes, with their sizes (contents are not read)."""
    found = None
    for prefix in prefixes:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        files = reader.load(prefix).select("path", "length")
        found = files if found is None else found.unionByName(files)
    return found.distinct()


def expand_mix(mix_table: DataFrame, files: DataFrame, mix: str, source: str = "source") -> DataFrame:
    """Files of a named mix (columns ``mix, source, repeat``), a repeated source as often as it is listed."""
    listed = mix_table.filter(F.col("mix") == mix).select(source, "repeat")
    joined = files.join(listed, source).filter(F.col("repeat") > 0)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeat") - 1))).drop("repeat")
