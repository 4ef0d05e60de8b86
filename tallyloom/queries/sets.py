"""Concatenation, offset, key difference, file list and mix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as ne
from ..operators import sets as st
from .functions_arrays import nested_json
from .registry import TABLES, Tables, query


@query(
    "u1_concat",
    "SELECT doc_id, lang, 0 AS source_no FROM documents UNION ALL SELECT item_id, NULL, 1 FROM benchmark UNION ALL SELECT doc_id, 'label', 2 FROM labels",
)
def _(t: Tables):
    return st.concat(
        [
            t.documents.select("doc_id", "lang"), t.benchmark.select(F.col("item_id").alias("doc_id")),
            t.labels.select("doc_id", F.lit("label").alias("lang")),
        ]
    )


@query(
    "u2_union_with_offset",
    """
    SELECT item_id AS doc_id, 0 AS source_no FROM benchmark UNION ALL SELECT p_partkey + (SELECT max(item_id) + 1 FROM benchmark), 1 FROM part UNION ALL
    SELECT s_suppkey + (SELECT max(item_id) + 1 FROM benchmark) + (SELECT max(p_partkey) + 1 FROM part), 2 FROM supplier
    """,
)
def _(t: Tables):
    ids = [t.benchmark.select("item_id"), t.part.select("p_partkey"), t.supplier.select("s_suppkey")]
    return st.union_with_offset([df.toDF("doc_id") for df in ids], "doc_id")


@query(
    "u3_map_key_difference",
    """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a.d|e|f.k' ELSE 'a.d|e' END AS only_left, CASE WHEN event_id % 2 = 0 THEN 'g' ELSE '' END AS only_right,
           CASE WHEN event_id % 2 = 0 THEN 'a.b' ELSE 'a.b|f.k' END AS shared FROM events
    """,
)
def _(t: Tables):
    left = ne.flatten_json(nested_json())
    right = F.create_map(F.lit("a.b"), F.lit("1"), F.when(F.col("event_id") % 2 == 0, "g").otherwise("f.k"), F.lit("2"))
    rows = st.map_key_difference(t.events.select("event_id", left.alias("l"), right.alias("r")), F.col("l"), F.col("r"))
    return rows.select("event_id", *[F.array_join(c, "|").alias(c) for c in ("only_left", "only_right", "shared")])


# no SQL: it lists the input folder, not a table
@query("u4_list_files")
def _(t: Tables):
    files = st.list_files(t.spark, [t.dir, t.dir], "*.parquet")
    named = files.select(F.substring_index("path", "/", -1).alias("name"), "length")
    return named.filter(F.col("name").isin([f"{n}.parquet" for n in TABLES]))


MIX = [("base", "src1", 1), ("base", "src2", 3), ("base", "src3", 0), ("other", "src1", 5), ("base", "src4", 2)]


@query(
    "u5_expand_mix",
    """
    SELECT doc_id, source, unnest(range(0, r))::INT AS copy FROM documents JOIN (VALUES ('src1', 1), ('src2', 3), ('src4', 2)) v(source, r) USING (source)
    """,
)
def _(t: Tables):
    table = t.spark.createDataFrame(MIX, "mix string, source string, repeat int")
    return st.expand_mix(table, t.documents.select("doc_id", "source"), "base").select("doc_id", "source", "copy")


