"""Scans of corpora, generation files and evaluation files into DataFrames with declared schemas."""

from __future__ import annotations

import importlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..plans.scratch import materialize

TEXT_COLUMN = "value"

EVAL_RECORD = T.StructType(
    [
        T.StructField("problem", T.StringType()),
        T.StructField(
            "completions",
            T.ArrayType(T.StructType([T.StructField("output", T.StringType()), T.StructField("acc", T.DoubleType())])),
        ),
        T.StructField("acc", T.DoubleType()),
        T.StructField("maj_acc", T.DoubleType()),
    ]
)

EVAL_REQUEST = T.StructType(
    [
        T.StructField("request_type", T.StringType()),
        T.StructField("doc", T.StringType()),  # raw JSON; tasks read it by path
        T.StructField(
            "request",
            T.StructType([T.StructField("context", T.StringType()), T.StructField("continuation", T.StringType())]),
        ),
        T.StructField("idx", T.IntegerType()),
        T.StructField("label", T.StringType()),  # a number or a name
        T.StructField("doc_id", T.LongType()),
    ]
)

# Metric names of request files and the names used here.
METRIC_NAMES = {"acc_raw": "acc", "acc_per_char": "len_norm", "acc_uncond": "pmi_dc", "logits_per_byte": "bpb"}


def read_lines(spark: SparkSession, path: str, number: bool = False) -> DataFrame:
    """Text lines with their file, and with their 0-based line number when asked for.

    Numbered lines are written once with their split and their place in it, then counted per split from what was
    written: a second scan of the files might cut them elsewhere, as the cuts follow the cluster's size. No file is
    pulled into one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), TEXT_COLUMN
    )
    if not number:
        return raw.drop("_block")
    placed = materialize(raw.withColumn("_id", F.monotonically_increasing_id()), "lines")
    splits = placed.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return placed.join(offsets, ["file", "_block"]).select(
        "file", (F.col("_off") + F.col("_id") - F.col("_first")).alias("line_no"), TEXT_COLUMN
    )


def read_parts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Text in folders ``column=value``, however many there are: each core lists its share of them.

    Spark's own number of listing tasks, one for each of up to 10,000 folders, makes the list cost more than the text.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.schema(schema).text(path)
    finally:
        spark.conf.set(name, before)


def _metadata(columns: Sequence[str]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])


def read_parquet_docs(
    spark: SparkSession, path: str, text_key: str = "text", id_key: str | None = None, keep_metadata: Sequence[str] = ()
) -> DataFrame:
    """``id, text, metadata`` of a parquet corpus; only the named columns are read."""
    fallback = F.concat_ws("/", "_metadata.file_path", F.col("_metadata.row_index").cast("string"))
    ident = F.coalesce(F.col(id_key).cast("string"), fallback) if id_key else fallback
    return spark.read.parquet(path).select(
        ident.alias("id"), F.col(text_key).alias("text"), _metadata(keep_metadata).alias("metadata")
    )


def read_jsonl_docs(
    spark: SparkSession, path: str, schema: T.StructType, text_key: str = "text", id_key: str | None = "id",
    keep_metadata: Sequence[str] = (), number: bool = True,
) -> DataFrame:
    """``id, text, metadata`` of JSON lines (plain, gzip or zstd); a missing id becomes ``path/line``.

    ``number=False`` saves the numbering pass for corpora known to have ids everywhere.
    """
    parsed = read_lines(spark, path, number).withColumn("_r", F.from_json(TEXT_COLUMN, schema)).filter(
        strip(TEXT_COLUMN) != ""
    )
    flat = parsed.select("file", *(["line_no"] if number else []), "_r.*")
    own = F.col(id_key).cast("string") if id_key else F.lit(None).cast("string")
    ident = F.coalesce(own, F.concat_ws("/", "file", F.col("line_no").cast("string"))) if number else own
    return flat.select(ident.alias("id"), F.col(text_key).alias("text"), _metadata(keep_metadata).alias("metadata"))


def read_json_arrays(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """Every element of a JSON array line becomes a row with its index as ``id``; unreadable lines drop out."""
    parsed = read_lines(spark, path).withColumn("_a", F.from_json(TEXT_COLUMN, T.ArrayType(element)))
    return parsed.select("file", F.posexplode("_a").alias("id", "_e")).select("file", "id", "_e.*")


def count_bad_arrays(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """Readable and unreadable lines of a file of JSON arrays (one row)."""
    bad = F.from_json(TEXT_COLUMN, T.ArrayType(element)).isNull()
    return read_lines(spark, path).filter(strip(TEXT_COLUMN) != "").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(bad.cast("int")).alias("n_bad")
    )


_TEXT_ONLY = T.StructType([T.StructField("text", T.StringType()), T.StructField("_corrupt_record", T.StringType())])


def _raw_text(spark: SparkSession, path: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return read_lines(spark, path).select(F.from_json(TEXT_COLUMN, _TEXT_ONLY, options).alias("_r")).select(
        strip("_r.text").alias("text"), F.col("_r._corrupt_record").isNotNull().alias("bad")
    )


def read_text_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The stripped, non-empty ``text`` fields of JSON lines; other fields and bad lines are skipped."""
    return _raw_text(spark, path).filter(~F.col("bad") & (F.col("text") != "")).select("text")


def text_jsonl_report(spark: SparkSession, path: str) -> DataFrame:
    """Lines, bad lines and empty texts of such a file (one row)."""
    return _raw_text(spark, path).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("bad").cast("int")).alias("n_bad"),
        F.sum((~F.col("bad") & (F.coalesce("text", F.lit("")) == "")).cast("int")).alias("n_empty"),
    )


def read_any(spark: SparkSession, path: str, split: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, JSON, JSON lines or CSV by file extension; ``split`` names a sub-folder.

    A folder may mix them: the files of each format are read as such, and the rows are united by column name.
    """
    root = f"{path.rstrip('/')}/{split}" if split else path
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)  # names only
    ending = F.regexp_extract("path", r"(\.[A-Za-z0-9]+(?:\.(?:gz|zst|bz2))?)$", 1)
    endings = sorted(r[0] for r in listed.select(ending).distinct().collect())  # a handful
    if not endings:
        raise FileNotFoundError(root)
    formats = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".csv": "csv"}
    found: dict[str, list[str]] = {}
    for name in endings:
        kind = re.sub(r"\.(gz|zst|bz2)$", "", name).lower()
        if kind not in formats:
            raise ValueError(f"no reader for {name or 'nameless'} files")
        found.setdefault(formats[kind], []).append(name)
    out = None
    for kind, names in found.items():
        reader = spark.read.format(kind).option("pathGlobFilter", "*{" + ",".join(names) + "}")
        if schema is not None:
            reader = reader.schema(schema)
        if kind == "csv":
            reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
        part = reader.load(root)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_eval_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records without the metrics line; of a repeated problem the last record counts."""
    lines = read_lines(spark, path, number=True)
    records = lines.select("file", "line_no", F.from_json(TEXT_COLUMN, EVAL_RECORD).alias("_r")).filter(
        F.col("_r.problem").isNotNull()
    )
    last = records.groupBy(F.col("_r.problem").alias("problem")).agg(
        F.max_by("_r", F.struct("file", "line_no")).alias("_r")
    )
    return last.select("problem", "_r.completions", "_r.acc", "_r.maj_acc")


def primary_metric(spark: SparkSession, folder: str) -> DataFrame:
    """One row with the ``metric`` that the folder's config names (null: none, or one that is not known)."""
    names = F.create_map(*[F.lit(x) for kv in METRIC_NAMES.items() for x in kv])
    config = spark.read.option("wholetext", "true").text(f"{folder.rstrip('/')}/config.json").agg(F.max(TEXT_COLUMN).alias("_c"))
    return config.select(F.try_element_at(names, F.get_json_object("_c", "$.task_config.primary_metric")).alias("metric"))


def read_eval_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of one evaluation folder (``requests.jsonl`` or ``.gz``) with the metric of its config."""
    root = folder.rstrip("/")
    requests = read_lines(spark, f"{root}/requests.jsonl*").select(F.from_json(TEXT_COLUMN, EVAL_REQUEST).alias("_r"))
    flat = requests.select("_r.request_type", "_r.doc", "_r.request.*", "_r.idx", "_r.label", "_r.doc_id")
    return flat.crossJoin(F.broadcast(primary_metric(spark, folder)))  # one row


def custom_table(spark: SparkSession, name: str, module: str | None = None, **arguments) -> DataFrame:
    """Table from a caller's own function ``fn(spark, **arguments)``, named with its module (``a.b.fn``) or beside it."""
    if module is None:
        module, _, name = (name or "").rpartition(".")
    if not module or not name:
        raise ValueError("name the function with its module, or give the module")
    return getattr(importlib.import_module(module), name)(spark, **arguments)


def flatten_qa(
    df: DataFrame, passages: str = "passages", context: str = "context", questions: str = "questions",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Nested benchmark rows to one row per question; missing text becomes an empty string."""
    per_passage = df.select(*keep, F.posexplode(passages).alias("passage_no", "_p"))
    per_question = per_passage.select(
        *keep, "passage_no", F.coalesce(F.col(f"_p.{context}"), F.lit("")).alias("context"),
        F.posexplode(f"_p.{questions}").alias("question_no", "_q"),
    )
    fields = per_question.schema["_q"].dataType.fields
    return per_question.select(
        *keep, "passage_no", "question_no", "context",
        *[
            (F.coalesce(F.col(f"_q.{f.name}"), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f"_q.{f.name}")).alias(f.name)
            for f in fields
        ],
    )
