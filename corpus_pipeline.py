"""A corpus pipeline of five operators: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes the documents that the stage before it kept, as a written table, and the last returns packed pieces.
All columns of ``documents`` pass through, whatever they are called; a stage needs doc_id and text. Null texts count as
empty, repeated rows as rows of their own (near-duplicates keep one of them), and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, line_dedup, packing, quality, simhash_pivots
from tallyloom.llm.common import fresh
from tallyloom.llm.queries import table
from tallyloom.plans.scratch import materialize

#: SQL has no conditional random field, fingerprints or tokenizer; the tests compare each stage with a plain version.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level quality model does not reject (score of 0.5 or more); without labels all stay."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand earlier in the corpus; n_chars follows where a text changes. Every row stays."""
    lines, gone = fresh(docs, "lines", "gone_lines")
    out = line_dedup.without_repeated_lines(docs, counts=(lines, gone))
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, changed).otherwise(F.col("n_chars")))
    return out.drop(lines, gone)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each set of texts linked by fingerprints (four-word shingles, at most 4 differing bits) the document with the smallest id."""
    return simhash_pivots.keep_one(docs, size=4, bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a passage of the benchmark."""
    return decontaminate.keep_clean(docs, decontaminate.prepare(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
