"""Source and sink queries: the tables are written in the file format under test and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import tokens as tk
from ..plans.layout import spread
from ..plans.ordering import running_sum
from ..plans.scratch import scratch_path
from ..sources import readers as rd
from ..sources import writers as wr
from .registry import ORACLES, Tables, query
from .rows import rw

DOC_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@query("s1_parquet_docs", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_md5, lang, source FROM documents")
def _(t: Tables):
    docs = rd.read_parquet_docs(t.spark, f"{t.dir}/documents.parquet", "text", "doc_id", ["lang", "source"])
    return docs.select("id", F.md5("text").alias("text_md5"), F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


@query("s2_jsonl_docs", "SELECT doc_id % 5 = 0 AS numbered, count(*) AS n, count(DISTINCT doc_id) AS n_ids, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    # every fifth document has no id and gets its place in the file instead
    ident = F.when(F.col("doc_id") % 5 > 0, F.col("doc_id").cast("string"))
    wr.write_jsonl(t.documents.select(ident.alias("id"), "text", "lang"), path, "gzip")
    docs = rd.read_jsonl_docs(t.spark, path, DOC_SCHEMA, "text", "id", ["lang"])
    return docs.groupBy(F.contains("id", F.lit("/")).alias("numbered")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.sum(F.length("text")).alias("n_chars")
    )


TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def conversation_arrays(t: Tables) -> str:
    """One JSON array per conversation and one broken line per system message."""
    path = scratch_path(t.spark, "arrays")
    turns = F.sort_array(F.collect_list(F.struct("turn", "conv_id", "role", "text")))
    good = t.conversations.groupBy("conv_id").agg(F.to_json(F.transform(turns, lambda x: x.dropFields("turn"))).alias("value"))
    bad = t.conversations.filter("role = 'system'").select(F.concat(F.lit('[{"conv_id": 1, "role": '), "role").alias("value"))
    good.select("value").unionByName(bad).write.text(path)
    return path


@query(
    "s3_json_arrays",
    "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS id, role, md5(text) AS text_md5 FROM conversations",
)
def _(t: Tables):
    rows = rd.read_json_arrays(t.spark, conversation_arrays(t), TURN)
    return rows.select("conv_id", "id", "role", F.md5("text").alias("text_md5"))


@query(
    "s3_bad_line_count",
    "SELECT count(DISTINCT conv_id) + count(*) FILTER (role = 'system') AS n_lines, count(*) FILTER (role = 'system') AS n_bad FROM conversations",
)
def _(t: Tables):
    return rd.count_bad_arrays(t.spark, conversation_arrays(t), TURN)


def raw_lines(t: Tables) -> str:
    """Text lines with a further field; every seventh is broken, every eleventh blank."""
    path = scratch_path(t.spark, "raw")
    key = F.col("doc_id")
    text = F.when(key % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    line = F.to_json(F.struct(text.alias("text"), key.alias("extra")))
    broken = F.when(key % 7 == 0, F.substring(line, 1, 15)).otherwise(line)
    t.documents.select(broken.alias("value")).write.option("compression", "gzip").text(path)
    return path


@query(
    "s4_text_jsonl",
    r"SELECT md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_md5, count(*) AS n FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0 AND trim(text) <> '' GROUP BY 1",
)
def _(t: Tables):
    return rd.read_text_jsonl(t.spark, raw_lines(t)).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_text_jsonl_report",
    "SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 7 = 0) AS n_bad, count(*) FILTER (doc_id % 7 > 0 AND (doc_id % 11 = 0 OR trim(text) = '')) AS n_empty FROM documents",
)
def _(t: Tables):
    return rd.text_jsonl_report(t.spark, raw_lines(t))


@query(
    "s5_read_any",
    """
    SELECT format, c_custkey, c_name, c_mktsegment FROM customer, (SELECT unnest(['parquet', 'json', 'csv']) AS format)
    """,
)
def _(t: Tables):
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    root = scratch_path(t.spark, "formats")
    rows.write.parquet(f"{root}/p/train")
    rows.write.json(f"{root}/j/train")
    rows.write.option("header", "true").csv(f"{root}/c/train")
    out = None
    for name, folder in (("parquet", "p"), ("json", "j"), ("csv", "c")):
        read = rd.read_any(t.spark, f"{root}/{folder}", "train", rows.schema).select(F.lit(name).alias("format"), *rows.columns)
        out = read if out is None else out.unionByName(read)
    return out


@query("s7_sft_arrays", f"SELECT 256 AS seq_len, true AS same_length, count(*) AS n, sum(n_labels)::BIGINT AS n_labels FROM ({ORACLES['p8_label_mask']})")
def _(t: Tables):
    written = wr.write_sft_arrays(rw.label_mask(t.conversations, 256), scratch_path(t.spark, "sft"))
    labels = F.size(F.filter("label_mask", lambda x: x))
    same = F.size("tokens") == F.size("label_mask")
    return written.groupBy(F.size("tokens").alias("seq_len"), same.alias("same_length")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(labels).alias("n_labels")
    )


@query("s8_write_jsonl", "SELECT event_id, event_type AS output, value AS reward FROM events")
def _(t: Tables):
    path = scratch_path(t.spark, "rewards")
    rows = t.events.select("event_id", F.col("event_type").alias("output"), F.col("value").alias("reward"))
    wr.write_jsonl(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query(
    "s9_eval_records",
    """
    SELECT 'p' || user_id AS problem, 'e' || max(event_id) AS output, arg_max(value, event_id) AS acc, (max(event_id) % 2)::DOUBLE AS maj_acc FROM events GROUP BY user_id
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "records")
    record = F.to_json(
        F.struct(
            F.format_string("p%d", "user_id").alias("problem"),
            F.array(F.struct(F.format_string("e%d", "event_id").alias("output"), F.col("value").alias("acc"))).alias("completions"),
            F.col("value").alias("acc"), (F.col("event_id") % 2).cast("double").alias("maj_acc"),
        )
    )
    # files in event order, the last one closed by a metrics line
    metrics = t.events.agg(F.to_json(F.struct(F.avg("value").alias("final_accuracy"))).alias("value"), F.lit(1 << 60).alias("o"))
    lines = t.events.select(record.alias("value"), F.col("event_id").alias("o")).unionByName(metrics)
    lines.orderBy("o").select("value").write.text(path)
    return rd.read_eval_records(t.spark, path).select("problem", F.get("completions", F.lit(0))["output"].alias("output"), "acc", "maj_acc")


@query(
    "s10_eval_requests",
    "SELECT item_id AS doc_id, 'loglikelihood' AS request_type, (item_id % 4)::INT AS idx, (item_id % 3)::VARCHAR AS label, length(text) AS n_chars, 'len_norm' AS metric FROM benchmark",
)
def _(t: Tables):
    root = scratch_path(t.spark, "requests")
    line = F.to_json(
        F.struct(
            F.lit("loglikelihood").alias("request_type"), F.struct(F.col("text").alias("q")).alias("doc"),
            F.struct(F.col("text").alias("context"), F.lit(" yes").alias("continuation")).alias("request"),
            (F.col("item_id") % 4).alias("idx"), (F.col("item_id") % 3).alias("label"), F.col("item_id").alias("doc_id"),
        )
    )
    t.benchmark.select(line.alias("value")).write.option("compression", "gzip").text(f"{root}/requests.jsonl.gz")
    config = t.benchmark.agg(F.count(F.lit(1)).alias("n_docs")).select(
        F.to_json(F.struct(F.struct(F.lit("acc_per_char").alias("primary_metric"), "n_docs").alias("task_config"))).alias("value")
    )
    config.write.text(f"{root}/config.json")
    return rd.read_eval_requests(t.spark, root).select(
        "doc_id", "request_type", "idx", "label", F.length("context").cast("bigint").alias("n_chars"), "metric"
    )


LINES_SQL = """
    l AS (SELECT source AS file, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS line_no, string_split(text, chr(10))[i + 1] AS line
          FROM (SELECT *, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents))
"""


def doc_lines(t: Tables):
    """Documents split by line; the source is the file, and its lines are numbered without gaps."""
    docs = spread(t.documents.select("doc_id", F.col("source").alias("file"), "text"), "doc_id")
    sizes = t.documents.select("doc_id", F.col("source").alias("file"), F.size(F.split("text", "\n")).alias("n_lines"))
    before = running_sum(sizes, "n_lines", "doc_id", ["file"], "before").select("doc_id", "before")
    long = docs.join(before, "doc_id").select("file", "before", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return long.select("file", (F.col("before") + F.col("i")).cast("bigint").alias("line_no"), "line")


@query(
    "s11_split_by_size",
    f"""
    WITH {LINES_SQL}, b AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY line_no) - strlen(line) - 1 AS before FROM l)
    SELECT file, (before // 20000)::BIGINT AS part, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes FROM b GROUP BY ALL
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "parts")
    wr.write_size_limited(doc_lines(t), path, 20_000, "file", "line_no", "line")
    parts = rd.read_parts(t.spark, path, "value string, file string, part bigint")
    return parts.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value")).alias("n_bytes"))


def result_rows(t: Tables):
    return t.events.groupBy(F.col("event_type").alias("task")).agg(
        F.count(F.lit(1)).alias("num_instances"), F.round(F.avg("value"), 9).alias("metric")
    )


@query(
    "s13_append_results",
    """
    SELECT event_type AS task, count(*) AS num_instances, round(avg(value), 9) AS metric, date, 'greedy' AS decoding
    FROM events, (SELECT unnest(['2024-01-01 00:00:00 UTC', '2024-01-02 00:00:00 UTC']) AS date) GROUP BY event_type, date
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "results")
    for stamp in ("2024-01-01 00:00:00 UTC", "2024-01-02 00:00:00 UTC"):
        wr.append_results(result_rows(t), path, stamp, {"decoding": "greedy"})
    return t.spark.read.parquet(path)


@query(
    "s14_metric_tables",
    """
    SELECT 'value' AS type, event_type AS task, round(avg(value), 9) AS mean, max(value) AS top FROM events GROUP BY ALL UNION ALL
    SELECT 'user', event_type, round(avg(user_id), 9), max(user_id)::DOUBLE FROM events GROUP BY ALL
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "metric-tables")
    inner = lambda c: F.create_map(F.lit("mean"), F.round(F.avg(c), 9), F.lit("top"), F.max(c).cast("double"))
    rows = t.events.groupBy(F.col("event_type").alias("task")).agg(
        F.create_map(F.lit("value"), inner("value"), F.lit("user"), inner("user_id")).alias("metrics")
    )
    kinds = wr.write_metric_tables(rows, path, ["task"])
    tables = [t.spark.read.parquet(f"{path}/{k}").select(F.lit(k).alias("type"), "task", "mean", "top") for k in kinds]
    return tables[0].unionByName(tables[1])


@query("s15_read_or_build", "SELECT user_id, max(value) AS best FROM events GROUP BY user_id")
def _(t: Tables):
    path = scratch_path(t.spark, "expert")
    build = lambda: t.events.groupBy("user_id").agg(F.max("value").alias("best"))
    wr.read_or_build(t.spark, path, build)

    def again():
        raise AssertionError("the saved table must be reused")

    return wr.read_or_build(t.spark, path, again)


@query(
    "s16_flatten_qa",
    """
    SELECT conv_id, (turn // 2)::INT AS passage_no, (row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) - 1)::INT AS question_no,
           CASE WHEN turn // 2 % 2 = 0 THEN 'p' || conv_id ELSE '' END AS context, md5(text) AS question, CASE WHEN role = 'assistant' THEN role ELSE '' END AS answer
    FROM conversations
    """,
)
def _(t: Tables):
    path = scratch_path(t.spark, "nested")
    question = F.struct("turn", F.md5("text").alias("question"), F.when(F.col("role") == "assistant", F.col("role")).alias("answer"))
    passage = t.conversations.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("p")).agg(
        F.transform(F.sort_array(F.collect_list(question)), lambda q: q.dropFields("turn")).alias("questions")
    )
    context = F.when(F.col("p") % 2 == 0, F.concat(F.lit("p"), F.col("conv_id").cast("string")))
    nested = passage.select("conv_id", F.struct("p", context.alias("context"), "questions").alias("x")).groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("x")), lambda x: x.dropFields("p")).alias("passages")
    )
    wr.write_jsonl(nested, path)
    return rd.flatten_qa(t.spark.read.schema(nested.schema).json(path), keep=["conv_id"])


@query(
    "s17_lines_to_pages",
    f"""
    WITH {LINES_SQL}, h AS (SELECT file, line_no, CASE WHEN length(line) % 7 = 0 AND length(line) > 0 THEN '= ' || line || ' =' ELSE line END AS line FROM l),
    n AS (SELECT *, regexp_matches(regexp_replace(replace(replace(line, '= = =', '==='), '= =', '=='), '^\\s+|\\s+$', '', 'g'), '(?s)^= .* =$') AS head FROM h),
    p AS (SELECT *, (sum(head::INT) OVER (PARTITION BY file ORDER BY line_no))::BIGINT AS page_no FROM n),
    g AS (SELECT file, page_no, string_agg(line, chr(10) ORDER BY line_no) AS page FROM p GROUP BY ALL)
    SELECT file, page_no, md5(page) AS page_md5 FROM g WHERE regexp_matches(page, '\\S')
    """,
)
def _(t: Tables):
    heading = F.when((F.length("line") % 7 == 0) & (F.length("line") > 0), F.concat(F.lit("= "), "line", F.lit(" ="))).otherwise(F.col("line"))
    pages = tk.lines_to_pages(doc_lines(t).withColumn("line", heading), "file", "line_no", "line")
    return pages.select("file", "page_no", F.md5("page").alias("page_md5"))


@query("x6_custom_table", "SELECT doc_id::VARCHAR AS id, length(text) AS n_chars, lang FROM documents")
def _(t: Tables):
    docs = rd.custom_table(
        t.spark, "tallyloom.sources.readers.read_parquet_docs", path=f"{t.dir}/documents.parquet", id_key="doc_id", keep_metadata=["lang"]
    )
    return docs.select("id", F.length("text").cast("bigint").alias("n_chars"), F.col("metadata")["lang"].alias("lang"))
