"""Join queries: run comparison, result collection, roll-up, look-ups and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as ne
from ..functions import text as tx
from ..operators import joins as jn
from ..operators import metrics as mt
from .functions_arrays import nested_json
from .functions_text import REPLIES
from .metrics import CATEGORY_SQL, categories, subject_rows, with_k
from .registry import Tables, fill, query, sql_fill

RUNS_SQL = """
    base AS (SELECT 'q' || event_id AS question, event_type AS output, (value >= 50)::INT::DOUBLE AS acc FROM events),
    ckpt AS (SELECT 'q' || (event_id + 100) AS question, props AS output, ((props->>'$.k')::INT >= 50)::INT::DOUBLE AS acc FROM events)
"""


def runs(t: Tables):
    """Two runs over all events; the question numbers of the second are shifted, so some stay unmatched."""
    name = lambda shift: F.concat(F.lit("q"), (F.col("event_id") + shift).cast("string")).alias("question")
    base = t.events.select(name(0), F.col("event_type").alias("output"), mt.truth(F.col("value") >= 50).alias("acc"))
    ckpt = with_k(t).select(name(100), F.col("props").alias("output"), mt.truth(F.col("k") >= 50).alias("acc"))
    return base, ckpt


@query(
    "j2_compare_runs",
    f"""
    WITH {RUNS_SQL} SELECT question, b.output AS base_output, b.acc AS base_acc, c.output AS ckpt_output, c.acc AS ckpt_acc
    FROM base b JOIN ckpt c USING (question)
    """,
)
def _(t: Tables):
    return jn.compare_runs(*runs(t))


@query("j2_unmatched_questions", f"WITH {RUNS_SQL} SELECT count(*) AS n_missing FROM base WHERE question NOT IN (SELECT question FROM ckpt)")
def _(t: Tables):
    return jn.unmatched_count(*runs(t))


@query(
    "p11_newly_right",
    f"WITH {RUNS_SQL} SELECT question, b.output AS base_output, c.output AS ckpt_output FROM base b JOIN ckpt c USING (question) WHERE b.acc = 0 AND c.acc = 1",
)
def _(t: Tables):
    return jn.newly_right(jn.compare_runs(*runs(t))).select("question", "base_output", "ckpt_output")


MULTI_SQL = """
    m AS (SELECT user_id || '/' || (props->>'$.k')::INT % 20 AS question, event_id AS idx, event_type AS output, (value >= 50)::INT::DOUBLE AS b, (value >= 40)::INT::DOUBLE AS c FROM events),
    f AS (SELECT question, arg_min(output, idx) AS base_output, max(b) AS base_acc FROM m GROUP BY question),
    l AS (SELECT question, coalesce(arg_min(output, idx) FILTER (c = 1), arg_max(output, idx)) AS ckpt_output, max(c) AS ckpt_acc FROM m GROUP BY question)
"""


def multi_runs(t: Tables):
    rows = with_k(t).select(
        F.concat_ws("/", F.col("user_id").cast("string"), (F.col("k") % 20).cast("string")).alias("question"),
        F.col("event_id").alias("idx"), F.col("event_type").alias("output"),
        mt.truth(F.col("value") >= 50).alias("b"), mt.truth(F.col("value") >= 40).alias("c"),
    )
    return rows.withColumnRenamed("b", "acc").drop("c"), rows.withColumnRenamed("c", "acc").drop("b")


@query("j3_compare_runs_multi", f"WITH {MULTI_SQL} SELECT * FROM f JOIN l USING (question)")
def _(t: Tables):
    return jn.compare_runs_multi(*multi_runs(t))


@query(
    "j5_collect_results",
    "SELECT event_type AS task, user_id AS doc, string_agg(props, '|' ORDER BY event_id) AS results FROM events GROUP BY ALL",
)
def _(t: Tables):
    origin = t.events.select(F.col("event_type").alias("task"), F.col("user_id").alias("doc"), F.col("event_id").alias("i"))
    responses = t.events.select(F.col("event_type").alias("task"), F.col("event_id").alias("i"), F.col("props").alias("response"))
    listed = jn.collect_results(responses, origin, ["task", "i"], ["task", "doc"], "i", "response")
    return listed.select("task", "doc", F.array_join("results", "|").alias("results"))


@query(
    "j7_category_join",
    f"WITH {CATEGORY_SQL} SELECT category, sub, count(*) AS n, sum(ok::INT)::BIGINT AS n_right FROM rows JOIN map USING (subject) GROUP BY ALL",
)
def _(t: Tables):
    joined = jn.category_join(subject_rows(t), categories(t), "subject")
    return joined.groupBy("category", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("n_right"))


LOG_SQL = """
    log AS (SELECT event_id // 8 AS step, (event_id % 8)::INT AS slot, event_id * 31 % (SELECT count(*) FROM documents) AS instance_id FROM events)
"""


def index_log(t: Tables):
    """The events as index log: eight instance numbers per step line."""
    total = t.documents.agg(F.count(F.lit(1)).alias("_n"))
    ids = t.events.select("event_id").crossJoin(F.broadcast(total)).select(
        F.floor(F.col("event_id") / 8).alias("step"), F.col("event_id").alias("o"), (F.col("event_id") * 31 % F.col("_n")).cast("string").alias("id")
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("o", "id"))), lambda s: s["id"])
    return ids.groupBy("step").agg(listed.alias("l")).select(
        F.concat_ws("\t", F.col("step").cast("string"), F.array_join("l", "\t")).alias("value")
    )


@query(
    "j8_examples_at",
    f"WITH {LOG_SQL} SELECT step, slot, instance_id, source, n_chars FROM log JOIN documents ON instance_id = doc_id",
)
def _(t: Tables):
    log = jn.parse_index_log(index_log(t))
    instances = t.documents.select(F.col("doc_id").alias("instance_id"), "source", "n_chars")
    return jn.examples_at(log, instances).select("step", "slot", "instance_id", "source", "n_chars")


@query(
    "j10_diff_configs",
    """
    WITH l AS (SELECT event_id, unnest([{k: 'a.b', v: '[{"c":' || event_id || '},{"c":' || user_id || '}]'}, {k: 'a.d', v: event_type},
                      {k: 'e', v: (event_id % 9)::VARCHAR}, {k: 'f.k', v: props->>'$.k'}]) AS s FROM events),
    r AS (SELECT event_id, unnest([{k: 'a.d', v: event_type}, {k: 'e', v: (event_id % 7)::VARCHAR}, {k: 'g', v: user_id::VARCHAR}]) AS s FROM events),
    j AS (SELECT coalesce(l.event_id, r.event_id) AS event_id, coalesce(l.s.k, r.s.k) AS key, l.s.v AS left_value, r.s.v AS right_value,
                 l.event_id IS NULL AS no_left, r.event_id IS NULL AS no_right FROM l FULL JOIN r ON l.event_id = r.event_id AND l.s.k = r.s.k)
    SELECT event_id, key, left_value, right_value, CASE WHEN no_right THEN 'left' WHEN no_left THEN 'right' ELSE 'both' END AS side
    FROM j WHERE no_left OR no_right OR left_value IS DISTINCT FROM right_value
    """,
)
def _(t: Tables):
    left = t.events.select("event_id", F.explode(ne.flatten_json(nested_json())).alias("key", "value"))
    fields = F.create_map(
        F.lit("a.d"), F.col("event_type"), F.lit("e"), (F.col("event_id") % 7).cast("string"), F.lit("g"), F.col("user_id").cast("string")
    )
    right = t.events.select("event_id", F.explode(fields).alias("key", "value"))
    return jn.diff_configs(left, right, ["event_id", "key"])


@query(
    "j10_diff_path_lists",
    r"""
    WITH l AS (SELECT regexp_replace(url, '/[^/]*$', '') AS dir, count(*) AS n FROM pages GROUP BY 1),
    r AS (SELECT regexp_replace(replace(url, 'http://', 'https://'), '/[^/]*$', '') AS dir, count(*) AS n FROM pages GROUP BY 1)
    SELECT dir, coalesce(l.n, 0) AS n_left, coalesce(r.n, 0) AS n_right FROM l FULL JOIN r USING (dir) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)
    """,
)
def _(t: Tables):
    right = t.pages.select(F.replace("url", F.lit("http://"), F.lit("https://")).alias("url"))
    return jn.diff_path_lists(t.pages.select("url"), right, "url")


@query("j11_zip_by_index", "SELECT event_id, event_type AS result, props AS doc FROM events")
def _(t: Tables):
    results = t.events.select("event_id", F.col("event_type").alias("result"))
    docs = t.events.select("event_id", F.col("props").alias("doc"))
    return jn.zip_by_index(results, docs, "event_id")


@query(
    "j13_attach_labels",
    "SELECT event_id, user_id, event_type, c_mktsegment AS label FROM events JOIN customer ON user_id = c_custkey",
)
def _(t: Tables):
    prompts = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("label"))
    return jn.attach_labels(t.events.select("event_id", "user_id", "event_type"), prompts, "user_id")


@query(
    "a45_judge_counts",
    rf"""
    WITH r AS (SELECT event_id, {sql_fill(REPLIES, 'event_id', 'user_id', 'event_id')} AS s FROM events),
    l AS (SELECT event_id, unnest(list_distinct(list_transform(string_split(trim(array_to_string(regexp_extract_all(s, '(?s)<judge>(.*?)</judge>', 1), '')), ','),
             lambda x: trim(x)))) AS category FROM r)
    SELECT category, count(*) AS n_rows, count(DISTINCT event_id) AS n_docs FROM l WHERE category <> '' GROUP BY 1
    """,
)
def _(t: Tables):
    replies = t.events.select("event_id", tx.judge_labels(fill(REPLIES, "event_id", "user_id", "event_id")).alias("labels"))
    return mt.judge_counts(replies, "labels", "event_id")


