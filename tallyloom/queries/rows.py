"""Row-builder queries over conversations, parts, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import rows as rw
from ..operators import tasks as tk
from ..functions.common import div
from .registry import Tables, query

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
TURNS_SQL = """
    e AS (SELECT conv_id, arg_max(text, turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id),
    c AS (SELECT conv_id, (turn // 2)::BIGINT AS pair, max(text) FILTER (turn % 2 = 0) AS prompt, max(text) FILTER (turn % 2 = 1) AS first, any_value(last) AS last, any_value(n) AS n
          FROM conversations JOIN e USING (conv_id) GROUP BY ALL)
"""


def exchanges(t: Tables):
    """Every two turns of a conversation as message and answer, with the conversation's last message and number of turns."""
    at = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.col("text")))
    ends = t.conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.count(F.lit(1)).alias("n"))
    pairs = t.conversations.groupBy("conv_id", div("turn", 2).alias("pair")).agg(at(0).alias("prompt"), at(1).alias("first"))
    return pairs.join(ends, "conv_id").withColumn("key", F.concat_ws("-", "conv_id", "pair"))


@query("p1_concat_pair", f"WITH {TURNS_SQL} SELECT conv_id, pair, prompt || chr(10) || chr(10) || first AS text FROM c")
def _(t: Tables):
    return rw.concat_pair(exchanges(t), "prompt", "first").select("conv_id", "pair", "text")


@query(
    "p2_apply_template",
    f"WITH {TURNS_SQL} SELECT conv_id, pair, 'User: ' || prompt || chr(10) || 'Assistant: ' AS prompt, n::VARCHAR AS label FROM c",
)
def _(t: Tables):
    return rw.apply_template(exchanges(t), "User: {}\nAssistant: ", "prompt", "n").select("conv_id", "pair", "prompt", "label")


BODY_SQL = STRIP.format("text") + " || CASE WHEN role = 'assistant' THEN '</s>' ELSE '' END || chr(10)"


@query(
    "p3_render_chat",
    f"SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || {BODY_SQL}, '' ORDER BY turn) AS text "
    "FROM conversations GROUP BY conv_id",
)
def _(t: Tables):
    return rw.render_chat(t.conversations)


@query(
    "p4_sft_rows",
    rf"""
    WITH b AS (SELECT conv_id, turn, '<|' || role || '|>' || chr(10) AS head, {BODY_SQL} AS body,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    r AS (SELECT conv_id, string_agg(CASE WHEN back = 1 THEN head ELSE head || body END, '' ORDER BY turn) AS prompt,
                 max(body) FILTER (back = 1) AS response, count(*) AS n FROM b GROUP BY conv_id),
    l AS (SELECT conv_id, prompt, response, len(regexp_extract_all(prompt, '\S+'))::INT AS prompt_len,
                 regexp_replace(prompt || response, chr(10) || '+$', '') AS text FROM r WHERE n > 1)
    SELECT conv_id, prompt, response, prompt_len, CASE WHEN suffix(text, '</s>') THEN text ELSE text || ' </s>' END AS text
    FROM l WHERE response <> '' AND prompt_len < 598
    """,
)
def _(t: Tables):
    return rw.sft_rows(t.conversations, 600)


@query(
    "p5_response_ranges",
    rf"""
    WITH b AS (SELECT conv_id, turn, role, len(regexp_extract_all({BODY_SQL}, '\S+')) AS n FROM conversations),
    s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS st FROM b)
    SELECT conv_id, turn, st::INT AS start, (st + n - 1)::INT AS "end" FROM s WHERE role = 'assistant'
    """,
)
def _(t: Tables):
    return rw.response_ranges(t.conversations)


@query(
    "p6_preference_rows",
    rf"""
    WITH {TURNS_SQL} SELECT conv_id, pair, prompt, first AS chosen, last AS rejected, n::DOUBLE AS margin FROM c
    WHERE len(regexp_extract_all(prompt, '\S+')) < 58
    """,
)
def _(t: Tables):
    pairs = exchanges(t).select(
        "conv_id", "pair", "prompt", F.concat("prompt", "first").alias("chosen"), F.concat("prompt", "last").alias("rejected"), "n"
    )
    return rw.preference_rows(pairs, 60, margin="n")


@query(
    "p7_unpaired_rows",
    r"""
    SELECT d.doc_id, d.lang || ' ' || d.source AS prompt, d.text AS response, l.quality AS label
    FROM documents d JOIN labels l USING (doc_id)
    """,
)
def _(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.concat_ws(" ", "lang", "source").alias("p"), "text", "quality"
    )
    return rw.unpaired_rows(rows, 64, "p", "text", "quality")


@query(
    "p8_label_mask",
    rf"""
    WITH b AS (SELECT conv_id, turn, role, list_concat(list_concat(['<|' || role || '|>', chr(10)],
                  list_concat(regexp_extract_all(text, '\S+'), CASE WHEN role = 'assistant' THEN ['</s>'] ELSE []::VARCHAR[] END)), [chr(10)]) AS t
               FROM conversations),
    l AS (SELECT conv_id, 0::BIGINT AS turn, -1::BIGINT AS i, '</s>' AS tok, false AS m FROM (SELECT DISTINCT conv_id FROM b)
          UNION ALL SELECT conv_id, turn, i, t[i], role = 'assistant' AND i > 2 AND i < len(t) FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM b)),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos FROM l),
    f AS (SELECT conv_id, string_agg(tok, ' ' ORDER BY pos) AS tokens, string_agg(m::INT::VARCHAR, '' ORDER BY pos) AS mask,
                 sum(m::INT)::INT AS n_labels, count(*)::INT AS n FROM p WHERE pos <= 256 GROUP BY conv_id)
    SELECT conv_id, tokens || repeat(' <pad>', 256 - n) AS tokens, mask || repeat('0', 256 - n) AS mask, n_labels FROM f WHERE n_labels > 0
    """,
)
def _(t: Tables):
    m = rw.label_mask(t.conversations, 256)
    bits = F.transform("label_mask", lambda x: x.cast("int").cast("string"))
    return m.select("conv_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(bits, "").alias("mask"), "n_labels")


@query("p12_project_fields", "SELECT p_partkey, p_name, p_type FROM part")
def _(t: Tables):
    return rw.project_fields(rw.project_fields(t.part, drop=["p_brand", "p_size"]), keep=["p_partkey", "p_name", "p_type", "nothing"])


REQUESTS_SQL = """
    SELECT 999000 + user_id AS doc_id, event_id, (event_id % 4)::INT AS idx,
           CASE WHEN user_id % 7 = 0 THEN 'unit' ELSE (user_id % 4)::VARCHAR END AS label, -value / 10 AS ll, event_id % 50 = 0 AS alone FROM events
"""


def requests(t: Tables):
    key = F.col("event_id")
    return t.events.select(
        (F.lit(999_000) + F.col("user_id")).alias("doc_id"), "event_id", (key % 4).cast("int").alias("idx"),
        F.when(F.col("user_id") % 7 == 0, F.lit("unit")).otherwise((F.col("user_id") % 4).cast("string")).alias("label"),
        (-F.col("value") / 10).alias("ll"), (key % 50 == 0).alias("alone"),
    )


@query("p13_filter_requests", f"SELECT * REPLACE (0 AS idx, 0 AS label) FROM ({REQUESTS_SQL}) WHERE NOT alone AND (label = 'unit' OR idx::VARCHAR = label)")
def _(t: Tables):
    return rw.filter_requests(requests(t), "ce_loss", F.col("alone"))


MOUNTS = {"https://m.": "/mobile/", "https://": "/secure/", "http://": "/plain/"}


@query(
    "p14_remap_prefix",
    """
    SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN '/mobile/' || substr(url, 11) WHEN starts_with(url, 'https://')
      THEN '/secure/' || substr(url, 9) WHEN starts_with(url, 'http://') THEN '/plain/' || substr(url, 8) ELSE url END AS path FROM pages
    """,
)
def _(t: Tables):
    return rw.remap_prefix(t.pages, "url", MOUNTS, "path").select("page_id", "path")


CHOICE_SQL = """
    SELECT p_partkey, p_brand AS ctx, ' ' || p_name || ' ' || p_partkey AS q, p_type || ' ' AS c1, CASE WHEN p_size % 3 > 0 THEN 'size ' || p_size END AS c2,
           ' ' || p_brand AS c3, p_name AS c4, [ 'A', 'b', 'C', '' ][p_size % 4 + 1] AS letter FROM part
"""


def choice_parts(t: Tables):
    size = F.col("p_size")
    return t.part.select(
        "p_partkey", F.col("p_brand").alias("ctx"), F.format_string(" %s %d", "p_name", "p_partkey").alias("q"),
        F.concat("p_type", F.lit(" ")).alias("c1"), F.when(size % 3 > 0, F.format_string("size %d", size)).alias("c2"),
        F.concat(F.lit(" "), "p_brand").alias("c3"), F.col("p_name").alias("c4"),
        F.element_at(F.array(*[F.lit(x) for x in ("A", "b", "C", "")]), size % 4 + 1).alias("letter"),
    )


@query(
    "p15_multiple_choice",
    f"""
    SELECT p_partkey, trim(ctx) || ' ' || trim(q) AS question, concat_ws('|', trim(c1), trim(c2), trim(c3), trim(c4)) AS choices,
           CASE WHEN letter <> '' THEN ascii(lower(letter)) - 97 END AS correct_index FROM ({CHOICE_SQL})
    """,
)
def _(t: Tables):
    mc = rw.to_multiple_choice(choice_parts(t), "q", ["c1", "c2", "c3", "c4"], answer="letter", context="ctx")
    return mc.select("p_partkey", "question", F.array_join("answer_choices", "|").alias("choices"), "correct_index")


@query(
    "p16_shuffle_choices",
    f"""
    WITH c AS (SELECT p_partkey, trim(q) AS question, unnest(range(0, 3)) AS i, [trim(c1), trim(c3), trim(c4)] AS cs FROM ({CHOICE_SQL})),
    o AS (SELECT *, cs[i + 1] AS c, row_number() OVER (PARTITION BY p_partkey ORDER BY md5(question || ':' || i)) - 1 AS pos FROM c)
    SELECT p_partkey, question, string_agg(c, '|' ORDER BY pos) AS choices, (max(pos) FILTER (i = 2))::INT AS correct_index
    FROM o GROUP BY p_partkey, question
    """,
)
def _(t: Tables):
    mc = rw.to_multiple_choice(choice_parts(t), "q", ["c1", "c3", "c4"], correct_field="c4").drop("c2", "letter", "ctx")
    return mc.select("p_partkey", "question", F.array_join("answer_choices", "|").alias("choices"), "correct_index")


@query(
    "p17_classification",
    """
    SELECT doc_id, text AS premise, lang AS hypothesis, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS label
    FROM documents JOIN labels USING (doc_id)
    """,
)
def _(t: Tables):
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", "text", "lang", "quality")
    return rw.to_classification(rows, "text", "quality", {0: "low", 1: "high"}, "lang")


@query(
    "p18_io_rows",
    """
    SELECT 'translation' AS kind, doc_id::VARCHAR AS id, lang AS input, source AS target FROM documents UNION ALL
    SELECT 'classification', doc_id::VARCHAR, md5(text), lang FROM documents UNION ALL
    SELECT 'unlabeled', doc_id::VARCHAR, md5(text), NULL FROM documents
    """,
)
def _(t: Tables):
    docs = t.documents.select("doc_id", "lang", F.md5("text").alias("digest"), F.struct(F.col("lang").alias("xx"), F.col("source").alias("yy")).alias("pair"))
    parts = {
        "translation": rw.to_io_rows(docs, "translation", "doc_id", "pair", languages=("xx", "yy")),
        "classification": rw.to_io_rows(docs, "classification", "doc_id", "digest", "lang"),
        "unlabeled": rw.to_io_rows(docs, "unlabeled", "doc_id", "digest").withColumn("target", F.lit(None).cast("string")),
    }
    tagged = [df.select(F.lit(kind).alias("kind"), "*") for kind, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(
    "p19_truncate_prompt",
    """
    SELECT doc_id, array_to_string(string_split(text, ' ')[1:(('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT % 40)], ' ') AS text FROM documents
    """,
)
def _(t: Tables):
    return rw.truncate_prompt(t.documents.select("doc_id", "text"), "text", "doc_id", 40, 7)


MC_SQL = """
    SELECT p_partkey, lower(replace(p_brand, '#', '_')) AS subject, p_name || ' number ' || p_partkey AS question,
           [p_type, 'size ' || p_size, p_brand, p_name] AS choices, (p_size % 4)::INT AS answer FROM part
"""


def mc_parts(t: Tables):
    return t.part.select(
        "p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("subject"),
        F.format_string("%s number %d", "p_name", "p_partkey").alias("question"),
        F.array("p_type", F.format_string("size %d", "p_size"), "p_brand", "p_name").alias("choices"),
        (F.col("p_size") % 4).alias("answer"),
    )


_EXAMPLE = """question || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3]
           || chr(10) || 'D. ' || choices[4] || chr(10) || 'Answer:'"""
FEWSHOT_SQL = f"""
    p AS ({MC_SQL}),
    d AS (SELECT *, {_EXAMPLE} AS open, {_EXAMPLE} || ' ' || chr(65 + answer) || chr(10) || chr(10) AS solved,
                 row_number() OVER (PARTITION BY subject ORDER BY md5('3:' || subject || ':' || question || ':' || answer)) AS rk FROM p),
    s AS (SELECT a.p_partkey, a.subject, a.open, b.solved, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.rk) AS k
          FROM d a JOIN d b ON a.subject = b.subject AND a.p_partkey <> b.p_partkey AND b.rk <= 4),
    descr AS (SELECT p_partkey, 'The following are multiple choice questions (with answers) about  ' || replace(subject, '_', ' ') || '.' || chr(10) || chr(10) AS d,
                     open FROM d)
"""


def fewshot(t: Tables):
    # question and answer identify a row; each row may serve as an example for the others
    parts = mc_parts(t)
    return jn.fewshot_prompt(parts, parts, "subject", "question", "choices", "answer", 3, 3, ["question", "answer"])


@query(
    "j6_fewshot_join",
    f"WITH {FEWSHOT_SQL} SELECT p_partkey, string_agg(solved, '' ORDER BY k) AS shots, count(*) AS n FROM s WHERE k <= 3 GROUP BY p_partkey",
)
def _(t: Tables):
    return fewshot(t).select("p_partkey", F.array_join("shots", "").alias("shots"), F.size("shots").cast("bigint").alias("n"))



@query(
    "p20_fewshot_prompt",
    f"""
    WITH {FEWSHOT_SQL} SELECT p_partkey, d || string_agg(solved, '' ORDER BY k) || open AS prompt
    FROM descr JOIN (SELECT p_partkey, k, solved FROM s WHERE k <= 3) USING (p_partkey) GROUP BY p_partkey, d, open
    """,
)
def _(t: Tables):
    return fewshot(t).select("p_partkey", "prompt")


@query(
    "p21_fit_fewshot",
    rf"""
    WITH {FEWSHOT_SQL},
    w AS (SELECT p_partkey, k, solved, sum(len(regexp_extract_all(solved, '\S+'))) OVER (PARTITION BY p_partkey ORDER BY k) AS run FROM s WHERE k <= 3),
    f AS (SELECT p_partkey, d, open, len(regexp_extract_all(d, '\S+')) + len(regexp_extract_all(open, '\S+')) AS fixed FROM descr)
    SELECT p_partkey, d || coalesce(string_agg(solved, '' ORDER BY k) FILTER (fixed + run <= 55), '') || open AS prompt,
           (count(*) FILTER (fixed + run <= 55))::INT AS n_shots
    FROM f JOIN w USING (p_partkey) GROUP BY p_partkey, d, open
    """.replace(chr(92) * 2 + "S", chr(92) + "S"),
)
def _(t: Tables):
    return jn.fit_fewshot(fewshot(t), 55).select("p_partkey", "prompt", "n_shots")


@query("p22_gold_only", f"SELECT p_partkey, choices[answer + 1] AS choice, 0 AS correct_index FROM ({MC_SQL})")
def _(t: Tables):
    gold = rw.gold_only(mc_parts(t), "choices", "answer")
    return gold.select("p_partkey", F.element_at("choices", 1).alias("choice"), F.col("answer").alias("correct_index"))


@query(
    "p23_judge_prompt",
    """
    SELECT event_id, 'Question: q' || event_id || chr(10) || chr(10) || 'Incorrect answer: ' || event_type || chr(10) || chr(10) || 'Correct answer: ' || props
           || chr(10) || chr(10) || 'Name the kinds of mistake between <judge></judge> tags, separated by commas, and explain them after the tags.' || chr(10) AS prompt
    FROM events
    """,
)
def _(t: Tables):
    rows = t.events.select("event_id", F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("q"), "event_type", "props")
    return rw.judge_prompt(rows, "q", "event_type", "props").select("event_id", "prompt")


@query(
    "p24_reward_prompt",
    "SELECT event_id, event_type || ' <rm_score>: ' || printf('%.2f', value) || ' ' AS input FROM events",
)
def _(t: Tables):
    return rw.reward_prompt(t.events.select("event_id", F.col("event_type").alias("input"), "value"), "input", "value").select(
        "event_id", "input"
    )


_SAMPLE_TAIL = r"""
    w AS (SELECT *, regexp_extract_all(context, '\S+') AS ctx, regexp_extract_all(cont, '\S+') AS ct, regexp_extract_all(domain, '\S+') AS dc FROM c),
    q AS (SELECT *, list_concat(ctx, ct[1:len(ct) - 1]) AS query FROM w)
    SELECT doc_id, cont_id::INT AS cont_id, {ctx_len} AS ctx_len, len(dc)::INT AS dc_len, len(ct)::INT AS cont_len,
           (length(cont) - 1)::INT AS cont_str_len, strlen(substr(cont, 2))::INT AS cont_byte_len,
           array_to_string(query[greatest(len(query) - 11, 1):], ' ') AS query, array_to_string(list_concat(dc, ct[1:len(ct) - 1]), ' ') AS dc_query, label_id
    FROM q
""".replace(chr(92) * 2, chr(92))


def sample_columns(df):
    return df.select(
        "doc_id", "cont_id", "ctx_len", "dc_len", "cont_len", "cont_str_len", "cont_byte_len",
        F.array_join("query", " ").alias("query"), F.array_join("dc_query", " ").alias("dc_query"), "label_id",
    )


@query(
    "p25_eval_samples",
    f"""
    WITH m AS ({MC_SQL}), c AS (SELECT p_partkey AS doc_id, 'Question: ' || question || ' of ' || subject || chr(10) || 'Answer:' AS context, i AS cont_id,
         ' ' || choices[i + 1] AS cont, 'Answer:' AS domain, answer AS label_id FROM m, (SELECT unnest(range(0, 4)) AS i)),
    """
    + _SAMPLE_TAIL.format(ctx_len="(least(len(query), 12) - len(ct) + 1)::INT"),
)
def _(t: Tables):
    rows = mc_parts(t).withColumn("question", F.concat_ws(" of ", "question", "subject"))
    return sample_columns(tk.task_samples(rows.withColumnRenamed("p_partkey", "doc_id"), "mmlu", 12))


@query(
    "p26_blank_samples",
    """
    WITH c AS (SELECT p_partkey AS doc_id, 'the old ' || p_name || ' of the ' || o AS context, i AS cont_id, ' is of size ' || p_size AS cont,
         o AS domain, (p_size % 2)::INT AS label_id FROM (SELECT *, unnest(range(0, 2)) AS i, unnest([p_brand, p_type]) AS o FROM part)),
    """
    + _SAMPLE_TAIL.format(ctx_len="len(ctx)::INT"),
)
def _(t: Tables):
    rows = t.part.select(
        F.col("p_partkey").alias("doc_id"), F.format_string("the old %s of the _ is of size %d", "p_name", "p_size").alias("sentence"),
        F.col("p_brand").alias("option1"), F.col("p_type").alias("option2"), (F.col("p_size") % 2 + 1).cast("string").alias("answer"),
    )
    return sample_columns(rw.blank_samples(rows, 12, "doc_id", "sentence", ["option1", "option2"], "answer"))


@query("p27_relabel_fields", "SELECT doc_id::VARCHAR AS id, lang AS label, NULL::VARCHAR AS extra FROM documents")
def _(t: Tables):
    rows = t.documents.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rw.relabel_fields(rows, {"id": "doc_id", "label": "lang", "extra": "not_there"})


@query(
    "p28_select_subset",
    "SELECT doc_id AS id, lang, n_chars % 17 || ',' || (n_chars % 19) AS answer_start FROM documents WHERE lower(source) = 'src3'",
)
def _(t: Tables):
    span = lambda k: F.array(F.struct((F.col("n_chars") % k).alias("start"), F.col("n_chars").alias("end")))
    rows = t.documents.select(
        F.col("doc_id").alias("qid"), "lang", F.upper("source").alias("subset"), F.array(span(17), span(19)).alias("char_spans")
    )
    out = rw.select_subset(rows, "Src3")
    return out.withColumn("answer_start", F.array_join(F.col("answer_start").cast("array<string>"), ","))


@query(
    "p29_rank_rows",
    f"""
    WITH {FEWSHOT_SQL}, pre AS (SELECT p_partkey, string_agg(solved, '' ORDER BY k) AS pre FROM s WHERE k <= 3 GROUP BY p_partkey)
    SELECT p_partkey, pre || question AS prompt, list_position(choices, choices[answer + 1]) - 1 AS label, i::INT AS option_id, ' ' || choices[i + 1] AS option
    FROM p JOIN pre USING (p_partkey), (SELECT unnest(range(0, 4)) AS i)
    """,
)
def _(t: Tables):
    rows = fewshot(t).select(
        "p_partkey", F.col("question").alias("input"), F.col("choices").alias("options"),
        F.element_at("choices", F.col("answer") + 1).alias("output"), F.array_join("shots", "").alias("prefix"),
    )
    return rw.rank_rows(rows, prefix="prefix")


TASK_SQL = """
    SELECT 'piqa' AS task, p_partkey AS doc_id, 'Question: ' || p_name || chr(10) || 'Answer:' AS context, [' ' || p_brand, ' ' || p_type] AS cs,
           (p_size % 2)::INT AS label, 'Answer:' AS domain FROM part UNION ALL
    SELECT 'hellaswag', p_partkey, p_brand || ': ' || p_name || '.  ' || upper(p_type[1]) || lower(p_type[2:]) || ' step',
           [' ' || p_name || '. end', ' ' || p_type], (p_size % 2)::INT, upper(p_type[1]) || lower(p_type[2:]) || ' step' FROM part UNION ALL
    SELECT 'copa', p_partkey, 'The ' || p_name || ' broke' || CASE WHEN p_size % 2 = 0 THEN ' because' ELSE ' therefore' END,
           [' ' || lower(p_brand[1]) || p_brand[2:], ' ' || lower(p_type[1]) || p_type[2:]], (p_size % 2)::INT,
           CASE WHEN p_size % 2 = 0 THEN 'because' ELSE 'therefore' END FROM part UNION ALL
    SELECT 'mrpc', p_partkey, 'Sentence 1: ' || p_name || ', it isn''t' || chr(10) || 'Sentence 2: (' || p_brand || ')' || chr(10)
           || 'Question: Do both sentences mean the same thing?' || chr(10) || 'Answer:', [' yes', ' no'], (1 - p_size % 2)::INT, 'Answer:' FROM part UNION ALL
    SELECT 'arc_easy', p_partkey, 'Question: ' || p_name || chr(10) || 'Answer:', [' ' || p_brand, ' ' || p_type], (p_size % 2)::INT, 'Answer:' FROM part
"""


@query(
    "x10_task_formatters",
    f"""
    SELECT task, doc_id, context, (i - 1)::INT AS cont_id, CASE WHEN task = 'hellaswag' THEN replace(cs[i], '.  ', '. ') ELSE cs[i] END AS continuation, label,
           domain FROM ({TASK_SQL}), (SELECT unnest([1, 2]) AS i)
    """,
)
def _(t: Tables):
    size = F.col("p_size")
    fields = t.part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("goal"), F.col("p_brand").alias("sol1"), F.col("p_type").alias("sol2"),
        (size % 2).alias("label"), F.col("p_brand").alias("activity_label"), F.concat("p_name", F.lit(" [title] [x]")).alias("ctx_a"),
        F.concat(F.lower("p_type"), F.lit(" STEP")).alias("ctx_b"),
        F.array(F.concat("p_name", F.lit(" [title]end")), F.col("p_type")).alias("endings"),
        F.format_string(" The %s broke. ", "p_name").alias("premise"), F.col("p_brand").alias("choice1"), F.col("p_type").alias("choice2"),
        F.when(size % 2 == 0, "cause").otherwise("effect").alias("question"),
        F.format_string("%s , it is n't", "p_name").alias("sentence1"), F.format_string("( %s )", "p_brand").alias("sentence2"),
    )
    arc = t.part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("choices"),
        F.when(size % 4 == 0, "A").when(size % 4 == 1, "b").when(size % 4 == 2, "1").otherwise("2").alias("answer"),
    )
    out = None
    for task, rows in (("piqa", fields), ("hellaswag", fields), ("copa", fields), ("mrpc", fields), ("arc_easy", arc)):
        made = tk.task_rows(rows, task).select(
            F.lit(task).alias("task"), "doc_id", "context", F.posexplode("continuations").alias("cont_id", "continuation"), "label", "domain"
        )
        out = made if out is None else out.unionByName(made)
    return out


_ASK = "chr(10) || 'Answer:'"
_PAIR = "[' ' || p_brand, ' ' || p_type]"
_PLAIN = f"'Question: ' || p_name || {_ASK}"
MORE_TASKS_SQL = " UNION ALL ".join(
    f"SELECT '{task}' AS task, p_partkey AS doc_id, {context} AS context, {cs} AS cs, ({label})::INT AS label, {domain} AS domain FROM part"
    for task, context, cs, label, domain in [
        ("openbook_qa", "p_name", _PAIR, "p_size % 2", "list_last(string_split(p_name, ' '))"),
        ("boolq", f"p_name || chr(10) || 'Question: ' || p_brand || '?' || {_ASK}", "[' yes', ' no']", "p_size % 2", "'Answer:'"),
        ("sciq", f"p_name || chr(10) || 'Question: ' || p_brand || {_ASK}", "[' ' || p_type, ' ' || p_brand, ' size ' || p_size, ' ' || p_name]", "3", "'Answer:'"),
        *[(task, _PLAIN, _PAIR, "p_size % 2", "'Answer:'") for task in ("arc_challenge", "basic_arithmetic", "commonsense_qa", "mmlu")],
        *[(task, _PLAIN, "[' ' || [p_brand, p_type][p_size % 2 + 1]]", "0", "'Answer:'") for task in ("arc_easy_gold", "mmlu_gold")],
        *[(task, f"chr(10) || {_PLAIN}", "[' ' || p_brand]", "0", "'Answer:'") for task in ("trivia_qa_gold", "natural_questions_gold")],
        ("social_iqa", f"'Question: ' || p_name || ' ' || p_brand || {_ASK}", "[' ' || p_type, ' ' || p_brand, ' size ' || p_size]", "p_size % 3", "'Answer:'"),
        ("rte", f"p_name || chr(10) || 'Question: ' || p_brand || ' True or False?' || {_ASK}", "[' True', ' False']", "p_size % 2", "'Answer:'"),
        ("commitment_bank", f"p_name || chr(10) || 'Question: ' || p_brand || '. True, False or Neither?' || {_ASK}", "[' True', ' False', ' Neither']", "p_size % 3", "'Answer:'"),
        ("sst2", f"p_name || ', it isn''t' || chr(10) || 'Question: Is this sentence positive or negative?' || {_ASK}", "[' negative', ' positive']", "p_size % 2", "'Answer:'"),
    ]
)


@query(
    "x10_more_formatters",
    f"""
    SELECT task, doc_id, context, (generate_subscripts(cs, 1) - 1)::INT AS cont_id, unnest(cs) AS continuation, label, domain FROM ({MORE_TASKS_SQL})
    """,
)
def _(t: Tables):
    size, name, brand, kind = F.col("p_size"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    sized = F.format_string("size %d", "p_size")
    letter = F.when(size % 4 == 0, "A").when(size % 4 == 1, "b").when(size % 4 == 2, "1").otherwise("2")
    pair = F.array(brand, kind)
    fields = {
        "openbook_qa": {"question_stem": name, "choices": pair, "answer": letter},
        "boolq": {"passage": name, "question": brand, "answer": size % 2 == 0},
        "sciq": {
            "support": F.concat(F.lit(" "), name, F.lit(chr(10))), "question": brand, "distractor1": kind, "distractor2": brand,
            "distractor3": sized, "correct_answer": name,
        },
        "social_iqa": {"context": name, "question": brand, "answerA": kind, "answerB": brand, "answerC": sized, "label": (size % 3 + 1).cast("string")},
        "rte": {"sentence1": name, "sentence2": brand, "label": size % 2},
        "commitment_bank": {"premise": name, "hypothesis": brand, "label": size % 3},
        "sst2": {"sentence": F.format_string("%s , it is n't", "p_name"), "label": size % 2},
    }
    for task in ("arc_challenge", "arc_easy_gold", "basic_arithmetic", "commonsense_qa"):
        fields[task] = {"question": name, "choices": pair, "answer": letter}
    for task in ("mmlu", "mmlu_gold"):
        fields[task] = {"question": name, "choices": pair, "answer": size % 2}
    for task in ("trivia_qa_gold", "natural_questions_gold"):
        fields[task] = {"question": name, "answer": brand}
    out = None
    for task, columns in fields.items():
        rows = t.part.select(F.col("p_partkey").alias("doc_id"), *[c.alias(n) for n, c in columns.items()])
        made = tk.task_rows(rows, task).select(
            F.lit(task).alias("task"), "doc_id", "context", F.posexplode("continuations").alias("cont_id", "continuation"), "label", "domain"
        )
        out = made if out is None else out.unionByName(made)
    return out


@query(
    "x10_subject_prompts",
    f"""
    WITH m AS ({MC_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p_partkey) AS rk FROM m),
    f AS (SELECT *, CASE WHEN letters THEN question || chr(10) || 'A. ' || choices[1] || chr(10) || 'B. ' || choices[2] || chr(10) || 'C. ' || choices[3]
                 || chr(10) || 'D. ' || choices[4] || chr(10) || 'Answer:' ELSE 'Question: ' || question || chr(10) || 'Answer:' END AS ask,
                 CASE WHEN letters THEN chr(65 + answer) ELSE choices[answer + 1] END AS said FROM r, (SELECT unnest([true, false]) AS letters)),
    v AS (SELECT unnest(range(0, 7)) AS no),
    s AS (SELECT subject, letters, no, string_agg(ask || ' ' || said || chr(10) || chr(10), '' ORDER BY rk) AS shots FROM f, v WHERE rk < no GROUP BY ALL)
    SELECT letters, p_partkey + no * (SELECT max(p_partkey) + 1 FROM part) AS doc_id, CASE no WHEN 0 THEN NULL WHEN 1 THEN 'inst' ELSE 'inst+' || (no - 1) END AS variant,
           CASE WHEN no > 0 THEN 'The following are multiple choice questions (with answers) about ' || replace(subject, '_', ' ') || ':' || chr(10) || chr(10) ELSE '' END
           || coalesce(shots, '') || ask AS context,
           CASE WHEN letters THEN ' A| B| C| D' ELSE ' ' || array_to_string(choices, '| ') END AS continuations, answer AS label
    FROM f CROSS JOIN v LEFT JOIN s USING (subject, letters, no)
    """,
)
def _(t: Tables):
    rows = mc_parts(t).withColumnRenamed("p_partkey", "doc_id")
    dev = mc_parts(t).withColumnRenamed("p_partkey", "seq")

    def made(letters: bool):
        out = tk.subject_rows(rows, dev, letters=letters)
        return out.select(
            F.lit(letters).alias("letters"), "doc_id", "variant", "context", F.array_join("continuations", "|").alias("continuations"), "label"
        )

    return made(True).unionByName(made(False))
