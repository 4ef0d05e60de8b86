"""Composed jobs, end to end over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import rows as rw
from ..operators import sampling as sa
from ..plans import jobs
from ..plans.layout import spread
from ..plans.ordering import hash_unit
from ..plans.scratch import scratch_path
from .functions_text import REPLIES
from .joins import RUNS_SQL, index_log, jn, runs
from .metrics import COMPLETIONS_SQL, MAJORITY_SQL, completions, rounded
from .registry import Tables, fill, query, sql_fill
from .rows import MC_SQL, exchanges, mc_parts
from .sampling import WEIGHTS, WEIGHTS_SQL, md5_order, unit
from .tokens import CHUNK, GRAM_SQL, POS_SQL, VOCAB, VOCAB_SQL, encoded, evaluation, joined, token_table, vocab

CORPUS_SQL = r"""
    pairs AS (SELECT conv_id || '-' || pair AS conv_id, p || chr(10) || chr(10) || f AS text
              FROM (SELECT conv_id, (turn // 2)::BIGINT AS pair, max(text) FILTER (turn % 2 = 0) AS p, max(text) FILTER (turn % 2 = 1) AS f FROM conversations GROUP BY ALL)
              WHERE p IS NOT NULL AND f IS NOT NULL),
    w AS (SELECT conv_id, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i FROM pairs),
    v AS (SELECT word, (row_number() OVER (ORDER BY count(*) DESC, word) + 2)::INT AS id FROM w GROUP BY word QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= 1000),
    x AS (SELECT conv_id, i, coalesce(id, 2) AS id FROM w LEFT JOIN v USING (word) UNION ALL SELECT conv_id, 1000000000, 1 FROM pairs),
    r AS (SELECT conv_id, copy, i, id, md5('0:' || conv_id || ':' || copy) AS h FROM x, (SELECT unnest([0, 1]) AS copy)),
    s AS (SELECT id, row_number() OVER (ORDER BY h, i) - 1 AS p FROM r)
"""


@query(
    "c1_corpus_build",
    f"WITH {CORPUS_SQL} SELECT lpad((p // 4096)::VARCHAR, 5, '0') AS shard, count(*) AS n_tokens, sum(id * (p % 4096))::BIGINT AS weighted FROM s GROUP BY 1",
)
def _(t: Tables):
    shards = jobs.corpus_build(exchanges(t), "key", "prompt", "first", 2, 1000, 0, scratch_path(t.spark, "corpus"), 4096)
    long = shards.select("shard", "at", F.posexplode("tokens").alias("i", "id"))
    place = (F.col("at") + F.col("i")) % 4096
    return long.groupBy("shard").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("id") * place).alias("weighted"))


@query(
    "c3_contamination_report",
    f"""
    WITH {GRAM_SQL} SELECT 'all' AS subset, count(*) AS n, round(avg((length(text) % 3 = 0)::INT), 9) AS acc FROM benchmark UNION ALL
    SELECT 'clean', count(*), round(avg((length(text) % 3 = 0)::INT), 9) FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM overlap)
    """,
)
def _(t: Tables):
    rows = evaluation(t).withColumn("right", mt.truth(F.length("text") % 3 == 0))
    return jobs.contamination_report(
        rows, spread(t.documents.select("doc_id", "text"), "doc_id"), lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("right"), 9).alias("acc"))
    )


@query(
    "c4_mixture_report",
    f"""
    WITH {WEIGHTS_SQL}, r AS (SELECT doc_id, source, n_chars, w, row_number() OVER (PARTITION BY source ORDER BY {md5_order(5, 'doc_id')}) AS rn,
       count(*) OVER (PARTITION BY source) AS n FROM documents JOIN w USING (source) WHERE w > 0),
    k AS (SELECT source, n_chars * greatest(floor(w), 1)::BIGINT AS tokens FROM r WHERE w >= 1 OR rn <= floor(n * w)),
    g AS (SELECT source, sum(tokens)::BIGINT AS taken FROM k GROUP BY source), a AS (SELECT source, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source)
    SELECT source, total AS total_tokens, coalesce(taken, 0) AS taken_tokens, printf('%.4f', coalesce(taken, 0) / (SELECT sum(taken) FROM g)) AS share
    FROM a LEFT JOIN g USING (source)
    """,
)
def _(t: Tables):
    rows = t.documents.select("doc_id", "source", "n_chars")
    return jobs.mixture(rows, WEIGHTS, 5, "source", ["doc_id"], "n_chars")[1]


@query(
    "c5_training_set",
    f"""
    WITH {VOCAB_SQL}, {POS_SQL}, l AS (SELECT source, chunk_idx, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM chunks),
    b AS (SELECT source, chunk_idx, i, i - coalesce(lag(i) OVER (PARTITION BY source, chunk_idx ORDER BY i), -1) AS d FROM l WHERE v = 1 OR i = {CHUNK - 1}),
    n AS (SELECT source, chunk_idx, string_agg(d::VARCHAR, ' ' ORDER BY i) AS doc_lens FROM b GROUP BY ALL),
    e AS (SELECT source, chunk_idx, i, p, v = lag(v, p) OVER (PARTITION BY source, chunk_idx, p ORDER BY i) AS eq FROM l, (SELECT unnest(range(1, 14)) AS p)),
    r AS (SELECT *, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY source, chunk_idx, p ORDER BY i) AS g FROM e),
    s AS (SELECT source, chunk_idx, p, min(i) AS s, max(i) + 1 AS e FROM r WHERE eq GROUP BY source, chunk_idx, p, g),
    bad AS (SELECT DISTINCT source, chunk_idx FROM s WHERE ((s + p - 1) // p + 1) * p <= e AND e - s + p >= 3 * p AND (e - s + p) // p >= 4)
    SELECT source, chunk_idx, array_to_string(list_transform(x, lambda v: (v % 2)::INT), '') AS mask, doc_lens, bad.source IS NULL AS instance_mask
    FROM chunks JOIN n USING (source, chunk_idx) LEFT JOIN bad USING (source, chunk_idx)
    """,
)
def _(t: Tables):
    tokens = token_table(t).withColumn("label_mask", F.transform("tokens", lambda x: x % 2 == 1))
    rows = jobs.training_set(tokens, CHUNK, "source", "doc_id", "label_mask", max_count=4)
    bits = F.transform("label_mask", lambda x: x.cast("int").cast("string"))
    return rows.select("source", "chunk_idx", F.array_join(bits, "").alias("mask"), joined("doc_lens").alias("doc_lens"), "instance_mask")


@query(
    "c6_epoch_plan",
    f"""
    WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_order(9, 'doc_id')}) - 1 AS pos FROM documents), n AS (SELECT count(*) AS n FROM documents),
    p AS (SELECT doc_id, pos FROM o UNION ALL SELECT doc_id, pos + n FROM o, n WHERE pos < (7 - n % 7) % 7)
    SELECT doc_id, pos, (pos % 7)::INT AS rank, pos // 28 AS batch FROM p WHERE pos >= 56
    """,
)
def _(t: Tables):
    return jobs.epoch_plan(t.documents, ["doc_id"], 6, 3, 7, 28, start=56)


EXPERT = ["we add # and get #### @", "so it is #### #", "#### @,000", "no marker"]


@query(
    "c7_expert_data",
    f"""
    WITH e AS (SELECT user_id::VARCHAR AS gold, 'task ' || user_id AS prompt,
       replace({sql_fill([m.replace('####', '~~~~') for m in EXPERT], 'event_id', 'user_id', '(event_id % 10)')}, '~~~~', '####') AS response FROM events)
    SELECT DISTINCT prompt, response FROM e WHERE replace(regexp_extract(response, '#### (-?[0-9.,]+)', 1), ',', '') = gold
    """,
)
def _(t: Tables):
    rows = t.events.withColumn("last", F.col("event_id") % 10)
    response = F.replace(fill([m.replace("####", "~~~~") for m in EXPERT], "event_id", "user_id", "last"), F.lit("~~~~"), F.lit("####"))
    rows = rows.select(
        F.col("user_id").cast("string").alias("gold"), F.format_string("task %d", "user_id").alias("prompt"), response.alias("response")
    )
    return jobs.expert_data(rows, scratch_path(t.spark, "expert"), "prompt", "response", "gold")


def generations(t: Tables):
    return t.events.select(
        F.col("event_id").alias("seq"), F.format_string("user %d", "user_id").alias("input"), F.col("event_type").alias("output"),
        (F.col("value") * 0.987654321).alias("reward"),
    )


@query(
    "c8_rejection_sampling",
    "SELECT 'user ' || user_id AS input, event_type AS output, value * 0.987654321 AS reward FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
)
def _(t: Tables):
    return jobs.process(generations(t), "rs")


@query(
    "c8_conditional",
    """
    WITH r AS (SELECT *, value * 0.987654321 AS v FROM events), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM r)
    SELECT 'user ' || user_id || ' <rm_score>: ' || printf('%.2f', (v - m) / sd) || ' ' AS input, event_type AS output, round((v - m) / sd, 7) AS reward FROM r, s
    """,
)
def _(t: Tables):
    return rounded(jobs.process(generations(t), "csft"), 7)


@query(
    "c8_preference_pairs",
    """
    WITH r AS (SELECT *, value * 0.987654321 AS v FROM events)
    SELECT 'user ' || h.user_id AS prompt, h.event_type AS chosen, h.v AS chosen_reward, l.event_type AS rejected, l.v AS rejected_reward
    FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1) h
    JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1) l USING (user_id)
    """,
)
def _(t: Tables):
    return jobs.process(generations(t), "iter_dpo").withColumnRenamed("input", "prompt")


ROLLOUTS_SQL = """
    st AS (SELECT o_custkey AS prompt, l_orderkey AS sample, o_totalprice / 77777 AS reward, -l_discount * 3.14159265358979 AS lp, -l_tax * 2.71828182845905 AS base, l_quantity / 50 AS v,
             (l_returnflag <> 'R')::INT AS m,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
             count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    lm AS (SELECT *, coalesce(max(i) FILTER (m = 1) OVER (PARTITION BY sample), n - 1) AS last FROM st)
"""


def rollout_rows(t: Tables):
    steps = rw.step_arrays(
        t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        logp=-F.col("l_discount") * 3.14159265358979, base=-F.col("l_tax") * 2.71828182845905, value=F.col("l_quantity") / 50,
        mask=(F.col("l_returnflag") != "R").cast("int"),
    )
    return steps.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("prompt"), F.col("l_orderkey").alias("sample"), (F.col("o_totalprice") / 77_777).alias("reward"),
        "logp", "base", "value", "mask",
    )


@query(
    "c9_group_advantages",
    f"""
    WITH {ROLLOUTS_SQL}, g AS (SELECT prompt, avg(reward) AS mean, stddev_samp(reward) AS sd, count(*) AS k FROM (SELECT DISTINCT prompt, sample, reward FROM st) GROUP BY prompt),
    r AS (SELECT lm.*, CASE WHEN i = last THEN CASE WHEN k > 1 THEN (reward - mean) / (sd + 1e-9) ELSE 0 END ELSE 0 END - 0.05 * (lp - base) * m AS r FROM lm JOIN g USING (prompt)),
    a AS (SELECT prompt, sample, i, m, sum(r * m) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM r),
    s AS (SELECT sum(a) / sum(m) AS mu FROM a), v AS (SELECT sum((a - mu) * (a - mu) * m) / sum(m) AS var FROM a, s)
    SELECT prompt, sample, i::INT AS step, m AS mask, round(a, 6) AS ret, round((a - mu) / sqrt(greatest(var, 1e-8)), 6) AS normalized FROM a, s, v
    """,
)
def _(t: Tables):
    table = jobs.advantage_table(rollout_rows(t), "group_norm", 0.05, 1.0)
    return rounded(table.select("prompt", "sample", "step", "mask", "ret", "normalized"), 6)


@query(
    "c9_gae_advantages",
    f"""
    WITH {ROLLOUTS_SQL}, r AS (SELECT *, (CASE WHEN i = last THEN greatest(least(reward, 4), 1) ELSE 0 END - 0.05 * (lp - base) * m) * m AS r, v * m AS vm FROM lm),
    d AS (SELECT *, r + 0.987654321 * coalesce(lead(vm) OVER (PARTITION BY sample ORDER BY i), 0) - vm AS d FROM r),
    a AS (SELECT prompt, sample, i, m, vm, sum(d * pow(0.987654321 * 0.95, i)) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.987654321 * 0.95, i) AS a FROM d)
    SELECT prompt, sample, i::INT AS step, m AS mask, round(a + vm, 6) AS ret, round(a, 6) AS advantage FROM a
    """,
)
def _(t: Tables):
    table = jobs.advantage_table(rollout_rows(t), "gae", 0.05, 0.987654321, 0.95, clip=(1.0, 4.0), normalize=False)
    return rounded(table.select("prompt", "sample", "step", "mask", "ret", "advantage"), 6)


@query(
    "c10_benchmark_scores",
    f"""
    WITH m AS ({MC_SQL}), c AS (SELECT p_partkey, i, answer, -{unit(31, 'p_partkey', 'i')} * 40 / length(choices[i + 1]) AS v FROM m, (SELECT unnest(range(0, 4)) AS i)),
    p AS (SELECT (i = answer)::INT AS ok FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, i) = 1)
    SELECT 'mmlu' AS task, 'len_norm' AS metric, round(avg(ok), 9) AS score, round(stddev_samp(ok) / sqrt(count(*)), 9) AS stderr FROM p
    """,
)
def _(t: Tables):
    docs = mc_parts(t).withColumnRenamed("p_partkey", "doc_id")
    places = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cont_id"))
    likelihoods = places.withColumn("ll", -hash_unit(31, "doc_id", "cont_id") * 40)
    return rounded(jobs.benchmark_scores(docs, "mmlu", likelihoods, 2048))


@query(
    "c10_blank_task_scores",
    f"""
    WITH c AS (SELECT p_partkey, i, (p_size % 2)::INT AS label, -{unit(31, 'p_partkey', 'i')} * 40 AS v FROM part, (SELECT unnest(range(0, 2)) AS i)),
    p AS (SELECT (i = label)::INT AS ok FROM c QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY v DESC, i) = 1)
    SELECT 'winogrande' AS task, 'acc' AS metric, round(avg(ok), 9) AS score, round(stddev_samp(ok) / sqrt(count(*)), 9) AS stderr FROM p
    """,
)
def _(t: Tables):
    docs = t.part.select(
        F.col("p_partkey").alias("doc_id"), F.format_string("the old %s of the _ is of size %d", "p_name", "p_size").alias("sentence"),
        F.col("p_brand").alias("option1"), F.col("p_type").alias("option2"), (F.col("p_size") % 2 + 1).cast("string").alias("answer"),
    )
    places = t.part.select(F.col("p_partkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("cont_id"))
    likelihoods = places.withColumn("ll", -hash_unit(31, "doc_id", "cont_id") * 40)
    return rounded(jobs.benchmark_scores(docs, "winogrande", likelihoods, 2048))


def request_folders(t: Tables) -> list[str]:
    """Two request folders: parts with four choices, each also without a context, and customers with two choices."""
    parts = mc_parts(t).select(
        F.col("p_partkey").alias("doc_id"), "question", "answer", F.posexplode("choices").alias("idx", "choice")
    )
    alone = parts.withColumns({"doc_id": F.col("doc_id") + 1_000_000, "question": F.lit("")})
    buyers = t.customer.select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("question"), (F.col("c_custkey") % 2).alias("answer"),
        F.posexplode(F.array(F.lit("yes"), F.lit("no"))).alias("idx", "choice"),
    )
    roots = []
    for rows in (parts.unionByName(alone), buyers):
        root = scratch_path(t.spark, "requests")
        line = F.to_json(F.struct(
            F.lit("loglikelihood").alias("request_type"), F.struct("question").alias("doc"),
            F.struct(F.col("question").alias("context"), F.concat(F.lit(" "), "choice").alias("continuation")).alias("request"),
            "idx", F.col("answer").alias("label"), "doc_id",
        ))
        rows.select(line.alias("value")).write.text(f"{root}/requests.jsonl")
        config = F.to_json(F.struct(F.struct(F.lit("acc_per_char").alias("primary_metric")).alias("task_config")))
        t.spark.range(1).select(config.alias("value")).write.text(f"{root}/config.json")
        roots.append(root)
    return roots


REQUESTS_SQL = f"""
    m AS ({MC_SQL}), o AS (SELECT max(p_partkey) + 1 AS o FROM part),
    c AS (SELECT p_partkey AS d, i, answer AS g, choices[i + 1] AS ch FROM m, (SELECT unnest(range(0, 4)) AS i)
          UNION ALL SELECT c_custkey + o, i, c_custkey % 2, ['yes', 'no'][i + 1] FROM customer, o, (SELECT unnest(range(0, 2)) AS i))
"""


def _scored_requests(t: Tables, metric: str | None):
    folders, alone = request_folders(t), lambda r: F.col("context") == ""
    samples = jobs.request_samples(t.spark, folders, metric or jobs.request_metric(t.spark, folders), 2048, alone)
    model = samples.select("doc_id", "cont_id", (-hash_unit(31, "doc_id", "cont_id") * 40).alias("ll"))
    return rounded(jobs.request_scores(t.spark, folders, model, 2048, metric, alone))


@query(
    "c10_request_scores",
    f"""
    WITH {REQUESTS_SQL}, v AS (SELECT d, i, g, -{unit(31, 'd', 'i')} * 40 / length(ch) AS v FROM c),
    p AS (SELECT (i = g)::INT AS ok FROM v QUALIFY row_number() OVER (PARTITION BY d ORDER BY v DESC, i) = 1)
    SELECT 'requests' AS task, 'len_norm' AS metric, round(avg(ok), 9) AS score, round(stddev_samp(ok) / sqrt(count(*)), 9) AS stderr FROM p
    """,
)
def _(t: Tables):
    return _scored_requests(t, None)


@query(
    "c10_request_loss",
    f"""
    WITH {REQUESTS_SQL}, z AS (SELECT d, 0 AS z, ch FROM c WHERE i = g)
    SELECT round(avg({unit(31, 'd', 'z')} * 40 / strlen(ch) * 1.44269504089), 9) AS loss FROM z
    """,
)
def _(t: Tables):
    return _scored_requests(t, "bpb")


@query(
    "c11_math_evaluation",
    f"""
    WITH {COMPLETIONS_SQL}, {MAJORITY_SQL}, d AS (SELECT doc_id, max((acc = 1)::INT) AS r FROM comp GROUP BY 1)
    SELECT response_type, round(count(*) / ((SELECT count(*) FROM d) * 64), 9) AS share, round(avg(acc), 9) AS acc, (SELECT round(avg(r), 9) FROM d) AS final_accuracy,
           (SELECT round(avg(acc), 9) FROM comp) AS pass_at_1, (SELECT round(avg(maj_acc), 9) FROM maj) AS final_maj_accuracy FROM comp GROUP BY response_type
    """,
)
def _(t: Tables):
    return rounded(jobs.math_evaluation(completions(t), 64, "text_answer"))


@query(
    "c12_error_analysis",
    f"""
    WITH {RUNS_SQL}, q AS (SELECT b.question FROM base b JOIN ckpt c USING (question) WHERE b.acc = 0 AND c.acc = 1),
    r AS (SELECT 'q' || event_id AS question, {sql_fill(REPLIES, 'event_id', 'user_id', 'event_id')} AS s FROM events),
    l AS (SELECT question, unnest(list_distinct(list_transform(string_split(trim(array_to_string(regexp_extract_all(s, '(?s)<judge>(.*?)</judge>', 1), '')), ','),
             lambda x: trim(x)))) AS category FROM r JOIN q USING (question))
    SELECT category, count(*) AS n_rows, count(DISTINCT question) AS n_docs FROM l WHERE category <> '' GROUP BY 1
    """,
)
def _(t: Tables):
    prompts = jobs.error_analysis(*runs(t))
    replies = t.events.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), fill(REPLIES, "event_id", "user_id", "event_id").alias("reply")
    )
    return jobs.judged_errors(prompts, replies, "question", "reply")


@query(
    "c13_inspect_training_data",
    f"""
    WITH {VOCAB_SQL}, log AS (SELECT event_id // 8 AS step, (event_id % 8)::INT AS slot, event_id * 31 % (SELECT count(*) FROM documents) AS doc_id FROM events),
    d AS (SELECT doc_id, coalesce(string_agg(CASE WHEN id = 2 THEN '<unk>' ELSE word END, ' ' ORDER BY i) FILTER (id > 1), '') AS text
          FROM ids LEFT JOIN (SELECT token_id AS id, word FROM vocab) USING (id) GROUP BY doc_id)
    SELECT step, slot, md5(text) AS text_md5 FROM log JOIN d USING (doc_id)
    """,
)
def _(t: Tables):
    words = vocab(t)
    instances = encoded(t, words).select(F.col("doc_id").alias("instance_id"), "tokens")
    shown = jobs.inspect_batches(jn.parse_index_log(index_log(t)), instances, words, VOCAB)
    return shown.select("step", "slot", F.md5("text").alias("text_md5"))


@query(
    "x5_named_processors",
    """
    WITH r AS (SELECT *, value * 0.987654321 AS v FROM events), s AS (SELECT avg(v) AS m, stddev_samp(v) AS sd FROM r),
    o AS (SELECT 'rs' AS name, user_id, max(v) AS v FROM r GROUP BY user_id UNION ALL SELECT 'csft', user_id, sum((v - m) / sd) FROM r, s GROUP BY user_id
          UNION ALL SELECT 'iter_dpo', user_id, max(v) - min(v) FROM r GROUP BY user_id)
    SELECT name, user_id, round(v, 6) AS value FROM o
    """,
)
def _(t: Tables):
    user = F.regexp_extract("input", r"^user (\d+)", 1).cast("bigint").alias("user_id")
    values = {"rs": F.max("reward"), "csft": F.sum("reward"), "iter_dpo": F.max(F.col("chosen_reward") - F.col("rejected_reward"))}
    out = None
    for name, value in values.items():
        part = jobs.process(generations(t), name).groupBy(user).agg(F.round(value, 6).alias("value"))
        part = part.select(F.lit(name).alias("name"), "user_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "x7_task_hooks",
    f"""
    WITH c AS (SELECT p_partkey AS id, i, p_size % 2 AS answer, -{unit(33, 'p_partkey', 'i')} * 20 AS ll, length([p_brand, p_type][i + 1]) AS n FROM part, (SELECT unnest([0, 1]) AS i)),
    a AS (SELECT 'piqa' AS task, 'len_norm' AS metric, (i = answer)::INT AS ok FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY ll / n DESC, i) = 1
          UNION ALL SELECT 'arc_easy', 'acc', (i = answer)::INT FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY ll DESC, i) = 1)
    SELECT task, metric, round(avg(ok), 9) AS score, round(stddev_samp(ok) / sqrt(count(*)), 9) AS stderr FROM a GROUP BY ALL
    """,
)
def _(t: Tables):
    size = F.col("p_size")
    docs = t.part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("goal"), F.col("p_brand").alias("sol1"), F.col("p_type").alias("sol2"),
        (size % 2).alias("label"), F.col("p_name").alias("question"), F.array("p_brand", "p_type").alias("choices"),
        F.when(size % 2 == 0, "A").otherwise("B").alias("answer"),
    )
    likelihoods = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("cont_id")).withColumn(
        "ll", -hash_unit(33, "doc_id", "cont_id") * 20
    )
    scores = [jobs.benchmark_scores(docs, task, likelihoods, 2048) for task in ("piqa", "arc_easy")]
    return rounded(scores[0].unionByName(scores[1]))


@query(
    "x9_chained_steps",
    f"SELECT doc_id, unnest([0, 1])::INT AS copy, length(text) + 1 AS n FROM documents WHERE {unit(3, 'doc_id')} < 0.25",
)
def _(t: Tables):
    return jobs.chain(
        t.documents.select("doc_id", "text"),
        [
            lambda df: sa.sample_rows(df, 0.25, 3, ["doc_id"]), lambda df: sa.repeat(df, 2),
            jobs.with_columns(n=(F.length("text") + 1).cast("bigint")), lambda df: df.drop("text"),
        ],
    )


@query(
    "x8_named_metrics",
    f"""
    WITH s AS (SELECT p_partkey AS doc_id, i AS cont_id, -{unit(31, 'p_partkey', 'i')} * 40 AS ll, (p_partkey % 4)::INT AS label FROM part, (SELECT unnest(range(0, 4)) AS i)),
    p AS (SELECT (cont_id = label)::INT AS ok FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ll DESC, cont_id) = 1)
    SELECT round(avg(ok), 9) AS acc, count(*) AS n FROM p
    """,
)
def _(t: Tables):
    rows = t.part.select(
        F.col("p_partkey").alias("doc_id"), (F.col("p_partkey") % 4).cast("int").alias("label"), F.lit(0).alias("seq"),
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cont_id"),
    ).withColumn("ll", -hash_unit(31, "doc_id", "cont_id") * 40)
    return rounded(mt.named_metric("acc")(rows))


