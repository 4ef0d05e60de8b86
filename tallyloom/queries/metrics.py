"""Metric queries. Events stand for completions, scores and rewards; labels and orders for classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metrics as mt
from ..plans.ordering import hash_unit, with_position
from .registry import Tables, query

R9 = 9


def rounded(df, digits: int = R9, *columns: str):
    """Doubles rounded so that the order of additions does not show."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---- completions -----------------------------------------------------------------------------------------

COMPLETIONS_SQL = """
    k AS (SELECT event_id, user_id, event_type, value, (props->>'$.k')::INT AS k FROM events),
    comp AS (SELECT user_id AS doc_id, event_id AS idx, event_type AS response_type, (value >= 50)::INT::DOUBLE AS acc,
                    CASE WHEN k % 7 > 0 THEN event_type END AS answer, CASE WHEN k % 5 = 0 THEN event_type END AS text_answer,
                    ['view', 'click', 'purchase', 'signup', 'error'][user_id % 5 + 1] AS gold FROM k)
"""


def with_k(t: Tables):
    return t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def completions(t: Tables):
    kinds = F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])
    return with_k(t).select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), F.col("event_type").alias("response_type"),
        mt.truth(F.col("value") >= 50).alias("acc"), F.when(F.col("k") % 7 > 0, F.col("event_type")).alias("answer"),
        F.when(F.col("k") % 5 == 0, F.col("event_type")).alias("text_answer"),
        F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("gold"),
    )


@query(
    "a1_pass_at_1",
    f"""
    WITH {COMPLETIONS_SQL} SELECT response_type, round(count(*) / (SELECT count(*) FROM comp), 9) AS share, round(avg(acc), 9) AS acc,
    (SELECT round(avg(acc), 9) FROM comp) AS final_accuracy FROM comp GROUP BY 1
    """,
)
def _(t: Tables):
    return rounded(mt.pass_at_1(completions(t)))


@query(
    "a2_pass_at_n",
    f"""
    WITH {COMPLETIONS_SQL}, d AS (SELECT doc_id || '/' || response_type AS d, max((acc = 1)::INT) AS r FROM comp GROUP BY 1)
    SELECT response_type, round(count(*) / ((SELECT count(*) FROM d) * 64), 9) AS share, round(avg(acc), 9) AS acc,
           (SELECT round(avg(r), 9) FROM d) AS final_accuracy FROM comp GROUP BY 1
    """,
)
def _(t: Tables):
    docs = completions(t).withColumn("doc_id", F.concat_ws("/", "doc_id", "response_type"))
    return rounded(mt.pass_at_n(docs, 64))


MAJORITY_SQL = """
    va AS (SELECT doc_id, answer, count(*) AS n, min(idx) AS f, min(gold) AS g FROM comp WHERE answer IS NOT NULL GROUP BY ALL),
    vt AS (SELECT doc_id, text_answer AS answer, count(*) AS n, min(idx) AS f, min(gold) AS g FROM comp WHERE text_answer IS NOT NULL GROUP BY ALL),
    wa AS (SELECT doc_id, answer = g AS r FROM va QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
    wt AS (SELECT doc_id, answer = g AS r FROM vt QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
    maj AS (SELECT doc_id, (coalesce(wa.r, false) OR coalesce(wt.r, false))::INT::DOUBLE AS maj_acc
            FROM (SELECT DISTINCT doc_id FROM comp) LEFT JOIN wa USING (doc_id) LEFT JOIN wt USING (doc_id))
"""


@query("a3_majority_at_n", f"WITH {COMPLETIONS_SQL}, {MAJORITY_SQL} SELECT * FROM maj")
def _(t: Tables):
    return mt.majority_at_n(completions(t), text_answer="text_answer")


# ---- multiple choice --------------------------------------------------------------------------------------

SCORES_SQL = """
    s AS (SELECT event_id AS seq, user_id * 8 + event_id % 8 AS doc_id, (props->>'$.k')::INT % 5 AS cont_id, -value / 10 AS ll,
                 (user_id % 5)::INT AS label, (5 + event_id % 11)::INT AS cont_str_len, (6 + event_id % 13)::INT AS cont_byte_len,
                 -(1 + event_id % 7)::DOUBLE AS dc_ll FROM events)
"""


def scores(t: Tables):
    e = F.col("event_id")
    return with_k(t).select(
        e.alias("seq"), (F.col("user_id") * 8 + e % 8).alias("doc_id"), (F.col("k") % 5).alias("cont_id"),
        (-F.col("value") / 10).alias("ll"), (F.col("user_id") % 5).cast("int").alias("label"),
        (5 + e % 11).cast("int").alias("cont_str_len"), (6 + e % 13).cast("int").alias("cont_byte_len"),
        (-(1 + e % 7)).cast("double").alias("dc_ll"),
    )


def _mc_sql(value: str, tail: str) -> str:
    return f"""
    WITH {SCORES_SQL}, o AS (SELECT *, {value} AS v FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, cont_id ORDER BY seq) = 1),
    d AS (SELECT doc_id, arg_min(label, seq) AS label, max(cont_id) + 1 = count(*) AS whole FROM o GROUP BY doc_id),
    p AS (SELECT doc_id, cont_id AS pred FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, cont_id) = 1),
    pred AS (SELECT doc_id, pred, label FROM p JOIN d USING (doc_id) WHERE whole)
    {tail}
    """


_ACC_TAIL = "SELECT round(avg((pred = label)::INT), 9) AS acc, count(*) AS n FROM pred"
for _name, _metric, _value in (
    ("a4_mc_accuracy", "acc", "ll"),
    ("a5_length_normalised_accuracy", "len_norm", "ll / cont_str_len"),
    ("a6_domain_conditional_accuracy", "pmi_dc", "ll / dc_ll"),
):

    @query(_name, _mc_sql(_value, _ACC_TAIL))
    def _(t: Tables, metric=_metric):
        return rounded(mt.mc_accuracy(scores(t), metric))


@query(
    "a7_gold_loss",
    f"""
    WITH {SCORES_SQL}, o AS (SELECT * FROM s WHERE cont_id = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1)
    SELECT round(avg(-ll / cont_str_len), 9) AS ce_loss, round(avg(-ll / cont_byte_len * 1.44269504089), 9) AS bpb FROM o
    """,
)
def _(t: Tables):
    return rounded(mt.gold_loss(scores(t)))


# ---- classification -----------------------------------------------------------------------------------------


def _f1_sql(pos: int) -> str:
    return f"""
    SELECT round(2.0 * tp / (g + p), 9) AS f1, round(acc, 9) AS acc FROM (SELECT count(*) FILTER (quality = {pos} AND toxic = {pos}) AS tp,
      count(*) FILTER (quality = {pos}) AS g, count(*) FILTER (toxic = {pos}) AS p, avg((quality = toxic)::INT) AS acc FROM labels)
    """


@query("a8_f1_positive_0", _f1_sql(0))
def _(t: Tables):
    return rounded(mt.f1_binary(t.labels, "quality", "toxic", 0))


@query("a9_f1_positive_1", _f1_sql(1))
def _(t: Tables):
    return rounded(mt.f1_binary(t.labels, "quality", "toxic", 1))


ORDER_PRED = "['F', 'O', 'P'][o_custkey % 3 + 1]"


@query(
    "a10_f1_macro",
    f"""
    WITH o AS (SELECT o_orderstatus AS g, {ORDER_PRED} AS p FROM orders),
    f AS (SELECT k, 2.0 * count(*) FILTER (g = k AND p = k) / (count(*) FILTER (g = k) + count(*) FILTER (p = k)) AS f1
          FROM o, (SELECT unnest(['F', 'O', 'P']) AS k) GROUP BY k)
    SELECT round(avg(f1), 9) AS f1, (SELECT round(avg((g = p)::INT), 9) FROM o) AS acc FROM f
    """,
)
def _(t: Tables):
    pred = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("o_custkey") % 3 + 1).cast("int"))
    rows = t.orders.select("o_orderstatus", pred.alias("pred"))
    return rounded(mt.f1_macro(rows, "o_orderstatus", "pred", ["F", "O", "P"]))


@query("a11_matthews", "SELECT round(corr(quality, toxic), 9) AS mcc FROM labels")
def _(t: Tables):
    return rounded(mt.mcc(t.labels, "quality", "toxic"))


STEP_SQL = "l AS (SELECT l_orderkey, l_suppkey, (l_returnflag = 'A')::INT AS gold, (l_linestatus = 'F')::INT AS pred, l_quantity > 5 AS ok FROM lineitem)"


def steps(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_suppkey", (F.col("l_returnflag") == "A").cast("int").alias("gold"),
        (F.col("l_linestatus") == "F").cast("int").alias("pred"), (F.col("l_quantity") > 5).alias("ok"),
    )


@query(
    "a12_all_correct",
    f"""
    WITH {STEP_SQL}, a AS (SELECT avg(r) AS acc FROM (SELECT bool_and(ok)::INT AS r FROM l GROUP BY l_orderkey, l_suppkey)),
    b AS (SELECT stddev_samp(r) / sqrt(count(*)) AS e FROM (SELECT bool_and(ok)::INT AS r FROM l GROUP BY l_orderkey))
    SELECT round(acc, 9) AS acc, round(e, 9) AS acc_stderr FROM a, b
    """,
)
def _(t: Tables):
    return rounded(mt.all_correct(steps(t), ["l_orderkey", "l_suppkey"], ["l_orderkey"], "ok"))


@query(
    "a13_question_f1",
    f"""
    WITH {STEP_SQL}, q AS (SELECT bool_and(gold = pred)::INT AS em, CASE WHEN sum(pred) > 0 THEN sum(gold * pred) / sum(pred) ELSE 1.0 END::DOUBLE AS p,
      CASE WHEN sum(gold) > 0 THEN sum(gold * pred) / sum(gold) ELSE 1.0 END::DOUBLE AS r FROM l GROUP BY l_orderkey)
    SELECT round(avg(em), 9) AS em, round(avg(2 * p * r / (p + r)) FILTER (p + r > 0), 9) AS f1 FROM q
    """,
)
def _(t: Tables):
    return rounded(mt.question_f1(steps(t), ["l_orderkey"], "gold", "pred"))


@query("a14_group_em", f"WITH {STEP_SQL} SELECT round(avg(r), 9) AS em FROM (SELECT bool_and(ok)::INT AS r FROM l GROUP BY l_orderkey)")
def _(t: Tables):
    return rounded(mt.group_em(steps(t), "l_orderkey", "ok"))


# ---- likelihood ------------------------------------------------------------------------------------------------


@query("a15_perplexity", "SELECT round(exp(-avg(-value / 100)), 9) AS ppl FROM events")
def _(t: Tables):
    return rounded(mt.perplexity(t.events.select((-F.col("value") / 100).alias("ll"))))


DOC_LL_SQL = "d AS (SELECT *, -(n_chars * 0.5 + doc_id % 13) AS ll FROM documents)"


def doc_scores(t: Tables):
    return t.documents.withColumn("ll", -(F.col("n_chars") * 0.5 + F.col("doc_id") % 13))


_CORPUS_SQL = r"""round(exp(-sum(ll) / sum(len(regexp_split_to_array(text, '\s+')))), 9) AS word_perplexity,
    round(exp(-sum(ll) / sum(strlen(text))), 9) AS byte_perplexity, round(-sum(ll) / sum(strlen(text)) / ln(2), 9) AS bits_per_byte"""


@query("a16_corpus_perplexity", f"WITH {DOC_LL_SQL} SELECT {_CORPUS_SQL} FROM d")
def _(t: Tables):
    return rounded(mt.corpus_perplexity(doc_scores(t), "ll", "text"))


@query("a17_perplexity_by_source", f"WITH {DOC_LL_SQL} SELECT source, round(exp(-avg(ll / n_chars)), 9) AS ppl FROM d GROUP BY source")
def _(t: Tables):
    rows = doc_scores(t).withColumn("per_char", F.col("ll") / F.col("n_chars"))
    return rounded(mt.perplexity(rows, "per_char", ["source"]))


@query("a18_bits_per_char", f"WITH {DOC_LL_SQL} SELECT round(-sum(ll) / sum(n_chars) / ln(2), 9) AS entropy FROM d")
def _(t: Tables):
    return rounded(mt.entropy_per_unit(doc_scores(t), "ll", F.col("n_chars")))


@query(
    "a19_token_perplexity",
    rf"WITH {DOC_LL_SQL} SELECT round(exp(-sum(ll) / 10 / sum(len(regexp_extract_all(text, '\S+')))), 9) AS ppl FROM d",
)
def _(t: Tables):
    return rounded(mt.token_ppl(doc_scores(t).withColumn("ll", F.col("ll") / 10), "ll", F.size(tx.words("text"))))


@query(
    "a20_eval_loss",
    """
    SELECT event_type, round(sum(value / 100 * (user_id % 3)) / sum(user_id % 3), 9) AS loss,
           round(exp(sum(value / 100 * (user_id % 3)) / sum(user_id % 3)), 9) AS ppl
    FROM events WHERE event_type <> 'error' GROUP BY 1
    """,
)
def _(t: Tables):
    weight = F.when(F.col("event_type") == "error", 0).otherwise(F.col("user_id") % 3)
    rows = t.events.select("event_type", (F.col("value") / 100).alias("loss"), weight.alias("w"))
    return rounded(mt.eval_loss(rows, "event_type", "loss", "w"))


@query(
    "a21_accuracy",
    "SELECT round(avg((quality = toxic)::INT), 9) AS acc, round((avg((quality = toxic)::INT) - 0.5) / 0.5, 9) AS relative_improvement FROM labels",
)
def _(t: Tables):
    acc = mt.accuracy(t.labels, "quality", "toxic")
    return rounded(acc.crossJoin(F.broadcast(mt.relative_accuracy(t.labels, "quality", "toxic", 2))))


# ---- roll-ups and spread -----------------------------------------------------------------------------------------

CATEGORY_SQL = """
    map AS (SELECT n_nationkey AS subject, n_name AS sub, r_name AS category FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
            SELECT n_nationkey, 'even', r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0),
    rows AS (SELECT s_nationkey AS subject, l_quantity > 25 AS ok FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""


def categories(t: Tables):
    """Many to many: even nations also belong to a sub-category of their own."""
    base = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    own = base.select(F.col("n_nationkey").alias("subject"), F.col("n_name").alias("sub"), F.col("r_name").alias("category"))
    even = base.filter(F.col("n_nationkey") % 2 == 0).select(
        F.col("n_nationkey").alias("subject"), F.lit("even").alias("sub"), F.col("r_name").alias("category")
    )
    return own.unionByName(even)


def subject_rows(t: Tables):
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("subject"), (F.col("l_quantity") > 25).alias("ok")
    )


@query(
    "a22_accuracy_rollup",
    f"""
    WITH {CATEGORY_SQL}, x AS (
      SELECT 'subject' AS level, subject::VARCHAR AS name, ok FROM rows UNION ALL SELECT 'overall', 'all', ok FROM rows UNION ALL
      SELECT 'subcategory', sub, ok FROM rows JOIN (SELECT DISTINCT subject, sub FROM map) USING (subject) UNION ALL
      SELECT 'category', category, ok FROM rows JOIN (SELECT DISTINCT subject, category FROM map) USING (subject))
    SELECT level, name, round(avg(ok::INT), 9) AS acc, count(*) AS n FROM x GROUP BY ALL
    """,
)
def _(t: Tables):
    return rounded(mt.accuracy_rollup(subject_rows(t), categories(t), "subject", "ok", "sub", "category"))


@query(
    "a23_mean_stderr",
    """
    SELECT event_type, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS pop_stddev, round(stddev_samp(value), 9) AS sample_stddev,
           round(stddev_samp(value) / sqrt(count(*)), 9) AS stderr FROM events GROUP BY 1
    """,
)
def _(t: Tables):
    return rounded(mt.mean_stderr(t.events, "value", ["event_type"]))


@query(
    "a24_bootstrap_stderr",
    """
    WITH n AS (SELECT count(*) AS n FROM labels),
    t AS (SELECT quality, toxic, count(*) AS c, md5('tuple:' || quality || ':' || toxic) AS h FROM labels GROUP BY ALL),
    r AS (SELECT quality, toxic, sum(c) OVER (ORDER BY h) - c AS st, sum(c) OVER (ORDER BY h) AS en FROM t),
    d AS (SELECT rep, ('0x' || substr(md5('11:' || rep || ':' || i), 1, 15))::BIGINT % n AS draw
          FROM n, (SELECT unnest(range(0, 200)) AS rep), (SELECT unnest(range(0, (SELECT n FROM n))) AS i)),
    m AS (SELECT rep, 2.0 * count(*) FILTER (quality = 1 AND toxic = 1) / (count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1)) AS m
          FROM d JOIN r ON draw >= st AND draw < en GROUP BY rep)
    SELECT round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS stderr FROM m
    """,
)
def _(t: Tables):
    q, x = F.col("quality") == 1, F.col("toxic") == 1
    f1 = 2.0 * F.sum(mt.truth(q & x)) / (F.sum(mt.truth(q)) + F.sum(mt.truth(x)))
    return rounded(mt.bootstrap_stderr(t.labels, ["quality", "toxic"], f1, 200, 11))


@query("a25_median", "SELECT round(median(value), 9) AS median FROM events")
def _(t: Tables):
    return rounded(mt.median(t.events, "value"))


# ---- ranking and several golds ----------------------------------------------------------------------------------------


@query(
    "a26_rank_metrics",
    """
    WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events),
    g AS (SELECT user_id, value AS gold FROM c WHERE idx = user_id % 4),
    d AS (SELECT user_id, count(*) FILTER (value > gold) AS above, arg_max(idx, value - idx / 1e9) = user_id % 4 AS first
          FROM c JOIN g USING (user_id) GROUP BY user_id)
    SELECT round(avg(first::INT), 9) AS recall_1, round(avg((above = 1)::INT + first::INT), 9) AS recall_2, round(avg(1.0 / (above + 1)), 9) AS mrr FROM d
    """,
)
def _(t: Tables):
    numbered = with_position(t.events, "event_id", ["user_id"], out="idx")
    rows = numbered.select("user_id", "value", "idx", (F.col("user_id") % 4).cast("int").alias("label"))
    return rounded(mt.rank_metrics(rows, "user_id", "idx", "value", "label"))


@query(
    "a27_mc1_mc2",
    """
    WITH c AS (SELECT user_id, -value / 20 AS ll, (props->>'$.k')::INT % 2 = 0 AS is_true, event_id FROM events),
    d AS (SELECT user_id, sum(exp(ll)) FILTER (is_true) / sum(exp(ll)) AS mc2, arg_max(event_id, ll - event_id / 1e12) AS best FROM c GROUP BY user_id)
    SELECT round(avg((best < 100)::INT), 9) AS mc1, round(avg(coalesce(mc2, 0)), 9) AS mc2 FROM d
    """,
)
def _(t: Tables):
    # the candidate index is 0 for the first hundred events, so that some groups are won by it
    rows = with_k(t).select(
        "user_id", (-F.col("value") / 20).alias("ll"), (F.col("k") % 2 == 0).alias("is_true"),
        F.when(F.col("event_id") < 100, 0).otherwise(F.col("event_id")).alias("idx"),
    )
    return rounded(mt.mc1_mc2(rows, "user_id", "idx", "ll", "is_true"))


GOLDS_SQL = r"""
    g AS (SELECT item_id, i, text AS pred, string_split(text, '.')[i] AS gold
          FROM (SELECT *, unnest(range(1, len(string_split(text, '.')) + 1)) AS i FROM benchmark)),
    w AS (SELECT item_id, i, {p} AS p, {g} AS g FROM g),
    m AS (SELECT item_id, i, (array_to_string(p, ' ') = array_to_string(g, ' '))::INT::DOUBLE AS em, len(p) AS np, len(g) AS ng,
                 list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS same FROM w),
    s AS (SELECT item_id, i, em, CASE WHEN np = 0 OR ng = 0 THEN (np = ng)::INT WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2.0 * same / (np + ng) END::DOUBLE AS f1 FROM m)
"""
_NORMAL = r"""list_filter(regexp_extract_all(translate(lower({}), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\S+'), lambda t: t NOT IN ('a', 'an', 'the'))"""
GOLDS_SQL = GOLDS_SQL.format(p=_NORMAL.format("pred"), g=_NORMAL.format("gold"))


def golds(t: Tables):
    """A whole item against each of its sentences."""
    parts = F.split("text", r"\.")
    return t.benchmark.select("item_id", F.col("text").alias("pred"), F.posexplode(parts).alias("i", "gold"))


@query(
    "a28_max_over_golds",
    f"WITH {GOLDS_SQL}, b AS (SELECT item_id, max(em) AS em, max(f1) AS f1 FROM s GROUP BY item_id) "
    "SELECT round(avg(em), 9) AS em, round(avg(f1), 9) AS f1 FROM b",
)
def _(t: Tables):
    return rounded(mt.max_over_golds(golds(t), "item_id", "pred", "gold"))


@query(
    "a29_leave_one_out",
    f"""
    WITH {GOLDS_SQL}, n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
    r AS (SELECT a.item_id, a.i, max(b.em) AS em, max(b.f1) AS f1 FROM s a JOIN n USING (item_id)
          JOIN s b ON a.item_id = b.item_id AND (a.i <> b.i OR n = 1) GROUP BY ALL),
    d AS (SELECT item_id, avg(em) AS em, avg(f1) AS f1 FROM r GROUP BY item_id)
    SELECT 'em' AS metric, round(avg(em), 9) AS score FROM d UNION ALL SELECT 'f1', round(avg(f1), 9) FROM d
    """,
)
def _(t: Tables):
    return rounded(mt.leave_one_out(golds(t), "item_id", "i", "pred", "gold"))


@query(
    "a30_any_alias",
    """
    WITH a AS (SELECT DISTINCT p_brand AS doc, unnest([p_name, split_part(p_name, ' ', 1), p_name || ' x']) AS alias, p_size, p_partkey FROM part),
    h AS (SELECT doc, alias, max((p_size = 7)::INT) AS hit FROM a GROUP BY ALL),
    k AS (SELECT * FROM h x WHERE NOT EXISTS (SELECT 1 FROM h y WHERE y.doc = x.doc AND y.alias <> x.alias AND starts_with(x.alias, y.alias)))
    SELECT round(avg(m), 9) AS acc FROM (SELECT doc, max(hit) AS m FROM k GROUP BY doc)
    """,
)
def _(t: Tables):
    first = F.substring_index("p_name", " ", 1)
    rows = t.part.select(
        "p_brand", F.explode(F.array("p_name", first, F.concat("p_name", F.lit(" x")))).alias("alias"), (F.col("p_size") == 7).alias("hit")
    )
    return rounded(mt.any_alias(rows, "p_brand", "alias", "hit"))


@query("a31_pair_accuracy", "SELECT round(avg((value > (props->>'$.k')::INT)::INT), 9) AS acc FROM events")
def _(t: Tables):
    return rounded(mt.pair_accuracy(with_k(t), "value", "k"))


QA_SQL = r"""
    d AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, quality, toxic, ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS na
          FROM documents JOIN labels USING (doc_id)),
    q AS (SELECT doc_id, CASE WHEN toxic = 1 THEN '' ELSE array_to_string(w, ' ') END AS pred,
                 CASE WHEN quality = 1 THEN array_to_string(list_filter(w, lambda x: length(x) > 1 + doc_id % 5), ' ') END AS gold, na FROM d),
    w2 AS (SELECT doc_id, na, gold IS NOT NULL AS has, pred <> '' AS answered, {p} AS p, {g} AS g FROM q),
    m AS (SELECT *, (array_to_string(p, ' ') = array_to_string(g, ' '))::INT::DOUBLE AS exact, len(p) AS np, len(g) AS ng,
           list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS same FROM w2),
    s AS (SELECT has, answered, na, exact, CASE WHEN np = 0 OR ng = 0 THEN (np = ng)::INT WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2.0 * same / (np + ng) END::DOUBLE AS f1 FROM m),
    r AS (SELECT sum(CASE WHEN has THEN exact ELSE -answered::INT END) OVER (ORDER BY na) AS re, sum(CASE WHEN has THEN f1 ELSE -answered::INT END) OVER (ORDER BY na) AS rf FROM s),
    b AS (SELECT greatest(max(re), 0) AS be, greatest(max(rf), 0) AS bf FROM r),
    n AS (SELECT count(*) AS n, count(*) FILTER (NOT has) AS n0 FROM s)
""".format(p=_NORMAL.format("pred"), g=_NORMAL.format("coalesce(gold, '')"))


@query(
    "a35_qa_report",
    f"""
    WITH {QA_SQL} SELECT round(100 * avg(exact), 7) AS exact, round(100 * avg(f1), 7) AS f1, round(100 * avg(exact) FILTER (has), 7) AS has_exact,
      round(100 * avg(f1) FILTER (has), 7) AS has_f1, round(100 * avg(exact) FILTER (NOT has), 7) AS no_exact, round(100 * avg(f1) FILTER (NOT has), 7) AS no_f1,
      round(any_value(100 * (n0 + be) / n), 7) AS best_exact, round(any_value(100 * (n0 + bf) / n), 7) AS best_f1 FROM s, b, n
    """,
)
def _(t: Tables):
    w = tx.words("text")
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "").otherwise(F.array_join(w, " ")).alias("pred"),
        F.when(F.col("quality") == 1, F.array_join(F.filter(w, lambda x: F.length(x) > 1 + F.col("doc_id") % 5), " ")).alias("gold"),
        hash_unit(5, "doc_id").alias("na"),
    )
    return rounded(mt.qa_report(rows, "pred", "gold", "na"), 7)


# ---- rewards, preferences, runs --------------------------------------------------------------------------------------------

PAIRS_SQL = "p AS (SELECT event_id, value / 20 - 3 AS c, (props->>'$.k')::INT / 20.0::DOUBLE - 2 AS r, (user_id % 10) / 10.0::DOUBLE AS m FROM events)"


def pairs(t: Tables):
    return with_k(t).select(
        "event_id", (F.col("value") / 20 - 3).alias("c"), (F.col("k") / 20.0 - 2).alias("r"), (F.col("user_id") % 10 / 10.0).alias("m")
    )


_HIST = ", ".join(f"sum((least(floor((x + 10) / 2), 9) = {i} AND x BETWEEN -10 AND 10)::INT) / count(*) FILTER (x BETWEEN -10 AND 10)" for i in range(10))


@query(
    "a38_reward_report",
    f"""
    WITH {PAIRS_SQL}, x AS (SELECT c AS x FROM p UNION ALL SELECT r FROM p),
    s AS (SELECT avg(x) AS m, stddev_samp(x) AS sd, [{_HIST}] AS h FROM x), l AS (SELECT avg((c > r)::INT) AS acc, avg(ln(1 + exp(r - c))) AS loss FROM p)
    SELECT round(m, 9) AS reward_mean, round(sd, 9) AS reward_std, round(acc, 9) AS acc, round(loss, 9) AS loss, i::INT AS bin, round(h[i + 1], 9) AS density
    FROM s, l, (SELECT unnest(range(0, 10)) AS i)
    """,
)
def _(t: Tables):
    report = mt.reward_report(pairs(t), "c", "r")
    return rounded(report.select("reward_mean", "reward_std", "acc", "loss", F.posexplode("histogram").alias("bin", "density")))


LOGPS_SQL = """
    lp AS (SELECT event_id, -value / 50 AS pc, -(props->>'$.k')::INT / 30.0::DOUBLE AS pr, -value / 60 - 0.3 AS rc, -(props->>'$.k')::INT / 40.0::DOUBLE - 0.2 AS rr,
           (event_id % 3 - 1)::INT AS label FROM events)
"""


def logps(t: Tables):
    return with_k(t).select(
        "event_id", (-F.col("value") / 50).alias("pi_chosen"), (-F.col("k") / 30.0).alias("pi_rejected"),
        (-F.col("value") / 60 - 0.3).alias("ref_chosen"), (-F.col("k") / 40.0 - 0.2).alias("ref_rejected"),
        (F.col("event_id") % 3 - 1).cast("int").alias("label"),
    )


@query(
    "a39_preference_report",
    f"""
    WITH {LOGPS_SQL}, z AS (SELECT 0.5 * ((pc - pr) - (rc - rr)) AS z, (pc - pr) - (rc - rr) AS g, 0.5 * (pc - rc) AS c, 0.5 * (pr - rr) AS r FROM lp)
    SELECT 'plain' AS form, round(avg(ln(1 + exp(-z))), 9) AS loss, round(avg((c > r)::INT), 9) AS acc, round(avg(c), 9) AS chosen_reward, round(avg(r), 9) AS rejected_reward FROM z UNION ALL
    SELECT 'smoothed', round(avg(0.9 * ln(1 + exp(-z)) + 0.1 * ln(1 + exp(z))), 9), round(avg((c > r)::INT), 9), round(avg(c), 9), round(avg(r), 9) FROM z UNION ALL
    SELECT 'squared', round(avg((g - 1) * (g - 1)), 9), round(avg((c > r)::INT), 9), round(avg(c), 9), round(avg(r), 9) FROM z
    """,
)
def _(t: Tables):
    rows = logps(t)
    forms = {
        "plain": mt.preference_report(rows, 0.5), "smoothed": mt.preference_report(rows, 0.5, smoothing=0.1),
        "squared": mt.preference_report(rows, 0.5, squared=True),
    }
    named = [df.select(F.lit(name).alias("form"), "*") for name, df in forms.items()]
    return rounded(named[0].unionByName(named[1]).unionByName(named[2]))


@query(
    "a40_unpaired_report",
    f"""
    WITH {LOGPS_SQL}, b AS (SELECT greatest(avg(pr - rr) FILTER (label = -1), 0) AS kl FROM lp),
    l AS (SELECT label, pc - rc AS x, kl, CASE WHEN label = 1 THEN 1.5 * (1 - 1 / (1 + exp(-0.5 * (pc - rc - kl)))) ELSE 0.5 * (1 - 1 / (1 + exp(-0.5 * (kl - (pc - rc))))) END AS loss
          FROM lp, b WHERE label >= 0),
    e AS (SELECT greatest(avg(pc - rc) FILTER (label = 1), 0) AS kc, greatest(avg(pc - rc) FILTER (label = 0), 0) AS kr FROM lp WHERE label >= 0),
    el AS (SELECT avg(CASE WHEN label = 1 THEN 1 - 1 / (1 + exp(-0.5 * (pc - rc - kr))) ELSE 1 - 1 / (1 + exp(-0.5 * (kc - (pc - rc)))) END) AS even_loss FROM lp, e WHERE label >= 0)
    SELECT round(avg(loss), 9) AS loss, round(0.5 * avg(x) FILTER (label = 1), 9) AS chosen_reward, round(0.5 * avg(x) FILTER (label = 0), 9) AS rejected_reward,
           round(max(kl), 9) AS kl, round(any_value(even_loss), 9) AS even_loss FROM l, el
    """,
)
def _(t: Tables):
    rows = logps(t).select(
        F.col("pi_chosen").alias("pi"), F.col("ref_chosen").alias("ref"), "label", (F.col("pi_rejected") - F.col("ref_rejected")).alias("kl")
    )
    report = mt.unpaired_report(rows, 0.5, 1.5, 0.5)
    even = mt.even_unpaired_report(rows.filter("label >= 0"), 0.5).withColumnRenamed("loss", "even_loss")
    return rounded(report.crossJoin(F.broadcast(even)))


@query(
    "a41_pair_loss",
    f"WITH {PAIRS_SQL} SELECT round(avg(ln(1 + exp(-(c - r - m)))), 9) AS loss, round(avg(ln(1 + exp(r - c))), 9) AS log_exp_loss FROM p",
)
def _(t: Tables):
    return rounded(mt.pair_loss(pairs(t), "c", "r", "m"))


@query(
    "a42_step_accuracy",
    """
    WITH s AS (SELECT user_id, event_id // 4 AS step, (event_id % 4)::INT AS cand, value, (user_id % 4)::INT AS label FROM events WHERE event_type <> 'error'),
    b AS (SELECT user_id, step, cand, label FROM s QUALIFY row_number() OVER (PARTITION BY user_id, step ORDER BY value DESC, cand) = 1)
    SELECT round(avg((cand = label)::INT), 9) AS acc, count(*) AS n_steps FROM b
    """,
)
def _(t: Tables):
    rows = t.events.select(
        "user_id", F.floor(F.col("event_id") / 4).alias("step"), (F.col("event_id") % 4).cast("int").alias("cand"), "value",
        (F.col("user_id") % 4).cast("int").alias("label"), (F.col("event_type") != "error").alias("placeholder"),
    )
    return rounded(mt.step_accuracy(rows, ["user_id", "step"], "cand", "value", "label", "placeholder"))


@query("a43_eval_acc_by_step", "SELECT event_id // 100 AS step, round(avg(value), 9) AS eval_acc FROM events GROUP BY 1")
def _(t: Tables):
    rows = t.events.select(F.floor(F.col("event_id") / 100).alias("step"), "value")
    return rounded(mt.eval_acc_by_step(rows, "step", "value"))


@query(
    "a44_throughput_report",
    r"""
    WITH b AS (SELECT lang, doc_id // 32 AS batch, count(*) AS i, sum(len(regexp_split_to_array(text, '\s+'))) AS w, sum(len(regexp_extract_all(text, '\S+'))) AS t,
                      max(1 + doc_id // 32 % 5)::DOUBLE AS s FROM documents GROUP BY ALL)
    SELECT lang, sum(i)::BIGINT AS n_instances, sum(w)::BIGINT AS n_words, sum(t)::BIGINT AS n_tokens, round(sum(i) / sum(s), 9) AS instances_per_second,
           round(sum(w) / sum(s), 9) AS words_per_second, round(sum(t) / sum(s), 9) AS tokens_per_second, round(sum(s) / count(*) * 1000, 9) AS latency_ms FROM b GROUP BY lang
    """,
)
def _(t: Tables):
    batch = F.floor(F.col("doc_id") / 32)
    rows = t.documents.select("lang", "text", batch.alias("batch"), (1 + batch % 5).cast("double").alias("seconds"))
    return rounded(mt.throughput_report(rows, "text", "seconds", "batch", ["lang"]))


@query("a46_dedup_pairs", "SELECT DISTINCT lang AS prompt, md5(text) AS response FROM documents")
def _(t: Tables):
    # a digest of the text decides equality, so whole texts never cross the network
    rows = t.documents.select(F.col("lang").alias("prompt"), F.md5("text").alias("response"))
    return mt.dedup_pairs(rows, "prompt", "response")


@query(
    "a48_greedy_accuracy",
    "SELECT round(avg((value >= 30)::INT), 9) AS acc, round(exp(avg(value / 100)), 9) AS ppl FROM events",
)
def _(t: Tables):
    rows = t.events.select((-F.col("value") / 100).alias("ll"), (F.col("value") >= 30).alias("greedy"))
    return rounded(mt.greedy_accuracy(rows, "ll", "greedy"))


@query(
    "a49_exact_match",
    "SELECT round(avg((text = lower(substr(text, 1, 1)) || substr(text, 2) OR item_id % 3 = 0)::INT), 9) AS acc FROM benchmark",
)
def _(t: Tables):
    lowered = F.concat(F.lower(F.substring("text", 1, 1)), F.substring("text", 2, 1 << 30))
    rows = t.benchmark.select("text", F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(lowered).alias("gold"))
    return rounded(mt.exact_match(rows, "text", "gold"))


@query(
    "a37_source_report",
    """
    WITH d AS (SELECT CASE WHEN starts_with(source, 'src1') THEN 'src1' WHEN starts_with(source, 'src') THEN 'src' END AS source, n_chars,
               ('0x' || substr(md5('9:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.4 AS taken FROM documents)
    SELECT source, sum(n_chars)::BIGINT AS total_tokens, sum(CASE WHEN taken THEN n_chars ELSE 0 END)::BIGINT AS taken_tokens,
           printf('%.4f', sum(CASE WHEN taken THEN n_chars ELSE 0 END) / (SELECT sum(n_chars) FROM d WHERE taken)) AS share FROM d GROUP BY source
    """,
)
def _(t: Tables):
    rows = mt.longest_prefix(t.documents, "source", ["src", "src1"], "prefix").select(
        F.col("prefix").alias("source"), "n_chars", (hash_unit(9, "doc_id") < 0.4).alias("taken")
    )
    return mt.source_report(rows, "source", "n_chars", "taken")


@query(
    "x4_reward_function",
    "SELECT event_id, CASE WHEN event_type = ['view', 'click', 'purchase'][user_id % 3 + 1] THEN 1.0 ELSE 0.0 END::DOUBLE - length(props) / 100.0 AS reward FROM events",
)
def _(t: Tables):
    kinds = F.array(*[F.lit(x) for x in ("view", "click", "purchase")])
    rows = t.events.withColumn("label", F.element_at(kinds, (F.col("user_id") % 3 + 1).cast("int")))
    scored = mt.score(
        rows, lambda q, p, label: mt.truth(q == label) - F.length(p) / 100.0, "event_type", "props", "label"
    )
    return scored.select("event_id", "reward")
