"""Array and nested-value functions over documents, embeddings, conversations and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as ans
from ..functions import arrays as ar
from ..functions import nested as ne
from ..functions import text as tx
from ..operators import rows as rw
from ..plans.layout import spread
from ..plans.skew import with_group_stats
from .registry import Tables, query

TOKENS_SQL = r"SELECT doc_id, source, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)::INT) AS x FROM documents"


def doc_tokens(t: Tables):
    """Documents with one small number per word: its length."""
    docs = spread(t.documents.select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", "source", F.transform(tx.words("text"), lambda w: F.length(w)).alias("x"))


TURN_TOKENS_SQL = TOKENS_SQL.replace("doc_id, source", "conv_id, turn, role").replace("documents", "conversations")


def turn_tokens(t: Tables):
    return t.conversations.select(
        "conv_id", "turn", "role", F.transform(tx.words("text"), lambda w: F.length(w)).alias("x")
    )


@query(
    "f14_periodic_runs",
    f"""
    WITH t AS ({TOKENS_SQL}),
    l AS (SELECT doc_id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM t),
    e AS (SELECT doc_id, n, i, p, v = lag(v, p) OVER (PARTITION BY doc_id, p ORDER BY i) AS eq
          FROM l, (SELECT unnest(range(1, 14)) AS p)),
    r AS (SELECT doc_id, n, i, p, eq, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM e),
    s AS (SELECT doc_id, n, p, min(i) AS s, max(i) + 1 AS e FROM r WHERE eq GROUP BY doc_id, n, p, g)
    SELECT doc_id, (s - p)::INT AS start, e::INT AS "end", p::INT AS period, ((e - s + p) // p)::INT AS times FROM s
    WHERE ((s + p - 1) // p + 1) * p <= e AND e - s + p >= 3 * p AND p <= n // 3
    """,
)
def _(t: Tables):
    runs = doc_tokens(t).select("doc_id", F.explode(ar.periodic_runs(F.col("x"), 13)).alias("r"))
    return runs.select("doc_id", "r.*")


@query(
    "f15_true_run_ends",
    r"""
    SELECT doc_id, CASE WHEN list_position(f, false) IS NULL THEN len(f) ELSE list_position(f, false) - 1 END::INT AS first_end,
           CASE WHEN f[len(f)] THEN len(f) - (coalesce(list_position(list_reverse(f), false), len(f) + 1) - 1) ELSE -1 END::INT AS last_start
    FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w) > 1) AS f FROM documents)
    """,
)
def _(t: Tables):
    flags = t.documents.select("doc_id", F.transform(tx.words("text"), lambda w: F.length(w) > 1).alias("f"))
    return flags.select(
        "doc_id", ar.end_of_first_true(F.col("f")).alias("first_end"), ar.start_of_last_true(F.col("f")).alias("last_start")
    )


@query(
    "f20_truncate_add_eos",
    f"""
    SELECT doc_id, array_to_string(l, ' ') AS keep_left, array_to_string(r, ' ') AS keep_right,
           array_to_string(CASE WHEN l[len(l)] = 3 THEN l ELSE list_append(l, 3) END, ' ') AS with_eos
    FROM (SELECT doc_id, x[1:64] AS l, x[greatest(len(x) - 63, 1):] AS r FROM ({TOKENS_SQL}))
    """,
)
def _(t: Tables):
    left, right = ar.truncate(F.col("x"), 64), ar.truncate(F.col("x"), 64, side="left")
    join = lambda c: F.array_join(c.cast("array<string>"), " ")
    return doc_tokens(t).select(
        "doc_id", join(left).alias("keep_left"), join(right).alias("keep_right"), join(ar.add_eos(left, 3)).alias("with_eos")
    )


@query(
    "f21_pad_batch",
    f"""
    WITH t AS ({TURN_TOKENS_SQL}), m AS (SELECT conv_id, max(len(x)) AS mx FROM t GROUP BY conv_id),
    b AS (SELECT conv_id, turn, x, list_resize([]::INT[], mx - len(x), 0) AS z FROM t JOIN m USING (conv_id))
    SELECT conv_id, turn, array_to_string(list_concat(x, z), ' ') AS ids_right, array_to_string(list_concat(z, x), ' ') AS ids_left,
           array_to_string(list_transform(list_concat(z, x), lambda v: (v <> 0)::INT), ' ') AS mask_left FROM b
    """,
)
def _(t: Tables):
    batch = with_group_stats(turn_tokens(t), ["conv_id"], widest=F.max(F.size("x")))
    join = lambda c: F.array_join(c.cast("array<string>"), " ")
    left = ar.pad(F.col("x"), F.col("widest"), F.lit(0), side="left")
    return batch.select(
        "conv_id", "turn", join(ar.pad(F.col("x"), F.col("widest"), F.lit(0))).alias("ids_right"),
        join(left).alias("ids_left"), join(ar.attention_mask(left, 0)).alias("mask_left"),
    )


# pad = 0, end = 1; the last ``label`` slots are padding
SEQ_SQL = """SELECT vec_id, label, list_transform(embedding, lambda v, i: CASE WHEN i > 64 - label THEN 0
               ELSE (floor(abs(v::DOUBLE) * 1000)::INT % 7)::INT END) AS x FROM embeddings"""


def sequences(t: Tables):
    return t.embeddings.select(
        "vec_id", "label",
        F.transform(
            "embedding",
            lambda v, i: F.when(i >= 64 - F.col("label"), F.lit(0)).otherwise(
                (F.floor(F.abs(v.cast("double")) * 1000) % 7).cast("int")
            ),
        ).alias("x"),
    )


@query(
    "f22_attention_mask",
    f"SELECT vec_id, array_to_string(list_transform(x, lambda v: (v <> 0)::INT), '') AS mask FROM ({SEQ_SQL})",
)
def _(t: Tables):
    mask = ar.attention_mask(F.col("x"), 0).cast("array<string>")
    return sequences(t).select("vec_id", F.array_join(mask, "").alias("mask"))


ROLLOUT_SQL = f"""
    src AS ({SEQ_SQL}),
    l AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM src),
    b AS (SELECT vec_id, min(i) FILTER (v > 1) AS first, least(coalesce(max(i) FILTER (v > 1), 63) + 1, 63) AS stop FROM l GROUP BY vec_id),
    s AS (SELECT vec_id, i, first, stop, CASE WHEN i = stop THEN 1 ELSE v END AS v,
                 (i BETWEEN first AND stop)::INT AS att, (i = 31 OR CASE WHEN i = stop THEN 1 ELSE v END > 1)::INT AS act
          FROM l JOIN b USING (vec_id))
"""


@query(
    "f23_rollout_masks",
    f"""
    WITH {ROLLOUT_SQL}
    SELECT vec_id, string_agg(v::VARCHAR, ' ' ORDER BY i) AS sequence, string_agg(att::VARCHAR, '' ORDER BY i) AS attention,
           string_agg(act::VARCHAR, '' ORDER BY i) FILTER (i BETWEEN 31 AND 62) AS actions FROM s GROUP BY vec_id
    """,
)
def _(t: Tables):
    m = sequences(t).select("vec_id", ar.rollout_masks(F.col("x"), F.lit(32), 1, 0).alias("m"))
    join = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep)
    return m.select(
        "vec_id", join("m.sequence", " ").alias("sequence"), join("m.attention_mask", "").alias("attention"),
        join("m.action_mask", "").alias("actions"),
    )


@query(
    "f24_strip_padding",
    f"""
    WITH {ROLLOUT_SQL},
    n AS (SELECT *, sum(CASE WHEN i BETWEEN 31 AND 62 THEN 1 - act ELSE 0 END) OVER (PARTITION BY vec_id) AS cut FROM s)
    SELECT vec_id, string_agg(v::VARCHAR, ' ' ORDER BY i) FILTER (i >= first AND i < 64 - cut) AS sequence,
           string_agg((v * 2)::VARCHAR, ' ' ORDER BY i) FILTER (i >= 31 AND i < 63 - cut) AS per_action FROM n GROUP BY vec_id
    """,
)
def _(t: Tables):
    m = sequences(t).select("vec_id", ar.rollout_masks(F.col("x"), F.lit(32), 1, 0).alias("m")).select("vec_id", "m.*")
    doubled = F.transform(F.slice("sequence", 32, 32), lambda v: v * 2)
    s = m.select(
        "vec_id",
        ar.strip_padding(F.col("sequence"), F.col("attention_mask"), F.col("action_mask"), doubled).alias("s"),
    )
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return s.select("vec_id", join("s.sequence").alias("sequence"), join("s.per_action").alias("per_action"))


VALUES_SQL = """
    v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y,
                 generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
"""


def score_arrays(t: Tables):
    doubles = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return doubles.select(
        "*", F.reverse("x").alias("y"), F.transform("x", lambda v, i: (i % 3 > 0).cast("int")).alias("mask")
    )


@query(
    "f25_kl_estimators",
    f"""
    WITH {VALUES_SQL}, d AS (SELECT vec_id, i, CASE WHEN i % 3 > 0 THEN x - y ELSE 0 END AS d FROM v)
    SELECT vec_id, i::INT AS i, round(d, 9) AS k1, round(d * d / 2, 9) AS k2, round(exp(-d) - 1 + d, 9) AS k3 FROM d
    """,
)
def _(t: Tables):
    k = score_arrays(t).select(
        "vec_id",
        *[ar.approx_kl(F.col("x"), F.col("y"), e, F.col("mask")).alias(e) for e in ("k1", "k2", "k3")],
    )
    long = k.select("vec_id", F.posexplode(F.arrays_zip("k1", "k2", "k3")).alias("i", "z"))
    return long.select("vec_id", "i", *[F.round(f"z.{e}", 9).alias(e) for e in ("k1", "k2", "k3")])


@query(
    "f26_token_rewards",
    f"""
    WITH {VALUES_SQL}
    SELECT vec_id, i::INT AS i, round(CASE WHEN i = 62 THEN greatest(least(label - 4.0, 2.0), -2.0) ELSE 0 END
                            - 0.1 * CASE WHEN i % 3 > 0 THEN x - y ELSE 0 END, 9) AS reward FROM v
    """,
)
def _(t: Tables):
    kl = ar.approx_kl(F.col("x"), F.col("y"), "k1", F.col("mask"))
    r = ar.token_rewards(F.col("label") - 4.0, kl, F.col("mask"), 0.1, (-2.0, 2.0))
    long = score_arrays(t).select("vec_id", F.posexplode(r).alias("i", "reward"))
    return long.select("vec_id", "i", F.round("reward", 9).alias("reward"))


@query(
    "a47_masked_mean",
    f"WITH {VALUES_SQL} SELECT vec_id, round(avg(x) FILTER (i % 3 > 0), 9) AS mean FROM v GROUP BY vec_id",
)
def _(t: Tables):
    return score_arrays(t).select("vec_id", F.round(ar.masked_mean(F.col("x"), F.col("mask")), 9).alias("mean"))


@query(
    "w10_masked_normalize",
    f"""
    WITH {VALUES_SQL}, m AS (SELECT *, CASE WHEN i % 3 > 0 THEN x ELSE 0 END AS z, avg(x) FILTER (i % 3 > 0) OVER w AS mu,
                                    var_pop(x) FILTER (i % 3 > 0) OVER w AS var FROM v WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, i::INT AS i, round((z - mu) / sqrt(greatest(var, 1e-8)), 7) AS z FROM m
    """,
)
def _(t: Tables):
    z = score_arrays(t).select(
        "vec_id", F.posexplode(ar.masked_normalize(F.col("x"), F.col("mask"))).alias("i", "z")
    )
    return z.select("vec_id", "i", F.round("z", 7).alias("z"))


@query(
    "w3_document_lengths",
    f"""
    WITH t AS ({TOKENS_SQL}), l AS (SELECT doc_id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM t),
    b AS (SELECT doc_id, i FROM l WHERE v = 2 OR i = n - 1)
    SELECT doc_id, (row_number() OVER w - 1)::INT AS k, (i - coalesce(lag(i) OVER w, -1))::INT AS length FROM b
    WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    """,
)
def _(t: Tables):
    return doc_tokens(t).filter(F.size("x") > 0).select("doc_id", F.posexplode(ar.doc_lengths(F.col("x"), 2)).alias("k", "length"))


GAMMA = 0.987654321  # many digits, so that no result sits on a rounding boundary
STEPS_SQL = """
    st AS (SELECT l_orderkey, l_discount AS r, l_tax AS v, (l_returnflag <> 'R')::INT AS m,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i,
             count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
"""


def rollouts(t: Tables):
    """Line items of an order in line order as step arrays."""
    return rw.step_arrays(
        t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        reward=F.col("l_discount"), value=F.col("l_tax"), mask=(F.col("l_returnflag") != "R").cast("int"),
    )


@query(
    "w7_discounted_returns",
    f"""
    WITH {STEPS_SQL}
    SELECT l_orderkey, i::INT AS i, round(sum(r * m * pow(0.987654321, i)) OVER w / pow(0.987654321, i), 9) AS ret FROM st
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    """,
)
def _(t: Tables):
    r = rollouts(t).select(
        "l_orderkey", F.posexplode(ar.discounted_returns(F.col("reward"), GAMMA, F.col("mask"))).alias("i", "ret")
    )
    return r.select("l_orderkey", "i", F.round("ret", 9).alias("ret"))


@query(
    "w8_gae",
    f"""
    WITH {STEPS_SQL}, d AS (SELECT *, r * m + 0.987654321 * coalesce(lead(v * m) OVER (PARTITION BY l_orderkey ORDER BY i), 0) - v * m AS d FROM st),
    a AS (SELECT l_orderkey, i, v * m AS v, sum(d * pow(0.987654321 * 0.95, i)) OVER w / pow(0.987654321 * 0.95, i) AS a FROM d
          WINDOW w AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT l_orderkey, i::INT AS i, round(a, 9) AS advantage, round(a + v, 9) AS ret FROM a
    """,
)
def _(t: Tables):
    a = rollouts(t).select(
        "l_orderkey", ar.gae(F.col("value"), F.col("reward"), GAMMA, 0.95, F.col("mask")).alias("a"),
        ar.masked(F.col("value"), F.col("mask")).alias("v"),
    )
    long = a.select("l_orderkey", F.posexplode(F.arrays_zip("a", "v")).alias("i", "z"))
    return long.select(
        "l_orderkey", "i", F.round("z.a", 9).alias("advantage"), F.round(F.col("z.a") + F.col("z.v"), 9).alias("ret")
    )


def _windows_sql(inp: str) -> str:
    return f"""
    WITH t AS ({TOKENS_SQL}), f AS (SELECT doc_id, x, len(x) AS n, least(64, len(x)) AS first FROM t WHERE len(x) > 0),
    w AS (SELECT doc_id, 0 AS k, list_concat([0], x[1:first - 1]) AS inp, x[1:first] AS pred FROM f
          UNION ALL
          SELECT doc_id, k + 1, x[e - 64:e - 1], x[s + 1:e] FROM
            (SELECT doc_id, x, k, first + k * 49 AS s, least(n, first + k * 49 + 49) AS e FROM
              (SELECT *, unnest(range(0, ((n - first + 48) // 49)::BIGINT)) AS k FROM f)))
    SELECT doc_id, k::INT AS k, len(i) AS n_in, len(pred) AS n_pred, coalesce(list_sum(i), 0)::BIGINT AS sum_in, list_sum(pred)::BIGINT AS sum_pred,
           list_sum(list_transform(pred, lambda v, j: v * j))::BIGINT AS weighted
    FROM (SELECT doc_id, k, pred, {inp} AS i FROM w)
    """


def _windows(t: Tables, disjoint: bool):
    w = doc_tokens(t).select(
        "doc_id", F.posexplode(ar.rolling_windows(F.col("x"), 64, 16, 0, disjoint)).alias("k", "w")
    )
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, v: a + v)
    weighted = F.transform("w.pred", lambda v, j: v * (j + 1))
    return w.select(
        "doc_id", "k", F.size("w.input").cast("bigint").alias("n_in"), F.size("w.pred").cast("bigint").alias("n_pred"),
        add(F.col("w.input")).alias("sum_in"), add(F.col("w.pred")).alias("sum_pred"), add(weighted).alias("weighted"),
    )


@query("w16_rolling_windows", _windows_sql("inp"))
def _(t: Tables):
    return _windows(t, False)


@query("w16_disjoint_windows", _windows_sql("inp[1:len(inp) - len(pred) + 1]"))
def _(t: Tables):
    return _windows(t, True)


@query(
    "w19_position_ids",
    f"""
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1)::INT AS pos, (k - 1)::INT AS position_id
    FROM (SELECT conv_id, turn, unnest(range(1, len(x) + 1)) AS k FROM ({TURN_TOKENS_SQL}))
    """,
)
def _(t: Tables):
    packed = rw.pack_groups(turn_tokens(t), ["conv_id"], "turn", "x", multiple=16)
    ids = packed.select("conv_id", "n_tokens", F.posexplode(ar.position_ids(F.col("samples"))).alias("pos", "position_id"))
    return ids.filter(F.col("pos") < F.col("n_tokens")).select("conv_id", "pos", "position_id")


@query(
    "t18_pack_groups",
    f"""
    WITH t AS ({TURN_TOKENS_SQL}), g AS (SELECT conv_id, sum(len(x))::INT AS n, string_agg(array_to_string(x, ' '), ' ' ORDER BY turn) AS ids,
         string_agg(len(x)::VARCHAR, ' ' ORDER BY turn) AS lengths,
         string_agg(repeat((rk::VARCHAR || ' '), len(x)), '' ORDER BY turn) AS samples
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM t) GROUP BY conv_id)
    SELECT conv_id, n AS n_tokens, lengths, ids || repeat(' 0', (-n % 16 + 16) % 16) AS ids,
           trim(samples || repeat('0 ', (-n % 16 + 16) % 16)) AS samples FROM g
    """,
)
def _(t: Tables):
    packed = rw.pack_groups(turn_tokens(t), ["conv_id"], "turn", "x", multiple=16)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return packed.select("conv_id", "n_tokens", join("lengths"), join("ids"), join("samples"))


@query(
    "t19_unpack",
    f"""
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS k, array_to_string(x, ' ') AS ids
    FROM ({TURN_TOKENS_SQL})
    """,
)
def _(t: Tables):
    packed = rw.pack_groups(turn_tokens(t), ["conv_id"], "turn", "x", multiple=16)
    parts = packed.select("conv_id", F.posexplode(ar.unpack(F.col("ids"), F.col("lengths"))).alias("k", "ids"))
    return parts.select("conv_id", "k", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(
    "p9_process_labels",
    f"""
    WITH l AS (SELECT doc_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM ({TOKENS_SQL})),
    k AS (SELECT doc_id, i, v, sum((v = 5)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l)
    SELECT doc_id, i::INT AS i, CASE WHEN k <= 40 THEN (k * 7 % 3)::INT ELSE -100 END AS label FROM k WHERE v = 5
    """,
)
def _(t: Tables):
    labels = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: k * 7 % 3)
    out = doc_tokens(t).select("doc_id", "x", F.posexplode(ar.process_labels(F.col("x"), labels, 5)).alias("i", "label"))
    return out.filter(F.get("x", F.col("i")) == 5).select("doc_id", "i", "label")


NESTED_SQL = """'{"a":{"b":[{"c":' || event_id || '},{"c":' || user_id || '}],"d":"' || event_type || '"},"e":' || (event_id % 9)
             || ',"f":' || props || '}'"""


def nested_json():
    return F.concat(
        F.lit('{"a":{"b":[{"c":'), F.col("event_id").cast("string"), F.lit('},{"c":'), F.col("user_id").cast("string"),
        F.lit('}],"d":"'), F.col("event_type"), F.lit('"},"e":'), (F.col("event_id") % 9).cast("string"),
        F.lit(',"f":'), F.col("props"), F.lit("}"),
    )


@query(
    "f27_json_path",
    f"""
    SELECT event_id, j->>'$.a.b[1].c' AS second, j->>'$.a.d' AS kind, j->>'$.f.k' AS k, j->>'$.a.b[5].c' AS missing
    FROM (SELECT event_id, ({NESTED_SQL})::JSON AS j FROM events)
    """,
)
def _(t: Tables):
    j = t.events.select("event_id", nested_json().alias("j"))
    paths = {"second": "a.b.1.c", "kind": "a.d", "k": "f.k", "missing": "a.b.5.c"}
    return j.select("event_id", *[ne.json_path("j", p).alias(name) for name, p in paths.items()])


@query(
    "f28_flatten_json",
    f"""
    WITH j AS (SELECT event_id, ({NESTED_SQL})::JSON AS j FROM events)
    SELECT event_id, 'a.b.0.c' AS key, j->>'$.a.b[0].c' AS value FROM j UNION ALL
    SELECT event_id, 'a.b.1.c', j->>'$.a.b[1].c' FROM j UNION ALL SELECT event_id, 'a.d', j->>'$.a.d' FROM j UNION ALL
    SELECT event_id, 'e', j->>'$.e' FROM j UNION ALL SELECT event_id, 'f.k', j->>'$.f.k' FROM j
    """,
)
def _(t: Tables):
    flat = ne.flatten_json(nested_json(), lists=True)
    return t.events.select("event_id", F.explode(flat).alias("key", "value"))


@query(
    "f37_flatten_metrics",
    """
    SELECT user_id, event_type || '.' || sub AS metric, value FROM
      (SELECT user_id, event_type, 'max' AS sub, max(value) AS value FROM events GROUP BY ALL UNION ALL
       SELECT user_id, event_type, 'min' AS sub, min(value) AS value FROM events GROUP BY ALL)
    """,
)
def _(t: Tables):
    per_type = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo"))
    subs = F.create_map(F.lit("max"), F.col("hi"), F.lit("min"), F.col("lo"))
    per_user = per_type.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("event_type"), subs))).alias("m")  # one entry per type
    )
    return per_user.select("user_id", F.explode(ne.flatten_metrics("m")).alias("metric", "value"))


@query(
    "f38_categorise_answers",
    """
    SELECT p_partkey, k::INT AS k, CASE WHEN m = 0 THEN 'unanswerable' WHEN m = 1 THEN 'yes' WHEN m = 2 THEN p_name
             WHEN m = 3 THEN p_brand || ', ' || p_type ELSE 'no' END AS answer,
           CASE WHEN m = 0 THEN 'unanswerable' WHEN m = 1 THEN 'bool' WHEN m = 2 THEN 'free form answer'
             WHEN m = 3 THEN 'extractive_spans' ELSE 'bool' END AS answer_type
    FROM (SELECT *, (p_size + k) % 5 AS m FROM part, (SELECT unnest([0, 1, 2]) AS k))
    """,
)
def _(t: Tables):
    def record(k: int):
        m = (F.col("p_size") + k) % 5
        return F.struct(
            (m == 0).alias("unanswerable"), F.when(m == 1, True).when(m == 4, False).alias("yes_no"),
            F.when(m == 2, F.col("p_name")).otherwise("").alias("free_form"),
            F.when(m == 3, F.array("p_brand", "p_type")).alias("spans"),
        )

    blobs = t.part.select("p_partkey", F.array(*[record(k) for k in range(3)]).alias("answers"))
    long = blobs.select("p_partkey", F.posexplode("answers").alias("k", "a"))
    kind = ans.categorise_answer(F.col("a.unanswerable"), F.col("a.yes_no"), F.col("a.free_form"), F.col("a.spans"))
    return long.select("p_partkey", "k", kind.alias("c")).select("p_partkey", "k", "c.answer", "c.answer_type")
