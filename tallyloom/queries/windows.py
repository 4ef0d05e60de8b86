"""Reward shaping, selection, islands, rolling and context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as wi
from .metrics import rounded
from .registry import Tables, query, turn_order


def rewards(t: Tables):
    return t.events.select("event_id", "user_id", F.col("event_type").alias("output"), (F.col("value") * 0.987654321).alias("reward"))


_SHAPES = {
    "w4_leave_one_out_baseline": ("rloo", "CASE WHEN n > 1 THEN value - (s - value) / (n - 1) ELSE 0 END"),
    "w5_group_baseline": ("baseline", "value - m"),
    "w6_group_normalisation": ("group_norm", "CASE WHEN n > 1 THEN (value - m) / (sd + 1e-9) ELSE 0 END"),
}
for _name, (_method, _expr) in _SHAPES.items():

    @query(
        _name,
        f"""
        SELECT event_id, user_id, round({_expr}, 7) AS shaped FROM (SELECT *, count(*) OVER w AS n, sum(value) OVER w AS s, avg(value) OVER w AS m,
          stddev_samp(value) OVER w AS sd FROM (SELECT event_id, user_id, value * 0.987654321 AS value FROM events) WINDOW w AS (PARTITION BY user_id))
        """,
    )
    def _(t: Tables, method=_method):
        return rounded(wi.shape_rewards(rewards(t), method, "user_id", "reward").select("event_id", "user_id", "shaped"), 7)


@query(
    "w9_normalize_advantages",
    """
    WITH a AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, (l_returnflag <> 'R')::INT AS m,
                      CASE WHEN l_returnflag <> 'R' THEN l_discount - l_tax ELSE 0 END AS a FROM lineitem),
    s AS (SELECT sum(a) / sum(m) AS mu FROM a), v AS (SELECT sum((a - mu) * (a - mu) * m) / sum(m) AS var FROM a, s)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, round((a - mu) / sqrt(greatest(var, 1e-8)), 7) AS normalized FROM a, s, v
    """,
)
def _(t: Tables):
    kept = F.col("l_returnflag") != "R"
    rows = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", kept.cast("int").alias("m"),
        F.when(kept, F.col("l_discount") - F.col("l_tax")).otherwise(0.0).alias("a"),
    )
    return rounded(wi.normalize_advantages(rows, "a", "m").drop("a", "m"), 7, "normalized")


@query(
    "w11_best_of_n",
    "SELECT user_id, event_type AS output, value * 0.987654321 AS reward FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
)
def _(t: Tables):
    return wi.best_of_n(rewards(t), "user_id", "output", "reward", "event_id")


@query(
    "w12_best_worst",
    """
    SELECT h.user_id, h.event_type AS chosen, h.value * 0.987654321 AS chosen_reward, l.event_type AS rejected, l.value * 0.987654321 AS rejected_reward
    FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1) h
    JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1) l USING (user_id)
    """,
)
def _(t: Tables):
    return wi.best_worst(rewards(t), "user_id", "output", "reward", "event_id")


@query(
    "w13_normalize_reward",
    "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 7) AS reward FROM events",
)
def _(t: Tables):
    return rounded(wi.normalize_reward(rewards(t), "reward").select("event_id", "reward"), 7)


@query(
    "w14_mismatched_pairs",
    """
    WITH p AS (SELECT conv_id, turn, md5(text) AS text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations),
    b AS (SELECT *, pos // 8 AS b FROM p)
    SELECT conv_id, turn, text, 1 AS label FROM p UNION ALL
    SELECT conv_id, turn, coalesce(lead(text) OVER w, first_value(text) OVER w), -1 FROM b WINDOW w AS (PARTITION BY b ORDER BY pos)
    """,
)
def _(t: Tables):
    rows = turn_order(t.conversations.select("conv_id", "turn", F.md5("text").alias("text"), F.lit(1).alias("label")))
    return wi.mismatched_pairs(rows, 8, "key", "conv_id", "text").drop("key")


@query(
    "w15_islands",
    """
    WITH v AS (SELECT DISTINCT event_type, event_id // 3 AS v FROM events),
    g AS (SELECT event_type, v, v - row_number() OVER (PARTITION BY event_type ORDER BY v) AS g FROM v)
    SELECT event_type, min(v) AS start, max(v) AS "end", count(*) AS length FROM g GROUP BY event_type, g
    """,
)
def _(t: Tables):
    values = t.events.select("event_type", F.floor(F.col("event_id") / 3).alias("v")).distinct()
    return wi.islands(values, "v", ["event_type"])


@query(
    "w18_rolling_throughput",
    """
    SELECT event_id, round(sum(user_id) OVER w / sum(value) OVER w, 9) AS tokens_per_second FROM events
    WINDOW w AS (ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
    """,
)
def _(t: Tables):
    log = t.events.select("event_id", F.col("user_id").alias("tokens"), F.col("value").alias("seconds"))
    # a small block shows the hand-over between blocks
    rolled = wi.rolling_throughput(log, 10, "event_id", "tokens", "seconds", block=1024)
    return rounded(rolled.select("event_id", "tokens_per_second"))


@query(
    "w20_grouped_context",
    """
    WITH q AS (SELECT c.conv_id, c.turn, c.text AS q, coalesce(a.text, '') AS a, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) AS back
               FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant' WHERE c.role = 'user')
    SELECT conv_id, 'Article: ' || conv_id || chr(10) || chr(10) || coalesce(string_agg('Question: ' || q || chr(10) || 'Answer: ' || a || chr(10), '' ORDER BY turn) FILTER (back > 1), '')
           || max(q) FILTER (back = 1) AS context, max(a) FILTER (back = 1) AS target, count(*)::INT AS n_items FROM q GROUP BY conv_id
    """,
)
def _(t: Tables):
    turns = t.conversations
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    pairs = asked.join(answers, ["conv_id", "turn"], "left").fillna("", ["a"])
    head = F.format_string("Article: %d\n\n", "conv_id")
    return wi.grouped_context(pairs, ["conv_id"], "turn", "q", "a", head)
