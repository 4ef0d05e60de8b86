"""Shuffle, sample, mixture and batch queries, mostly over documents by source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as sa
from ..plans.ordering import first_rows
from .registry import Tables, query, turn_order


def md5_order(seed, *keys: str) -> str:
    return "md5('" + str(seed) + ":' || " + " || ':' || ".join(f"{k}::VARCHAR" for k in keys) + ")"


def unit(seed, *keys: str) -> str:
    return f"(('0x' || substr({md5_order(seed, *keys)}, 1, 8))::BIGINT / 4294967296.0)"


def docs(t: Tables):
    return t.documents.select("doc_id", "source", "n_chars")


@query("t1_shuffle", f"SELECT doc_id, source, n_chars, row_number() OVER (ORDER BY {md5_order(0, 'doc_id')}) - 1 AS pos FROM documents")
def _(t: Tables):
    return sa.shuffle(docs(t), 0, ["doc_id"])


@query(
    "t2_epoch_order",
    " UNION ALL ".join(
        f"SELECT {e} AS epoch, doc_id, row_number() OVER (ORDER BY {md5_order(17 + e, 'doc_id')}) - 1 AS pos FROM documents" for e in (0, 1)
    ),
)
def _(t: Tables):
    epochs = [sa.epoch_order(docs(t), 17, e, ["doc_id"]).select(F.lit(e).alias("epoch"), "doc_id", "pos") for e in (0, 1)]
    return epochs[0].unionByName(epochs[1])


ORDER_SQL = f"o AS (SELECT doc_id, row_number() OVER (ORDER BY {md5_order(0, 'doc_id')}) - 1 AS pos FROM documents), n AS (SELECT count(*) AS n FROM documents)"


def order(t: Tables):
    return sa.epoch_order(docs(t), 0, 0, ["doc_id"])


@query(
    "t3_pad_order",
    f"WITH {ORDER_SQL} SELECT doc_id, pos FROM o UNION ALL SELECT doc_id, pos + n FROM o, n WHERE pos < (7 - n % 7) % 7",
)
def _(t: Tables):
    return sa.pad_or_drop(order(t), 7, drop_last=False)


@query("t3_drop_tail", f"WITH {ORDER_SQL} SELECT doc_id, pos FROM o, n WHERE pos < n - n % 7")
def _(t: Tables):
    return sa.pad_or_drop(order(t), 7, drop_last=True)


@query("t4_take", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def _(t: Tables):
    return sa.take(docs(t).select("doc_id", "n_chars"), 100, [F.desc("n_chars"), "doc_id"])


@query(
    "t4_first_half",
    "SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id) <= (SELECT count(*) // 2 FROM documents)",
)
def _(t: Tables):
    rows = docs(t).select("doc_id", "n_chars")
    return first_rows(rows, rows.count() // 2, [F.desc("n_chars"), "doc_id"])


@query(
    "t4_take_fraction",
    "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE rn <= floor((SELECT count(*) FROM documents) * 0.3)",
)
def _(t: Tables):
    return sa.take_fraction(docs(t).select("doc_id", "n_chars"), 0.3, "doc_id")


@query(
    "t5_iteration_slice",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations) WHERE p >= 128 AND p < 192",
)
def _(t: Tables):
    return sa.iter_slice(turn_order(t.conversations.select("conv_id", "turn")), 2, 64, "key").select("conv_id", "turn")


@query("t6_resume", f"WITH {ORDER_SQL} SELECT doc_id, pos FROM o WHERE pos >= 300 AND pos < 900")
def _(t: Tables):
    return sa.resume(order(t), 300, 900)


@query("t7_sample_rows", f"SELECT doc_id FROM documents WHERE {unit(3, 'doc_id')} < 0.25")
def _(t: Tables):
    return sa.sample_rows(docs(t), 0.25, 3, ["doc_id"]).select("doc_id")


@query("t8_repeat", "SELECT doc_id, unnest([0, 1, 2])::INT AS copy FROM documents")
def _(t: Tables):
    return sa.repeat(docs(t).select("doc_id"), 3)


WEIGHTS = {"src0": 0.0, "src1": 0.3, "src2": 0.75, "src3": 1.0, "src4": 2.0, "src5": 3.7}
WEIGHTS_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items()) + ") v(source, w))"


@query(
    "t9_mix",
    f"""
    WITH {WEIGHTS_SQL}, r AS (SELECT doc_id, source, w, row_number() OVER (PARTITION BY source ORDER BY {md5_order(5, 'doc_id')}) AS rn,
       count(*) OVER (PARTITION BY source) AS n FROM documents JOIN w USING (source) WHERE w > 0)
    SELECT doc_id, source, unnest(range(0, greatest(floor(w), 1)::BIGINT))::INT AS copy FROM r WHERE w >= 1 OR rn <= floor(n * w)
    """,
)
def _(t: Tables):
    return sa.mix(docs(t).select("doc_id", "source"), WEIGHTS, 5, "source", ["doc_id"]).select("doc_id", "source", "copy")


@query(
    "t10_token_budget",
    f"""
    WITH r AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY {md5_order(8, 'doc_id')}
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS tokens_before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
    SELECT doc_id, source, tokens_before FROM r WHERE tokens_before < 0.4 * total
    """,
)
def _(t: Tables):
    kept = sa.take_token_budget(docs(t), 0.4, 8, "source", ["doc_id"], "n_chars")
    return kept.select("doc_id", "source", F.col("tokens_before").cast("bigint").alias("tokens_before"))


PROBS = {"en": 0.5, "fr": 0.25, "de": 0.125, "es": 0.125}


def _interleave_sql(stop: str) -> str:
    size = 20
    pick = f"CASE WHEN {unit(13, 'pos')} < 0.5 THEN 'en' WHEN {unit(13, 'pos')} < 0.75 THEN 'fr' WHEN {unit(13, 'pos')} < 0.875 THEN 'de' ELSE 'es' END"
    return f"""
    WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    d AS (SELECT pos, {pick} AS lang FROM (SELECT unnest(range(0, (SELECT sum(n) * {size} FROM s)::BIGINT)) AS pos)),
    k AS (SELECT pos, lang, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS nth FROM d),
    e AS (SELECT {'min' if stop == 'first' else 'max'}(pos) AS cut FROM k JOIN s USING (lang) WHERE nth = n - 1),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rn FROM documents)
    SELECT pos, lang, doc_id FROM k JOIN s USING (lang) JOIN r USING (lang), e WHERE pos <= cut AND rn = nth % n
    """


@query("t11_interleave_first", _interleave_sql("first"))
def _(t: Tables):
    return sa.interleave(t.documents, PROBS, 13, "lang", "doc_id", "first", ["doc_id", "lang"]).select("pos", "lang", "doc_id")


@query("t11_interleave_all", _interleave_sql("all"))
def _(t: Tables):
    return sa.interleave(t.documents, PROBS, 13, "lang", "doc_id", "all", ["doc_id", "lang"]).select("pos", "lang", "doc_id")


@query(
    "t12_sample_to",
    f"""
    WITH r AS (SELECT p_partkey, unnest(range(0, ceil(25000 / (SELECT count(*) FROM part))::BIGINT))::INT AS copy FROM part)
    SELECT p_partkey, copy FROM r ORDER BY {md5_order(21, 'p_partkey', 'copy')} LIMIT 25000
    """,
)
def _(t: Tables):
    return sa.sample_to(t.part.select("p_partkey"), 25000, 21, ["p_partkey"])


@query(
    "t13_resample_batches",
    f"""
    WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rn FROM part), n AS (SELECT count(*) AS n FROM part),
    d AS (SELECT id // 32 AS batch, id % 32 AS slot, ('0x' || substr({md5_order(4, 'id')}, 1, 15))::BIGINT % n AS rn
          FROM n, (SELECT unnest(range(0, 50 * 32)) AS id))
    SELECT batch, slot, p_partkey FROM d JOIN r USING (rn)
    """,
)
def _(t: Tables):
    return sa.resample_batches(t.part.select("p_partkey"), 50, 32, 4, "p_partkey").select("batch", "slot", "p_partkey")


@query("t15_batches", "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 48 AS batch FROM part")
def _(t: Tables):
    return sa.batches(t.part.select("p_partkey"), 48, "p_partkey")


@query(
    "t16_dedup_requests",
    f"""
    WITH k AS (SELECT doc_id, length(text) AS len, md5(lang || chr(1) || text) AS h FROM documents),
    d AS (SELECT h, row_number() OVER (ORDER BY max(len) DESC, h) - 1 AS request_pos FROM k GROUP BY h)
    SELECT doc_id, request_pos FROM k JOIN d USING (h)
    """,
)
def _(t: Tables):
    rows = t.documents.select("doc_id", "lang", "text")
    return sa.dedup_requests(rows, ["lang", "text"], F.length("text"), "doc_id")[1]


@query(
    "t16_dedup_requests_with_nulls",
    """
    WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN lang END AS a, CASE WHEN doc_id % 3 <> 0 THEN lang END AS b FROM documents),
    k AS (SELECT doc_id, a, b, length(coalesce(a, b)) AS len, md5(concat_ws(chr(1), a, b)) AS h,
                 md5(coalesce(length(a) || ':' || a, '-') || coalesce(length(b) || ':' || b, '-')) AS g FROM r),
    d AS (SELECT a, b, row_number() OVER (ORDER BY max(len) DESC, h, g) - 1 AS request_pos FROM k GROUP BY a, b, h, g)
    SELECT doc_id, request_pos FROM k JOIN d ON k.a IS NOT DISTINCT FROM d.a AND k.b IS NOT DISTINCT FROM d.b
    """,
)
def _(t: Tables):
    third = F.col("doc_id") % 3
    rows = t.documents.select("doc_id", F.when(third != 1, F.col("lang")).alias("a"), F.when(third != 0, F.col("lang")).alias("b"))
    return sa.dedup_requests(rows, ["a", "b"], F.length(F.coalesce("a", "b")), "doc_id")[1]


@query("t17_limit_docs", f"SELECT item_id FROM benchmark ORDER BY {md5_order(42, 'item_id')} LIMIT 25")
def _(t: Tables):
    return sa.limit_docs(t.benchmark, 25, ["item_id"]).select("item_id")


@query(
    "t20_keep_latest",
    "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
)
def _(t: Tables):
    return sa.keep_latest(t.events.select("event_id", "user_id"), 10, "event_id", ["user_id"])


@query("t21_sample_n", f"SELECT event_id FROM events ORDER BY {md5_order(6, 'event_id')} LIMIT 500")
def _(t: Tables):
    return sa.sample_n(t.events.select("event_id"), 500, 6, ["event_id"])


@query("w17_assign_ranks", f"WITH {ORDER_SQL} SELECT doc_id, pos, (pos % 8)::INT AS rank, pos // 64 AS batch FROM o")
def _(t: Tables):
    return sa.assign_ranks(order(t), 8, 64)


