"""Overlap score queries over near copies: a text against a copy with some words replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import overlap as ov
from .metrics import rounded
from .registry import Tables, query, sql_rules

COPY_RULES = [("=", " the ", " a "), ("=", " le ", " un "), ("=", " and ", " or "), ("=", ", ", " "), ("=", " of ", " for the ")]


def near_copies(df, key: str):
    return df.select(key, F.col("text").alias("hyp"), tx.apply_rules("text", COPY_RULES).alias("ref"))


def _bleu_sql(expr: str) -> str:
    spaced = sql_rules(f"' ' || {sql_rules(expr, ov.BLEU_RULES)} || ' '", ov.BLEU_SPACING)
    return f"regexp_extract_all({spaced}, '\\S+')"


def _counts_sql(source: str, orders: str, sep: str) -> str:
    return f"""
    src AS ({source}),
    g AS (SELECT key, n, s, unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda i: array_to_string(w[i:i + n - 1], '{sep}'))) AS gram
          FROM (SELECT key, 'h' AS s, h AS w FROM src UNION ALL SELECT key, 'r', r FROM src), (SELECT unnest({orders}) AS n)),
    c AS (SELECT key, n, gram, count(*) FILTER (s = 'h') AS h, count(*) FILTER (s = 'r') AS r FROM g GROUP BY ALL),
    per AS (SELECT key, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM c GROUP BY ALL),
    tot AS (SELECT n, sum(h)::DOUBLE AS h, sum(r)::DOUBLE AS r, sum(m)::DOUBLE AS m FROM per GROUP BY n)
    """


COPY_SQL = sql_rules("text", COPY_RULES)


@query(
    "a32_corpus_bleu",
    f"""
    WITH {_counts_sql(f"SELECT doc_id AS key, {_bleu_sql('text')} AS h, {_bleu_sql(COPY_SQL)} AS r FROM documents", "[1, 2, 3, 4]", " ")},
    l AS (SELECT max(h) FILTER (n = 1) AS sys, max(r) FILTER (n = 1) AS ref, avg(ln(m / h)) AS lp FROM tot)
    SELECT round(100 * CASE WHEN sys < ref THEN exp(1 - ref / sys) ELSE 1 END * exp(lp), 7) AS bleu, sys::BIGINT AS sys_len, ref::BIGINT AS ref_len FROM l
    """,
)
def _(t: Tables):
    return rounded(ov.corpus_bleu(near_copies(t.documents, "doc_id"), "hyp", "ref"), 7)


@query(
    "a33_corpus_chrf",
    f"""
    WITH {_counts_sql(
        "SELECT row_number() OVER () AS key, string_split(regexp_replace(text, '\\s+', '', 'g'), '') AS h, "
        f"string_split(regexp_replace({COPY_SQL}, '\\s+', '', 'g'), '') AS r FROM conversations", "[1, 2, 3, 4, 5, 6]", "")},
    p AS (SELECT avg(m / h) AS p, avg(m / r) AS r FROM tot)
    SELECT round(100 * 5 * p * r / (4 * p + r), 7) AS chrf FROM p
    """,
)
def _(t: Tables):
    return rounded(ov.corpus_chrf(near_copies(t.conversations, "turn"), "hyp", "ref"), 7)


@query("a32_bleu_stderr")
def _(t: Tables):
    return ov.bleu_stderr(near_copies(t.documents, "doc_id"), "hyp", "ref", 200, 13)


@query("a33_chrf_stderr")
def _(t: Tables):
    return ov.chrf_stderr(near_copies(t.conversations, "turn"), "hyp", "ref", 200, 13)


@query(
    "a34_rouge_n",
    f"""
    WITH {_counts_sql(
        f"SELECT doc_id AS key, regexp_extract_all(lower(text), '[a-z0-9]+') AS h, regexp_extract_all(lower({COPY_SQL}), '[a-z0-9]+') AS r FROM documents",
        "[1, 2]", " ")},
    f AS (SELECT key, n, CASE WHEN m > 0 THEN 100 * 2.0 * m / (h + r) ELSE 0 END::DOUBLE AS f FROM per)
    SELECT doc_id, round(coalesce(max(f) FILTER (n = 1), 0), 7) AS rouge1, round(coalesce(max(f) FILTER (n = 2), 0), 7) AS rouge2
    FROM documents LEFT JOIN f ON key = doc_id GROUP BY doc_id
    """,
)
def _(t: Tables):
    return rounded(ov.rouge_n(near_copies(t.documents, "doc_id"), ["doc_id"], "hyp", "ref"), 7)


# no SQL: the subsequence recursion; tests/test_brute_force.py checks it
@query("x3_longest_common_subsequence")
def _(t: Tables):
    rows = near_copies(t.conversations, "conv_id").select("conv_id", ov.rouge_tokens("hyp").alias("h"), ov.rouge_tokens("ref").alias("r"))
    return rows.select("conv_id", F.size("h").alias("n_hyp"), F.size("r").alias("n_ref"), ov.lcs_length("h", "r").alias("lcs"))


CONTRAST_SQL = f"""
    b AS (SELECT item_id, text, text AS pred FROM benchmark),
    cr AS (SELECT item_id, pred, 1 AS k, {COPY_SQL} AS ref FROM b UNION ALL SELECT item_id, pred, 2, replace(text, 'e', '') FROM b
          UNION ALL SELECT item_id, pred, 3, reverse(text) FROM b)
"""


def contrast_rows(t: Tables):
    """An item against a near copy (true), and itself without a letter and its mirror image (false)."""
    refs = F.array(tx.apply_rules("text", COPY_RULES), F.replace("text", F.lit("e"), F.lit("")), F.reverse("text"))
    return t.benchmark.select("item_id", F.col("text").alias("pred"), F.posexplode(refs).alias("k", "ref"))


@query(
    "a34_reference_contrast",
    f"""
    WITH {CONTRAST_SQL}, {_counts_sql(
        "SELECT item_id * 10 + k AS key, regexp_extract_all(lower(pred), '[a-z0-9]+') AS h, regexp_extract_all(lower(ref), '[a-z0-9]+') AS r FROM cr",
        "[1, 2]", " ")},
    f AS (SELECT key // 10 AS item_id, key % 10 = 1 AS ok, n, CASE WHEN m > 0 THEN 100 * 2.0 * m / (h + r) ELSE 0 END::DOUBLE AS f FROM per),
    s AS (SELECT item_id, n, coalesce(max(f) FILTER (ok), 0) AS t, coalesce(max(f) FILTER (NOT ok), 0) AS w FROM f GROUP BY ALL)
    SELECT item_id, round(max(t) FILTER (n = 1), 7) AS rouge1_max, round(coalesce(max(t) FILTER (n = 2), 0), 7) AS rouge2_max,
           round(max(t - w) FILTER (n = 1), 7) AS rouge1_diff, round(coalesce(max(t - w) FILTER (n = 2), 0), 7) AS rouge2_diff,
           (max(t - w) FILTER (n = 1) > 0)::INT AS rouge1_acc, (coalesce(max(t - w) FILTER (n = 2), 0) > 0)::INT AS rouge2_acc FROM s GROUP BY item_id
    """,
)
def _(t: Tables):
    scored = ov.rouge_n(contrast_rows(t), ["item_id", "k"], "pred", "ref")
    return rounded(ov.ref_contrast(scored.withColumn("ok", F.col("k") == 0), "item_id", "ok", ["rouge1", "rouge2"]), 7)


# no SQL: contains the longest common subsequence
@query("a34_rouge_contrast_all")
def _(t: Tables):
    scored = ov.rouge(contrast_rows(t), ["item_id", "k"], "pred", "ref")
    return rounded(ov.ref_contrast(scored.withColumn("ok", F.col("k") == 0), "item_id", "ok", ["rouge1", "rouge2", "rougeL"]), 7)


