"""Registered queries of this folder: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_extract, line_dedup, packing, pii, quality, resampling, signature_trees, simhash_pivots, sketches, token_counts, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op3_pack_sequences")
def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), seq_len=2048, end_id=0)


@query("op4_quality_crf")
def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op8_simhash_pivots")
def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"), size=4, bits=4)


#: The words of a text, for SQL: A-Z in lower case, runs of digits, letters and characters beyond ASCII.
SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    "op9_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    h AS (SELECT doc_id, item_id, i, n FROM g JOIN win USING (n, g)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = decontaminate.benchmark_hits(docs, decontaminate.prepare(docs, table(spark, sf_dir, "benchmark"), window=13))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query("op10_bottom_k_sketches")
def op10_bottom_k_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


@query(
    "op7_warc_index",
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id != first THEN first END AS refers_to
    FROM f
    """,
)
def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_site_templates")
def op6_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


@query("op2_pii_tagger")
def op2_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.train(docs))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


@query(
    "op5_line_dedup",
    f"""
    WITH l AS (SELECT doc_id, i, line, trim(line, '{line_dedup.BLANKS}') AS x
               FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    f AS (SELECT x, length(x) AS n, min(doc_id) AS d, arg_min(i, (doc_id, i)) AS i FROM l WHERE x <> '' GROUP BY x),
    k AS (SELECT a.x FROM f a JOIN f b ON abs(a.n - b.n) <= 1 AND (b.d, b.i) < (a.d, a.i) AND a.n >= 24 AND b.n >= 24
          AND (left(a.x, least(a.n, b.n) // 2) = left(b.x, least(a.n, b.n) // 2) OR right(a.x, least(a.n, b.n) // 2) = right(b.x, least(a.n, b.n) // 2))
          WHERE levenshtein(a.x, b.x) <= 1),
    m AS (SELECT l.*, l.x <> '' AND ((l.doc_id, l.i) <> (f.d, f.i) OR l.x IN (SELECT x FROM k)) AS gone FROM l LEFT JOIN f USING (x))
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '') AS text, count(*)::BIGINT AS n_lines,
        (count(*) FILTER (gone))::BIGINT AS n_dropped FROM m GROUP BY doc_id
    """,
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs, counts=("n_lines", "n_dropped"))


#: CRC-32 of a word in SQL: the table of the polynomial made by rule, then one step for each byte.
SQL_CRC = """
    tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    kinds AS (SELECT x, list_transform(range(0, octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT x FROM words)),
    coded AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8))) % 10000 AS k FROM kinds, tab)
"""


@query(
    "op12_importance_resampling",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents), b AS (SELECT {SQL_WORDS} AS w FROM benchmark),
    words AS (SELECT true AS own, r, unnest(w) AS x FROM d UNION ALL SELECT false, NULL, unnest(w) FROM b),
    {SQL_CRC},
    f AS (SELECT own, r, k FROM words JOIN coded USING (x)),
    n AS (SELECT k, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f GROUP BY k),
    g AS (SELECT k, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
    v AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (k) WHERE own GROUP BY r),
    s AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
              + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
          FROM d LEFT JOIN v USING (r)),
    o AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS p, count(*) FILTER (n_features >= 20) OVER () AS n FROM s)
    SELECT doc_id, n_features, weight, score, CASE WHEN able AND p <= n * 10 // 100 THEN p END AS rank FROM o
    """,
)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024, percent=10, least_words=20)


@query(
    "op13_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    found = hard_negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)
    return found.withColumn("rank", F.col("rank").cast("int"))


@query("op11_jaccard_trees")
def op11_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.similar_documents(table(spark, sf_dir, "documents"), size=5, percent=80)
