"""Vocabulary, chunk, shard and contamination queries over documents and benchmark items."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import decontam as dc
from ..operators import joins as jn
from ..operators import metrics as mt
from ..operators import tokens as tk
from ..plans.layout import spread
from ..plans.ordering import running_sum
from ..plans.scratch import materialize, scratch_path
from ..sources import writers as wr
from .functions_text import NORMAL_SQL
from .registry import Tables, query, sql_text

VOCAB = 5000
VOCAB_SQL = rf"""
    words AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\S+'), 1) - 1 AS i FROM documents),
    vocab AS (SELECT word, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, word) + 2)::INT AS token_id FROM words GROUP BY word
              QUALIFY row_number() OVER (ORDER BY count(*) DESC, word) <= {VOCAB}),
    ids AS (SELECT doc_id, source, i, coalesce(token_id, 2) AS id FROM words LEFT JOIN vocab USING (word)
            UNION ALL SELECT doc_id, source, 1000000000, 1 FROM documents)
"""


def vocab(t: Tables):
    """Saved once: every use of a lazy vocabulary would count all words again."""
    words = tk.build_vocab(spread(t.documents.select("doc_id", "text"), "doc_id"), "text", VOCAB)
    return materialize(words, "vocab")


def encoded(t: Tables, words=None):
    return tk.encode(t.documents, vocab(t) if words is None else words, "doc_id", "text", ["source"])


def token_table(t: Tables, words=None):
    """Saved once, as chunks and shards read token counts first and tokens later."""
    return materialize(encoded(t, words), "tokens")


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query("x1_build_vocabulary", f"WITH {VOCAB_SQL} SELECT word, n, token_id FROM vocab")
def _(t: Tables):
    return vocab(t)


@query("x1_encode", f"WITH {VOCAB_SQL} SELECT doc_id, source, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM ids GROUP BY ALL")
def _(t: Tables):
    return encoded(t).select("doc_id", "source", joined("tokens").alias("ids"))


@query(
    "x1_decode",
    f"""
    WITH {VOCAB_SQL} SELECT doc_id, coalesce(string_agg(CASE WHEN id = 2 THEN '<unk>' ELSE word END, ' ' ORDER BY i) FILTER (id > 1), '') AS text
    FROM ids LEFT JOIN (SELECT token_id AS id, word FROM vocab) USING (id) GROUP BY doc_id
    """,
)
def _(t: Tables):
    words = vocab(t)
    return tk.decode(encoded(t, words), words, "doc_id", "tokens")


CHUNK = 64
POS_SQL = f"""
    pos AS (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS p FROM ids),
    chunks AS (SELECT source, p // {CHUNK} AS chunk_idx, list(id ORDER BY p) AS x FROM pos GROUP BY ALL HAVING count(*) = {CHUNK})
"""


def chunks(t: Tables):
    return tk.chunk_tokens(token_table(t), CHUNK, "source", "doc_id")


@query("w1_chunk_tokens", f"WITH {VOCAB_SQL}, {POS_SQL} SELECT source, chunk_idx, array_to_string(x, ' ') AS ids FROM chunks")
def _(t: Tables):
    return chunks(t).select("source", "chunk_idx", joined("tokens").alias("ids"))


@query(
    "w2_token_offsets",
    rf"""
    WITH n AS (SELECT doc_id, source, len(regexp_extract_all(text, '\S+')) + 1 AS n FROM documents)
    SELECT doc_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM n
    """,
)
def _(t: Tables):
    sized = spread(t.documents, "doc_id").select("doc_id", "source", (F.size(tx.words("text")) + 1).alias("n"))
    return running_sum(sized, "n", "doc_id", ["source"], "offset").drop("n")


MAX_TOKENS = 20_000
STREAM_SQL = f"""
    stream AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM ids)
"""


@query(
    "s6_token_shards",
    f"""
    WITH {VOCAB_SQL}, {STREAM_SQL} SELECT lpad((p // {MAX_TOKENS})::VARCHAR, 5, '0') AS shard, count(*) AS n_tokens, sum(id)::BIGINT AS ids,
           sum(id * (p % {MAX_TOKENS}))::BIGINT AS weighted FROM stream GROUP BY 1
    """,
)
def _(t: Tables):
    written = wr.write_token_shards(token_table(t), scratch_path(t.spark, "shards"), MAX_TOKENS, "doc_id")
    long = written.select("shard", "at", F.posexplode("tokens").alias("i", "id"))
    place = (F.col("at") + F.col("i")) % MAX_TOKENS
    return long.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum("id").alias("ids"), F.sum(F.col("id") * place).alias("weighted")
    )


@query(
    "a36_validate_tokens",
    f"""
    WITH {VOCAB_SQL} SELECT (SELECT count(*) FROM documents) AS n_docs, count(*) AS n_tokens, count(*) AS written_tokens, count(*) FILTER (id = 1) AS written_eos,
           0::BIGINT AS out_of_bounds, true AS valid FROM ids
    """,
)
def _(t: Tables):
    tokens = token_table(t)
    return tk.validate_tokens(tokens, tk.shard_rows(tokens, MAX_TOKENS, "doc_id"), VOCAB)


FILES_SQL = rf"""
    files AS (SELECT source, substr(source, 4)::BIGINT AS file_no, sum(len(regexp_extract_all(text, '\S+')) + 1)::BIGINT AS n FROM documents GROUP BY source),
    offsets AS (SELECT source, file_no, n, n // {CHUNK} AS n_instances, (sum(n // {CHUNK}) OVER (ORDER BY file_no) - n // {CHUNK})::BIGINT AS start,
                       (sum(n // {CHUNK}) OVER (ORDER BY file_no))::BIGINT AS "end" FROM files)
"""


def files(t: Tables):
    number = F.substring("source", 4, 20).cast("bigint").alias("file_no")
    return t.documents.groupBy("source", number).agg(F.sum(F.size(tx.words("text")) + 1).alias("n"))


def offsets(t: Tables):
    return tk.file_offsets(files(t).withColumn("n_mask", F.col("n")), CHUNK, "source", "file_no", "n", "n_mask")


@query("s12_file_offsets", f'WITH {FILES_SQL} SELECT source, file_no, n, n AS n_mask, n_instances, start, "end" FROM offsets')
def _(t: Tables):
    return offsets(t)


LOCATE_SQL = f"""
    WITH {FILES_SQL}, i AS (SELECT event_id, event_id * 7919 % (SELECT max("end") FROM offsets) AS instance_id FROM events)
"""


def lookups(t: Tables):
    total = offsets(t).agg(F.max("end").alias("_n"))
    return t.events.select("event_id").crossJoin(F.broadcast(total)).select(
        "event_id", (F.col("event_id") * 7919 % F.col("_n")).alias("instance_id")
    )


@query(
    "j9_locate_instances",
    f'{LOCATE_SQL} SELECT event_id, instance_id, source, instance_id - start AS local_index FROM i JOIN offsets ON instance_id >= start AND instance_id < "end"',
)
def _(t: Tables):
    ranges = offsets(t).select("source", "start", "end")
    return jn.locate(lookups(t), ranges, 64).select("event_id", "instance_id", "source", "local_index")


@query(
    "j12_zip_mask",
    f"""
    WITH {VOCAB_SQL}, {POS_SQL} SELECT source, chunk_idx, array_to_string(x, ' ') AS ids,
      array_to_string(list_transform(x, lambda v: (v % 3 > 0)::INT), '') AS mask FROM chunks
    """,
)
def _(t: Tables):
    tokens = token_table(t)
    masks = tokens.select("doc_id", "source", F.transform("tokens", lambda x: x % 3 > 0).alias("label_mask"))
    blocks = tk.chunk_tokens(tokens, CHUNK, "source", "doc_id")
    mask_blocks = tk.chunk_tokens(masks, CHUNK, "source", "doc_id", ["label_mask"])
    zipped = tk.zip_mask(blocks, mask_blocks, ["source", "chunk_idx"])
    bits = F.transform("label_mask", lambda x: x.cast("int").cast("string"))
    return zipped.select("source", "chunk_idx", joined("tokens").alias("ids"), F.array_join(bits, "").alias("mask"))


@query(
    "p10_filter_repetition",
    rf"""
    WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda w: length(w)) AS x FROM documents),
    l AS (SELECT doc_id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM x),
    e AS (SELECT doc_id, n, i, p, v = lag(v, p) OVER (PARTITION BY doc_id, p ORDER BY i) AS eq FROM l, (SELECT unnest(range(1, 14)) AS p)),
    r AS (SELECT doc_id, n, i, p, eq, sum(CASE WHEN eq THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, p ORDER BY i) AS g FROM e),
    s AS (SELECT doc_id, n, p, min(i) AS s, max(i) + 1 AS e FROM r WHERE eq GROUP BY doc_id, n, p, g),
    bad AS (SELECT DISTINCT doc_id FROM s WHERE ((s + p - 1) // p + 1) * p <= e AND e - s + p >= 3 * p AND p <= n // 3 AND (e - s + p) // p >= 5)
    SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM bad) AS instance_mask FROM documents
    """,
)
def _(t: Tables):
    lengths = F.transform(tx.words("text"), lambda w: F.length(w)).alias("x")
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", lengths)
    return tk.filter_repetition(rows, "x", max_count=5).select("doc_id", "instance_mask")


# ---- contamination -------------------------------------------------------------------------------------------

GRAM_SQL = f"""
    bg AS (SELECT item_id, unnest(list_transform(range(1, (len(w) - 11)::BIGINT), lambda i: array_to_string(w[i:i+12], ' '))) AS gram
           FROM (SELECT item_id, regexp_extract_all({NORMAL_SQL}, '\\S+') AS w FROM benchmark) WHERE len(w) >= 13),
    dg AS (SELECT DISTINCT unnest(list_transform(range(1, (len(w) - 11)::BIGINT), lambda i: array_to_string(w[i:i+12], ' '))) AS gram
           FROM (SELECT regexp_extract_all({NORMAL_SQL}, '\\S+') AS w FROM documents) WHERE len(w) >= 13),
    overlap AS (SELECT DISTINCT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, item_id AS doc_id FROM bg WHERE gram IN (SELECT gram FROM dg))
"""


def evaluation(t: Tables):
    task = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    split = F.when(F.col("item_id") % 3 == 0, "test").otherwise("validation")
    return t.benchmark.select(task.alias("task"), split.alias("split"), F.col("item_id").alias("doc_id"), "text")


def overlap(t: Tables):
    train = spread(t.documents.select("doc_id", "text"), "doc_id")
    return dc.train_overlap(evaluation(t), train)


@query("j1_train_overlap", f"WITH {GRAM_SQL} SELECT task, doc_id FROM overlap")
def _(t: Tables):
    return overlap(t)


@query(
    "j4_metric_decontaminated",
    f"""
    WITH {GRAM_SQL} SELECT count(*) AS n, round(avg((length(text) % 3 = 0)::INT), 9) AS acc FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM overlap)
    """,
)
def _(t: Tables):
    rows = evaluation(t).withColumn("right", mt.truth(F.length("text") % 3 == 0))
    return jn.metric_decontaminated(
        rows, overlap(t), ["task", "doc_id"],
        lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("right"), 9).alias("acc")),
    )


_PUNCT = sql_text(string.ascii_uppercase + string.punctuation) + ", " + sql_text(string.ascii_lowercase)
CLEAN_SQL = rf"""
    p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s+|\S+')) AS part, generate_subscripts(regexp_extract_all(text, '\s+|\S+'), 1) AS i FROM documents),
    s AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS st FROM p),
    w AS (SELECT doc_id, i, part, st, st + length(part) - 1 AS en FROM s WHERE regexp_matches(part, '^\S')),
    g AS (SELECT doc_id, st, lead(en, 12) OVER o AS en, {" || ' ' || ".join(f"lead(part, {k}) OVER o" for k in range(13))} AS gram
          FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT doc_id, st, en FROM g WHERE gram IS NOT NULL AND translate(gram, {_PUNCT}) IN (SELECT gram FROM bg)),
    k AS (SELECT doc_id, greatest(st - 200, 0) AS st, least(en + 200, length(text)) AS en, text,
                 row_number() OVER (PARTITION BY doc_id ORDER BY st) AS rn, count(*) OVER (PARTITION BY doc_id) AS hits FROM h JOIN documents USING (doc_id)),
    c AS (SELECT doc_id, rn, coalesce(lag(en) OVER (PARTITION BY doc_id ORDER BY rn), 0) AS a0, st, text FROM k WHERE hits <= 10),
    e AS (SELECT doc_id, max(hits) AS hits, arg_max(en, rn) AS en FROM k GROUP BY doc_id),
    o AS (SELECT doc_id, rn, substr(text, (a0 + 1)::BIGINT, (st - a0)::BIGINT) AS piece FROM c WHERE st - a0 > 200 UNION ALL
          SELECT doc_id, 1000000, substr(text, (coalesce(en, -1) + 2)::BIGINT) FROM documents LEFT JOIN e USING (doc_id)
          WHERE coalesce(hits, 0) <= 10 AND coalesce(en, -1) < length(text) - 200)
"""


@query(
    "c2_decontaminate_text",
    f"""
    WITH {GRAM_SQL}, {CLEAN_SQL}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1)::INT AS piece_no, length(piece) AS n_chars, md5(piece) AS piece_md5 FROM o
    """,
)
def _(t: Tables):
    train = spread(t.documents.select("doc_id", "text"), "doc_id")
    items = t.benchmark.select(F.col("text").alias("item_text"))
    pieces = dc.clean_text(train, items, "doc_id", "text", "item_text")
    return pieces.select("doc_id", "piece_no", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("piece_md5"))


