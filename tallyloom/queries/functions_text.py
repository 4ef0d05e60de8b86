"""Text functions over documents, conversations and parts."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as ans
from ..functions import text as tx
from ..functions.common import let
from ..plans.layout import colocate, spread
from .registry import Tables, fill, h32, query, sql_fill, sql_h32, sql_rules, sql_text

PUNCT_SQL = sql_text(string.ascii_uppercase + string.punctuation)
LOWER_SQL = sql_text(string.ascii_lowercase)
NORMAL_SQL = f"translate(text, {PUNCT_SQL}, {LOWER_SQL})"


@query(
    "f1_overlap_normal",
    f"SELECT doc_id, md5(n) AS normal_md5, length(n) AS n_chars FROM (SELECT doc_id, {NORMAL_SQL} AS n FROM documents)",
)
def _(t: Tables):
    n = tx.overlap_normal("text")
    return t.documents.select("doc_id", F.md5(n).alias("normal_md5"), F.length(n).cast("bigint").alias("n_chars"))


def gram_parts(docs):
    """``doc_id, gram, n_grams, n_distinct, digest``: one row (without ``gram``) for a document of one row, counted inside that
    row; rows that share an id give one row for each n-gram, as they have to be compared."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) == 1
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def part(gram, n_grams, n_distinct, digest):
        return F.struct(gram.cast("string").alias("gram"), n_grams.alias("n_grams"), n_distinct.alias("n_distinct"), digest.alias("digest"))

    def parts(grams):
        digest = F.aggregate(grams, none, lambda total, gram: total + h32(gram))
        whole = part(F.lit(None), F.size(grams).cast("bigint"), F.size(F.array_distinct(grams)).cast("bigint"), digest)
        each = F.transform(grams, lambda gram: part(gram, one, one, h32(gram)))
        return F.when(F.size(grams) > 0, F.when(F.col("_alone"), F.array(whole)).otherwise(each))

    grams = tx.word_ngrams(tx.overlap_normal("text"), 13)
    return docs.withColumn("_alone", alone).select("doc_id", F.explode(let(grams, parts)).alias("p")).select("doc_id", "p.*")


@query(
    "f2_word_ngrams",
    f"""
    WITH w AS (SELECT doc_id, regexp_extract_all({NORMAL_SQL}, '\\S+') AS w FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS gram
          FROM w WHERE len(w) >= 13)
    SELECT doc_id, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct, sum({sql_h32('gram')})::BIGINT AS digest
    FROM g GROUP BY doc_id
    """,
)
def _(t: Tables):
    parts = gram_parts(colocate(t.documents.select("doc_id", "text"), ["doc_id"]))
    # the window and both groupings stay in the task of the document
    per_gram = parts.groupBy("doc_id", "gram").agg(
        F.sum("n_grams").alias("n_grams"), F.max("n_distinct").alias("n_distinct"), F.sum("digest").alias("digest")
    )
    return per_gram.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_grams", "n_distinct", "digest")])


@query(
    "f3_ngram_spans",
    rf"""
    WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s+|\S+')) AS part,
                      generate_subscripts(regexp_extract_all(text, '\s+|\S+'), 1) AS i FROM documents),
    s AS (SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS st FROM p),
    w AS (SELECT doc_id, i, part, st, st + length(part) - 1 AS en FROM s WHERE regexp_matches(part, '^\S')),
    g AS (SELECT doc_id, part || ' ' || lead(part, 1) OVER o || ' ' || lead(part, 2) OVER o AS gram,
                 st, lead(en, 2) OVER o AS en FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, count(*) AS n_grams, sum(st)::BIGINT AS starts, sum(en)::BIGINT AS ends,
           sum({sql_h32("gram || ':' || st::BIGINT || ':' || en::BIGINT")})::BIGINT AS digest
    FROM g WHERE gram IS NOT NULL GROUP BY doc_id
    """,
)
def _(t: Tables):
    docs = colocate(t.documents.select("doc_id", "text"), ["doc_id"])
    spans = docs.select("doc_id", F.explode(tx.ngram_spans("text", 3)).alias("g")).select("doc_id", "g.*")
    return spans.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_grams"), F.sum("start").alias("starts"), F.sum("end").alias("ends"),
        F.sum(h32(F.concat_ws(":", "gram", "start", "end"))).alias("digest"),
    )


SPACED_SQL = r"""'( "' || regexp_replace(text, '([,.:;!?''])', ' \1 ', 'g') || '" )'"""


def spaced(column: str = "text"):
    return F.concat(F.lit('( "'), F.regexp_replace(column, r"([,.:;!?'])", " $1 "), F.lit('" )'))


def _register_rules(name: str, rules, fn):
    @query(
        name,
        f"SELECT doc_id, md5(c) AS clean_md5, length(c) AS n_chars FROM "
        f"(SELECT doc_id, {sql_rules('s', rules)} AS c FROM (SELECT doc_id, {SPACED_SQL} AS s FROM documents))",
    )
    def _(t: Tables):
        clean = spread(t.documents, "doc_id").select("doc_id", fn(spaced()).alias("c"))
        return clean.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").cast("bigint").alias("n_chars"))


_register_rules("f4_detokenize_sentence", tx.SENTENCE_RULES, tx.detokenize_sentence)
_register_rules("f5_detokenize_wiki", tx.WIKI_RULES, tx.detokenize_wiki)
_register_rules("f6_detokenize_cloze", tx.CLOZE_RULES, tx.detokenize_cloze)


@query(
    "f7_clean_caption",
    f"SELECT page_id, md5(c) AS clean_md5, length(c) AS n_chars FROM (SELECT page_id, "
    + sql_rules(
        r"regexp_replace(' [title]' || regexp_replace(html, '<([a-z]+)>', ' [\1] ', 'g'), '^\s+|\s+$', '', 'g')",
        tx.CAPTION_RULES,
    )
    + " AS c FROM pages)",
)
def _(t: Tables):
    marked = F.concat(F.lit(" [title]"), F.regexp_replace("html", "<([a-z]+)>", " [$1] "))
    clean = t.pages.select("page_id", tx.clean_caption(marked).alias("c"))
    return clean.select("page_id", F.md5("c").alias("clean_md5"), F.length("c").cast("bigint").alias("n_chars"))


MARKED = ["we add and get #### #,000", "so #### -@.5 is it", "no marker # here", "#### @ then #### #", "####@"]


@query(
    "f8_marked_answer",
    f"""
    SELECT p_partkey, CASE WHEN regexp_matches(s, '#### (-?[0-9.,]+)')
                THEN replace(regexp_extract(s, '#### (-?[0-9.,]+)', 1), ',', '') ELSE '[invalid]' END AS answer
    FROM (SELECT p_partkey, replace({sql_fill([m.replace('####', '~~~~') for m in MARKED], 'p_partkey', 'p_size', 'p_partkey')},
                                    '~~~~', '####') AS s FROM part)
    """,
)
def _(t: Tables):
    text = F.replace(
        fill([m.replace("####", "~~~~") for m in MARKED], "p_partkey", "p_size", "p_partkey"),
        F.lit("~~~~"), F.lit("####"),
    )
    return t.part.select("p_partkey", ans.marked_answer(text).alias("answer"))


BOXED = [
    r"first \boxed{no} then \boxed{\frac{@}{#}} done",
    r"nothing is boxed here @",
    r"never closed \boxed{a{@}",
    r"blank form \boxed @$ and # more",
    r"old form \fbox{x_{#}} end",
    r"\boxed{@} and text }",
]
BOXED_SQL = sql_fill(BOXED, "p_partkey", "p_size", "p_partkey")
LAST_BOXED_SQL = rf"""
    src AS (SELECT p_partkey, {BOXED_SQL} AS s FROM part),
    cut AS (SELECT p_partkey, s, CASE WHEN contains(s, '\boxed') THEN '\boxed' || list_last(string_split(s, '\boxed'))
                   WHEN contains(s, '\fbox') THEN '\fbox' || list_last(string_split(s, '\fbox')) END AS tail FROM src),
    chars AS (SELECT p_partkey, unnest(range(1, length(tail) + 1)) AS i, tail FROM cut WHERE tail IS NOT NULL),
    depth AS (SELECT p_partkey, i, tail[i] AS ch,
                sum(CASE tail[i] WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END)
                  OVER (PARTITION BY p_partkey ORDER BY i) AS d FROM chars),
    stop AS (SELECT p_partkey, min(i) AS e FROM depth WHERE ch = '}}' AND d = 0 GROUP BY p_partkey),
    boxed AS (SELECT p_partkey, s, CASE WHEN contains(s, '\boxed ')
                     THEN '\boxed ' || string_split(list_last(string_split(s, '\boxed ')), '$')[1]
                     ELSE tail[1:e] END AS boxed FROM cut LEFT JOIN stop USING (p_partkey))
"""


@query(
    "f9_last_boxed",
    rf"""
    WITH {LAST_BOXED_SQL}
    SELECT p_partkey, boxed, CASE WHEN starts_with(boxed, '\boxed ') THEN substr(boxed, 8)
        WHEN starts_with(boxed, '\boxed{{') THEN substr(boxed, 8, length(boxed) - 8) END AS content
    FROM boxed
    """,
)
def _(t: Tables):
    boxed = t.part.select(
        "p_partkey", ans.last_boxed(fill(BOXED, "p_partkey", "p_size", "p_partkey")).alias("boxed")
    )
    return boxed.select("p_partkey", "boxed", ans.unbox("boxed").alias("content"))


DOLLARS = ["so $@$ it is", "$@$ or $#$", "one $ only @", "none @", "$$"]


@query(
    "f10_between_dollars",
    rf"""
    SELECT p_partkey, CASE WHEN length(s) - length(replace(s, '$', '')) < 2 THEN s
        ELSE regexp_extract(s, '(?s)^[^$]*\$(.*)\$[^$]*$', 1) END AS answer
    FROM (SELECT p_partkey, {sql_fill(DOLLARS, 'p_partkey', 'p_size', 'p_partkey')} AS s FROM part)
    """,
)
def _(t: Tables):
    return t.part.select(
        "p_partkey", ans.between_dollars(fill(DOLLARS, "p_partkey", "p_size", "p_partkey")).alias("answer")
    )


MATHS = [
    r"\dfrac@#", r"x = @", r"\sqrt@ + \sqrt{#}", r"@/#", r"0.5", r".@", r"\left( @, # \right)",
    r"@^{\circ}", r"\$@,000", r"@\%", r"#\text{ units}", r"\tfrac{@}{#}", r"\frac@{#}", r"k=\frac1", r"f(x) = @",
    r"-@/#", r"\{.5, .@\}", r"\\frac{@}{#}\!",
]


def sql_math(expr: str) -> str:
    s = sql_rules(expr, ans.MATH_SPELLINGS)
    s = rf"string_split({s}, '\text{{ ')[1]"
    s = rf"replace({s}, '\%', '')"
    s = f"replace(replace({s}, ' .', ' 0.'), '{{.', '{{0.')"
    s = rf"regexp_replace({s}, '^\.', '0.')"
    s = rf"regexp_replace({s}, '(?s)^[^=]{{0,2}}=([^=]*)$', '\1')"
    s = rf"replace(regexp_replace({s}, '\\sqrt([^{{])', '\\sqrt{{\1}}', 'g'), ' ', '')"
    braces = rf"regexp_replace(x, '\\frac([^{{])([^{{])', '\\frac{{\1}}{{\2}}', 'g')"
    braces = rf"regexp_replace({braces}, '\\frac([^{{])\{{', '\\frac{{\1}}{{', 'g')"
    fixed = rf"CASE WHEN regexp_matches(x, '\\frac([^{{]?$|[^{{]?\\frac)') THEN x ELSE {braces} END"
    fixed = rf"replace('~' || ({fixed}) || '~', '~0.5~', '~\frac{{1}}{{2}}~')"
    whole = rf"regexp_replace(trim({fixed}, '~'), '^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$', '\\frac{{\1}}{{\2}}')"
    return f"list_transform([{s}], lambda x: {whole})[1]"


@query(
    "f11_math_normal",
    f"SELECT p_partkey, {sql_math('s')} AS answer FROM "
    f"(SELECT p_partkey, {sql_fill(MATHS, 'p_partkey', 'p_size', 'p_partkey')} AS s FROM part)",
)
def _(t: Tables):
    return t.part.select("p_partkey", ans.math_normal(fill(MATHS, "p_partkey", "p_size", "p_partkey")).alias("answer"))


@query(
    "f12_math_equal",
    f"""
    SELECT p_partkey, {sql_math('a')} IS NOT DISTINCT FROM {sql_math('b')} AS equal FROM
    (SELECT p_partkey, CASE WHEN p_partkey % 7 > 0 THEN {sql_fill(MATHS, 'p_partkey', 'p_size', 'p_partkey')} END AS a,
            CASE WHEN p_partkey % 5 > 0 THEN '\\frac{{' || p_size || '}}{{' || p_partkey || '}}' END AS b FROM part)
    """,
)
def _(t: Tables):
    pairs = t.part.select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 > 0, fill(MATHS, "p_partkey", "p_size", "p_partkey")).alias("a"),
        F.when(F.col("p_partkey") % 5 > 0, F.format_string("\\frac{%d}{%d}", "p_size", "p_partkey")).alias("b"),
    )
    return pairs.select("p_partkey", ans.math_equal("a", "b").alias("equal"))


SPANS_P = ["The @ old-rods, a plate!", "@", "an answer of #", "@.0 yards", "", "Old rods @"]
SPANS_G = ["@ old rods", "@.0", "answer #!", "the # yards", "the", "old rods #"]

# one part in one spelling
_PART_SQL = rf"""
list_transform(string_split_regex(X, '[ -]'), lambda p: trim(regexp_replace(regexp_replace(
  list_transform([CASE WHEN regexp_full_match(lower(p), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)') THEN lower(p)
                  ELSE translate(lower(p), {sql_text(string.punctuation)}, '') END],
     lambda q: CASE WHEN regexp_full_match(q, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)')
               THEN regexp_replace(q::DOUBLE::VARCHAR, '^(-?[0-9]+)$', '\1.0') ELSE q END)[1],
  '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')))
"""


def _span_sql(expr: str) -> str:
    return f"list_filter({_PART_SQL.replace('X', expr)}, lambda z: z <> '')"


_BAG_SQL = """
    CASE WHEN len(gn) > 0 AND len(list_intersect(gn, p)) = 0 THEN 0.0
         WHEN pr + rc = 0 THEN 0.0 ELSE round(2 * pr * rc / (pr + rc), 2) END
"""


@query(
    "f13_span_f1",
    rf"""
    WITH s AS (SELECT p_partkey, {_span_sql(sql_fill(SPANS_P, 'p_partkey', 'p_size', 'p_partkey'))} AS pl,
                      {_span_sql(sql_fill(SPANS_G, 'p_partkey', 'p_size', 'p_partkey'))} AS gl FROM part),
    b AS (SELECT p_partkey, pl, gl, list_distinct(pl) AS p, list_distinct(gl) AS g,
                 list_filter(gl, lambda z: regexp_full_match(z, '-?[0-9]+\.[0-9]+')) AS gn FROM s),
    r AS (SELECT *, CASE WHEN len(p) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, g)) / len(p) END AS pr,
                 CASE WHEN len(g) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(p, g)) / len(g) END AS rc FROM b)
    SELECT p_partkey, (array_to_string(pl, ' ') = array_to_string(gl, ' '))::INT::DOUBLE AS exact, ({_BAG_SQL})::DOUBLE AS f1
    FROM r
    """,
)
def _(t: Tables):
    p, g = (fill(x, "p_partkey", "p_size", "p_partkey") for x in (SPANS_P, SPANS_G))
    return t.part.select("p_partkey", ans.span_exact(p, g).alias("exact"), ans.span_f1(p, g).alias("f1"))


REPLIES = [
    "<judge>Arithmetic error, Algebraic/logic flaw</judge> the sign of @ flipped",
    "Because <judge> Incomplete answer </judge> it stopped at #",
    "no tags for #",
    "<judge>Formula/application mistake,</judge>@<judge> Notation/representation issue</judge>",
]


@query(
    "f16_judge_reply",
    rf"""
    SELECT event_id, array_to_string(list_transform(string_split(trim(array_to_string(
               regexp_extract_all(s, '(?s)<judge>(.*?)</judge>', 1), '')), ','), lambda x: trim(x)), '|') AS labels,
           trim(regexp_replace(s, '(?s)<judge>.*?</judge>', '', 'g')) AS explanation
    FROM (SELECT event_id, {sql_fill(REPLIES, 'event_id', 'user_id', 'event_id')} AS s FROM events)
    """,
)
def _(t: Tables):
    s = t.events.select("event_id", fill(REPLIES, "event_id", "user_id", "event_id").alias("s"))
    return s.select(
        "event_id", F.array_join(tx.judge_labels("s"), "|").alias("labels"),
        tx.judge_explanation("s").alias("explanation"),
    )


CODES = [
    "the result is @",
    "<llm-code>\nprint(#)\n</llm-code> gives @",
    "x = 1\ndef a():\n    return 1\ndef solve():\n    return @",
    "<llm-code>def f(): return #</llm-code>",
    "<llm-code> never closed def @",
]
CODES_SQL = "replace(" + sql_fill([c.replace("\n", "~") for c in CODES], "event_id", "user_id", "event_id") + ", '~', chr(10))"


@query(
    "f17_response_type",
    f"""
    SELECT event_id, CASE WHEN contains(s, '<llm-code>') AND event_id % 3 > 0 THEN 'llm-code'
             WHEN contains(s, 'def') THEN 'function-code' WHEN contains(s, '<llm-code>') THEN 'llm-code' ELSE 'text' END AS kind,
           CASE WHEN contains(s, '<llm-code>') AND event_id % 3 > 0 THEN 't' || event_id
             WHEN contains(s, 'def') AND event_id % 2 > 0 THEN 'd' || event_id ELSE 'x' || event_id END AS answer
    FROM (SELECT event_id, {CODES_SQL} AS s FROM events)
    """,
)
def _(t: Tables):
    tag = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), F.col("event_id").cast("string")))
    fun = F.when(F.col("event_id") % 2 > 0, F.concat(F.lit("d"), F.col("event_id").cast("string")))
    s = t.events.select("event_id", fill(CODES, "event_id", "user_id", "event_id").alias("s"), tag.alias("tag"), fun.alias("fun"))
    plain = F.concat(F.lit("x"), F.col("event_id").cast("string"))
    return s.select(
        "event_id", tx.response_type("s", F.col("tag")).alias("kind"),
        tx.response_answer("s", F.col("tag"), F.col("fun"), plain).alias("answer"),
    )


@query(
    "f18_code_blocks",
    rf"""
    SELECT event_id, trim(CASE WHEN regexp_matches(s, '(?s)<llm-code>(.*?)</llm-code>')
             THEN regexp_extract(s, '(?s)<llm-code>(.*?)</llm-code>', 1) END, chr(10) || ' ') AS tagged,
           'def' || list_last(string_split(s, chr(10) || 'def')) AS last_function
    FROM (SELECT event_id, {CODES_SQL} AS s FROM events)
    """,
)
def _(t: Tables):
    s = t.events.select("event_id", fill(CODES, "event_id", "user_id", "event_id").alias("s"))
    return s.select(
        "event_id", tx.tagged_code("s").alias("tagged"), tx.last_function_code("s").alias("last_function")
    )


@query(
    "f19_strip_special",
    r"""
    SELECT conv_id, turn, md5(regexp_replace(regexp_replace(s, '^(</s>|<pad>)+', ''), '(</s>|<pad>)+$', '')) AS stripped_md5,
           md5(replace(s, '</s>', '')) AS dropped_md5
    FROM (SELECT conv_id, turn, repeat('<pad>', (turn % 3)::INT) || '</s>' || text || '</s>' || repeat('<pad>', (turn % 2)::INT) AS s
          FROM conversations)
    """,
)
def _(t: Tables):
    s = F.concat(
        F.repeat(F.lit("<pad>"), (F.col("turn") % 3).cast("int")), F.lit("</s>"), F.col("text"), F.lit("</s>"),
        F.repeat(F.lit("<pad>"), (F.col("turn") % 2).cast("int")),
    )
    return t.conversations.select(
        "conv_id", "turn", F.md5(tx.strip_special(s, "<pad>", "</s>")).alias("stripped_md5"),
        F.md5(tx.drop_token(s, "</s>")).alias("dropped_md5"),
    )


@query(
    "f29_human_number",
    """
    SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || CASE
        WHEN a >= 1000000000000 THEN printf('%.2fT', a / 1e12) WHEN a >= 1000000000 THEN printf('%.2fB', a / 1e9)
        WHEN a >= 1000000 THEN printf('%.2fM', a / 1e6) WHEN a >= 1000 THEN printf('%.2fK', a / 1e3)
        ELSE a::VARCHAR END AS human
    FROM (SELECT o_orderkey, n, abs(n) AS a FROM
          (SELECT o_orderkey, (1 - 2 * (o_orderkey % 2)) * (o_orderkey % 1000) * 10 ** (o_orderkey % 11)::BIGINT AS n0,
                  ((1 - 2 * (o_orderkey % 2)) * (o_orderkey % 1000) * (10 ** (o_orderkey % 11))::BIGINT)::BIGINT AS n FROM orders))
    """,
)
def _(t: Tables):
    key = F.col("o_orderkey")
    n = (1 - 2 * (key % 2)) * (key % 1000) * F.pow(F.lit(10), key % 11).cast("bigint")
    return t.orders.select("o_orderkey", tx.human_number(n).alias("human"))


@query(
    "f30_answer_index",
    """
    SELECT p_partkey, CASE WHEN regexp_full_match(s, '[a-z]') THEN ascii(s) - 97
                           WHEN regexp_full_match(s, '[1-9]') THEN s::INT - 1 END AS idx
    FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 4 WHEN 0 THEN ' ' || chr((65 + p_size % 26)::INT) WHEN 1 THEN (p_size % 10)::VARCHAR
                 WHEN 2 THEN p_name ELSE chr((97 + p_size % 5)::INT) END)) AS s FROM part)
    """,
)
def _(t: Tables):
    kind, size = F.col("p_partkey") % 4, F.col("p_size")
    raw = (
        F.when(kind == 0, F.concat(F.lit(" "), F.char(65 + size % 26)))
        .when(kind == 1, (size % 10).cast("string"))
        .when(kind == 2, F.col("p_name"))
        .otherwise(F.char(97 + size % 5))
    )
    return t.part.select("p_partkey", tx.answer_index(raw).alias("idx"))


@query(
    "f31_byte_and_word_counts",
    r"SELECT doc_id, strlen(text) AS n_bytes, len(regexp_split_to_array(text, '\s+')) AS n_words FROM documents",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id", tx.byte_count("text").cast("bigint").alias("n_bytes"), tx.word_count("text").cast("bigint").alias("n_words")
    )


@query("f33_subject_name", "SELECT n_nationkey, ' ' || replace(lower(n_name), '_', ' ') AS subject FROM nation")
def _(t: Tables):
    return t.nation.select("n_nationkey", tx.subject_name(F.lower("n_name")).alias("subject"))


@query(
    "f34_parent_dir",
    "SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '' END AS parent FROM pages",
)
def _(t: Tables):
    return t.pages.select("page_id", tx.parent_dir("url").alias("parent"))


@query(
    "x6_type_path",
    r"""
    SELECT page_id, CASE WHEN contains(host, '.') THEN regexp_replace(host, '\.[^.]*$', '') END AS module,
           list_last(string_split(host, '.')) AS name
    FROM (SELECT page_id, string_split(url, '/')[3] AS host FROM pages)
    """,
)
def _(t: Tables):
    host = F.get(F.split("url", "/"), F.lit(2))
    return t.pages.select("page_id", tx.split_type_path(host).alias("p")).select("page_id", "p.module", "p.name")


@query(
    "x2_ngram_rows",
    r"""
    WITH p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\s+|\S+')) AS part, generate_subscripts(regexp_extract_all(text, '\s+|\S+'), 1) AS i FROM conversations),
    s AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(part) AS st FROM p),
    w AS (SELECT conv_id, turn, i, part, st, st + length(part) - 1 AS en FROM s WHERE regexp_matches(part, '^\S')),
    g AS (SELECT conv_id, turn, row_number() OVER o - 1 AS pos, part || ' ' || lead(part, 1) OVER o AS gram, st, lead(en, 1) OVER o AS en FROM w
          WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i))
    SELECT conv_id, turn, pos::INT AS pos, gram, st::INT AS start, en::INT AS "end" FROM g WHERE gram IS NOT NULL
    """,
)
def _(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.explode(tx.ngram_spans("text", 2)).alias("g"))
    return rows.select("conv_id", "turn", "g.pos", "g.gram", "g.start", "g.end")
