"""Tables with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

import os
import random

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Columns that an input may have besides, named like columns that operators use inside or return.
CLASHES = ["id", "key", "row", "fp", "score", "label", "bucket", "length", "rank", "part", "place", "n_tokens", "spans", "lines", "gone", "gone_lines", "sketch", "template", "digest", "time", "Fingerprint", "a b", "x.y"]


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    return SF_DIR


def words(seed, count):
    draw = random.Random(seed)
    return " ".join(draw.choice(["the", "and", "thereon", "edge", "tion", "été", "über", "niño", "42", "a,", "b.", "C;", "wide-open", "it's"]) for _ in range(count))


ODD_TEXTS = [
    (1, "Plain text of one line."), (2, None), (3, ""), (4, "  \n\t \n"), (5, words(5, 400) + "\n" + words(6, 300)), (6, words(5, 400) + "\n" + words(6, 300)), (7, words(7, 40_000)), (8, "x" * 70_000),
    (9, "日本語のテキスト　空白 😀 \x00 end"), (10, words(10, 30)), (10, words(10, 30)), (10, words(11, 30)), (None, words(12, 30)), (None, None), (11, "a"), (12, "▁ <s> <|endoftext|> </s>"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None, "s", -1) + tuple(None if k % 3 else str(k) for k in range(len(CLASHES))) for i, t in ODD_TEXTS]
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    kinds = ["long", "string", "string", "string", "long"] + ["string"] * len(CLASHES)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))).repartition(3)


@pytest.fixture(scope="session")
def odd_pages(spark):
    html = "<html><body><article><p>" + "A long payload that is repeated. " * 5 + "</p></article></body></html>"
    trap = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a.example/x", html), (2, "http://A.example:80/x#f", html), (3, None, html), (4, "u\r\nv w", None), (None, "http://a.example/", html), (5, "http://b.example/", ""), (6, "http://b.example/", "<p>é" * 40), (6, "http://b.example/", "<p>é" * 40), (7, "http://b.example/z", trap), (8, "", trap), (9, "http://c.example", "short"), (10, "http://c.example", "short"), (11, "http://c.example/long", "<div><p>" + "long text " * 30_000)]
    rows = [r + tuple(str(k) for k in range(len(CLASHES))) for r in rows]
    return spark.createDataFrame(rows, ", ".join(["page_id long", "url string", "html string", *(f"`{c}` string" for c in CLASHES)])).repartition(3)
