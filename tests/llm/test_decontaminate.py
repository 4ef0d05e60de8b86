import random
import re

import pytest
from conftest import ODD_TEXTS

from tallyloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=13):
    known = {}
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            known.setdefault(tuple(words[i : i + size]), set()).add("" if name is None else str(name))
    sizes, out = {len(k) for k in known}, []
    for key, text in docs:
        words = words_of(text)
        hit, found = [0] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                names = known.get(tuple(words[i : i + size]))
                if names:
                    found |= names
                    hit[i : i + size] = [1] * size
        out.append((key, len(words), sum(hit), tuple(sorted(found)), sum(b - a for a, b in runs(hit))))
    return sorted(out, key=str)


def runs(hit):
    edges = [i for i in range(len(hit) + 1) if (hit + [0])[i] != ([0] + hit)[i]]
    return list(zip(edges[::2], edges[1::2]))


def found(spark, docs, items, **options):
    docs = docs if hasattr(docs, "columns") else spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = items if hasattr(items, "columns") else spark.createDataFrame(items, "item_id long, text string")
    rows = D.benchmark_hits(docs, D.prepare(docs, items, **options)).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), sum(b - a for a, b in zip(r.hit_runs[::2], r.hit_runs[1::2]))) for r in rows], key=str)


@pytest.mark.parametrize("window, block_words", [(13, 1_000_000), (4, 20)])
def test_equals_comparing_all_windows(spark, window, block_words):
    draw = random.Random(window)
    docs = [(i, " ".join(draw.choice("a b c d é Ab".split()) for _ in range(draw.randint(0, 60)))) for i in range(150)] + [(1000, None), (1001, "")]
    items = [(i, " ".join(draw.choice("a b c D é ab".split()) for _ in range(draw.choice([0, 1, 2, 3, 5, 12, 13, 14, 20])))) for i in range(30)] + [(None, None), (None, "a b c a"), (3, "d d"), (3, "d d")]
    assert found(spark, docs, items, block_words=block_words, window=window) == plain(docs, items, window)


def test_odd_tables(spark, odd_docs):
    items = [(1, ODD_TEXTS[4][1]), (2, "日本語のテキスト　空白"), (3, ""), (4, "a"), (5, "x" * 70_000)]
    assert found(spark, odd_docs, items) == plain(ODD_TEXTS, items)
    assert all(r[2] == 0 for r in found(spark, odd_docs, spark.createDataFrame([], "item_id long, text string")))
    assert found(spark, odd_docs.limit(0), items) == []
    matcher = D.prepare(odd_docs, spark.createDataFrame(items, "item_id long, text string"))
    kept = D.keep_clean(odd_docs, matcher)
    want = [r[0] for r in plain(ODD_TEXTS, items) if not (r[2] > 0 and 20 * r[2] >= r[1])]
    assert kept.columns == odd_docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
