import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F
from test_decontaminate import words_of

from tallyloom.llm import sketches as S


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def drawn(seed, count, kinds=3000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(kinds)}" for _ in range(count))


def test_small_sets_are_exact():
    a, b = drawn(1, 60), drawn(1, 60)[:150] + " " + drawn(2, 20)
    x, y = S.sketch_texts(pa.array([a, b]))
    assert S.resemblance(x, y) == likeness(shingles(a), shingles(b)) and S.distinct_count(x) == len(shingles(a))
    assert S.containment(x, y) == pytest.approx(len(shingles(a) & shingles(b)) / len(shingles(a)))


def test_estimates_and_merging():
    parts = [drawn(k, 4000) for k in range(4)]
    whole = S.sketch_texts(pa.array(parts))
    merged = whole[0]
    for part in whole[1:]:
        merged = S.merged(merged, part)
    backwards = S.merged(whole[3], S.merged(whole[2], S.merged(whole[1], whole[0])))
    union = set().union(*map(shingles, parts))
    assert (merged == backwards).all() and abs(S.distinct_count(merged) / len(union) - 1) < 0.3
    assert abs(S.containment(whole[0], merged) - 1) < 0.3 and abs(S.resemblance(whole[0], merged) - 0.25) < 0.15


def test_repeats_do_not_hide_small_hashes():
    text = " ".join(["a b c d e f g"] * 5000) + " " + drawn(3, 300)
    own = S.sketch_texts(pa.array([text]))[0]
    each = S.sketch_texts(pa.array([" ".join(s) for s in shingles(text)]))
    assert (own == np.unique(np.concatenate(each))[: S.K]).all()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    follower = dict(zip(order, order[1:] + order[:1]))
    rows = S.edited_fingerprints(docs.repartition(5)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    misses = []
    for r in rows:
        text, after = texts[r.doc_id], texts[follower[r.doc_id]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.edited_fingerprint == S.shown(S.sketch_texts(pa.array([edited]))[0])
        misses += [r.near_edited - likeness(shingles(text), shingles(edited)), r.near_next - likeness(shingles(text), shingles(after))]
    assert np.std(misses) < 0.06


def test_odd_tables(spark, odd_docs):
    rows = S.edited_fingerprints(odd_docs).collect()
    order = sorted((t or "" for i, t in ODD_TEXTS if i is None))
    assert len(rows) == len(ODD_TEXTS) and len([r for r in rows if r.doc_id is None]) == len(order)
    by = {r.doc_id: r for r in rows if r.doc_id in (9, 8, 7)}
    texts = dict(ODD_TEXTS)
    edited = texts[9][: len(texts[9]) - len(texts[9]) // 3] + texts[8][: len(texts[9]) // 3]
    assert by[9].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1 and by[8].n_shingles == 1
    assert S.edited_fingerprints(odd_docs.limit(0)).collect() == []
    alone = S.edited_fingerprints(odd_docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    assert S.edited_fingerprints(odd_docs.where("doc_id IS NULL")).count() == 2


def test_merged_sketches_of_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sketched = S.document_sketches(docs).withColumn("g", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    got = {r.g: r.sketch for r in S.merge_sketches(sketched, "g").collect()}
    for g in (None, 1, 2):
        own = [np.array(r.sketch, np.uint64) for r in sketched.where(F.col("g").eqNullSafe(F.lit(g))).collect()]
        assert got[g] == np.unique(np.concatenate(own))[: S.K].tolist()
