import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import quality as Q
from tallyloom.llm.common import code_points


def test_marginals_equal_the_sum_over_all_paths():
    draw = np.random.default_rng(1)
    lines, ties = np.array([4, 1, 3]), draw.normal(0, 1, (2, 2))
    evidence = draw.normal(0, 2, lines.sum())
    good, pairs = Q.marginals(evidence, ties, lines)
    first = 0
    for n in lines:
        own, want, both, total = evidence[first : first + n], np.zeros(n), np.zeros((n, 4)), 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum((e if y else -e) / 2 for e, y in zip(own, path)) + sum(ties[a, b] for a, b in zip(path, path[1:])))
            total += weight
            want += weight * np.array(path)
            for t, (a, b) in enumerate(zip(path, path[1:])):
                both[t, 2 * a + b] += weight
        assert np.allclose(good[first : first + n], want / total) and np.allclose(pairs[first : first + n], both / total)
        first += n


def test_measures():
    values, size, lines = Q.line_measures(*code_points(pa.array(["Be be be BE!\n\nA1 ##", None, "x"])))
    at = {name: i for i, name in enumerate(Q.MEASURES)}
    assert lines.tolist() == [3, 1, 1] and size.tolist() == [12, 0, 5, 0, 1]
    assert values[0, at["repeated"]] == 0.5 and values[0, at["distinct"]] == 3 / 5 and values[0, at["upper"]] == 3 / 8
    assert values[2, at["symbols"]] == 0.4 and values[2, at["marked"]] == 0.5 and values[2, at["digits"]] == 0.2


def fold(key):
    return zlib.crc32(str(key).encode()) % 4


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    return docs, labels, Q.quality_scores(docs, Q.train(docs, labels)).collect()


def test_held_out_accuracy(scored):
    _, labels, rows = scored
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in known]) >= 0.95


def test_held_out_labels_teach_nothing(spark, scored):
    docs, labels, rows = scored
    other = spark.createDataFrame([(r.doc_id, 1 - r.quality if fold(r.doc_id) == 2 else r.quality) for r in labels.collect()], "doc_id long, quality int")
    again = Q.quality_scores(docs, Q.train(docs, other)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}


def test_odd_tables(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (7, 0), (None, 1), (99, 1), (8, None), (10, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        rows = Q.quality_scores(odd_docs, Q.train(odd_docs, given), keep=["score", "x.y"]).select("doc_id", "held_out", "predicted").collect()
        assert len(rows) == 16
    none = Q.train(odd_docs, labels.limit(0))
    assert {r.score for r in Q.quality_scores(odd_docs, none).collect()} == {1.0}
    kept = Q.keep_good(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == 16
    assert Q.quality_scores(odd_docs.limit(0), none).collect() == []
    model = Q.train(odd_docs, labels)
    scores = [r.score for r in Q.quality_scores(odd_docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_texts_are_measured_a_bounded_part_at_a_time(spark):
    class Model:
        def score(self, measures, size, lines):
            if size.sum() > 300_000:
                raise ValueError("a part is too large")
            return np.ones(len(lines))

    docs = spark.range(100).selectExpr("id as doc_id", "repeat('some words ', 2000) as text").coalesce(1)
    assert Q.keep_good(docs, Model()).count() == 100
    assert Q.quality_scores(docs, Model()).count() == 100
