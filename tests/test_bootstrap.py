"""Resampling against plain draws."""

import random

import numpy as np
import pytest

from tallyloom.operators import bootstrap as bs
from tallyloom.operators import overlap as ov
from pyspark.sql import functions as F


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(bs, "CELL_ROWS", 7)


def table(spark, n=300):
    rng = random.Random(2)
    return [(1.0, float(rng.randrange(40)), rng.gauss(0, 3)) if i % 3 else (1.0, 5.0, None) for i in range(n)]


def test_replicates_have_all_draws_and_the_right_moments(spark, small_cells):
    rows = table(spark)
    got = bs.resampled_sums(spark.createDataFrame(rows, "one double, x double, y double"), ["one", "x", "y"], 3000, 4).toPandas()
    assert sorted(got["replicate"]) == list(range(3000))
    assert (got["one"] == 300).all()
    plain = np.array([[x, y or 0.0] for _, x, y in rows])
    cov = np.cov(got[["x", "y"]].to_numpy().T)
    assert np.allclose(got[["x", "y"]].mean(), plain.sum(axis=0), atol=4 * np.sqrt(np.diag(cov) / 3000))
    assert np.allclose(np.diag(cov), 300 * plain.var(axis=0), rtol=0.12)
    assert np.corrcoef(got["x"], got["y"])[0, 1] == pytest.approx(np.corrcoef(plain.T)[0, 1], abs=0.08)


def test_replicates_do_not_depend_on_partitions(spark, small_cells):
    df = spark.createDataFrame(table(spark, 120), "one double, x double, y double")
    runs = []
    for n in (1, 9):
        rows = bs.resampled_sums(df.repartition(n), ["x", "one"], 20, "seed").orderBy("replicate").collect()
        runs.append([(r["replicate"], r["x"], r["one"]) for r in rows])
    assert runs[0] == runs[1]
    other = bs.resampled_sums(df, ["x", "one"], 20, "seed 2").orderBy("replicate").collect()
    assert [r["x"] for r in other] != [x for _, x, _ in runs[0]]


def test_small_tables(spark):
    kind = "x double"
    assert bs.resampled_sums(spark.createDataFrame([], kind), ["x"], 5, 1).count() == 0
    none = bs.stderr_of_sums(spark.createDataFrame([], kind), ["x"], F.col("x"), 5, 1).first()
    assert tuple(none) == (None, None)
    one = bs.stderr_of_sums(spark.createDataFrame([(2.5,)] * 4, kind), ["x"], F.col("x"), 5, 1).first()
    assert tuple(one) == (10.0, 0.0)


def test_bleu_and_chrf_errors_against_plain_resampling(spark, small_cells):
    rng = random.Random(5)
    texts = []
    for i in range(60):
        ref = [rng.choice("abcdefgh") * 2 for _ in range(rng.randrange(6, 20))]
        hyp = [w if rng.random() > 0.02 * (i % 20) else "zz" for w in ref]
        texts.append((" ".join(hyp), " ".join(ref)))
    df = spark.createDataFrame(texts, "hyp string, ref string")
    draw = np.random.default_rng(1)
    for matches, order, score, got in (
        (ov.clipped_matches(ov.bleu_tokens("hyp"), ov.bleu_tokens("ref"), 4), 4, ov._bleu(4), ov.bleu_stderr(df, "hyp", "ref", 800, 1)),
        (ov.clipped_matches(ov.char_tokens("hyp"), ov.char_tokens("ref"), 6), 6, ov._chrf(6, 2.0), ov.chrf_stderr(df, "hyp", "ref", 800, 1)),
    ):
        counts = ov._order_rows(df, matches, order).toPandas()
        sums = np.array([counts.to_numpy()[draw.integers(0, 60, 60)].sum(axis=0) for _ in range(800)], float)
        plain = spark.createDataFrame([tuple(map(float, r)) for r in sums], list(counts.columns)).select(score.alias("s")).toPandas()["s"]
        mean, err = got.first()
        assert mean == pytest.approx(plain.mean(), abs=5 * plain.std() / 800**0.5 * 2)
        assert err == pytest.approx(plain.std(ddof=1), rel=0.15)
