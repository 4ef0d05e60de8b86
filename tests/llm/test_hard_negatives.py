import math
import random

import numpy as np
import pytest
from conftest import CLASHES
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives as H


def plain(rows, anchor, positives=5, negatives=5, low=80, high=100):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], label))
    first = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, v, label in kept:
        if i is None or not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in kept]
        for s, j, _ in sorted((x for x in scored if x[2] == label and x[1] != i), key=first)[:positives]:
            hard = sorted((x for x in scored if x[2] != label and low * s <= 100 * x[0] <= high * s), key=first)[:negatives]
            out += [(i, j, k + 1, n, s, t) for k, (t, n, _) in enumerate(hard)]
    return sorted(out, key=str)


def table(spark, rows):
    extra = tuple(str(k) for k in range(len(CLASHES)))
    return spark.createDataFrame([r + extra for r in rows], ", ".join(["vec_id long, embedding array<float>, `label` int", *(f"`{c}_x` string" if c == "label" else f"`{c}` string" for c in CLASHES)])).repartition(3)


def found(spark, rows, anchor, **options):
    df = table(spark, rows)
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % anchor == 0, **options).collect()), key=str)


def cloud(seed, n, width, labels, spread=0.4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, width))
    return [(k, (centres[k % labels] + spread * draw.normal(size=width)).astype(np.float32).tolist(), int(draw.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("width", [1, 3, 24])
def test_against_all_pairs(spark, width):
    rows = cloud(width, 600, width, 5)
    assert found(spark, rows, 10) == plain(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, 50, positives=2, negatives=7, low=10, high=95) == plain(rows, lambda i: i % 50 == 0, 2, 7, 10, 95)


def test_odd_rows(spark):
    rows = cloud(1, 60, 4, 3)
    rows += [(100, None, 1), (110, [1.0, None, 2.0, 0.5], 1), (120, [math.nan, 1.0, 1.0, 1.0], 1), (130, [math.inf, 1.0, 1.0, 1.0], 0), (140, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, None, None)]
    rows += [(150, [], 1), (160, [0.0] * 4, 2), (170, [1.0, 2.0], 1), (0, *rows[0][1:]), (0, *rows[0][1:]), (20, rows[3][1], 2)]
    rows += [(200 + k, [1.0, 1.0, 1.0, 1.0], k % 3) for k in range(40)]  # ties
    rows += [(300, [-1.0] * 4, 0), (301, [-1.0] * 4, 1)]
    assert found(spark, rows, 10) == plain(rows, lambda i: i % 10 == 0)
    assert found(spark, rows[:0], 10) == []
    assert found(spark, [(0, [1.0], 1)], 10) == []
    assert found(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2)], 1) == plain([(1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2)], lambda i: True)


def test_shards_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 20)
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = cloud(2, 500, 8, 4) + [(1000 + k, [0.5] * 8, k % 4) for k in range(300)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, 5) == plain(rows, lambda i: i % 5 == 0)


def test_walks_end_early():
    draw = np.random.default_rng(5)
    v = np.concatenate([c + draw.normal(size=(2000, 16)) * 4 for c in draw.normal(size=(5, 16)) * 200]).astype(np.int32)
    none = np.zeros(len(v), bool)
    shard = H.Shard(np.arange(len(v)), none, np.arange(len(v)) % 2, v)
    mine = v[:50]
    centre = H.unit(mine.astype(float).sum(axis=0, keepdims=True))[0]
    radius = np.arccos(np.clip(H.unit(mine.astype(float)) @ centre, -1, 1)).max()
    shard.sort_for(0, centre, radius + 1e-7)
    seen = []
    anchors = {"v": mine, "id": np.arange(50), "label": np.arange(50) % 2, "lo": np.full((50, 1), -H.FAR), "hi": np.full((50, 1), H.FAR - 1)}
    shard.walk(anchors, True, 5, seen)
    assert sum(seen) < 0.5 * 50 * len(v)
