import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD_TEXTS
from pyspark.sql import functions as F

from tallyloom.llm import signature_trees as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size=5):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain(docs, percent=80):
    """(id, set size, smallest id reachable) by comparing all pairs."""
    sets = [plain_set(x) for _, x in docs]
    codes = {}
    ids = [np.array(sorted(codes.setdefault(x, len(codes)) for x in s), np.int64) for s in sets]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    have = {}
    for i, s in enumerate(ids):
        common = {}
        for x in s.tolist():
            for j in have.get(x, ()):
                common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(ids[j]) - n):
                a, b = sorted((find(i), find(j)))
                label[b] = a
        for x in s.tolist():
            have.setdefault(x, []).append(i)
    least = {}
    for i, (own, _) in enumerate(docs):
        if own is not None:
            least[find(i)] = min(least.get(find(i), own), own)
    return sorted(((own, len(ids[i]), least.get(find(i)) if len(ids[i]) else own) for i, (own, _) in enumerate(docs)), key=str)


def found(spark, docs, parts=5, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r) for r in T.similar_documents(df, **options).collect()), key=str)


def edited(draw, words, share):
    return [f"e{draw.random()}" if draw.random() < share else w for w in words]


def family(seed, count, length, share, boiler=0):
    draw = random.Random(seed)
    base = [f"{seed}w{draw.randrange(400)}" for _ in range(length)]
    return [" ".join([f"b{k}" for k in range(boiler)] + edited(draw, base, share)) for _ in range(count)]


def test_shingles():
    texts = ["A b c d e f", "a  B\tc d e f a b c d e", "a b", "b a", "", None, " \n", "x " * 50, "a b c d e"]
    sets = T.shingle_sets(pa.array(["junk", *texts]).slice(1), 5)
    for x, text in zip(sets, texts):
        want = plain_set(text)
        assert len(x) == len(want)
    seen = [frozenset(x.tolist()) for x in sets]
    for a, x in zip(seen, texts):
        for b, y in zip(seen, texts):
            assert len(a & b) == len(plain_set(x) & plain_set(y))


@pytest.mark.parametrize("bits", [64, 4096])
def test_tree_against_all_pairs(monkeypatch, bits):
    monkeypatch.setattr(T, "BITS", bits)
    monkeypatch.setattr(T, "PAIRS", 256)
    draw = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = draw.choice(3000, draw.integers(1, 120), replace=False)
        for _ in range(draw.integers(1, 40)):
            own = np.concatenate([base[draw.random(len(base)) > 0.06], draw.choice(10**6, draw.integers(0, 6)) + 3000])
            sets.append(np.unique(own) if len(own) else base)
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    label = list(range(len(sets)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    want = [find(i) for i in range(len(sets))]
    links = T.Tree(flat, at, np.arange(len(sets)), 80).walk()
    label = list(range(len(sets)))
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        label[b] = a
    assert [find(i) for i in range(len(sets))] == want
    assert len(links) == len(sets) - len(set(want))  # never more than what connects


def test_odd_table(spark, odd_docs):
    got = T.similar_documents(odd_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ODD_TEXTS)
    assert T.similar_documents(odd_docs.limit(0)).collect() == []
    nothing = [(1, None), (2, ""), (None, " ")]
    assert found(spark, nothing) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_families_and_blocks(spark):
    texts = family(1, 120, 150, 0.02) + family(2, 60, 80, 0.04) + family(3, 30, 60, 0.3) + family(4, 40, 3, 0.2) + family(5, 25, 700, 0.01)
    texts += family(1, 20, 150, 0.0) + [family(6, 1, 40, 0)[0]] * 30
    random.Random(4).shuffle(texts)
    docs = list(enumerate(texts))
    want = plain(docs)
    assert 10 < len({c for _, _, c in want}) < len(docs) - 50
    assert found(spark, docs) == want
    assert found(spark, docs, parts=2, block=3000) == want  # groups of many blocks


def test_boilerplate_is_no_group(spark, monkeypatch):
    """Documents that share most of their text with all others, but not enough, are told apart without comparing all."""
    draw = random.Random(9)
    texts = [" ".join([f"b{k}" for k in range(120)] + [f"o{draw.randrange(10**9)}" for _ in range(80)]) for _ in range(2000)]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = df.selectExpr("doc_id AS id", "text")
    packed = T.level_bitmaps(T.frequent(rows.select("text"), 5))
    marked = T.with_prefixes(rows, packed, 5, 80).withColumn("row", F.monotonically_increasing_id())
    assert T.shared_prefixes(marked, 80).count() < 50
    assert found(spark, docs, parts=4) == sorted(((i, 196, i) for i, _ in docs), key=str)


def test_levels_are_what_they_say(spark):
    counts = spark.createDataFrame([(k, n) for k, n in ((0, 2), (32767, 9), (32768, 64), (T.CELLS - 1, 2000), (5, 1), (T.CELLS + 7, 8))], "token bigint, n bigint")
    packed = T.level_bitmaps(counts)
    on = [set(np.flatnonzero(np.unpackbits(row, bitorder="little")).tolist()) for row in packed]
    assert on == [{0, 32767, 32768, T.CELLS - 1, 7}, {32768, T.CELLS - 1}, {T.CELLS - 1}]
    tokens = np.array([5, 0, 32768, T.CELLS - 1])
    assert (T.ordered(tokens, packed) & ((1 << 61) - 1)).tolist() == [5, 0, 32768, T.CELLS - 1]


def test_ties_connect_what_sizes_allow(spark):
    draw = random.Random(8)
    rows = []
    for fp in range(300):
        n = draw.choice([5, 20, 21, 24, 30, 37, 40, 49, 60, 70, 90, 91])
        rows.append((fp, n, draw.sample(range(300), int(T.prefix_length(n, 80)))))
    marked = spark.createDataFrame(rows, "row long, n long, prefix array<long>")
    for parts in (1, 40):
        label = {fp: fp for fp, _, _ in rows}

        def find(i):
            while label[i] != i:
                i = label[i]
            return i

        got = T.shared_prefixes(marked.repartition(parts), 80).collect()
        for r in got:
            a, b = sorted((find(r.fp), find(r.root)))
            label[b] = a
        for i, (a, n, p) in enumerate(rows):
            for b, m, q in rows[:i]:
                small, large = (p, q) if n < m else (q, p)
                both = [w for w in small[: int(T.smaller_prefix(min(n, m), 80))] if w in large]
                if n == m:
                    both = [w for w in both if w in large[: int(T.smaller_prefix(n, 80))]]
                if both and 10 * min(n, m) >= 8 * max(n, m):
                    assert find(a) == find(b)


def test_connected_finds_the_smallest(spark):
    draw = random.Random(10)
    chain = draw.sample(range(1000), 200)
    edges = [*zip(chain[:-1], chain[1:]), *((2000 + k, 3000) for k in range(20)), (5000, 5001), (5001, 5000), (7, 7)]
    label = {v: v for e in edges[:-1] for v in e}
    for _ in label:
        for a, b in edges[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "fp long, root long")
    assert {r.fp: r.label for r in T.connected(df).collect()} == label
    assert T.connected(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1 << 22, 50])
def test_shared_shingles_are_known_wherever_they_are_counted(spark, monkeypatch, block):
    """Documents in different tasks that share a passage which few others have are not tied, as all that is shared is known."""
    monkeypatch.setattr(T, "COUNTED", block)
    draw = random.Random(12)
    own = lambda n: [f"o{draw.randrange(10**9)}" for _ in range(n)]
    passages = [own(30) for _ in range(40)]
    texts = [" ".join(own(70) + passages[k % 40] + own(20)) for k in range(120)]
    texts += family(3, 10, 60, 0.02) + ["", None, " a", "b " * 40]
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "id long, text string").repartition(60)
    packed = T.cell_bitmaps(T.counted_cells(df.select("text"), 5).cache())
    sets = T.shingle_sets(pa.array(texts), 5)
    token, n = np.unique(np.concatenate(sets), return_counts=True)
    cells = [np.unpackbits(row, bitorder="little")[token % (len(row) * 8)] for row in packed]
    for row, least in zip(cells, T.LEVELS):
        assert row[n >= least].all() and row[n < least].mean() < 0.1
    marked = T.with_prefixes(df, packed, 5, 80, alone=True).withColumn("row", F.monotonically_increasing_id()).cache()
    assert {r.id for r in marked.where("prefix IS NOT NULL").collect()} <= set(range(120, 130))
    assert found(spark, docs, parts=60) == plain(docs)


def test_copies_alone_are_not_compared(spark, monkeypatch):
    """A family whose rows are all of one set is a node already; its sets are not sent."""
    docs = list(enumerate([family(20 + k, 1, 60, 0)[0] for k in range(20)] * 5))
    links, sent = T.family_links, []
    monkeypatch.setattr(T, "family_links", lambda sets, families, *rest: sent.append(families.count()) or links(sets, families, *rest))
    assert found(spark, docs, parts=50) == plain(docs)
    assert sent == [0]
