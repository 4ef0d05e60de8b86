import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from conftest import ODD_TEXTS

from tallyloom.llm import resampling as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, items, longest=1, buckets=10_000, percent=10, least=20):
    s, t = (Counter(bucket(f, buckets) for x in texts for f in runs(x, longest)[1]) for texts in ([x for _, x in docs], items))
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s.values()) + buckets) / ((s[k] + 1) * (sum(t.values()) + buckets)))) for k in range(buckets)]
    rows = []
    for i, x in docs:
        words, features = runs(x, longest)
        weight = sum(gain[bucket(f, buckets)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_runs_of_a_slice():
    texts = pa.array(["one two", None, "", " A-b\x00Été  9", "x"] * 3)
    for longest in (1, 3):
        kinds, at, words = R.run_buckets(texts.slice(3, 9), longest, 997)
        for k, text in enumerate(texts.slice(3, 9).to_pylist()):
            want = runs(text, longest)
            assert words[k] == len(want[0])
            assert sorted(kinds[at == k].tolist()) == sorted(bucket(f, 997) for f in want[1])


def test_odd_table(spark, odd_docs):
    items = ["the edge tion", None, "", "and thereon, 42 été", "plain text"]
    target = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "item_id long, text string")
    for longest, buckets, percent in ((1, 10_000, 50), (2, 101, 100)):
        got = R.resample(odd_docs, target, longest=longest, buckets=buckets, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ODD_TEXTS, items, longest, buckets, percent)
    assert R.resample(odd_docs.limit(0), target).collect() == []
    assert sorted((tuple(r) for r in R.resample(odd_docs, target.limit(0)).collect()), key=str) == plain(ODD_TEXTS, [])


def test_ranks_over_many_parts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat(concat('w', id % 7, ' '), 18 + cast(id % 5 AS int)), 'end') AS text").repartition(7)
    target = spark.createDataFrame([("w1 w2 w1",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in R.resample(docs, target).collect()), key=str) == plain(rows, ["w1 w2 w1"])
