import random
import re

import numpy as np
import xxhash
from conftest import ODD_TEXTS

from tallyloom.llm import simhash_pivots as S


def plain_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_sets(prints, bits=4):
    """The smallest fingerprint that links reach."""
    prints = np.unique(np.array(prints, np.uint64))
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            label[b] = a
    return {int(p): int(prints[find(i)]) for i, p in enumerate(prints)}


def same_partition(a, b):
    pairs = {(a[k], b[k]) for k in a}
    return a.keys() == b.keys() and len(pairs) == len(set(a.values())) == len(set(b.values()))


def cloud(seed, centres, members, flips):
    draw = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = draw.getrandbits(64)
        for _ in range(members):
            p = c
            for _ in range(draw.randint(0, flips)):
                p ^= 1 << draw.randrange(64)
            out.add(p)
    return sorted(out)


def labels_of(spark, prints, **options):
    nodes = spark.createDataFrame([(S.signed(p),) for p in prints], "fp long")
    got = {p: p for p in prints} | {r.fp % (1 << 64): r.label % (1 << 64) for r in S.components(S.links(nodes, **options)).collect()}
    return got


def test_links_are_complete(spark):
    prints = cloud(1, 40, 12, 5) + [0, 15, 31, (1 << 64) - 1]
    assert same_partition(labels_of(spark, prints), plain_sets(prints))


def test_hot_buckets_are_dealt_again(spark):
    prints = cloud(2, 2, 150, 6)
    assert same_partition(labels_of(spark, prints, bucket=8), plain_sets(prints))


def test_long_chains_meet(spark):
    prints = [sum(1 << b for b in range(4 * k)) for k in range(17)]  # each 4 bits from the next
    assert len(set(labels_of(spark, [p % (1 << 64) for p in prints]).values())) == 1


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    """The keys are 35 rows a fingerprint, but Spark sizes them like the fingerprints: only a counted table may go to the driver."""
    prints = cloud(5, 30, 10, 4)
    nodes = spark.createDataFrame([(S.signed(p), 0) for p in prints], "fp long, mask long")
    found = []
    for most in (0, 10**6):
        monkeypatch.setattr(S, "BROADCAST_ROWS", most, raising=False)
        members = S.bucket_members(nodes, 4, [0])
        plan = members._jdf.queryExecution().executedPlan().toString()
        sent = plan.split("BroadcastExchange")[1:]
        assert len(sent) == (most > 0)
        assert not any("Generate" in x or "Aggregate" in x for x in sent)
        found.append(sorted(tuple(r) for r in members.collect()))
    assert found[0] == found[1] and found[0]


def test_odd_table(odd_docs):
    rows = S.near_duplicates(odd_docs).collect()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str)
    prints = [plain_print(t) for _, t in ODD_TEXTS]
    label = plain_sets(prints)
    least = {}
    for (i, _), p in zip(ODD_TEXTS, prints):
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    assert got == sorted([(i, f"{p:016x}", least.get(label[p])) for (i, _), p in zip(ODD_TEXTS, prints)], key=str)
    assert S.near_duplicates(odd_docs.limit(0)).collect() == []
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(label.values()))
    assert {r.doc_id for r in rows if r.doc_id is not None} == set(least.values())
