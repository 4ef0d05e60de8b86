import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import ODD_TEXTS
from tokenizers import Tokenizer

from tallyloom.llm.packing import Capacities, best_fit_plan, pack, sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def one_by_one(lengths, size):
    """Best-fit decreasing, document by document."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, free in enumerate(bins) if free >= n]
        if fitting:
            bins[min(fitting, key=lambda i: bins[i])] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    draw = random.Random(seed)
    size = draw.choice([7, 20, 64])
    lengths = [draw.randint(1, size) for _ in range(draw.randint(0, 80))]
    seen, bins = Counter(), defaultdict(list)
    for length, rank, count, first, each, offset in best_fit_plan(dict(Counter(lengths)), size).tolist():
        assert rank == seen[length]
        seen[length] += count
        for k in range(count):
            bins[first + k // each].append((offset + k % each * length, length))
    assert seen == Counter(lengths)
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
    assert sorted(size - sum(n for _, n in c) for c in bins.values()) == one_by_one(lengths, size)


def test_tightest_capacity():
    tree = Capacities(50)
    for c in (3, 17, 50):
        tree.add(c, 0, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 17, 18, 50)] == [3, 3, 17, 17, 50, 50]
    tree.take(17)
    assert tree.tightest(4) == 50


def check(rows, texts, size):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    want = Counter()
    for i, text in texts:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in c) for c in bins.values()) == one_by_one([r.length for r in rows], size)


@pytest.mark.parametrize("size", [64, 2048])
def test_table(odd_docs, size):
    check(pack(odd_docs, PATH, seq_len=size).collect(), ODD_TEXTS, size)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)


def test_sequences_hold_the_ids(odd_docs):
    packed = pack(odd_docs, PATH, seq_len=128, with_ids=True)
    total = Counter(i for r in sequences(packed).collect() for i in r.ids)
    assert total == Counter(i for _, t in ODD_TEXTS for i in [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0])
    assert pack(odd_docs.limit(0), PATH).collect() == []


def test_words_are_cut_where_the_library_cuts(spark):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choice(" \n\t ab's1.é日​\x1c\x85\xa0") for _ in range(draw.randint(0, 40)))) for i in range(2000)] + [(-1, "a <|endoftext|> b<|endoftext|>")]
    check(pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect(), texts, 2048)
