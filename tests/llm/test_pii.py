import random
import re

import numpy as np

from tallyloom.llm import pii as P

PATTERNS = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 16 <= len(digits) <= 19 and P.luhn(digits) or kind == 3 and 8 <= len(digits) <= 15:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_patterns():
    draw = random.Random(2)
    for _ in range(20_000):
        text = "".join(draw.choice("0123456789..@@ab-+ ()") for _ in range(draw.randint(0, 40)))
        assert plain(text) == P.base_spans(text), text
    assert P.base_spans("1" * 200_000 + "a" * 200_000 + "@" + "." * 1000) == []


def test_gradients():
    tagger = P.Tagger(1)
    for name in ("table", "again", "out", "bias", "ties"):
        setattr(tagger, name, getattr(tagger, name).astype(np.float64))
    draw = np.random.default_rng(0)
    symbols, labels = draw.integers(30, 60, (3, 9)).astype(np.int16), draw.integers(0, P.LABELS, (3, 9))

    def loss():
        total = 0.0
        for s, y in zip(tagger.scores(symbols).astype(float), labels):
            ahead = s[0]
            for t in range(1, len(s)):
                ahead = s[t] + np.log(np.exp(ahead[:, None] + tagger.ties).sum(axis=0))
            total += np.log(np.exp(ahead).sum()) - s[np.arange(len(s)), y].sum() - tagger.ties[y[:-1], y[1:]].sum()
        return total / 3

    c = int(symbols[0, 4])
    for weight, slope, at in zip(tagger.weights(), tagger.gradients(symbols, labels), [(0, c, 5), (1, 3, 20), (1, 2, 3), (2,), (1, 3)]):
        old = weight[at]
        weight[at] = old + 1e-3
        high = loss()
        weight[at] = old - 1e-3
        low = loss()
        weight[at] = old
        assert abs((high - low) / 2e-3 - slope[at]) < 2e-4


def test_decoding_finds_the_best_path():
    draw = np.random.default_rng(3)
    tagger = P.Tagger()
    tagger.ties = draw.normal(0, 1, tagger.ties.shape)
    lengths = np.array([3, 1, 5])
    scores = draw.normal(0, 1, (9, P.LABELS))
    path, first = tagger.decode(scores, lengths), 0
    for n in lengths:
        value = lambda y: scores[np.arange(first, first + n), y].sum() + tagger.ties[y[:-1], y[1:]].sum()  # noqa: B023, E731
        best = max((np.array(y) for y in np.ndindex(*[P.LABELS] * n)), key=value)
        assert (path[first : first + n] == best).all()
        first += n


def test_whole_table(spark, sf_dir, odd_docs):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    tagger = P.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in P.personal_data(docs, tagger).collect()}
    for i, text in texts.items():
        assert [(P.KINDS.index(s.kind), s.start, s.end) for s in found[i].base] == plain(text)
    # held-out accuracy on generated items in contexts that the training did not see
    contexts = [t[:256] for t in texts.values() if not re.search("[0-9@]", t)][:200]
    symbols, labels = P.training_set(contexts, 200, seed=77)
    guess = tagger.decode(tagger.scores(symbols).reshape(-1, P.LABELS), np.full(len(symbols), P.WINDOW)).reshape(labels.shape)
    assert (guess == labels).mean() > 0.97 and (guess[labels > 0] == labels[labels > 0]).mean() > 0.85
    added = P.decoded_spans(tagger, ["write to john.doe (at) example.org now", "no data in this text at all", "call (555) 123-4567 or stop"])
    assert [(k, "write to john.doe (at) example.org now"[a:b]) for k, a, b in added[0]] == [(0, "john.doe (at) example.org")] and added[1] == []
    rows = P.personal_data(odd_docs, tagger).collect()
    assert len(rows) == 16 and P.personal_data(odd_docs.limit(0), tagger).collect() == []
    assert P.train(odd_docs.limit(0)).table.shape == tagger.table.shape


def test_span_string(spark):
    frame = spark.sql("SELECT array(named_struct('kind','phone','start',1L,'end',12L), named_struct('kind','email','start',30L,'end',40L), named_struct('kind','email','start',4L,'end',9L)) AS s")
    assert frame.select(P.joined("s")).first()[0] == "email:4:9,email:30:40,phone:1:12"
