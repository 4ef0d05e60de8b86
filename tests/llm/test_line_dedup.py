import random

from conftest import ODD_TEXTS

from tallyloom.llm import line_dedup as L


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def one_by_one(docs, near):
    """Every line against all earlier ones."""
    seen, known, out = [], set(), {}
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        keep = []
        for line in (text or "").split("\n"):
            x = line.strip()
            goes = bool(x) and (x in known or len(x) >= near and any(len(y) >= near and within_one_edit(x, y) for y in seen))
            if x and x not in known:
                seen.append(x)
                known.add(x)
            if not goes:
                keep.append(line)
        out[i] = "\n".join(keep) if text is not None else None
    return out


def drawn(seed, count):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab c") for _ in range(draw.randint(5, 14))) for _ in range(30)]

    def changed(text):
        chars = list(text)
        for _ in range(draw.choice([0, 0, 1, 1, 2])):
            kind, place = draw.choice("dix"), draw.randrange(len(chars) + 1)
            if kind == "i":
                chars.insert(place, draw.choice("abé"))
            elif place < len(chars):
                chars[place : place + 1] = [] if kind == "d" else [draw.choice("abé")]
        return "".join(chars)

    rows = [(i, "\n".join(draw.choice(["", " ", "\t"]) + changed(draw.choice(base)) for _ in range(draw.randint(0, 6)))) for i in range(count)]
    return rows + [(1000, None), (1001, ""), (1002, "\n\n"), (None, "zz zz zz zz\nqq")]


def test_equals_comparing_all_lines(spark, near=6):
    docs = drawn(7, 120)
    got = L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), near_chars=near)
    assert {r.doc_id: r.text for r in got.collect()} == one_by_one(docs, near)


def test_joins_by_exchange_give_the_same(spark, monkeypatch):
    docs = drawn(8, 60)
    monkeypatch.setattr(L, "BROADCAST_ROWS", -1)
    got = L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), near_chars=6)
    assert {r.doc_id: r.text for r in got.collect()} == one_by_one(docs, 6)


def test_odd_tables(spark, odd_docs):
    out = L.without_repeated_lines(odd_docs, counts=("n_lines", "n_dropped"))
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(ODD_TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].n_dropped == 0 and by[6][0].text == "" and by[6][0].n_dropped == 2
    assert by[2][0].text is None and by[3][0].text == "" and by[4][0].text == "  \n\t \n"
    assert len({r.text for r in by[10]} - {""}) in (1, 2) and sum(r.n_dropped for r in by[10]) == 0  # repeated rows are one document
    assert L.without_repeated_lines(odd_docs.limit(0)).collect() == []


def test_one_edit_in_a_very_long_line(spark):
    line = "".join(random.Random(1).choice("abcdefgh ") for _ in range(60_000)).strip()
    docs = [(1, line), (2, line[:30_000] + "Z" + line[30_001:]), (3, line[:-1]), (4, "Q" + line), (5, "QQ" + line)]
    got = {r.doc_id: r.text for r in L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == line and got[2] == got[3] == got[4] == "" and got[5] == ""  # 5 is one edit from 4


def test_a_hot_line(spark):
    docs = [(i, f"the line that everybody has\nown {i} " + "abc" * i) for i in range(300)]
    rows = L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=("n", "m")).collect()
    assert sum(r.m for r in rows) >= 299 and [r.m for r in rows if r.doc_id == 0] == [0]


def test_lines_built_to_collide_under_a_polynomial_stay(spark):
    """A Thue-Morse line and its complement have one hash under any polynomial modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, two), (3, two + "\nnew")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.without_repeated_lines(docs).collect()} == {1: one, 2: two, 3: "new"}


def test_a_worker_gets_each_text_once_and_in_small_parts(spark, monkeypatch):
    whole = L.slices

    def small(batch, text, most):
        assert most <= 1 << 18 and sum(str(c.type) in ("string", "large_string") for c in batch.columns) == 1
        return whole(batch, text, most)

    docs = [(1, "a line that is repeated later\none"), (2, "two\na line that is repeated later"), (3, None), (4, "a line that is repeated lat3r")]
    monkeypatch.setattr(L, "slices", small)
    got = L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), counts=("n", "m")).collect()
    assert sorted(tuple(r) for r in got) == [(1, docs[0][1], 2, 0), (2, "two", 2, 1), (3, None, 1, 0), (4, "", 1, 1)]
