"""Work that must not grow faster than the input."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.functions import answers as ans
from tallyloom.functions import arrays as ar
from tallyloom.functions import text as tx
from tallyloom.operators import decontam as dc
from tallyloom.operators import tokens as tk
from tallyloom.plans import jobs
from tallyloom.queries import QUERIES, functions_text
from tallyloom.streaming import incremental as inc


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_ngrams_of_a_single_row_document_stay_in_its_row(spark):
    words = [f"w{i % 40}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20])), (2, " ".join(words[:14])), (3, "too short"), (None, " ".join(words[:13])), (4, None)]
    parts = functions_text.gram_parts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: (r["rows"], r["n"], r["distinct"]) for r in parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_grams").alias("n"), F.count_distinct("gram").alias("distinct")).collect()}
    assert got == {1: (1, 188, 0), 2: (10, 10, 8), None: (1, 1, 0)}
    assert parts.where("doc_id = 1").first()["n_distinct"] == 40


def test_token_f1_of_long_answers(spark):
    n = 60_000
    pred, gold = " ".join(f"w{i}" for i in range(n)), " ".join(f"w{i}" for i in range(n // 2, n + n // 2))
    rows = [(1, pred, gold), (2, "b c c", "c c c d"), (3, "", ""), (4, "x", ""), (5, "x", "y"), (6, None, "x")]
    df = spark.createDataFrame(rows, "k int, p string, g string")
    begun = time.time()
    got = {r["k"]: r["f1"] for r in df.select("k", ans.token_f1("p", "g").alias("f1")).collect()}
    assert got == {1: 0.5, 2: 4 / 7, 3: 1.0, 4: 0.0, 5: 0.0, 6: None}
    assert time.time() - begun < 30


def test_workers_look_up_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(tk, "BATCH_WORDS", 8)
    rows, seen = [["a"] * n for n in (3, 0, 5, 1, 20, 2, 6, 0)] + [None, ["b"]], []

    def sizes(lists: pa.Array) -> pa.Array:
        seen.append(len(lists.flatten()))
        return pa.array([len(x or ()) for x in lists.to_pylist()], pa.int32())

    got = tk._in_slices(pa.array(rows, pa.list_(pa.string())), sizes, pa.int32())
    assert got.to_pylist() == [3, 0, 5, 1, 20, 2, 6, 0, 0, 1]
    assert sum(seen) == 38 and sorted(seen)[-1] == 20 and sorted(seen)[-2] <= 8
    assert tk._in_slices(pa.array([], pa.list_(pa.string())), sizes, pa.int32()).to_pylist() == []


def test_decode_of_odd_rows(spark):
    vocab = spark.createDataFrame([("x", 3), ("y", 4)], "word string, token_id int")
    rows = [(1, [3, 4, 3, 1]), (2, []), (3, None), (4, [2, 99, 4]), (5, [None, 3]), (5, [4])]
    got = tk.decode(spark.createDataFrame(rows, "k int, t array<int>"), vocab, "k", "t").collect()
    assert sorted((r["k"], r["text"]) for r in got) == [(1, "x y x"), (2, ""), (3, ""), (4, "<unk> y"), (5, "x"), (5, "y")]


def test_places_are_worked_out_for_documents_with_hits_only(spark):
    dirt = " ".join(f"d{i}" for i in range(5))
    rows = [(1, "A b " + dirt.upper() + " c"), (2, "clean words all the way down here"), (2, dirt), (None, dirt), (3, None)]
    train = spark.createDataFrame(rows, "k bigint, t string")
    spans = dc.dirty_spans(train, spark.createDataFrame([(dirt,)], "g string"), "k", "t", "g", n=5)
    got = {r["k"]: [tuple(h) for h in r["hits"]] for r in spans.collect()}
    assert got == {1: [(2, 4, 17)], 2: [(0, 0, 13)], None: [(0, 0, 13)]}
    assert plan_of(spans).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Join LeftSemi") == 2


def test_likelihoods_are_never_broadcast(spark):
    samples = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 1, 0, 2, 2)], "doc_id bigint, cont_id int, label int, cont_str_len int, cont_byte_len int")
    scores = jobs.score_samples(samples, spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0)], "doc_id bigint, cont_id int, ll double"), "acc", "t")
    assert "BroadcastHashJoin" not in plan_of(scores)
    assert scores.first()["score"] == 1.0


def test_a_buffer_state_holds_many_keys():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    step, state = inc._buffer_step(2, ["id", "v"]), State()

    def run(*batches):
        frames = [pd.DataFrame(b, columns=["_key", "id", "v"]) for b in batches]
        out = pd.concat(step((7, 1), iter(frames), state))
        return sorted(map(tuple, out[["_key", "_shard", "id", "v", "_version"]].astype({"id": int}).to_numpy().tolist()), key=str)

    first = run([("a", 1, 1.0), ("b", 2, 2.0)], [("a", 3, 3.0), ("a", 5, 5.0), (None, 4, 4.0)])
    assert first == sorted([("a", 1, 3, 3.0, 5), ("a", 1, 5, 5.0, 5), ("b", 1, 2, 2.0, 2), (None, 1, 4, 4.0, 4)], key=str)
    assert run([("b", 6, 6.0)]) == [("b", 1, 2, 2.0, 6), ("b", 1, 6, 6.0, 6)]  # the other keys stay, and are not told again
    assert len(state.get[0]) == 5


def test_an_instance_is_decoded_once(spark, monkeypatch):
    log = spark.createDataFrame([(s, k, i) for s in range(3) for k, i in enumerate((5, 6, 5))], "step bigint, slot int, instance_id bigint")
    instances = spark.createDataFrame([(5, [3, 4, 1]), (6, [4]), (8, [3])], "instance_id bigint, tokens array<int>")
    vocab, decoded, decode = spark.createDataFrame([("x", 3), ("y", 4)], "word string, token_id int"), [], tk.decode

    def counting(df, *args):
        decoded.append(df.count())
        return decode(df, *args)

    monkeypatch.setattr(tk, "decode", counting)
    for steps, most in ((None, 3), ([0, 2], 2)):
        got = {(r["step"], r["slot"]): r["text"] for r in jobs.inspect_batches(log, instances, vocab, 2, steps).collect()}
        assert got == {(s, k): t for s in steps or range(3) for k, t in enumerate(("x y", "y", "x y"))}
        assert decoded.pop() <= most


def test_word_places_and_runs_in_odd_texts(spark):
    texts = ["", "  ", " a", "a ", "\t a\n bb  c", "é ü𝒳 z", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", tx.word_spans("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert (got[i] is None) == (t is None)
        assert all(t[s["start"] : s["end"] + 1] == s["word"] for s in got[i] or ())
        assert [s["word"] for s in got[i] or ()] == (t or "").split()
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 3, n).tolist() for n in range(40)] + [[1, None, 1, None, 1, None, 1, None], [7] * 9, [1, 2] * 6 + [3]]

    def plain(x):
        runs = []
        for p in range(1, 6):
            same = [a is not None and a == b for a, b in zip(x[p:], x)] + [False]
            start = 0
            for i, s in enumerate(same):
                if not s:
                    first, end = start + p, i + p
                    if end - first >= 2 * p and (-(-first // p) + 1) * p <= end:
                        runs.append((first - p, end, p, (end - first + p) // p))
                    start = i + 1
        return [r for r in runs if r[2] <= len(x) // 3]

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, x array<int>")
    for r in rows.select("i", ar.periodic_runs(F.col("x"), 5).alias("r")).collect():
        assert [tuple(v) for v in r["r"]] == plain(arrays[r["i"]]), arrays[r["i"]]
    for most in (2, 3, 4, 6):
        for r in rows.select("i", ar.repeats_too_often(F.col("x"), most, 5).alias("r")).collect():
            assert r["r"] == any(v[3] >= most for v in plain(arrays[r["i"]])), (most, arrays[r["i"]])
    listed = plan_of(rows.select(ar.repeats_too_often(F.col("x"), 4, 5)))
    assert "regexp_extract_all" not in listed.lower()  # stretches are looked for, not cut out


def test_folders_of_parts_are_not_listed_by_a_task_each(spark, tmp_path):
    lines = [f"{i:06d} " + "x" * (i % 90) for i in range(20_000)]
    spark.createDataFrame([(0, "\n".join(lines), "web")], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(name), spark.sparkContext
    context.setJobGroup("parts", "parts")
    try:
        got = {(r["file"], r["part"]): (r["n_lines"], r["n_bytes"]) for r in QUERIES["s11_split_by_size"](spark, str(tmp_path)).collect()}
    finally:
        context._jsc.clearJobGroup()
    want, at = {}, 0
    for line in lines:
        n, size = want.get(("web", at // 20_000), (0, 0))
        want["web", at // 20_000] = (n + 1, size + len(line))
        at += len(line) + 1
    assert got == want and len(want) > 40
    status = context.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("parts") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < len(want)
    assert spark.conf.get(name) == before
