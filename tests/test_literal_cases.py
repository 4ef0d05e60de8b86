"""Small cases with expected values written out."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import answers as ans
from tallyloom.functions import arrays as ar
from tallyloom.functions import nested as ne
from tallyloom.functions import text as tx
from tallyloom.operators import decontam as dc
from tallyloom.operators import rows as rw
from tallyloom.operators import sampling as sa
from tallyloom.operators import tasks
from tallyloom.operators import tokens as tk
from tallyloom.operators import windows as wi
from tallyloom.plans import jobs
from tallyloom.sources import readers as rd


def value(df, column):
    return df.select(column.alias("v")).first()["v"]


def one(spark, **fields):
    return spark.createDataFrame([tuple(fields.values())], list(fields))


def files(spark, *lengths):
    """Token files with running numbers 0, 1, 2, ... as one document each."""
    rows, at = [], 0
    for i, n in enumerate(lengths):
        rows.append((f"file{i}", i, list(range(at, at + n))))
        at += n
    return spark.createDataFrame(rows, "file string, doc int, tokens array<int>")


def test_chunks_of_two_files(spark):
    chunks = tk.chunk_tokens(files(spark, 16, 16), 4, "file", "doc")
    got = {(r["file"], r["chunk_idx"]): r["tokens"] for r in chunks.collect()}
    assert got[("file0", 0)] == [0, 1, 2, 3]
    assert got[("file0", 1)] == [4, 5, 6, 7]
    assert got[("file1", 3)] == [28, 29, 30, 31]
    assert len(got) == 8


def test_chunk_masks(spark):
    df = files(spark, 16, 16).withColumn(
        "label_mask",
        F.transform("tokens", lambda x: ~x.isin(1, 31)),
    )
    chunks = tk.chunk_tokens(df, 4, "file", "doc", ["tokens", "label_mask"])
    got = {(r["file"], r["chunk_idx"]): r["label_mask"] for r in chunks.collect()}
    assert got[("file0", 0)] == [True, False, True, True]
    assert got[("file1", 3)] == [True, True, True, False]


def test_remainders_are_dropped_per_file(spark):
    df = files(spark, 16).unionByName(
        spark.createDataFrame([("file1", 1, list(range(8)))], "file string, doc int, tokens array<int>")
    )
    got = {(r["file"], r["chunk_idx"]): r["tokens"] for r in tk.chunk_tokens(df, 3, "file", "doc").collect()}
    assert sum(k[0] == "file0" for k in got) == 5 and sum(k[0] == "file1" for k in got) == 2
    assert got[("file1", 1)] == [3, 4, 5]


def test_documents_continue_in_the_next_chunk(spark):
    df = spark.createDataFrame(
        [("f", 0, [1, 2, 3]), ("f", 5, []), ("f", 9, [4]), ("f", 7, [5, 6, 7, 8, 9, 10])],
        "file string, doc int, tokens array<int>",
    )
    got = {r["chunk_idx"]: r["tokens"] for r in tk.chunk_tokens(df, 4, "file", "doc").collect()}
    assert got == {0: [1, 2, 3, 5], 1: [6, 7, 8, 9]}


def test_mask_of_other_length_is_an_error(spark):
    df = spark.createDataFrame([("f", 0, 10, 9)], "file string, no int, n int, m int")
    with pytest.raises(Exception, match="mask length differs"):
        tk.file_offsets(df, 4, "file", "no", "n", "m").collect()


E_ID = 50279


@pytest.mark.parametrize(
    "tokens, lengths",
    [
        ([E_ID, 3, 4, 5, 5, E_ID, 6, 5, E_ID, 3, 5], [1, 5, 3, 2]),
        ([3, 4, 5, 5, E_ID, 6, 5, E_ID, 3, 5, E_ID], [5, 3, 3]),
    ],
)
def test_document_lengths(spark, tokens, lengths):
    assert value(one(spark, x=tokens), ar.doc_lengths(F.col("x"), E_ID)) == lengths


def test_padded_document_lengths(spark):
    df = spark.createDataFrame([([1, 5, 3, 2],), ([5, 3, 3],)], "x array<int>")
    got = [r[0] for r in df.select(ar.pad(F.col("x"), 4, F.lit(0))).collect()]
    assert got == [[1, 5, 3, 2], [5, 3, 3, 0]]


def ordered(spark, n=20):
    return spark.range(n).select(F.col("id"), F.col("id").alias("pos"))


def rank_ids(df, rank):
    return [r["id"] for r in df.filter(F.col("rank") == rank).orderBy("pos").collect()]


def test_two_workers(spark):
    plan = sa.assign_ranks(sa.pad_or_drop(ordered(spark), 2, False), 2, 8)
    assert rank_ids(plan, 0) == list(range(0, 20, 2)) and plan.count() == 20


def test_three_workers_keep_last(spark):
    plan = sa.assign_ranks(sa.pad_or_drop(ordered(spark), 3, False), 3, 8)
    assert plan.count() == 21
    assert rank_ids(plan, 0) == list(range(0, 20, 3))
    assert rank_ids(plan, 2) == [2, 5, 8, 11, 14, 17, 0]


def test_three_workers_drop_last(spark):
    plan = sa.assign_ranks(sa.pad_or_drop(ordered(spark), 3, True), 3, 8)
    assert plan.count() == 18 and rank_ids(plan, 0) == [0, 3, 6, 9, 12, 15]


def test_limit_and_start(spark):
    assert rank_ids(sa.assign_ranks(sa.resume(ordered(spark), 0, 12), 2, 8), 0) == [0, 2, 4, 6, 8, 10]
    assert rank_ids(sa.assign_ranks(sa.resume(ordered(spark), 12), 2, 8), 0) == [12, 14, 16, 18]


@pytest.mark.parametrize("world", [2, 4])
def test_restart_covers_the_rest_once(spark, world):
    plan = sa.assign_ranks(sa.resume(ordered(spark), 4), world, 8)
    parts = [rank_ids(plan, r) for r in range(world)]
    assert sorted(x for p in parts for x in p) == list(range(4, 20))


def test_padding_of_fewer_rows_than_workers(spark):
    plan = sa.pad_or_drop(ordered(spark, 2), 5, False)
    assert [(r["id"], r["pos"]) for r in plan.orderBy("pos").collect()] == [(0, 0), (1, 1), (0, 2), (1, 3), (0, 4)]


def test_flatten_json(spark):
    df = one(spark, j='{"a":0,"b":{"e":5,"f":1},"c":2}')
    assert value(df, ne.flatten_json("j")) == {"a": "0", "b.e": "5", "b.f": "1", "c": "2"}


def test_flatten_json_with_lists(spark):
    df = one(spark, j='{"a":0,"b":{"e":[{"x":{"z":[222,333]}},{"y":{"g":[99,100]}}],"f":1},"c":2}')
    assert set(value(df, ne.flatten_json("j"))) == {"a", "b.e", "b.f", "c"}
    assert value(df, ne.flatten_json("j", lists=True)) == {
        "a": "0", "b.e.0.x.z.0": "222", "b.e.0.x.z.1": "333", "b.e.1.y.g.0": "99", "b.e.1.y.g.1": "100", "b.f": "1", "c": "2",
    }


@pytest.mark.parametrize(
    "path, module, name",
    [("foo", None, "foo"), ("foo.bar", "foo", "bar"), ("foo.bar.Baz", "foo.bar", "Baz"), ("foo.bar.Baz.Quux", "foo.bar.Baz", "Quux")],
)
def test_type_path(spark, path, module, name):
    got = value(one(spark, p=path), tx.split_type_path("p"))
    assert (got["module"], got["name"]) == (module, name)


@pytest.mark.parametrize(
    "completion, gold, right",
    [
        (r"the total is \boxed{18}", "#### 18", True),
        (r"the total is \boxed{6}", "#### 18", False),
        ("so we get #### 18", "#### 18", True),
    ],
)
def test_answer_verification(spark, completion, gold, right):
    df = one(spark, c=completion, g=gold)
    answer = F.coalesce(ans.unbox(ans.last_boxed("c")), ans.marked_answer("c"))
    assert value(df, ans.math_equal(answer, ans.marked_answer("g"))) is right


@pytest.mark.parametrize(
    "text, boxed",
    [
        (r"a \boxed{1} b \boxed{\frac{2}{3}} c", r"\boxed{\frac{2}{3}}"), (r"\boxed{never", None), ("nothing", None),
        (r"x \boxed 5$ y", r"\boxed 5"), (r"\fbox{7}", r"\fbox{7}"), (r"\boxed{a}} z", r"\boxed{a}"),
    ],
)
def test_last_boxed(spark, text, boxed):
    assert value(one(spark, t=text), ans.last_boxed("t")) == boxed


@pytest.mark.parametrize(
    "a, b",
    [
        (r"\dfrac12", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("1/2", r"\frac{1}{2}"), (r"x=5", "5"), (r"\sqrt3", r"\sqrt{3}"),
        (".5", "0.5"), (r"10\%", "10"), (r"90^\circ", "90"), (r"5\text{ cm}", "5"), (r"\left(1, 2\right)", "(1,2)"),
        (r"\frac1{72}", r"\frac{1}{72}"), ("f(x) = 3", "f(x)=3"),
    ],
)
def test_math_spellings(spark, a, b):
    assert value(one(spark, a=a, b=b), ans.math_equal("a", "b")) is True


def test_math_equal_with_missing_answers(spark):
    df = spark.createDataFrame([(None, None), (None, "1"), ("1", None)], "a string, b string")
    assert [r[0] for r in df.select(ans.math_equal("a", "b")).collect()] == [True, False, False]


def test_clean_text_leaves_no_contaminant(spark):
    dirty = "zero " * 60 + "one two three four five" + " six" * 80
    train = spark.createDataFrame([(1, dirty), (2, "short text"), (3, "clean " * 60)], "id int, text string")
    dirt = spark.createDataFrame([("two three FOUR!",)], "t string")
    pieces = dc.clean_text(train, dirt, "id", "text", "t", n=3, window=20, min_piece=100).collect()
    got = {}
    for r in sorted(pieces):
        got.setdefault(r["id"], []).append(r["text"])
    assert all("two three four" not in p for p in got[1]) and len(got[1]) == 2
    assert 2 not in got and got[3] == ["clean " * 60]


def test_label_mask_marks_assistant_content_only(spark):
    chat = spark.createDataFrame(
        [(1, 0, "user", "hi there"), (1, 1, "assistant", " hello you "), (2, 0, "user", "alone")],
        "conv_id int, turn int, role string, text string",
    )
    rows = rw.label_mask(chat, 14).collect()
    assert len(rows) == 1
    on = [t for t, m in zip(rows[0]["tokens"], rows[0]["label_mask"]) if m]
    assert on == ["hello", "you", "</s>"] and len(rows[0]["tokens"]) == 14


def test_shards_lose_no_token(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (3, [6]), (4, [7, 8, 9])], "doc int, tokens array<int>")
    rows = tk.shard_rows(df, 4, "doc").orderBy("shard", "at").collect()
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).extend(r["tokens"])
    assert shards == {"00000": [1, 2, 3, 4], "00001": [5, 6, 7, 8], "00002": [9]}


def test_unknown_names_are_errors(spark):
    df = one(spark, seq=1)
    with pytest.raises(ValueError, match="unknown processor"):
        jobs.process(df, "nope")
    with pytest.raises(ValueError, match="both"):
        rw.project_fields(df, ["a"], ["b"])
    with pytest.raises(ValueError, match="needs"):
        rw.reward_prompt(df, template="no slots")


def test_rollout_masks(spark):
    # pad 0, end 1; prompt of three, response of three
    got = value(one(spark, x=[0, 5, 6, 7, 1, 0]), ar.rollout_masks(F.col("x"), F.lit(3), 1, 0))
    assert got["sequence"] == [0, 5, 6, 7, 1, 0]
    assert got["attention_mask"] == [0, 1, 1, 1, 1, 0]
    assert got["action_mask"] == [1, 1, 0]


def test_position_ids(spark):
    assert value(one(spark, m=[1, 1, 1, 2, 2, 2, 3, 3, 0]), ar.position_ids(F.col("m"))) == [0, 1, 2, 0, 1, 2, 0, 1, 0]


@pytest.mark.parametrize("number, text", [(999, "999"), (1000, "1.00K"), (1500, "1.50K"), (1_000_000, "1.00M"), (1_500_000_000, "1.50B"), (-2_000, "-2.00K")])
def test_human_number(spark, number, text):
    assert value(one(spark, n=number), tx.human_number("n")) == text


@pytest.mark.parametrize("text, normal", [("The  cat, a dog", "cat dog"), ("une é a", "une é"), ("éa àthe", "éa àthe"), ("An-other (the) end", "another end")])
def test_qa_normal_drops_whole_articles_only(spark, text, normal):
    assert value(one(spark, t=text), ans.qa_normal("t")) == normal


def test_deep_json_and_rows_that_no_limit_drops(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":1.50}}}}},"x":[1,{"y":"z"}],"n":null}'
    df = one(spark, j=deep)
    assert value(df, ne.flatten_json("j")) == {"a.b.c.d.e.f": "1.50", "x": '[1,{"y":"z"}]', "n": None}
    assert value(one(spark, j="no json"), ne.flatten_json("j")) is None
    rows = spark.createDataFrame([(2_000_000, 1, "1", False), (5, 1, "unit", False), (6, 0, "1", False), (7, 1, "1", True), (8, 1, None, None)], "doc_id long, idx int, label string, alone boolean")
    kept = rw.filter_requests(rows, "bpb", F.col("alone")).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 2_000_000] and {(r["idx"], r["label"]) for r in kept} == {(0, 0)}
    assert rw.filter_requests(rows, "acc").count() == 5


def test_bad_rows_do_not_stop_a_job(spark):

    masks = spark.createDataFrame([([1.0, 3.0], [1, 1]), ([1.0, 3.0], [0, 0])], "v array<double>, m array<int>")
    assert [r[0] for r in masks.select(ar.masked_mean(F.col("v"), F.col("m"))).collect()] == [2.0, None]
    assert [r[0] is not None and r[0][0] is not None for r in masks.select(ar.masked_normalize(F.col("v"), F.col("m"))).collect()] == [True, False]
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, reward double")
    assert {r["reward"] for r in wi.normalize_reward(same, "reward").collect()} == {None}
    prompts = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "p string, r double")
    assert sorted((str(r["p"]), r["shaped"]) for r in wi.shape_rewards(prompts, "baseline", "p", "r").collect()) == [("None", -1.0), ("None", 1.0), ("a", 0.0)]
    log = spark.createDataFrame([(0, 10, 0.0), (1, 20, 2.0)], "i long, tokens long, s double")
    assert [r["tokens_per_second"] for r in wi.rolling_throughput(log, 1, "i", "tokens", "s").orderBy("i").collect()] == [None, 10.0]
    sources = spark.createDataFrame([(i, "a") for i in range(4)] + [(9, "never")], "i long, src string")
    assert sa.interleave(sources, {"a": 1.0, "never": 0.0}, 1, "src", "i").count() == 4


def test_mixed_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "a int, b string")
    rows.write.json(str(tmp_path / "j"))
    rows.write.option("header", "true").csv(str(tmp_path / "c"))
    (tmp_path / "mix").mkdir()
    for file in [*(tmp_path / "j").glob("part-*.json"), *(tmp_path / "c").glob("part-*.csv")]:
        (tmp_path / "mix" / file.name).write_bytes(file.read_bytes())
    got = rd.read_any(spark, str(tmp_path / "mix"), schema="a int, b string")
    assert [tuple(r) for r in got.collect()] == [(1, "x")] * 2


def test_ids_of_repeated_keys(spark):

    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "word string, token_id int")
    docs = spark.createDataFrame([(1, "a b c"), (1, "b"), (2, None), (3, "")], "k long, t string")
    got = tk.encode(docs, vocab, "k", "t")
    assert sorted((r["k"], r["tokens"], r["n_tokens"]) for r in got.collect()) == [(1, [3, 4, 2, 1], 4), (1, [4, 1], 2), (2, [1], 1), (3, [1], 1)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # a small table is dealt out
    assert sorted((r["k"], r["text"]) for r in tk.decode(got, vocab, "k", "tokens").collect()) == [(1, "a b <unk>"), (1, "b"), (2, ""), (3, "")]


def test_encoding_by_exchange_gives_the_same(spark, monkeypatch):

    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "word string, token_id int")
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "b b")], "k long, t string")
    want = sorted((r["k"], r["tokens"]) for r in tk.encode(docs, vocab, "k", "t").collect())
    monkeypatch.setattr(tk, "BROADCAST_WORDS", 1)
    joined = tk.encode(docs, vocab, "k", "t")
    assert sorted((r["k"], r["tokens"]) for r in joined.collect()) == want
    assert sorted((r["k"], r["text"]) for r in tk.decode(joined, vocab, "k", "tokens").collect()) == [(1, "a b <unk>"), (2, ""), (3, "b b")]


def test_blank_task(spark):
    df = one(spark, doc_id=7, sentence="The cup fell because the _ was too wide .", option1="cup", option2="shelf", answer="2")
    rows = tasks.task_samples(df, "winogrande", 100).orderBy("cont_id").collect()
    assert [r["label_id"] for r in rows] == [1, 1] and [r["ctx"][-1] for r in rows] == ["cup", "shelf"]
    assert rows[0]["continuation"] == ["was", "too", "wide", "."] and rows[1]["dc_query"] == ["shelf", "was", "too", "wide"]
    assert rows[0]["query"] == "The cup fell because the cup was too wide".split() and rows[0]["cont_str_len"] == len("was too wide .")
    with pytest.raises(ValueError):
        tasks.task_rows(df, "winogrande")


def test_long_arrays_are_linear(spark):
    n = 1_000_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit(1.0)).alias("r"), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i / 1000).cast("int")).alias("m"))
    got = df.select(F.element_at(ar.discounted_returns(F.col("r"), 0.5), 1).alias("g"), F.array_max(ar.position_ids(F.col("m"))).alias("p")).first()
    assert got["g"] == pytest.approx(2.0) and got["p"] == 999
    odd = spark.createDataFrame([([1.0, None, 2.0],), ([],), (None,), ([4.0],)], "r array<double>")
    assert [r[0] for r in odd.select(ar.discounted_returns(F.col("r"), 0.5)).collect()] == [[None, None, 2.0], [], None, [4.0]]


def _request_folder(root, lines, metric="acc_raw"):
    import json

    root.mkdir()
    (root / "config.json").write_text(json.dumps({"task_config": {"primary_metric": metric} if metric else {}}))
    (root / "requests.jsonl").write_text("".join(json.dumps(line) + "\n" for line in lines))
    return str(root)


def _request(doc_id, idx, label, cont, context="c d", kind="loglikelihood"):
    return {"request_type": kind, "doc": {"q": 1}, "request": {"context": context, "continuation": cont}, "idx": idx, "label": label, "doc_id": doc_id}


def test_requests_of_several_folders_are_one_set(spark, tmp_path):
    one_ = _request_folder(tmp_path / "a", [_request(0, 0, 1, " x"), _request(0, 1, 1, " y z"), _request(900, 0, 0, " q", "")])
    two = _request_folder(tmp_path / "b", [_request(0, 0, 0, " x"), _request(0, 1, 0, " ü"), _request(1, 0, "named", " k")], None)
    assert jobs.request_metric(spark, [one_, two]) == "acc"
    alone = lambda r: F.col("context") == ""
    rows = jobs.request_samples(spark, [one_, two], "acc", 2, alone).select("doc_id", "cont_id", "label_id", "ctx_len", "cont_len", "cont_str_len", "cont_byte_len", "query")
    assert sorted(map(tuple, rows.collect())) == [
        (0, 0, 1, 2, 1, 1, 1, ["c", "d"]), (0, 1, 1, 1, 2, 3, 3, ["d", "y"]), (1, 0, 0, 2, 1, 1, 1, ["c", "d"]),
        (1, 1, 0, 2, 1, 1, 2, ["c", "d"]), (2, 0, -1, 2, 1, 1, 1, ["c", "d"]),
    ]
    loss = jobs.request_samples(spark, [one_, two], "bpb", 9, alone).select("doc_id", "cont_id", "label_id", "cont_str_len")
    assert sorted(map(tuple, loss.collect())) == [(0, 0, 0, 3), (1, 0, 0, 1), (2, 0, 0, 1)]
    model = spark.createDataFrame([(0, 0, -1.0), (0, 1, -0.5), (1, 0, -3.0), (1, 1, -2.0), (2, 0, -1.0)], "doc_id long, cont_id int, ll double")
    got = jobs.request_scores(spark, [one_, two], model, 9, unconditional=alone).first()
    assert (got["metric"], got["score"]) == ("acc", pytest.approx(1 / 3))


def test_request_folders_must_agree(spark, tmp_path):
    a = _request_folder(tmp_path / "a", [_request(0, 0, 0, " x")], "acc_raw")
    b = _request_folder(tmp_path / "b", [_request(0, 0, 0, " x", kind="generate")], "acc_per_char")
    c = _request_folder(tmp_path / "c", [], None)
    for folders in ([a, b], [c]):
        with pytest.raises(ValueError):
            jobs.request_metric(spark, folders)
    with pytest.raises(Exception, match="unsupported request type: generate"):
        jobs.request_samples(spark, [b], "acc", 9).collect()


def test_subject_prompts_with_few_examples(spark):
    kind = "doc_id long, subject string, question string, choices array<string>, answer int"
    docs = spark.createDataFrame([(0, "a_b", " q0 ", ["x", "y"], 1), (1, None, "q1", ["x", "y"], 0), (2, "none", "q2", ["x", "y"], 0)], kind)
    dev = spark.createDataFrame([(7, "a_b", "d7", ["s", "t"], 0), (3, "a_b", "d3", ["u", "v"], 1)], kind.replace("doc_id", "seq"))
    got = {(r["variant"], r["doc_id"]): r for r in tasks.subject_rows(docs, dev, [None, "inst+1", "+3"]).collect()}
    assert len(got) == 9
    assert got[None, 0]["context"] == "Question: q0\nAnswer:" and got[None, 0]["continuations"] == [" x", " y"] and got[None, 0]["label"] == 1
    head = "The following are multiple choice questions (with answers) about a b:\n\n"
    assert got["inst+1", 3]["context"] == head + "Question: d3\nAnswer: v\n\nQuestion: q0\nAnswer:"
    assert got["+3", 6]["context"] == "Question: d3\nAnswer: v\n\nQuestion: d7\nAnswer: s\n\nQuestion: q0\nAnswer:"
    assert got["+3", 8]["context"] == "Question: q2\nAnswer:"
    lettered = tasks.subject_rows(docs, dev, ["inst+1"], letters=True).filter("doc_id = 0").first()
    assert lettered["context"] == head + "d3\nA. u\nB. v\nAnswer: B\n\nq0\nA. x\nB. y\nAnswer:"
    assert lettered["continuations"] == [" A", " B"]
    with pytest.raises(ValueError):
        tasks.subject_rows(docs, dev, ["shots"])


def numbers(spark, n=2):
    return spark.range(n)


def test_custom_table_by_name(spark):
    assert rd.custom_table(spark, f"{__name__}.numbers", n=5).count() == 5
    assert rd.custom_table(spark, "numbers", module=__name__).count() == 2
    for name in ("numbers", ""):
        with pytest.raises(ValueError):
            rd.custom_table(spark, name)
