"""Operators against plain Python on small random inputs."""

import math
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import arrays as ar
from tallyloom.functions import text as tx
from tallyloom.functions.common import running_starts
from tallyloom.operators import metrics as mt
from tallyloom.operators import overlap as ov
from tallyloom.operators import sampling as sa
from tallyloom.operators import windows as wi
from tallyloom.plans import bloom, skew
from tallyloom.sources import readers as rd
from tallyloom.plans.ordering import first_rows, identity, range_running_sums, running_sum, with_hash_position, with_position


def random_arrays(count, top, seed):
    rng = random.Random(seed)
    return [[rng.randint(1, 2) if rng.random() < 0.8 else rng.randint(1, 4) for _ in range(rng.randint(0, top))] for _ in range(count)]


def runs_by_definition(x, longest):
    """Blocks of p tokens equal to the block before, widened token by token."""
    found = []
    for p in range(1, min(longest, len(x) // 3) + 1):
        seen = set()
        for k in range(1, len(x) // p):
            if x[k * p : (k + 1) * p] == x[(k - 1) * p : k * p]:
                start, end = k * p, (k + 1) * p
                while start - 1 >= p and x[start - 1] == x[start - 1 - p]:
                    start -= 1
                while end < len(x) and x[end] == x[end - p]:
                    end += 1
                seen.add((start - p, end))
        found += [(s, e, p, (e - s) // p) for s, e in seen if (e - s) // p > 2]
    return sorted(found)


def test_periodic_runs(spark):
    arrays = random_arrays(120, 40, 1) + [[7] * 30, [1, 2, 3] * 9, []]
    df = spark.createDataFrame(list(enumerate(arrays)), "id int, x array<int>")
    for r in df.select("id", ar.periodic_runs(F.col("x"), 5).alias("r")).collect():
        assert sorted(tuple(z) for z in r["r"]) == runs_by_definition(arrays[r["id"]], 5), arrays[r["id"]]


def windows_by_definition(tokens, top, context):
    out, done, step = [], min(top, len(tokens)), top - context + 1
    if tokens:
        out.append(([0] + tokens[: done - 1], tokens[:done]))
    while done < len(tokens):
        n = min(len(tokens) - done, step)
        end = done + n
        out.append((tokens[end - top - 1 : end - 1], tokens[done:end]))
        done = end
    return out


@pytest.mark.parametrize("top, context", [(4, 1), (4, 2), (5, 5), (64, 16)])
def test_rolling_windows(spark, top, context):
    arrays = [list(range(1, n + 1)) for n in (0, 1, 3, 4, 5, 9, 17, 130)]
    df = spark.createDataFrame(list(enumerate(arrays)), "id int, x array<int>")
    for r in df.select("id", ar.rolling_windows(F.col("x"), top, context, 0).alias("w")).collect():
        got = [(list(w["input"]), list(w["pred"])) for w in (r["w"] or [])]
        assert got == windows_by_definition(arrays[r["id"]], top, context)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_longest_common_subsequence(spark):
    left, right = random_arrays(60, 25, 2), random_arrays(60, 25, 3)
    rows = [(i, [str(x) for x in a], [str(x) for x in b]) for i, (a, b) in enumerate(zip(left, right))]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    for r in df.select("id", ov.lcs_length("a", "b").alias("n")).collect():
        assert r["n"] == lcs(left[r["id"]], right[r["id"]])


def test_rouge_l_and_contrast(spark):
    df = spark.createDataFrame(
        [(1, "the cat sat", "the cat sat down", True), (1, "the cat sat", "a dog", False)], "id int, p string, r string, ok boolean"
    )
    scored = {r["ok"]: r["rougeL"] for r in ov.rouge_l(df, "p", "r").collect()}
    assert scored[True] == pytest.approx(100 * 6 / 7) and scored[False] == 0
    best = ov.ref_contrast(ov.rouge_l(df, "p", "r"), "id", "ok", ["rougeL"]).first()
    assert best["rougeL_acc"] == 1 and best["rougeL_diff"] == best["rougeL_max"]


def test_bleu_with_smoothing(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b x d e")], "id int, h string, r string")
    precisions = [4 / 5, 2 / 4, 1 / (2 * 3), 1 / (4 * 2)]
    want = 100 * math.exp(sum(math.log(p) for p in precisions) / 4)
    assert ov.corpus_bleu(df, "h", "r").first()["bleu"] == pytest.approx(want)


def test_running_sum_over_blocks(spark):
    rng = random.Random(4)
    rows = [(g, o, rng.randint(0, 9)) for g in "ab" for o in sorted(rng.sample(range(5000), 300))]
    df = spark.createDataFrame(rows, "g string, o bigint, v int")
    got = {(r["g"], r["o"]): r["s"] for r in running_sum(df, "v", "o", ["g"], "s", block=16).collect()}
    at = {}
    for g, o, v in rows:
        assert got[(g, o)] == at.get(g, 0)
        at[g] = at.get(g, 0) + v
    overall = with_position(df.filter("g = 'a'"), "o", out="p", block=16)
    assert [r["p"] for r in overall.orderBy("o").collect()] == list(range(300))


def test_hash_positions_are_dense_per_group(spark):
    df = spark.range(3000).withColumn("g", F.col("id") % 3)
    placed = with_hash_position(df, "s", ["id"], ["g"], digits=1)
    sizes = placed.groupBy("g").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.countDistinct("pos").alias("n")).collect()
    assert [(r["a"], r["b"], r["n"]) for r in sizes] == [(0, 999, 1000)] * 3


def test_range_running_sums(spark):
    rng = random.Random(5)
    rows = sorted({round(rng.random() ** 4, 3) for _ in range(500)})
    df = spark.createDataFrame([(x, i % 5) for i, x in enumerate(rows)], "k double, v int")
    total = 0
    for r in sorted(range_running_sums(df, ["v"], "k", buckets=7).collect(), key=lambda r: r["k"]):
        total += r["v"]
        assert r["v_run"] == total


def test_rolling_window_across_blocks(spark):
    df = spark.range(100).select("id", (F.col("id") * 7 % 13).alias("t"), F.lit(1.0).alias("s"))
    got = {r["id"]: r["x"] for r in wi.rolling_throughput(df, 5, "id", "t", "s", "x", block=8).collect()}
    assert len(got) == 100
    for i in range(100):
        last = [j * 7 % 13 for j in range(max(0, i - 4), i + 1)]
        assert got[i] == pytest.approx(sum(last) / len(last))


def test_interleave_like_a_sequential_reader(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, src string")
    sizes = {"a": [i for i, s in rows if s == "a"], "b": [i for i, s in rows if s == "b"]}
    for stop in ("first", "all"):
        got = [(r["src"], r["id"]) for r in sa.interleave(df, {"a": 0.5, "b": 0.5}, 1, "src", "id", stop).orderBy("pos").collect()]
        seen, through = {"a": 0, "b": 0}, set()
        for i, (src, ident) in enumerate(got):
            assert ident == sizes[src][seen[src] % len(sizes[src])]
            seen[src] += 1
            if seen[src] >= len(sizes[src]):
                through.add(src)
            done = through and (stop == "first" or len(through) == 2)
            assert bool(done) == (i == len(got) - 1)


def test_median_of_even_and_odd_counts(spark):
    for values in ([5.0, 1.0, 3.0], [4.0, 1.0, 3.0, 2.0], [2.0, 2.0, 9.0, 9.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values)
        want = (ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2
        assert mt.median(df, "v").first()["median"] == want


def test_bootstrap_error_is_near_the_closed_form(spark):
    df = spark.createDataFrame([(int(i % 4 == 0),) for i in range(400)], "x int")
    got = mt.bootstrap_stderr(df, ["x"], F.avg("x"), 300, 1).first()
    assert got["stderr"] == pytest.approx(math.sqrt(0.25 * 0.75 / 400), rel=0.15)
    assert got["mean"] == pytest.approx(0.25, abs=0.005)


def test_majority_ties_and_missing_answers(spark):
    df = spark.createDataFrame(
        [(1, 0, "x", "x"), (1, 1, "y", "x"), (2, 0, None, "x"), (3, 0, "y", "x"), (3, 1, "x", "x"), (3, 2, "x", "x")],
        "doc_id int, idx int, answer string, gold string",
    )
    got = {r["doc_id"]: r["maj_acc"] for r in mt.majority_at_n(df).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}


def test_word_spans_rebuild_the_text(spark):
    texts = ["  a bb\n\nccc ", "", " ", "x", "ä öö  ü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.word_spans("t").alias("s")).collect():
        assert [r["t"][s["start"] : s["end"] + 1] for s in r["s"]] == r["t"].split()


@pytest.fixture
def small_partitions(spark):
    """Adaptive execution at its default rules, but for tables of this size, and no broadcasts."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.shuffle.partitions": "12",
    }
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_table(spark):
    return spark.range(40_000).repartition(8).select("id", F.when(F.col("id") % 3 > 0, 1).when(F.col("id") % 30 == 0, None).otherwise(F.col("id") % 50).alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_splits_a_hot_key(small_partitions, how):
    left = hot_table(small_partitions)
    right = small_partitions.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.skew_join(left, right, ["k"], how)
    rows = {r["id"]: r["k"] for r in left.collect()}
    want = {i for i, k in rows.items() if how == "left" or (k is not None and k < 40) == (how != "left_anti")}
    assert sorted(r["id"] for r in got.collect()) == sorted(want)
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_group_stats_keep_null_and_hot_groups(small_partitions):
    df = hot_table(small_partitions)
    jobs = small_partitions.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup())
    got = skew.with_group_stats(df, ["k"], n=F.count(F.lit(1)))
    assert len(jobs.getJobIdsForGroup()) == before  # nothing runs before the action
    rows = got.collect()
    sizes = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert len(rows) == 40_000 and None in sizes and all(r["n"] == sizes[r["k"]] for r in rows)
    assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()


def test_large_samples_are_cut_by_position(spark, monkeypatch):
    df = spark.range(500)
    small = sorted(r["id"] for r in sa.sample_n(df, 40, "s", ["id"]).collect())
    latest = sorted(r["id"] for r in sa.keep_latest(df, 40, "id").collect())
    monkeypatch.setattr(sa, "TOP_ROWS", 10)
    assert sorted(r["id"] for r in sa.sample_n(df, 40, "s", ["id"]).collect()) == small
    assert sorted(r["id"] for r in sa.keep_latest(df, 40, "id").collect()) == latest == list(range(460, 500))


def test_first_rows_with_a_hot_value(spark):
    rng = random.Random(6)
    rows = [(i, 5 if rng.random() < 0.7 else rng.randrange(1000)) for i in range(3000)] + [(3000 + i, None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    for n in (0, 1, 17, 1500, 3019, 3020, 5000):
        got = first_rows(df, n, [F.col("v").desc_nulls_first()], ["id"]).collect()
        assert sorted(tuple(r) for r in got) == sorted(want[:n])
    assert first_rows(df.limit(0), 3, ["v", "id"]).count() == 0


def test_running_sums_and_median_of_a_hot_value(spark):
    rng = random.Random(8)
    values = [3.5] * 700 + [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in values], "v double").repartition(6)
    ordered = sorted(values)
    assert mt.median(df, "v").first()[0] == (ordered[649] + ordered[650]) / 2


def test_identity_tells_tuples_apart(spark):
    fields = [None, "", "-", "1:a", "a", "ab", "b", "a\x01b"]
    rows = [(a, b, c) for a in fields for b in fields for c in fields]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert df.select(identity("a", "b", "c")).distinct().count() == len(rows)


def test_requests_with_nulls_stay_apart(spark):
    df = spark.createDataFrame([(0, "x", None), (1, None, "x"), (2, "x", None), (3, None, None), (4, "x\x01y", None), (5, "x", "y")], "row int, a string, b string")
    requests, owners = sa.dedup_requests(df, ["a", "b"], F.length(F.coalesce("a", "b")), "row")
    by_pos = {r["request_pos"]: (r["a"], r["b"]) for r in requests.collect()}
    assert sorted(by_pos) == list(range(5)) and by_pos[0] == ("x\x01y", None) and by_pos[4] == (None, None)
    assert {r["row"]: by_pos[r["request_pos"]] for r in owners.collect()} == {0: ("x", None), 1: (None, "x"), 2: ("x", None), 3: (None, None), 4: ("x\x01y", None), 5: ("x", "y")}


def test_prefixes_are_pruned(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), "".join(rng.choice("abé") for _ in range(rng.randint(0, 6)))) for _ in range(300)] + [(1, None), (2, None)]
    df = spark.createDataFrame(rows, "d int, a string").repartition(4)
    distinct = set(rows)
    want = {(d, a) for d, a in distinct if d is None or a is None or not any(e == d and b and b != a and a.startswith(b) for e, b in distinct if b is not None)}
    got = [tuple(r) for r in mt.prune_prefixes(df, "d", "a").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 3000, 7).selectExpr("'k' || id AS key").union(spark.createDataFrame([(None,)], "key string"))
    rows = spark.range(3000).selectExpr("id", "'k' || id AS value").repartition(3)
    for cells in (64, 1 << 10, 1 << 20):
        got = {r["id"] for r in bloom.maybe_in(rows, "value", keys, "key", cells).collect()}
        assert got >= set(range(0, 3000, 7))
        assert bloom.filter_words(keys, "key", 0, cells).count() <= cells // 64
    assert len(got) < 440  # 429 keys
    plan = bloom.maybe_in(rows, "value", keys, "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == bloom.PROBES
    assert bloom.maybe_in(rows, "value", keys.limit(0), "key").count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 300_000])
def test_running_starts(spark, n):
    lengths = [(7 * i) % 10 for i in range(n)]
    got = spark.createDataFrame([(lengths,)], "x array<int>").select(running_starts(F.col("x"))).first()[0]
    assert got == [0, *accumulate(lengths)][:n]


def test_long_common_subsequence_crosses_blocks(monkeypatch):
    rng = random.Random(8)
    for block in (1, 3, 64):
        monkeypatch.setattr(ov, "LCS_BLOCK", block)
        for _ in range(60):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
            assert ov._lcs_length(a, b) == lcs(a, b)


def test_line_numbers_do_not_depend_on_the_splits_of_a_later_scan(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(reversed(lines)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        df = rd.read_lines(spark, str(tmp_path), number=True)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "31000")
        got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["value"] for r in df.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {("a.txt", i): x for i, x in enumerate(lines)} | {("b.txt", i): x for i, x in enumerate(reversed(lines))}
