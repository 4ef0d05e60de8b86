"""The pipeline's stages against plain versions of the same decisions, each on its own input."""

import corpus_pipeline as P
import public_tokenizers
from test_decontaminate import plain as plain_hits
from test_line_dedup import one_by_one
from test_packing import check as check_packing
from test_simhash_pivots import plain_print, plain_sets

import __spark_entry__ as contract
from tallyloom.llm import line_dedup, packing, quality
from tallyloom.plans.scratch import materialize


def test_registered():
    assert [name for name, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = materialize(stage(spark, docs, sf_dir), name)
        rows = after.collect()
        if name == "packing":
            check_packing(rows, [(r.doc_id, r.text) for r in before.values()], 2048)
            break
        assert after.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in quality.quality_scores(docs, quality.train(docs, labels), threshold=0.5).collect() if r.predicted}
            assert {r.doc_id for r in rows} == kept
            label = {r.doc_id: r.quality for r in labels.collect()}
            good = [i for i in before if label.get(i) == 1]
            assert sum(i in kept for i in good) >= 0.97 * len(good)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in rows} == one_by_one([(i, r.text) for i, r in before.items()], 24)
            assert all(r.n_chars == (len(r.text) if r.text != before[r.doc_id].text else before[r.doc_id].n_chars) for r in rows)
        elif name == "near_duplicates":
            prints = {i: plain_print(r.text) for i, r in before.items()}
            label, least = plain_sets(list(prints.values())), {}
            for i in sorted(prints):
                least.setdefault(label[prints[i]], i)
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            hits = plain_hits([(i, r.text) for i, r in before.items()], items)
            assert sorted(r.doc_id for r in rows) == sorted(h[0] for h in hits if not (h[2] > 0 and 20 * h[2] >= h[1]))
        docs = after


def test_odd_documents(spark, odd_docs, sf_dir):
    docs = odd_docs
    for _, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), "odd")
        assert after.columns == odd_docs.columns
        docs = after
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    empty = odd_docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def sent_to_all(df):
    """What the plan broadcasts, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            at = line.index("BroadcastExchange")
            below = lines[i + 1 :]
            end = next((k for k, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*(0123456789)")) < at), len(below))
            out.append("\n".join(below[:end]))
    return out


def test_what_grows_is_not_broadcast(spark, odd_docs, monkeypatch):
    """Spark sizes rows below an explode like those above, and a compressed table by its file; both were broadcast if that was little."""
    plans = {}

    def kept(df, name):
        plans[name] = sent_to_all(df)
        return materialize(df, name)

    monkeypatch.setattr(line_dedup, "materialize", kept)
    line_dedup.without_repeated_lines(odd_docs)
    assert {"wanted", "went"} <= plans.keys()
    assert not any("Generate" in x for found in plans.values() for x in found)
    assert sent_to_all(packing.pack(odd_docs, public_tokenizers.path("byte_bpe_50k.json"))) == []
