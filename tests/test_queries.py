"""Every registered query against its SQL on the smallest tables, and independence from the partitioning."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect
from tallyloom.queries import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = con.execute(sql)
    assert compare(df.columns, rows, [c[0] for c in result.description], result.fetchall()) == ""


class Repartitioned(registry.Tables):
    """The same tables in another number of partitions."""

    def __init__(self, spark, sf_dir, parts):
        super().__init__(spark, sf_dir)
        self.parts = parts

    def __getattr__(self, name):
        return super().__getattr__(name).repartition(self.parts)


ORDER_SENSITIVE = [
    "a3_majority_at_n", "a4_mc_accuracy", "a24_bootstrap_stderr", "a35_qa_report", "c2_decontaminate_text", "c5_training_set",
    "c6_epoch_plan", "j3_compare_runs_multi", "j6_fewshot_join", "s17_lines_to_pages", "t1_shuffle", "t9_mix", "t10_token_budget",
    "t11_interleave_first", "t16_dedup_requests", "w11_best_of_n", "w12_best_worst", "w14_mismatched_pairs", "w18_rolling_throughput",
    "x1_build_vocabulary", "x1_encode",
]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_partitioning_does_not_matter(spark, con, name):
    build, sql = registry.QUERIES[name].build, registry.ORACLES[name]
    result = con.execute(sql)
    columns, want = [c[0] for c in result.description], result.fetchall()
    for parts in (1, 4, 16):
        df = build(Repartitioned(spark, SF_DIR, parts))
        assert compare(df.columns, [tuple(r) for r in df.collect()], columns, want) == "", parts
