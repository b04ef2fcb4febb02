"""Plans are what they are meant to be, and results do not depend on partitioning."""

import pytest
from compare_rows import rows_of

from sievewright import queries

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name,column", [("f01_select", "source"), ("f05_roles", "role"), ("j18_layers", "layer")])
def test_filters_reach_the_scan(spark, name, column):
    text = plan(queries.queries()[name](spark, SMALL))
    assert any("PushedFilters" in line and f"({column}" in line for line in text.split("\n"))


@pytest.mark.parametrize("name", ["x11_tiers", "x13_pair_score", "j13_hamming", "j14_jaccard", "w05_expected_retrieval", "r13_mcnemar"])
def test_no_python_in_the_plan(spark, name):
    text = plan(queries.queries()[name](spark, SMALL))
    assert not any(x in text for x in ("ArrowEval", "BatchEvalPython", "MapInPandas", "FlatMapGroups"))


@pytest.mark.parametrize("name", ["decon_edges", "j01_align", "w03_deciles", "r01_bootstrap", "d02_stratified", "r28_schedule", "v02_scene_rules"])
def test_partitions_do_not_matter(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = queries.queries()[name](spark, SMALL)
            found.append(rows_of(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
