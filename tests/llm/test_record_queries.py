"""Every query of the subpackage with SQL gives the rows of its SQL on the small tables."""

import pytest
from compare_rows import rows_of

from sievewright.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_sample_does_not_shuffle(spark):
    text = plan(queries.queries()["p2_sample"](spark, SMALL))
    assert "Exchange" not in text and "Python" not in text


def test_no_python_in_the_plan(spark):
    assert not any(x in plan(queries.queries()["p3_report"](spark, SMALL)) for x in ("ArrowEval", "BatchEvalPython", "MapInPandas", "FlatMapGroups"))


@pytest.mark.parametrize("name", ["p3_classes", "p4_split"])
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
