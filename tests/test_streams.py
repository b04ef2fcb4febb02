"""Operators over streams and samples: nulls, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators import streams
from sievewright.operators.guards import GuardError


def test_coverage_and_overlap(spark):
    stream = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", None), ("y", "b"), ("y", "z")], "arm string, k string")
    audited = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    got = {r["arm"]: (r["n"], r["audited"], r["items"]) for r in streams.audited_coverage(stream, audited, "k", ["arm"]).collect()}
    assert got == {"x": (3, 2, 1), "y": (2, 1, 1)}
    assert sorted(r[0] for r in streams.drawn_and_audited(stream, audited, "k").collect()) == ["a", "b"]
    assert streams.audited_coverage(stream.limit(0), audited, "k", ["arm"]).count() == 0
    assert streams.overlap(stream, audited, ["k"]).count() == 3
    with pytest.raises(GuardError):
        streams.without_overlap(stream, audited, ["k"])
    assert streams.without_overlap(stream, audited.limit(0), ["k"]) is stream


def test_groups_in_order_and_pairs(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "g", f"v{i}") for i in range(20)], "ordinal long, g string, v string").withColumn("n", F.lit(1)).repartition(5)
    got = {r["g"]: (r["n"], r["first_rows"]) for r in streams.grouped_in_order(rows, ["g"], "ordinal", "v", 2).collect()}
    assert got == {None: (7, ["v0", "v3"]), "g": (13, ["v1", "v2"])}
    pairs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"), (6, "d")], "ordinal long, v string")
    assert [tuple(r) for r in streams.uneven_pairs(pairs, "ordinal", "v").collect()] == [(1, 2, 2)]


def test_pilot_rates(spark):
    rows = spark.createDataFrame([(1, [True] + [False] * 15), (2, []), (3, None), (4, [True] * 3)], "id int, bits array<boolean>")
    got = {r["id"]: r for r in rows.select("id", *[c.alias(n) for n, c in streams.pilot_rates(F.col("bits")).items()]).collect()}
    p = 1.5 / 17
    assert abs(got[1]["q_i"] - (1 - p**5 - (1 - p) ** 5)) < 1e-12 and abs(got[1]["pass_at_g"] - 5 / 16) < 1e-12 and got[1]["pass_at_all"] == 1
    assert got[2]["p_sample"] is None and got[3]["p_sample"] is None and got[4]["pass_at_g"] is None and got[4]["p_sample"] == 1
