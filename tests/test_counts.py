"""Rank statistics count first: results with ties, and plans without needless rows."""

import math
import random

import pytest
from test_plans import SMALL, plan

from sievewright import queries
from sievewright.operators import ranking


def test_spearman_with_ties(spark):
    r = random.Random(3)
    rows = [(g, r.randint(0, 6), r.random() // 0.1) for g in "ab" for _ in range(300)] + [("c", 1, 0.5), ("c", 1, 0.7), ("a", None, 0.1)]
    df = spark.createDataFrame(rows, "g string, x int, y double")
    got = {x["g"]: (x["n"], x["rho"]) for x in ranking.spearman(df, "x", "y", ["g"]).collect()}
    for g in "ab":
        own = [(x, y) for h, x, y in rows if h == g and x is not None]
        rank = lambda v, vs: sum(u < v for u in vs) + (sum(u == v for u in vs) + 1) / 2
        a, b = [[rank(v, side) for v in side] for side in zip(*own, strict=True)]
        n, mean = len(own), (len(own) + 1) / 2
        cov = lambda p, q: sum((s - mean) * (t - mean) for s, t in zip(p, q, strict=True))
        assert got[g] == (n, pytest.approx(cov(a, b) / math.sqrt(cov(a, a) * cov(b, b)), abs=1e-9))
    assert got["c"] == (2, None)


def test_stability_ranks_counts_and_joins_nothing(spark):
    text = plan(queries.queries()["r29_stability"](spark, SMALL))
    assert "Join" not in text
    assert text.index("__c#") and all("__c" in part for part in text.split("\n\n") if ") Window\n" in part)
