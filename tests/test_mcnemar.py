"""The exact McNemar test at small and at large counts."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sievewright.operators import compare


def test_mcnemar_of_large_counts(spark):
    counts = [(0, 0), (0, 9), (5, 5), (3, 14), (16, 40), (950, 1_040), (149_700, 150_300), (1_000_000, 1_000_000)]
    got = [r["p"] for r in spark.createDataFrame(counts, "a long, b long").select(compare.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()]
    for (a, b), p in zip(counts[:6], got, strict=False):
        n, k = a + b, min(a, b)
        assert p == pytest.approx(float(min(1, Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))), rel=1e-10)
    assert got[6] == pytest.approx(math.erfc(599 / math.sqrt(300_000) / math.sqrt(2)), rel=1e-4)  # normal, with continuity correction
    assert got[7] == 1.0
