"""Leak attacks on pairs: can a side be told from features that should not tell it?"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators.resampling import grouped_folds, interval, rank_auc, ridge_scores


def member_table(pairs: DataFrame, key: str, features: dict[str, tuple]) -> DataFrame:
    """Two rows a pair with label 0 for side a and 1 for side b, and one column a feature: name -> (column of a, of b)."""
    sides = [F.struct(F.lit(i).alias("label"), *[ab[i].cast("double").alias(n) for n, ab in features.items()]) for i in (0, 1)]
    return pairs.select(key, F.explode(F.array(*sides)).alias("m")).select(key, "m.*")


def feature_auc(table: DataFrame, features: list[str]) -> DataFrame:
    """Area under the curve of every feature by itself: one pass over the unpivoted table."""
    from sievewright.operators.ranking import auc

    long = table.select("label", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x")).select("label", "x.*")
    return auc(long, "v", "label", ["feature"])


def discriminant(table: DataFrame, key: str, features: list[str], folds: int = 5, seed: int = 0, draws: int = 200, scope: str | None = None) -> DataFrame:
    """Out-of-fold area of a ridge discriminant with a bootstrap over pairs, per scope of any size.

    Both members of a pair lie in one fold. Returns scope, n_pairs, auc, folded (at least one half), ci_low, ci_high.
    """
    name = scope or "__all"
    lean = table.select(*([scope] if scope else [F.lit("all").alias(name)]), key, "label", *features).na.drop()

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "label"], kind="stable")
        fold = grouped_folds(pdf[key].tolist(), folds, seed)
        y = pdf["label"].to_numpy()
        score = ridge_scores(pdf[features].to_numpy(np.float64), y, pdf[key].map(fold).to_numpy())
        whole = rank_auc(score, y)
        start, size = np.unique(pdf[key].to_numpy(), return_index=True, return_counts=True)[1:]
        rng, found = np.random.default_rng(seed), []
        for _ in range(draws):
            pick = rng.integers(0, len(start), len(start))
            ends = np.cumsum(size[pick])
            at = np.repeat(start[pick] - ends + size[pick], size[pick]) + np.arange(ends[-1])
            v = rank_auc(score[at], y[at])
            found.append(max(v, 1 - v))
        low, high = interval(np.array(found)) if found else (None, None)
        return pd.DataFrame([{"scope": str(group[0]), "n_pairs": len(start), "auc": whole, "folded": max(whole, 1 - whole), "ci_low": low, "ci_high": high}])

    return lean.groupBy(name).applyInPandas(run, "scope string, n_pairs long, auc double, folded double, ci_low double, ci_high double")
