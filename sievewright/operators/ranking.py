"""Ranks, bins and rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean, within groups."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Spearman correlation with tied ranks per group; null where a side is constant.

    Equal pairs of values are counted first, so windows run over distinct pairs.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    counted = pairs.groupBy(*by, "__x", "__y").agg(F.count("*").alias("__c"))
    whole = Window.partitionBy(*by)

    def centred(v: str) -> Column:
        ties = F.sum("__c").over(Window.partitionBy(*by, v))
        return F.sum("__c").over(whole.orderBy(v)) - (ties - 1) / 2 - (F.sum("__c").over(whole) + 1) / 2

    ranked = counted.select(*by, "__c", centred("__x").alias("rx"), centred("__y").alias("ry"))
    total = lambda a, b: F.sum(F.col("__c") * F.col(a) * F.col(b))
    spread = F.sqrt(total("rx", "rx")) * F.sqrt(total("ry", "ry"))
    return ranked.groupBy(*by).agg(F.sum("__c").alias("n"), F.round(F.try_divide(total("rx", "ry"), spread), 9).alias("rho"))


def auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve from average ranks per group; null where a class is empty."""
    ranked = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(label).cast("int").alias("y"), average_rank(score, by).alias("r"))
    pos, neg = F.sum("y"), F.sum(1 - F.col("y"))
    value = (F.sum(F.col("r") * F.col("y")) - pos * (pos + 1) / 2) / (pos * neg)
    return ranked.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when((pos > 0) & (neg > 0), F.round(value, 9)).alias("auc"))


def ks_statistic(df: DataFrame, value: str, label: str, by: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group. Values are counted first, so windows run over distinct values."""
    counted = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by, value).agg(F.sum(F.col(label).cast("int")).alias("a"), F.sum(1 - F.col(label).cast("int")).alias("b"))
    w, whole = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    gap = F.abs(F.try_divide(F.sum("a").over(w), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(w), F.sum("b").over(whole)))
    return counted.select(*by, "a", "b", gap.alias("gap")).groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.round(F.max("gap"), 9).alias("d"))


def floor_and_deciles(df: DataFrame, count: str, q: str, gain: str, tie: str) -> DataFrame:
    """Mean gain of rows without success (group 0) and of ten near-equal groups of the others by ``q`` (1 to 10)."""
    w = Window.partitionBy("above").orderBy(q, tie)
    placed = df.withColumn("above", (F.col(count) > 0).cast("int")).withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("above")))
    group = F.when(F.col("above") == 0, 0).otherwise(F.ceil(F.lit(10) * F.col("i") / F.col("m")).cast("int"))
    return placed.groupBy(group.alias("decile")).agg(F.count("*").alias("n"), F.round(F.min(q), 9).alias("q_min"), F.round(F.max(q), 9).alias("q_max"), F.round(F.avg(gain), 9).alias("mean_gain"))


def quartile_edge(df: DataFrame, value: str, key: str, by: list[str], top: bool = True) -> DataFrame:
    """First quarter (rounded up) of every group by value, ties by key: the rows with ``position`` and ``m``."""
    order = [F.col(value).desc() if top else F.col(value).asc(), F.col(key).cast("string")]
    placed = df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("m", F.ceil(F.count("*").over(Window.partitionBy(*by)) / 4))
    return placed.where("position <= m")


def expected_retrieval(df: DataFrame, value: str, relevant: str, by: list[str]) -> DataFrame:
    """Expected share of the top quarter that is relevant when ties at its border are broken at random; tie mass of the border.

    Per distinct value: rows above it count in full, rows at the border by the share of places left.
    """
    per = df.groupBy(*by, value).agg(F.count("*").alias("k"), F.sum(F.col(relevant).cast("int")).alias("hits"))
    whole = Window.partitionBy(*by)
    before = Window.partitionBy(*by).orderBy(F.col(value).desc())
    placed = per.withColumn("n", F.sum("k").over(whole)).withColumn("upto", F.sum("k").over(before)).withColumn("m", F.ceil(F.col("n") / 4))
    room = F.greatest(F.lit(0), F.least(F.col("k"), F.col("m") - (F.col("upto") - F.col("k"))))
    border = (F.col("upto") >= F.col("m")) & (F.col("upto") - F.col("k") < F.col("m"))
    return placed.withColumn("room", room).groupBy(*by).agg(F.max("m").alias("m"), F.round(F.sum(F.col("room") / F.col("k") * F.col("hits")) / F.max("m"), 9).alias("retrieval"), F.round(F.max(F.when(border, F.col("k") / F.col("n"))), 9).alias("tie_mass"))


def histogram01(value: Column, bins: int = 10) -> Column:
    """Bin of a value in [0, 1] out of equal bins, the last one closed: 1 to ``bins``."""
    return F.least(F.floor(value * bins) + 1, F.lit(bins))


def decile_band(value: Column) -> Column:
    """Band 0 to 9 of a value in [0, 1]."""
    return F.least(F.floor(value * 10), F.lit(9))


def common_support(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """Share of each group's rows that lie in strata that all groups have: ``group``, ``n``, ``n_common``, ``share``."""
    groups = df.select(group).distinct().agg(F.count("*").alias("g"))
    cells = df.groupBy(group, stratum).agg(F.count("*").alias("k"))
    common = cells.groupBy(stratum).agg(F.count("*").alias("has")).crossJoin(F.broadcast(groups)).where("has = g").select(stratum, F.lit(1).alias("c"))
    return cells.join(common, stratum, "left").groupBy(group).agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.col("k") * F.col("c")), F.lit(0)).alias("n_common"), F.round(F.coalesce(F.sum(F.col("k") * F.col("c")), F.lit(0)) / F.sum("k"), 9).alias("share"))


def standardized(df: DataFrame, group: str, stratum: str, value: str) -> DataFrame:
    """Mean of each group with the pooled weights of the strata that all groups have."""
    cells = df.groupBy(group, stratum).agg(F.count("*").alias("k"), F.avg(value).alias("m"))
    n_groups = df.select(group).distinct().agg(F.count("*").alias("g"))
    pooled = cells.groupBy(stratum).agg(F.sum("k").alias("w"), F.count("*").alias("has")).crossJoin(F.broadcast(n_groups)).where("has = g")
    return cells.join(pooled, stratum).groupBy(group).agg(F.round(F.sum(F.col("m") * F.col("w")) / F.sum("w"), 9).alias("standardized"), F.sum("k").alias("n"))


def lattice(value: Column, step: float) -> Column:
    """Nearest multiple of a step, halves to even."""
    return F.bround(value / step) * step


def natural_order(key: Column) -> list[Column]:
    """Sort order: whole numbers first by value, then texts."""
    number = key.rlike(r"\A\d+\z")
    return [F.when(number, 0).otherwise(1), F.when(number, key.try_cast("decimal(38,0)")), key]


def extremum_gap(points: DataFrame, by: list[str], axis: str, label: str) -> DataFrame:
    """Largest point of each group on an axis and its distance to the next: ties go to the first label."""
    w = Window.partitionBy(*by).orderBy(F.col(axis).desc(), label)
    placed = points.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return placed.groupBy(*by).agg(F.max(F.when(F.col("r") == 1, F.col(label))).alias("target"), (F.max(F.when(F.col("r") == 1, F.col(axis))) - F.max(F.when(F.col("r") == 2, F.col(axis)))).alias("margin"))


def boundary_shares(values: DataFrame, group: str, max_share: float) -> DataFrame:
    """Most frequent value of each group and whether it stays within a share (at least one row is always allowed)."""
    counted = values.groupBy(group, "value").agg(F.count("*").alias("k"))
    return counted.groupBy(group).agg(F.sum("k").alias("n"), F.max("k").alias("most")).withColumn("within", F.col("most") <= F.greatest(F.lit(1.0), F.col("n") * max_share))
