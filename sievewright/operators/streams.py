"""Training streams, audited items and samples: coverage, groups in order, pairs of rows, pilot rates, member sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.measures import jeffreys, mixed_group, pass_at_k
from sievewright.operators.guards import GuardError


def audited_coverage(stream: DataFrame, audited: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows of a stream per group, those whose item was audited, and the distinct audited items: ``n``, ``audited``, ``items``.

    Repeated audits of an item count once; rows without a key count as not audited.
    """
    known = audited.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__hit", F.col(key))
    joined = stream.join(known, key, "left")
    return joined.groupBy(*by).agg(F.count("*").alias("n"), F.count("__hit").alias("audited"), F.count_distinct("__hit").alias("items"))


def drawn_and_audited(stream: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """Distinct items that a stream draws and that were audited: ``key``. Rows without a key are left out."""
    return stream.where(F.col(key).isNotNull()).select(key).distinct().join(audited.select(key).distinct(), key, "left_semi")


def overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that both sides have; nulls are equal to each other, as in a set of rows."""
    return left.select(*on).intersect(right.select(*on))


def without_overlap(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left side, or an error if it shares a key with the right one."""
    if overlap(left, right, on).limit(1).count():
        raise GuardError(f"both sides have some of {on}")
    return left


def grouped_in_order(rows: DataFrame, by: list[str], order: str, value: str, first: int) -> DataFrame:
    """Groups with their sizes and the values of their ``first`` rows in order: ``n``, ``first_rows``.

    Only the first rows of a group are gathered: each task keeps its own ``first`` ones, and these are merged.
    """
    task = rows.withColumn("__task", F.spark_partition_id())
    kept = task.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__task").orderBy(order))).where(F.col("__r") <= first)
    heads = kept.groupBy(*by).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("__v")))), 1, first), lambda x: x["__v"]).alias("first_rows"))
    same = F.lit(True)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"__{c}") for c in by], "n")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return heads.join(counts, same).drop(*[f"__{c}" for c in by])


def uneven_pairs(stream: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Consecutive even and odd rows that do not agree in a value: ``pair``, ``n``, ``values``. Nulls do not disagree."""
    each = stream.groupBy(F.floor(F.col(ordinal) / 2).alias("pair")).agg(F.count("*").alias("n"), F.count_distinct(value).alias("values"))
    return each.where("values > 1")


def pilot_rates(bits: Column, group: int = 5) -> dict[str, Column]:
    """Rates of sampled responses of an item: counts, raw and Jeffreys rate, chance of a mixed group, pass rates, variance.

    ``bits``: array of booleans. The chance of a mixed group and the variance are those of the Jeffreys rate. All are null
    for a null array; an empty one has no rates.
    """
    n, c = F.size(bits), F.size(F.filter(bits, lambda x: x))
    p = jeffreys(c, n)
    return {
        "sample_count": F.when(n > 0, n),
        "sample_correct_count": F.when(n > 0, c),
        "p_sample": F.when(n > 0, c / n),
        "p_i_jeffreys": F.when(n > 0, p),
        "q_i": F.when(n > 0, mixed_group(p, group)),
        "pass_at_g": F.when(n >= group, pass_at_k(n, c, group)),
        "pass_at_all": F.when(n > 0, (c > 0).cast("double")),
        "variance_proxy": F.when(n > 0, p * (1 - p)),
    }


def sample_statistics(sample: DataFrame, by: str, distinct: str, sized: str) -> DataFrame:
    """Statistics of a sample per group: ``n``, distinct values of a column, elements of an array column. Null arrays have none."""
    return sample.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"), F.sum(F.greatest(F.size(sized), F.lit(0)).cast("long")).alias("n_elements"))


def attack_members(pairs: DataFrame, key: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """Pairs whose first member is decided by the digest of their key: the columns, ``swapped``, ``first_answer``, ``second_answer``.

    Half of the keys are swapped, the same ones on every run. Pairs without a key are left out.
    """
    placed = pairs.where(F.col(key).isNotNull()).withColumn("swapped", F.md5(key) < "8")
    return placed.select(*columns, "swapped", F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first)).alias("first_answer"), F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)).alias("second_answer"))


def runtime_valid(generator: Column, seed: Column, n_points: Column) -> Column:
    """Whether the metadata of a run are complete: a generator, a seed that is not negative, at least one point."""
    return F.coalesce(generator.isNotNull() & (seed >= 0) & (n_points > 0), F.lit(False))
