"""Joins and rates of paired runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.guards import full_coverage, unique

Z95 = 1.959963984540054


def last_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The row of the highest ordinal per key; a null ordinal counts as the lowest."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ordinal), *[F.col(c) for c in rest if c != ordinal])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The row of the lowest ordinal per key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(ordinal).isNull(), F.col(ordinal), *[F.col(c) for c in rest if c != ordinal])).alias("__r")).select(*keys, "__r.*").select(*df.columns)


def align(left: DataFrame, right: DataFrame, key: str, flag: str, ordinal: str = "ordinal") -> DataFrame:
    """Shared ids of two runs with both flags: ``key``, ``left``, ``right``. The last row of an id wins."""
    a = last_wins(left.select(key, ordinal, flag), [key], ordinal).select(key, F.col(flag).alias("left"))
    b = last_wins(right.select(key, ordinal, flag), [key], ordinal).select(key, F.col(flag).alias("right"))
    return a.join(b, key)


def strict_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one join that raises on repeated or one-sided keys. Other columns get the prefixes ``l_`` and ``r_``."""
    unique(left, keys), unique(right, keys)
    full_coverage(left, right, keys)
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    return a.join(b, keys)


def choose_key(left: DataFrame, right: DataFrame, candidates: list[list[str]]) -> list[str]:
    """The first candidate key that is non-null and unique on both sides."""
    for keys in candidates:
        if all(set(keys) <= set(d.columns) for d in (left, right)):
            probes = [d.agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("u")).first() for d in (left, right)]
            if all(p["n"] == p["u"] for p in probes):
                return keys
    raise ValueError("no candidate key is unique on both sides")


def quadrants(aligned: DataFrame) -> DataFrame:
    """Counts of the four outcomes of a pair of flags, those that do not occur with zero: ``quadrant``, ``n``."""
    label = F.when(F.col("left") & F.col("right"), "both").when(F.col("left"), "left_only").when(F.col("right"), "right_only").otherwise("neither")
    counted = aligned.where("left is not null and right is not null").groupBy(label.alias("quadrant")).agg(F.count("*").alias("n"))
    names = aligned.sparkSession.createDataFrame([(x,) for x in ("both", "left_only", "neither", "right_only")], "quadrant string")
    return names.join(counted, "quadrant", "left").select("quadrant", F.coalesce("n", F.lit(0)).alias("n"))


def rate(flag: Column) -> Column:
    """Share of true flags."""
    return F.avg(flag.cast("double"))


def pair_rates(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rates of scored pairs; NaN on an empty table without groups.

    Pair and member accuracy, both strict as well, collapse, format (the contract), ambiguity, and, where the scores
    have them, extraction, fallback and responses that match both golds as a whole.
    """
    both = lambda a, b: F.avg((F.col(a).cast("int") + F.col(b).cast("int")) / 2)
    rates = {
        "pair_accuracy": rate(F.col("pair_correct")),
        "member_accuracy": both("correct_a", "correct_b"),
        "strict_pair_accuracy": rate(F.col("strict_pair_correct")),
        "strict_member_accuracy": both("strict_a", "strict_b"),
        "collapse_rate": rate(F.col("collapsed")),
        "format_rate": both("format_a", "format_b"),
        "ambiguity_rate": rate(F.col("ambiguous")),
    }
    if "extractor_a" in scored.columns:
        rates |= {"extractor_rate": both("extractor_a", "extractor_b"), "fallback_rate": both("fallback_a", "fallback_b")}
    if "mentions_both" in scored.columns:
        rates["mentions_both_rate"] = rate(F.col("mentions_both"))
    aggs = [F.count("*").alias("n"), *[F.round(F.coalesce(v, F.lit(float("nan"))), 9).alias(k) for k, v in rates.items()]]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


def benchmark_rates(scored: DataFrame, category: str) -> DataFrame:
    """Rates of scored answers, overall (null category) and per category: ``n``, strict and final accuracy, format, extractor, contract, ambiguity, fallback.

    ``scored``: category, correct, strict, format_valid, extractor_valid, ambiguous, fallback. A missing category is named
    ``unknown``. An empty table gives no rows but the overall one, without rates.
    """
    parts = {"acc_strict": "strict", "acc_final": "correct", "format_valid": "format_valid", "extractor_valid": "extractor_valid", "contract_valid": "format_valid", "ambiguous_rate": "ambiguous", "fallback_rate": "fallback"}
    named = scored.withColumn(category, F.coalesce(F.col(category), F.lit("unknown")))
    return named.rollup(category).agg(F.count("*").alias("n"), *[F.round(rate(F.col(c)), 9).alias(k) for k, c in parts.items()])


def member_rate(a: Column, b: Column) -> Column:
    """Successes over two members a row."""
    return F.avg((a.cast("int") + b.cast("int")) / 2)


def seed_means(rows: DataFrame, by: list[str], seed: str, value: str) -> DataFrame:
    """Mean and sample deviation of the means of seeds; one seed has deviation 0: ``mean``, ``sd``, ``n_seeds``."""
    each = rows.groupBy(*by, seed).agg(F.avg(F.col(value).cast("double")).alias("m"))
    return each.groupBy(*by).agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 9).alias("sd"), F.count("*").alias("n_seeds"))


def group_all(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether all members of a pair are right; only keys with exactly two members count."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.bool_and(flag).alias("all_correct"), F.count("*").alias("n")).where("n = 2").drop("n")


def wilson(successes: Column, n: Column) -> Column:
    """Wilson interval of a rate, clamped to [0, 1]: ``low``, ``high``; null for n = 0."""
    p = successes / n
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    found = F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high"))
    return F.when(n > 0, found)


def _stirling_error(c: Column) -> Column:
    """log(c!) less Stirling's approximation, for counts of 1 or more: from a table up to 15, else by the series."""
    table = F.array(*[F.lit(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi)) for i in range(1, 16)])
    x = c.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - F.lit(1 / 1680) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(c <= 15, F.get(table, c.cast("int") - 1)).otherwise(series)


def mcnemar_p(b01: Column, b10: Column) -> Column:
    """Two-sided exact McNemar p-value; 1 without discordant pairs.

    The chance of the smaller count comes from Loader's form of the binomial, which keeps its digits for large counts.
    Each smaller outcome is i / (n - i + 1) times the next one, so the whole tail is one sum of as many terms as the
    smaller count.
    """
    n, k = b01 + b10, F.least(b01, b10)
    rest, x = n - k, (n - 2 * k) / n
    deviance = n / 2 * ((1 - x) * F.log1p(-x) + (1 + x) * F.log1p(x))
    chance = F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - deviance) * F.sqrt(n / (2 * math.pi * k * rest))
    at = F.when(k == 0, F.exp(-n * math.log(2.0))).otherwise(chance)
    tail = at * F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(1.0), lambda a, i: 1.0 + a * i / (n - i + 1))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def discordant(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Discordant counts and McNemar p-value: ``n``, ``b01`` (right only), ``b10`` (left only), ``p_value``."""
    aggs = [F.count("*").alias("n"), F.coalesce(F.sum((~F.col("left") & F.col("right")).cast("long")), F.lit(0)).alias("b01"), F.coalesce(F.sum((F.col("left") & ~F.col("right")).cast("long")), F.lit(0)).alias("b10")]
    counted = aligned.groupBy(*by).agg(*aggs) if by else aligned.agg(*aggs)
    return counted.withColumn("p_value", F.round(mcnemar_p(F.col("b01"), F.col("b10")), 9))


def paired_change(rows: DataFrame, key: str, step: str, base: int, value: str) -> DataFrame:
    """Mean change of every step against the base step over the ids of both: ``step``, ``n``, ``mean``, ``change``."""
    first = rows.where(F.col(step) == base).select(key, F.col(value).cast("double").alias("__base"))
    joined = rows.where(F.col(step) != base).join(first, key)
    return joined.groupBy(step).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 9).alias("mean"), F.round(F.avg(F.col(value).cast("double") - F.col("__base")), 9).alias("change"))


def movement_share(rows: DataFrame, task: str, value: str) -> DataFrame:
    """Share of each task in the total movement: its mean weighted by its size over the sum of all."""
    each = rows.groupBy(task).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    total = each.agg(F.sum(F.col("m") * F.col("n")).alias("whole"))
    return each.crossJoin(F.broadcast(total)).select(task, "n", F.round("m", 9).alias("mean"), F.round(F.try_divide(F.col("m") * F.col("n"), F.col("whole")), 9).alias("share"))


def venn_regions(members: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """Sizes of the regions of a Venn diagram: one 0/1 pattern per id over the named groups."""
    flags = [F.max((F.col(group) == g).cast("int")).alias(f"in_{i}") for i, g in enumerate(groups)]
    each = members.where(F.col(group).isin(groups)).groupBy(key).agg(*flags)
    return each.groupBy(F.concat(*[F.col(f"in_{i}").cast("string") for i in range(len(groups))]).alias("region")).agg(F.count("*").alias("n"))


def outcome(value: Column, printed: Column, relation: Column, tolerance: Column, rounded: Column | None = None, issue: Column | None = None) -> Column:
    """How a value compares with a printed statement: matched, matched after rounding, issue known, mismatch, or null without one.

    Relations: eq (within the tolerance), le, ge (with a small guard), lt, gt, zero, undefined (no value).
    """
    kind, room = F.coalesce(relation, F.lit("eq")), F.coalesce(tolerance, F.lit(5e-4))
    near = lambda x: F.coalesce(F.abs(x - printed) <= room, F.lit(False))
    holds = (
        F.when(kind == "undefined", value.isNull())
        .when(value.isNull(), False)
        .when(kind == "eq", near(value))
        .when(kind == "le", value <= printed + 1e-9)
        .when(kind == "lt", value < printed)
        .when(kind == "ge", value >= printed - 1e-9)
        .when(kind == "gt", value > printed)
        .when(kind == "zero", value == 0)
    )
    result = F.when(printed.isNull() & (kind != "undefined"), F.lit(None).cast("string")).when(F.coalesce(holds, F.lit(False)), "matched")
    if rounded is not None:
        result = result.when(near(rounded), "matched after rounding")
    if issue is not None:
        result = result.when(issue.isNotNull(), "issue known")
    return result.otherwise("mismatch")
