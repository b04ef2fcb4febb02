"""Preconditions that raise, and listings of their violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A precondition does not hold."""


def required_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The input, if it has all the columns."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise GuardError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their number of rows. Null keys count as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The input, if no key repeats."""
    bad = duplicate_keys(df, keys).limit(3).collect()
    if bad:
        raise GuardError(f"repeated keys {keys}: {[tuple(r)[:-1] for r in bad]}")
    return df


def no_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    """The input with a check, made while it is read, that the columns hold no null: an unscored row is not a wrong one."""
    checked = {n: F.when(F.col(n).isNull(), F.raise_error(F.lit(f"null in {n}")).cast(df.schema[n].dataType)).otherwise(F.col(n)) for n in names}
    return df.withColumns(checked)


def coverage_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: the keys and ``side`` (left_only, right_only)."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(True)), right.select(*keys).distinct().withColumn("__r", F.lit(True))
    both = a.join(b, keys, "full")
    return both.where("__l is null or __r is null").select(*keys, F.when(F.col("__r").isNull(), "left_only").otherwise("right_only").alias("side"))


def full_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Raises unless both sides have the same keys."""
    bad = coverage_gaps(left, right, keys).limit(3).collect()
    if bad:
        raise GuardError(f"keys on one side only: {[tuple(r) for r in bad]}")


def single_valued(df: DataFrame, names: list[str]) -> dict[str, object]:
    """The one value of each lock column; raises where a column has several."""
    row = df.agg(*[F.count_distinct(F.to_json(F.struct(n))).alias(n) for n in names]).first()
    several = [n for n in names if row[n] > 1]
    if several:
        raise GuardError(f"several values in {several}")
    first = df.select(*names).first()
    return {n: first[n] for n in names} if first else {}


def equal_locks(left: DataFrame, right: DataFrame, names: list[str]) -> None:
    """Raises unless the lock columns are single-valued and equal on both sides."""
    a, b = single_valued(left, names), single_valued(right, names)
    if a != b:
        raise GuardError(f"locks differ: {sorted(n for n in names if a.get(n) != b.get(n))}")


def exactly_one(df: DataFrame, keys: list[str]) -> DataFrame:
    """The input, if its rows belong to one evaluation."""
    found = df.select(*keys).distinct().limit(2).count()
    if found != 1:
        raise GuardError(f"{'no' if not found else 'more than one'} evaluation selected")
    return df


def matches(filters: dict[str, object]) -> Column:
    """Conjunction of filters: a value must be equal (null matches null), a list must hold it, a callable gives a condition."""

    def one(name: str, want: object) -> Column:
        c = F.col(name)
        if callable(want) and not isinstance(want, Column):
            return want(c)
        if isinstance(want, list | tuple | set | frozenset):
            values = [v for v in want if v is not None]
            hit = c.isin(values) if values else F.lit(False)
            return hit | c.isNull() if len(values) < len(want) else hit
        return c.eqNullSafe(F.lit(want))

    return reduce(lambda a, b: a & b, (one(n, w) for n, w in filters.items()), F.lit(True))


def select(df: DataFrame, **filters: object) -> DataFrame:
    """Rows that match all filters; a column the table lacks reads as null."""
    absent = {n for n in filters if n not in df.columns}
    wide = df.withColumns({n: F.lit(None).cast("string") for n in absent}) if absent else df
    return wide.where(matches(filters)).drop(*absent)


def shard(df: DataFrame, n: int, k: int, ordinal: str = "ordinal", limit: int | None = None) -> DataFrame:
    """Every n-th row by position, from ``k`` on; then the first ``limit`` of them by position."""
    part = df.where(F.pmod(F.col(ordinal), F.lit(n)) == k)
    return part if limit is None else part.where(F.col(ordinal) < k + n * limit)


def forbidden_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of a table that it must not have, whatever their case, in their order; an empty list is as it should be."""
    banned = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in banned]


def without_forbidden(df: DataFrame, names: list[str]) -> DataFrame:
    """The table, or an error if it has a column it must not have (such as the question or answer beside a caption)."""
    found = forbidden_columns(df, names)
    if found:
        raise GuardError(f"forbidden columns: {found}")
    return df
