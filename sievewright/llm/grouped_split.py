"""Splits that keep tied records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.keys import unit_hash
from sievewright.llm.components import counted_components
from sievewright.session import broadcast_if_few, cut

SALT = "grouped-split-v1"
#: Rows of a tied group from which the group gets its first row by broadcast instead of a shuffle by its key. At most
#: one group in this many rows is that large, which bounds what is broadcast.
LARGE_GROUP = 100_000


def tied_groups(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Each row with the smallest key of the group it is tied to (``group_key``).

    Rows are tied if they share a value of any of ``keys``, and ties carry over. Only keys that stand beside another
    key in some row take part in the component search; all others already name their group. A row without any key has
    a null group and is tied to nothing. All columns of ``rows`` are kept; ``group_key`` must be new.
    """
    named = rows.withColumn("__keys", F.array_sort(F.array_distinct(F.array_compact(F.array(*keys)))))
    edges = named.where(F.size("__keys") > 1).select(F.col("__keys")[0].alias("a"), F.explode(F.slice("__keys", 2, len(keys))).alias("b")).distinct()
    found, n = counted_components(edges)
    found = found.select(F.col("node").alias("__key"), F.col("component").alias("__component"))
    keyed = named.withColumn("__key", F.get("__keys", F.lit(0)))
    joined = keyed.join(broadcast_if_few(found, n, 200), "__key", "left")
    return joined.withColumn("group_key", F.coalesce("__component", "__key")).drop("__keys", "__key", "__component")


def first_of_groups(grouped: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Each tied group with its lowest ordinal: ``group_key``, ``first_ordinal``, ``n_rows``."""
    return grouped.where("group_key is not null").groupBy("group_key").agg(F.min(ordinal).alias("first_ordinal"), F.count("*").alias("n_rows"))


def with_first(grouped: DataFrame, ordinal: str = "ordinal", large: int = LARGE_GROUP) -> DataFrame:
    """Each row with the lowest ordinal of its group; a row that is tied to nothing is its own group.

    Rows without a group take no part in the shuffle, and rows of groups above ``large`` stay where they are and get
    their first row by broadcast.
    """
    first = cut(first_of_groups(grouped, ordinal))
    hot = first.where(F.col("n_rows") > large).drop("n_rows")
    cold = first.where(F.col("n_rows") <= large).drop("n_rows")
    tied, free = grouped.where("group_key is not null"), grouped.where("group_key is null").withColumn("first_ordinal", F.col(ordinal))
    n_hot = hot.count()
    if n_hot:
        spread = tied.join(F.broadcast(hot), "group_key")
        tied = tied.join(F.broadcast(hot.select("group_key")), "group_key", "left_anti").join(cold, "group_key").unionByName(spread)
    else:
        tied = tied.join(cold, "group_key")
    return tied.unionByName(free)


def rendezvous(group: Column, shares: list[tuple[str, float]], salt: str = SALT) -> Column:
    """Split of a group by weighted rendezvous hashing.

    Every split draws an exponential key of the group with the share as its rate; the smallest key wins, so a split
    gets its share of groups on average, and a change of shares moves as few groups as possible. Ties go to the first
    name in order. Splits of zero share get nothing.
    """
    real = [(n, s) for n, s in sorted(shares) if s and s > 0]
    if not real:
        raise ValueError("no split has a positive share")
    drawn = [F.struct((-F.log(F.greatest(unit_hash(group, f"{salt}|{n}"), F.lit(1e-300))) / F.lit(float(s))).alias("k"), F.lit(n).alias("n")) for n, s in real]
    return drawn[0]["n"] if len(drawn) == 1 else F.least(*drawn)["n"]


def grouped_split(rows: DataFrame, keys: list[Column], shares: DataFrame, ordinal: str = "ordinal", salt: str = SALT) -> DataFrame:
    """Rows with a split per scheme: ``ordinal``, ``first_ordinal``, ``scheme``, ``split``.

    ``shares``: scheme, split, target_share, a small fixed table. All rows of a tied group get the same split of a
    scheme; rows that are tied to nothing are groups of their own.
    """
    schemes: dict[str, list] = {}
    for r in shares.select("scheme", "split", "target_share").where("scheme is not null and split is not null").collect():
        schemes.setdefault(r["scheme"], []).append((r["split"], r["target_share"]))
    grouped = with_first(tied_groups(rows.select(F.col(ordinal), *[k.alias(f"__k{i}") for i, k in enumerate(keys)]), [F.col(f"__k{i}") for i in range(len(keys))]), ordinal)
    named = grouped.withColumn("group_key", F.coalesce("group_key", F.concat(F.lit("#"), F.col(ordinal).cast("string"))))
    each = F.array(*[F.struct(F.lit(s).alias("scheme"), rendezvous(F.col("group_key"), v, f"{salt}|{s}").alias("split")) for s, v in sorted(schemes.items())])
    return named.select(ordinal, "first_ordinal", F.explode(each).alias("x")).select(ordinal, "first_ordinal", "x.scheme", "x.split")


def split_report(assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """Shares reached per scheme and split, by rows and by groups."""
    counted = assigned.groupBy("scheme", "split").agg(F.count("*").alias("n_rows"), F.count_distinct("first_ordinal").alias("n_groups"))
    total = counted.groupBy("scheme").agg(F.sum("n_rows").alias("all_rows"))
    joined = shares.join(counted, ["scheme", "split"], "left").join(total, "scheme", "left")
    return joined.select("scheme", "split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.round(F.coalesce(F.col("n_rows"), F.lit(0)) / F.col("all_rows"), 9).alias("share"))
