"""Connected components by Hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut

#: Cluster size from which a cluster is told its minimum by a broadcast instead of a shuffle by its node. At most one
#: node in this many rows is that large, which bounds what is broadcast.
LARGE = 100_000


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, large: int = LARGE) -> DataFrame:
    """Components of an undirected graph given by its edges: columns ``node`` and ``component`` (the smallest node).

    Each node keeps a cluster, at first itself and its neighbours. In a round it sends its cluster to the smallest
    member and the smallest member to all others, until clusters are stars: a smallest node with all others, and these
    with it alone. Clusters are kept as (node, member) rows; the rows of a cluster above ``large`` stay where they are
    and get the minimum of their node by broadcast, so no task collects a large cluster. Edges with a null end are
    ignored, a repeated edge or a loop changes nothing, and an empty input gives an empty result. Raises after
    ``rounds`` rounds without a stable state.
    """
    return counted_components(edges, a, b, rounds, large)[0]


def counted_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, large: int = LARGE) -> tuple[DataFrame, int]:
    """The result of ``hash_to_min`` and its number of rows."""
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    ends = F.array(*[F.struct(F.col(p).alias("node"), F.col(q).alias("member")) for p, q in ("xy", "yx", "xx", "yy")])
    state, largest = cut(e.select(F.explode(ends).alias("e")).select("e.*").distinct()), 0
    for number in range(rounds):
        told = _with_minimum(state, large if largest > large or (not number and _largest(state) > large) else None)
        sent = F.array(F.struct(F.col("low").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("low").alias("member")))
        state = cut(told.select(F.explode(sent).alias("e")).select("e.*").distinct())
        stable, nodes, largest = _look(state)
        if stable:
            return state.where("member <= node").select("node", F.col("member").alias("component")), nodes
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def _with_minimum(state: DataFrame, large: int | None) -> DataFrame:
    """Rows of a state with the smallest member of their node."""
    low = state.groupBy("node").agg(F.min("member").alias("low"), F.count("*").alias("n"))
    if large is None:
        return state.join(low.drop("n"), "node")
    hot = F.broadcast(low.where(F.col("n") > large).select("node", "low"))
    cold = low.where(F.col("n") <= large).select("node", "low")
    return state.join(hot, "node").unionByName(state.join(hot.select("node"), "node", "left_anti").join(cold, "node"))


def _largest(state: DataFrame) -> int:
    """Rows of the largest cluster; no cluster has more rows than the state."""
    n = state.count()
    return n if n <= LARGE else state.groupBy("node").count().agg(F.max("count")).first()[0]


def _look(state: DataFrame) -> tuple[bool, int, int]:
    """Whether all clusters are stars, the number of nodes, and the size of the largest cluster.

    Stars: a node that is not its own smallest member has one member only, and the rows from such nodes mirror the
    rows of the others (compared by their number and a hash of the set).
    """
    out = F.xxhash64("node", "member")
    back = F.xxhash64("member", "node")
    by = state.groupBy("node").agg(F.min("member").alias("low"), F.count("*").alias("n"), F.bit_xor(out).alias("out"), F.bit_xor(F.when(F.col("node") != F.col("member"), back)).alias("back"))
    centre = F.col("low") == F.col("node")
    row = by.agg(
        F.count("*"), F.max("n"), F.max((~centre & (F.col("n") > 1)).cast("int")), F.count_if(~centre), F.sum(F.when(centre, F.col("n") - 1)),
        F.bit_xor(F.when(~centre, F.col("out"))), F.bit_xor(F.when(centre, F.col("back"))),
    ).first()
    nodes, most, several, leaves, held, gone, come = row
    return not several and (leaves or 0) == (held or 0) and (gone or 0) == (come or 0), nodes, most or 0
