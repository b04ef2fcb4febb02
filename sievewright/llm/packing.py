"""Filling fixed-capacity containers: conflict-constrained best-fit.

Bins of a block are ordered by the space left and carry bitmaps of the sources and duplicate clusters inside. An item
goes to the tightest bin it fits into; while that bin holds a conflicting source or another copy of the item, the
search goes on to the next larger rest. Items are taken by falling size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.tokens import VOCABULARY, measured
from sievewright.session import cut

#: Items that one task packs; a block leaves at most a few bins partly unused.
BLOCK_ITEMS = 20_000


def best_fit(sizes: list[int], sources: list[str], clusters: list[int], capacity: int, apart: tuple = ()) -> list[int]:
    """Bin of each item, in the order given. Every size must be between 1 and ``capacity``.

    Two items with one cluster never share a bin, nor do items of two sources that are to be kept ``apart``.
    """
    bit = {s: 1 << i for i, s in enumerate(sorted(set(sources)))}
    against = dict.fromkeys(bit, 0)
    for a, b in apart:
        if a in bit and b in bit:
            against[a] |= bit[b]
            against[b] |= bit[a]
    copies = {c: 1 << i for i, c in enumerate(k for k, n in Counter(clusters).items() if n > 1)}
    order: list[tuple[int, int]] = []  # (space left, bin)
    inside: list[int] = []
    holds: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        no_source, copy = against[source], copies.get(cluster, 0)
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not inside[b] & no_source and not holds[b] & copy:
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(inside)
            inside.append(0)
            holds.append(0)
        inside[b] |= bit[source]
        holds[b] |= copy
        out.append(b)
        if left > size:
            insort(order, (left - size, b))
    return out


def pack(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY, apart: tuple = (), block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Documents in containers: ``setting``, ``capacity``, ``container``, ``doc_id``, ``piece``, ``first_token``, ``tokens``, ``source``.

    ``limits``: rows of ``purpose`` container with ``setting`` and ``max_tokens``. A text of more tokens than a
    capacity is divided into pieces of exactly the capacity, each a full container of its own, and a rest that is
    packed like any other item; no other text is divided. Items are spread over blocks by a hash of their id, and each
    block is packed by itself; there are as many blocks as the number of documents asks for, so containers change when
    documents are added. No container holds two copies of a text; ``apart`` names pairs of sources that share no
    container either. Null, empty and blank texts take no container. Rows that repeat a document count as the one with
    the most tokens.
    """
    sized = cut(_one_each(measured(documents, vocabulary)))
    settings = [(r["setting"], int(r["max_tokens"])) for r in limits.where("purpose = 'container' and max_tokens > 0").select("setting", "max_tokens").distinct().collect()]
    schema = "setting string, capacity long, container string, doc_id long, piece int, first_token long, tokens long, source string"
    spark = documents.sparkSession
    if not settings:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("setting"), F.lit(c).cast("long").alias("capacity")) for s, c in sorted(settings)]))
    items = sized.select("*", each.alias("x")).select("doc_id", "source", "tokens", "cluster", "x.*").withColumn("full", F.expr("tokens div capacity"))
    blocks = max(1, -(-sized.count() // block_items))
    whole = items.where("full > 0").select("setting", "capacity", "doc_id", "source", F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
    full = whole.select("setting", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"), "source")
    rest = items.where("tokens > full * capacity").select("setting", "capacity", "doc_id", "source", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), (F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens"), "cluster", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"))

    def fill(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(pdf["tokens"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), int(key[1]), apart)
        pdf = pdf.assign(container=[f"{key[2]}-{b}" for b in bins])
        return pdf[["setting", "capacity", "container", "doc_id", "piece", "first_token", "tokens", "source"]]

    packed = rest.groupBy("setting", "capacity", "block").applyInPandas(fill, schema)
    return packed.unionByName(full)


def _one_each(sized: DataFrame) -> DataFrame:
    """One row a document: of repeated ones that with the most tokens, of equals the greatest."""
    most = F.max(F.struct("tokens", "cluster", "source"))
    return sized.groupBy("doc_id").agg(most.alias("m")).select("doc_id", "m.source", "m.tokens", "m.cluster")


def pack_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of the space used per setting, with the least number of containers possible by volume."""
    return packed.groupBy("setting", "capacity").agg(
        F.count_distinct("container").alias("n_containers"),
        F.sum("tokens").alias("tokens"),
        F.ceil(F.sum("tokens") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("tokens") / (F.count_distinct("container") * F.first("capacity")), 6).alias("used_share"),
    )
