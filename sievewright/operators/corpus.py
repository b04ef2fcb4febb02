"""Corpus building: allocation, stratified samples, mixtures in windows, freezing and profiles."""

from __future__ import annotations

import hashlib
import json
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.measures import exact_count
from sievewright.operators.ordering import numbered
from sievewright.session import broadcast_if_small


def allocation(rows: DataFrame, strata: list[str], size: int) -> DataFrame:
    """Proportional allocation with largest remainders: the strata, ``n`` and ``take``.

    The rest after rounding down goes to the largest remainders, ties to the larger stratum and then to the higher key.
    Raises if ``size`` is not between 1 and the number of rows. Windows run over strata, not rows.
    """
    cells = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t")).first()["t"] or 0
    if not 1 <= size <= total:
        raise ValueError(f"size must lie in [1, {total}]")
    ideal = F.lit(size) * F.col("n") / F.lit(total)
    based = cells.withColumn("base", F.floor(ideal)).withColumn("part", F.round(ideal - F.floor(ideal), 12))
    left = size - (based.agg(F.sum("base").alias("s")).first()["s"])
    order = [F.col("part").desc(), F.col("n").desc(), *[F.col(s).desc() for s in strata]]
    ranked = based.withColumn("r", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(*strata, "n", (F.col("base") + (F.col("r") <= left).cast("long")).alias("take"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, size: int, seed: int) -> DataFrame:
    """A stratified sample: each stratum is shuffled by a generator seeded with its key, and its allocation is taken.

    Only keys are shuffled, so a task holds the ids of a stratum, not its rows. Ids must be unique.
    """
    take = allocation(rows, strata, size)

    def pick(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf[key].astype(str))
        digest = hashlib.sha256(f"{seed}:{json.dumps([str(g) for g in group[:-1]], separators=(',', ':'))}".encode()).digest()
        random.Random(digest).shuffle(names)
        return pd.DataFrame({key: names[: int(group[-1])]})

    keyed = rows.select(*strata, F.col(key).cast("string").alias(key)).join(broadcast_if_small(take.drop("n")), strata)
    chosen = keyed.groupBy(*strata, "take").applyInPandas(pick, f"`{key}` string")
    return rows.join(chosen, rows[key].cast("string") == chosen[key], "left_semi")


def cycled(pool: DataFrame, n: int, ordinal: str) -> DataFrame:
    """Rows 0 to ``n - 1`` of a pool repeated from its start: the pool's columns and ``draw``. ``ordinal`` counts from 0."""
    size = pool.count()
    if not size:
        raise ValueError("the pool is empty")
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod("id", F.lit(size)).alias(ordinal))
    return draws.join(pool.withColumn(ordinal, F.col(ordinal).cast("long")), ordinal)


def mixture(constructed: DataFrame, natural: DataFrame, share: str, windows: int, batch: int, order_key: Column, columns: list[str]) -> DataFrame:
    """A training stream of ``windows`` batches with an exact share of constructed rows in each.

    Constructed rows cycle in their order (``ordinal`` from 0); natural rows are taken without replacement in the
    order of ``order_key``. Raises if the share of a batch is no whole number or the natural pool is too small. Output:
    ``ordinal``, ``arm_part`` (constructed, natural) and the columns.
    """
    c = exact_count(share, batch)
    need = windows * (batch - c)
    placed = numbered(natural, order_key, name="draw").where(F.col("draw") < need)
    if need and natural.count() < need:
        raise ValueError(f"the natural pool has fewer than {need} rows")
    parts = []
    if c:
        part = cycled(constructed, windows * c, "ordinal")
        parts.append(part.select((F.floor(F.col("draw") / c) * batch + F.col("draw") % c).cast("long").alias("at"), F.lit("constructed").alias("arm_part"), *columns))
    if batch - c:
        d = batch - c
        parts.append(placed.select((F.floor(F.col("draw") / d) * batch + c + F.col("draw") % d).cast("long").alias("at"), F.lit("natural").alias("arm_part"), *columns))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumnRenamed("at", "ordinal")


def count_windows(stream: DataFrame, batch: int, ordinal: str = "ordinal") -> DataFrame:
    """Stream rows with the number of their batch and the place inside it."""
    return stream.withColumn("window", F.floor(F.col(ordinal) / batch)).withColumn("place", F.col(ordinal) % batch)


def layer_pairs(scenes: DataFrame, key: str, layer: str, first: str, second: str, columns: list[str]) -> DataFrame:
    """Items with rows of both layers: ``key`` and the columns of either with the layer's name as prefix. The lowest ordinal counts."""
    def one(name: str) -> DataFrame:
        best = scenes.where((F.col(layer) == name) & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), "ordinal").alias("r"))
        return best.select(key, *[F.col(f"r.{c}").alias(f"{name}_{c}") for c in columns])

    return one(first).join(one(second), key)


def content_dedupe(rows: DataFrame, content: str, path: str) -> DataFrame:
    """One row per distinct content: ``digest``, the smallest path and the other paths in order."""
    digest = F.sha2(F.col(content), 256)
    grouped = rows.where(F.col(content).isNotNull()).groupBy(digest.alias("digest")).agg(F.array_sort(F.collect_set(path)).alias("p"))
    return grouped.select("digest", F.col("p")[0].alias("first_path"), F.slice("p", 2, F.size("p")).alias("duplicate_paths"))


def merge_shards(shards: DataFrame, key: str, value: str) -> DataFrame:
    """Shards of one store merged by key; raises where two rows of a key differ but for outer blanks."""
    clean = F.trim(F.col(value))
    merged = shards.groupBy(key).agg(F.min(clean).alias("lo"), F.max(clean).alias("hi"), F.count("*").alias("copies"))
    checked = F.when(F.col("lo") != F.col("hi"), F.raise_error(F.concat(F.lit("different values for "), F.col(key)))).otherwise(F.col("lo"))
    return merged.select(key, checked.alias(value), "copies")


def resume_prefix(source: DataFrame, done: DataFrame, keys: list[str], ordinal: str = "ordinal") -> int:
    """Rows already done, if they are a prefix of the source in its order; raises otherwise."""
    n = done.count()
    ahead = source.where(F.col(ordinal) < n).select(ordinal, *keys)
    differ = ahead.exceptAll(done.select(ordinal, *keys)).limit(1).count() + done.select(ordinal, *keys).exceptAll(ahead).limit(1).count()
    if differ:
        raise ValueError("the rows done are no prefix of the source")
    return n


def corpus_key(category: Column, uid: Column, member: Column) -> Column:
    """Key of a stream row in its corpus: the natural id without its prefix, else uid and member."""
    natural = F.lower(uid).startswith("virl:")
    return F.when(natural, F.substring(uid, F.lit(6), F.length(uid))).otherwise(F.concat(uid, F.lit(":"), F.coalesce(member, F.lit(""))))


def constructed_rows(scenes: DataFrame, key: str, order_key: Column, split: str = "training") -> DataFrame:
    """Four adjacent training rows per item with rows of the layers l3 and probe, both of the split.

    Items are shuffled by ``order_key``; members come in the order l3_a, l3_b, probe_a, probe_b. Output: ``ordinal``,
    ``pair_group_uid``, ``pair_member``, ``answer``.
    """
    both = layer_pairs(scenes, key, "layer", "l3", "probe", ["split", "answer_a", "answer_b"])
    kept = both.where((F.col("l3_split") == split) & (F.col("probe_split") == split))
    placed = numbered(kept, order_key, F.col(key), name="place")
    members = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"{layer}_{s}").alias("pair_member"), F.col(f"{layer}_answer_{s}").alias("answer")) for i, (layer, s) in enumerate([("l3", "a"), ("l3", "b"), ("probe", "a"), ("probe", "b")])])
    return placed.select("place", F.col(key).alias("pair_group_uid"), F.explode(members).alias("m")).select((F.col("place") * 4 + F.col("m.i")).cast("long").alias("ordinal"), "pair_group_uid", "m.pair_member", "m.answer")


def packaged(pairs: DataFrame, key: str, salt: str) -> DataFrame:
    """Release form of pairs: opaque ids, the order of the two members and of the pairs decided by salted digests.

    Output: ``pair_id``, ``first_side``, ``place_key`` (sort by it), ``source_pair_id``.
    """
    digest = lambda what: F.sha2(F.concat_ws("\0", F.lit(salt), F.lit(what), F.col(key)), 256)
    return pairs.where(F.col(key).isNotNull()).select(F.substring(digest("id"), 1, 16).alias("pair_id"), F.when(digest("side") < "8", "a").otherwise("b").alias("first_side"), digest("place").alias("place_key"), F.col(key).alias("source_pair_id")).distinct()
