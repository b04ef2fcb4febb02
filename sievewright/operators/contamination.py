"""Contamination edges between training and held-out records: exact, near-hash and shingle joins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import normalize_text, tokens, word_ngrams
from sievewright.session import BROADCAST_BYTES, broadcast_if_few, broadcast_if_small, cut

#: Largest hash distance and least overlap at which a pair is removed or looked at, and the words that
#: make an exact question distinctive.
HASH_REMOVE, HASH_INSPECT = 6, 10
JACCARD_REMOVE, JACCARD_INSPECT = 0.80, 0.70
DISTINCTIVE_WORDS = 5
#: Columns of a record that edges are made of.
_USED = ("record_id", "split", "question", "answer", "image_sha256", "image_applicable", "phash64", "dhash64", "delivered_at", "recorded_at")
#: Blocks of 16 bits into which a hash is cut, bytes of a block in a broadcast list, and hashes that a task looks up.
BLOCKS = 4
_BLOCK_BYTES, _LOOKED_UP = 72, 50_000
#: Texts from which a shingle counts as common.
_COMMON = 20


def latest(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row a key: the delivery of the latest ``delivered_at`` and ``recorded_at``, of equals the one with the greatest content.

    Rows with a null key are left out. Time columns that are absent do not count.
    """
    first = [c for c in ("delivered_at", "recorded_at") if c in records.columns]
    rest = [c for c in records.columns if c not in (*first, key)]
    best = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*first, *rest)).alias("__best"))
    return best.select(*[F.col(c) if c == key else F.col("__best")[c].alias(c) for c in records.columns])


def record_keys(records: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Records with ``question_key``, ``qa_key`` and ``words`` added. Empty questions have no key."""
    q = normalize_text(F.col(question))
    named = records.withColumn("question_key", F.when(q != "", q)).withColumn("words", tokens(F.coalesce(q, F.lit(""))))
    both = F.concat_ws("\x1f", "question_key", normalize_text(F.coalesce(F.col(answer), F.lit(""))))
    return named.withColumn("qa_key", F.when(F.col("question_key").isNotNull(), both))


def _pairs(train: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    a = train.select(F.col("record_id").alias("train_record_id"), *on).where(" and ".join(f"{c} is not null" for c in on))
    b = held.select(F.col("record_id").alias("eval_record_id"), *on).where(" and ".join(f"{c} is not null" for c in on))
    return a.join(b, on).drop(*[c for c in on])


def exact_edges(train: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs with one image, one question and answer, or one question: ``signal``, ``action`` rank (1 inspect, 2 remove)."""
    shown = _pairs(train.where("image_applicable"), held.where("image_applicable"), ["image_sha256"]).select("*", F.lit("image_sha256_exact").alias("signal"), F.lit(2).alias("action"))
    distinctive = held.withColumn("long", F.size("words") >= DISTINCTIVE_WORDS)
    qa = train.select(F.col("record_id").alias("train_record_id"), "qa_key").join(distinctive.select(F.col("record_id").alias("eval_record_id"), "qa_key", "long"), "qa_key")
    qa = qa.select("train_record_id", "eval_record_id", F.lit("question_answer_exact").alias("signal"), F.when(F.col("long"), 2).otherwise(1).alias("action"))
    q = _pairs(train, held, ["question_key"]).select("*", F.lit("question_exact").alias("signal"), F.lit(1).alias("action"))
    return shown.unionByName(qa).unionByName(q)


def sides(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and held-out records with their keys, each as last delivered; the keys are computed once."""
    used = records.select(*[c for c in _USED if c in records.columns])
    one = cut(record_keys(latest(used)))
    return one.where("split = 'train'"), one.where("split <> 'train'")


def _near_masks(radius: int) -> list[int]:
    """All 16-bit masks of at most ``radius`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(16), r)]


def _number(c: Column) -> Column:
    """A hash of 16 hexadecimal digits as a 64-bit number; null where one of its halves is no number."""
    half = lambda at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hash_edges(train: DataFrame, held: DataFrame, most: int = HASH_INSPECT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs whose smaller distance of the two perceptual hashes is at most ``most``: ``distance`` and action.

    By the pigeonhole principle such hashes have a 16-bit block that differs in no more bits than its reach, where the
    reaches of the four blocks add up to ``most - 3`` (2, 2, 2, 1 for a distance of 10). Distinct hashes of the held-out
    side are broadcast by block value, those of the training side look up every value in reach, and the exact distance
    decides; looked-up values are made on the way and never shuffled. Lists that do not fit ``limit`` at once take more
    passes, each over its own block values. Rows without hashes or with images that do not apply take no part.
    """
    if not 0 <= most <= 15:
        raise ValueError("distance must lie in [0, 15]")
    total = most - BLOCKS + 1
    reach = [total // BLOCKS + (i < total % BLOCKS) for i in range(BLOCKS)]

    def side(df: DataFrame, name: str) -> DataFrame:
        real = df.where("image_applicable and phash64 is not null and dhash64 is not null")
        return real.select(F.col("record_id").alias(f"{name}_record_id"), _number(F.col("phash64")).alias(f"p_{name}"), _number(F.col("dhash64")).alias(f"d_{name}"))

    def blocks(df: DataFrame, name: str, passes: int, k: int) -> DataFrame:
        """Number and value of each block that pass ``k`` may look at: the number stands in the lowest three bits."""
        each = [
            F.struct(F.lit(i).alias("i"), F.shiftleft(F.shiftrightunsigned(F.col(f"{c}_{name}"), 16 * (i % BLOCKS)).bitwiseAND(F.lit(0xFFFF)), 3).bitwiseOR(F.lit(i)).alias("own"))
            for c, first in (("p", 0), ("d", BLOCKS)) for i in range(first, first + BLOCKS) if reach[i % BLOCKS] >= 0 and i % min(passes, 2 * BLOCKS) == k % min(passes, 2 * BLOCKS)
        ]
        return df.select("*", F.inline(F.array(*each))).where("own is not null") if each else df.limit(0).select("*", F.lit(0).alias("i"), F.lit(0).cast("long").alias("own"))

    a, b = side(train, "train"), side(held, "eval")
    ours, theirs = cut(a.drop("train_record_id").distinct()), cut(b.drop("eval_record_id").distinct())
    wanted = theirs.count() * 2 * BLOCKS * _BLOCK_BYTES
    passes = 1
    while wanted > passes * limit:
        passes *= 2
    spread = ours.repartition(max(2 * ours.sparkSession.sparkContext.defaultParallelism, -(-ours.count() // _LOOKED_UP)))
    masks = {r: F.array(*[F.lit(m << 3).cast("long") for m in _near_masks(r)]) for r in set(reach) if r >= 0}
    near = F.least(F.bit_count(F.col("p_train").bitwiseXOR(F.col("p_eval"))), F.bit_count(F.col("d_train").bitwiseXOR(F.col("d_eval"))))
    found = None
    for k in range(passes):
        by_reach = F.coalesce(*[F.when(F.col("i").isin([i for i in range(2 * BLOCKS) if reach[i % BLOCKS] == r]), m) for r, m in masks.items()])
        looked = blocks(spread, "train", passes, k).select("p_train", "d_train", "own", F.explode(by_reach).alias("mask")).select("p_train", "d_train", F.col("own").bitwiseXOR(F.col("mask")).alias("block"))
        listed = blocks(theirs, "eval", passes, k).select("p_eval", "d_eval", F.col("own").alias("block"))
        if passes > 1:
            looked, listed = (df.where(F.col("block") % passes == k) for df in (looked, listed))
        hits = looked.join(F.broadcast(listed), "block").where(near <= most).select("p_train", "d_train", "p_eval", "d_eval", near.alias("distance")).distinct()
        if passes > 1:
            hits = cut(hits)  # one list at a time is broadcast
        found = hits if found is None else found.unionByName(hits)
    one = found.distinct() if passes > 1 else found
    for name, df in (("train", a), ("eval", b)):
        own = df.select(f"{name}_record_id", F.col(f"p_{name}").alias("p"), F.col(f"d_{name}").alias("d"))
        one = one.join(own, F.col(f"p_{name}").eqNullSafe(F.col("p")) & F.col(f"d_{name}").eqNullSafe(F.col("d"))).drop("p", "d")
    return one.select("train_record_id", "eval_record_id", "distance").select("*", F.lit("perceptual_hash").alias("signal"), F.when(F.col("distance") <= HASH_REMOVE, 2).otherwise(1).alias("action"))


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float = JACCARD_INSPECT, n: int = 5) -> DataFrame:
    """Pairs of texts with a shingle overlap of at least ``least``: ``left_id``, ``right_id``, ``score``. Exact.

    Inputs: ``id`` and ``words``. Each side keeps the rarest shingles of a text only: a pair that reaches the overlap
    must share one of its first ``size - ceil(least * size) + 1`` shingles in any order that both sides have. Shingles
    travel as 64-bit hashes; the order puts those of ``_COMMON`` texts or more last, by how many have them, and all
    others by their hash. Sizes, then hashes are compared before the shingles themselves decide.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        made = df.select(F.col("id").alias(name), F.transform(word_ngrams(F.col("words"), n), lambda g: F.xxhash64(g)).alias("h"))
        return made.where(F.size("h") > 0)

    a, b = cut(hashed(left, "left_id")), cut(hashed(right, "right_id"))
    counted = a.select(F.explode("h").alias("g")).unionByName(b.select(F.explode("h").alias("g"))).groupBy("g").agg(F.count("*").alias("df"))
    counted = cut(counted.where(F.col("df") >= _COMMON))
    common = broadcast_if_few(counted, counted.count(), 64)

    def prefix(df: DataFrame, name: str) -> DataFrame:
        each = df.repartition(name).select(name, F.explode("h").alias("g")).join(common, "g", "left")
        ranked = each.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g"))).alias("o"))
        keep = F.size("o") - F.ceil(F.lit(least) * F.size("o") - 1e-9).cast("int") + 1
        return ranked.select(name, F.size("o").alias(f"n_{name}"), F.explode(F.array_distinct(F.transform(F.slice("o", F.lit(1), keep), lambda x: x["g"]))).alias("g"))

    alike = (F.col("n_left_id") >= least * F.col("n_right_id") - 1e-9) & (F.col("n_right_id") >= least * F.col("n_left_id") - 1e-9)
    found = prefix(a, "left_id").join(prefix(b, "right_id"), "g").where(alike).select("left_id", "right_id").distinct()
    both = found.join(a.withColumnRenamed("h", "ha"), "left_id").join(b.withColumnRenamed("h", "hb"), "right_id")
    clash = (F.size(F.array_distinct("ha")) < F.size("ha")) | (F.size(F.array_distinct("hb")) < F.size("hb"))
    common_hashes = F.size(F.array_intersect("ha", "hb"))
    near = both.where(clash | (common_hashes >= least * (F.size("ha") + F.size("hb") - common_hashes) - 1e-6)).select("left_id", "right_id")
    wa, wb = (df.select(F.col("id").alias(name), F.col("words").alias(w)) for df, name, w in ((left, "left_id", "wa"), (right, "right_id", "wb")))
    sets = near.join(wa, "left_id").join(wb, "right_id").select("left_id", "right_id", word_ngrams(F.col("wa"), n).alias("sa"), word_ngrams(F.col("wb"), n).alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return sets.select("left_id", "right_id", (shared / (F.size("sa") + F.size("sb") - shared)).alias("score")).where(F.col("score") >= least)


def text_edges(train: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of near-equal questions by five-word shingles."""
    left = train.select(F.col("record_id").alias("id"), "words")
    right = held.select(F.col("record_id").alias("id"), "words")
    found = jaccard_pairs(left, right)
    return found.select(F.col("left_id").alias("train_record_id"), F.col("right_id").alias("eval_record_id"), "score", F.lit("question_5gram_jaccard").alias("signal"), F.when(F.col("score") >= JACCARD_REMOVE, 2).otherwise(1).alias("action"))


def edges(records: DataFrame) -> DataFrame:
    """All edges between training and held-out records with merged signals and the strongest action.

    Columns: train_record_id, eval_record_id, the signals as nullable columns, and action (inspect or remove). Records
    delivered twice count once, as last delivered.
    """
    train, held = sides(records)
    nothing = [F.lit(None).cast("int").alias("distance"), F.lit(None).cast("double").alias("score")]
    every = exact_edges(train, held).select("train_record_id", "eval_record_id", "signal", "action", *nothing)
    every = every.unionByName(hash_edges(train, held).select("train_record_id", "eval_record_id", "signal", "action", "distance", F.lit(None).cast("double").alias("score")))
    every = every.unionByName(text_edges(train, held).select("train_record_id", "eval_record_id", "signal", "action", F.lit(None).cast("int").alias("distance"), "score"))
    flag = lambda name: F.bool_or(F.col("signal") == name).alias(name)
    merged = every.groupBy("train_record_id", "eval_record_id").agg(
        flag("image_sha256_exact"), flag("question_answer_exact"), flag("question_exact"), F.min("distance").alias("hash_distance"), F.round(F.max("score"), 9).alias("question_5gram_jaccard"), F.max("action").alias("a")
    )
    return merged.withColumn("action", F.when(F.col("a") == 2, "remove").otherwise("inspect")).drop("a")


def removals(found: DataFrame, records: DataFrame) -> DataFrame:
    """Training items to remove (any of their records is to be removed) or only to inspect: ``dataset``, ``item_id``, ``action``."""
    worst = found.groupBy(F.col("train_record_id").alias("record_id")).agg(F.max(F.when(F.col("action") == "remove", 2).otherwise(1)).alias("a"))
    items = records.select("record_id", "dataset", "item_id").where("item_id is not null").distinct().join(worst, "record_id")
    return items.groupBy("dataset", "item_id").agg(F.when(F.max("a") == 2, "remove").otherwise("inspect").alias("action"))


def without_removed(records: DataFrame, removed: DataFrame) -> DataFrame:
    """Records whose item is not to be removed; items to inspect stay."""
    out = removed.where("action = 'remove'").select("dataset", "item_id")
    return records.join(broadcast_if_small(out), ["dataset", "item_id"], "left_anti")
