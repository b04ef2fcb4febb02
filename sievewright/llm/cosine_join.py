"""Exact weighted cosine join of sparse vectors between two sides, over inverted lists with bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.components import hash_to_min
from sievewright.session import broadcast_if_few, cut

#: Vectors with a term from which the term's list is treated as hot: near copies in it are merged first, and it is
#: joined in blocks.
LONG_LIST = 4_000
#: Postings of one side of a hot list that one task joins.
LIST_BLOCK = 2_000
_EPS = 1e-6


def weighted_vectors(rows: DataFrame, threshold: float, tilt: float | None = None) -> tuple[DataFrame, int]:
    """Unit vectors of sets of terms with what the join needs, and the number of vectors with the most frequent term.

    The vectors have the input's other columns, ``ts``, ``ws``, ``p``, ``b0`` and ``b1``.

    ``rows``: ``key``, ``terms`` (array of 64-bit terms) and any other columns, one row a key. The raw
    weight of a term is its rarity, ``ln(1 + n / df)`` over all n rows; with a ``tilt`` it is ``sqrt(1 + tilt * r)``, where
    r is the rarity as a share of the largest one possible, so that squared weights differ by a factor of at most
    ``1 + tilt`` even where a third of the rows are near copies. ``ts`` and ``ws`` list terms and weights, rarest (heaviest) first. ``p`` is the
    length of the prefix that is posted: what follows cannot reach ``threshold`` by itself, bounded by its residual norm
    and by its products with the maximal weights (a term weighs at most its raw weight over the smallest norm).
    ``b0``, ``b1`` are a bitmap of the terms.
    Rows with a null key and rows with null or empty terms have no vector; repeated terms count once.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    named = rows.withColumn("terms", F.array_distinct(F.array_compact("terms"))).where("key is not null and size(terms) > 0")
    extra = [c for c in named.columns if c not in ("key", "terms")]
    stats = cut(named.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")))
    n_rows, n_terms, most = named.count(), *stats.agg(F.count("*"), F.max("df")).first()
    flat = named.select("key", *extra, F.explode("terms").alias("t")).join(broadcast_if_few(stats, n_terms, 48), "t")
    listed = flat.groupBy("key", *extra).agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("v"))
    rarity = lambda x: F.log(1 + F.lit(float(n_rows)) / x["df"])
    raw = F.transform("v", rarity if tilt is None else lambda x: F.sqrt(1 + tilt * rarity(x) / math.log(1 + max(n_rows, 1))))
    measured = listed.select("key", *extra, F.transform("v", lambda x: x["t"]).alias("ts"), raw.alias("raw"))
    measured = measured.withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, r: a + r * r)))
    bit = lambda t: F.pmod(F.shiftrightunsigned(F.xxhash64(t), 9), F.lit(128))
    bitmap = lambda half: F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: F.when(F.floor(bit(t) / 64) == half, a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(t) % 64).cast("int")))).otherwise(a))
    whole = cut(measured.select("key", *extra, "ts", F.transform("raw", lambda r: (r / F.col("norm")).cast("float")).alias("ws"), "raw", "norm", bitmap(0).alias("b0"), bitmap(1).alias("b1")))
    smallest = whole.agg(F.min("norm")).first()[0] or 1.0
    return whole.withColumn("p", _prefix(F.col("raw"), F.col("norm"), smallest, threshold)).drop("raw", "norm"), most or 0


def _prefix(raw: Column, norm: Column, smallest: float, threshold: float) -> Column:
    """Number of leading terms that are posted: from the back, terms are left out while both bounds stay below the threshold."""

    def add(a: Column, r: Column) -> Column:
        square = a["square"] + (r / norm) * (r / norm)
        product = a["product"] + r / norm * r / F.lit(smallest)
        reaches = F.least(F.sqrt(square), product) >= threshold - _EPS
        return F.struct(square.alias("square"), product.alias("product"), (a["p"] + reaches.cast("int")).alias("p"))

    return F.aggregate(F.reverse(raw), F.struct(F.lit(0.0).alias("square"), F.lit(0.0).alias("product"), F.lit(0).alias("p")), add)["p"]


def _posted(vectors: DataFrame) -> DataFrame:
    """Inverted lists of the prefixes: ``t``, ``key``, ``cls``, ``side``, weight ``w``, norm ``rest`` of what follows, size ``n``, bitmap."""
    spent = F.aggregate(F.slice("ws", 1, F.col("i") + 1), F.lit(0.0), lambda a, w: a + w * w)
    each = vectors.select("key", "cls", "side", "ws", F.size("ts").alias("n"), "b0", "b1", F.posexplode(F.slice("ts", 1, F.col("p"))).alias("i", "t"))
    return each.select("t", "key", "cls", "side", F.get("ws", F.col("i")).cast("double").alias("w"), F.sqrt(F.greatest(1 - spent, F.lit(0.0))).alias("rest"), "n", "b0", "b1")


def _may_reach(threshold: float) -> Column:
    """Whether two postings of one list can belong to a pair at the threshold, if the list is their first common one.

    Two bounds: the product in this list plus the residual norms; and the number of terms the bitmaps leave possible
    times the weights in this list, which are the largest of what follows.
    """
    residual = F.col("w") * F.col("w_2") + F.col("rest") * F.col("rest_2")
    only = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    common = F.least(F.col("n") - only("b0", "b0_2") - only("b1", "b1_2"), F.col("n_2") - only("b0_2", "b0") - only("b1_2", "b1"))
    return (residual >= threshold - _EPS) & (common * F.col("w") * F.col("w_2") >= threshold - _EPS)


def _second(posted: DataFrame) -> DataFrame:
    return posted.select("t", *[F.col(c).alias(c + "_2") for c in posted.columns if c != "t"])


def _verified(found: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Candidates (``key``, ``key_2``, ``cls``, ``cls_2``) whose exact dot product reaches the threshold, with ``cosine``."""
    found = cut(found.select("key", "key_2", "cls", "cls_2").distinct())
    n = found.count()
    lean = vectors.select("key", "ts", "ws")
    one = broadcast_if_few(found, n, 80).join(lean, "key")
    both = lean.select(F.col("key").alias("key_2"), F.col("ts").alias("ts_2"), F.col("ws").alias("ws_2")).join(broadcast_if_few(one, n, 1_000), "key_2")
    place = lambda ts, ws, t: F.element_at(ws, F.array_position(ts, t).cast("int")).cast("double")
    dot = F.aggregate(F.array_intersect("ts", "ts_2"), F.lit(0.0), lambda a, t: a + place("ts", "ws", t) * place("ts_2", "ws_2", t))
    return both.select("key", "key_2", "cls", "cls_2", dot.alias("cosine")).where(F.col("cosine") >= threshold - _EPS)


def cosine_pairs(vectors: DataFrame, longest: int, threshold: float) -> DataFrame:
    """All pairs of an indexed vector and another one with cosine of at least ``threshold`` in different classes.

    ``vectors``, ``longest``: as of ``weighted_vectors``, with ``cls`` and ``side`` (1: indexed, 0: probing only). Exact: ``key``,
    ``key_2``, ``cls``, ``cls_2``, ``cosine``; pairs of two indexed vectors come once. Lists that are hot are joined in
    blocks of postings of either side, so no task holds one. The result has every pair; ``cosine_links`` gives what is
    needed to form classes.
    """
    posted = _posted(vectors)
    index, probe = posted.where("side = 1"), _second(posted)
    keys = ["t"]
    if longest >= LONG_LIST:
        counts = posted.groupBy("t").agg(F.ceil(F.sum("side") / LIST_BLOCK).cast("int").alias("l"), F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("r")).where("r > 1 and l > 0")
        index, probe = _blocks(index, probe, counts)
        keys = ["t", "bl", "br"]
    pairs = index.join(probe, keys).where((F.col("cls") != F.col("cls_2")) & ((F.col("side_2") == 0) | (F.col("key") < F.col("key_2")))).where(_may_reach(threshold))
    return _verified(pairs, vectors, threshold)


def _blocks(left: DataFrame, right: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the lists with block numbers ``bl``, ``br``: the join on them meets every pair of a list once.

    ``counts``: t, l, r (blocks of either side) of the lists that need blocks; a list in it stands in ``LIST_BLOCK``
    vectors or more, so the table is small against the postings.
    """
    few = cut(counts)
    few = broadcast_if_few(few, few.count(), 64)
    span = lambda c: F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)
    left = left.join(few, "t", "left").withColumn("bl", F.pmod(F.xxhash64("key"), F.coalesce("l", F.lit(1))).cast("int")).withColumn("br", F.explode(span(F.col("r")))).drop("l", "r")
    right = right.join(few, "t", "left").withColumn("br", F.pmod(F.xxhash64("key_2"), F.coalesce("r", F.lit(1))).cast("int")).withColumn("bl", F.explode(span(F.col("l")))).drop("l", "r")
    return left, right


def cosine_links(vectors: DataFrame, longest: int, threshold: float, rounds: int = 4) -> DataFrame:
    """Links between classes of vectors: ``a``, ``b``, such that links and classes connect exactly what chains of similar pairs connect.

    ``vectors``, ``longest``: as for ``cosine_pairs``; vectors of one class belong together already. Where a list is hot, its
    members are compared with one indexed member each (another one each round) and the classes merged, so near copies
    collapse before pairs are listed. Inside hot lists, members outside the largest class are then compared with all.
    """
    if longest < LONG_LIST:
        return cosine_pairs(vectors, longest, threshold).select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).distinct()
    links, now = None, vectors
    for number in range(rounds):
        posted = _posted(now)
        lists = posted.groupBy("t").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min_by(F.when(F.col("side") == 1, F.struct("key", "cls")), F.when(F.col("side") == 1, F.xxhash64("key", F.lit(number)))).alias("leader"))
        long = cut(lists.where((F.col("n") >= LONG_LIST) & (F.col("lo") != F.col("hi")) & F.col("leader").isNotNull()).select("t", F.col("leader.key").alias("key_2"), F.col("leader.cls").alias("cls_2")))
        n_long = long.count()
        if not n_long:
            break
        told = posted.select("t", "key", "cls").join(broadcast_if_few(long, n_long, 64), "t").where("cls <> cls_2")
        found = cut(_verified(told, now, threshold).select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).distinct())
        if not found.limit(1).count():
            break
        links = found if links is None else links.unionByName(found)
        merged = cut(hash_to_min(found).select(F.col("node").alias("cls"), "component"))
        now = cut(now.join(broadcast_if_few(merged, merged.count(), 48), "cls", "left").withColumn("cls", F.coalesce("component", "cls")).drop("component"))
    posted = _posted(now)
    long = posted.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= LONG_LIST).select("t")
    long = cut(long)
    long = broadcast_if_few(long, long.count(), 32)
    short, hot = posted.join(long, "t", "left_anti"), posted.join(long, "t", "left_semi")
    pairs = short.where("side = 1").join(_second(short), "t").where((F.col("cls") != F.col("cls_2")) & ((F.col("side_2") == 0) | (F.col("key") < F.col("key_2")))).where(_may_reach(threshold)).select("key", "key_2", "cls", "cls_2")
    by_class = hot.groupBy("t", "cls").agg(F.count("*").alias("n"))
    most = cut(by_class.groupBy("t").agg(F.max_by("cls", F.struct("n", "cls")).alias("most"), F.sum("n").alias("n"), F.max("n").alias("own")).where("n > own"))
    few = broadcast_if_few(most.select("t", "most"), most.count(), 64)
    left = hot.join(few, "t").where("cls <> most")
    right = _second(hot).join(few, "t").withColumn("main", F.col("cls_2") == F.col("most")).drop("most")
    left, right = _blocks(left.drop("most"), right, most.select("t", F.ceil((F.col("n") - F.col("own")) / LIST_BLOCK).cast("int").alias("l"), F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("r")))
    wide = left.join(right, ["t", "bl", "br"]).where((F.col("cls") != F.col("cls_2")) & ((F.col("side") == 1) | (F.col("side_2") == 1)) & (F.col("main") | (F.col("key") < F.col("key_2")))).where(_may_reach(threshold)).select("key", "key_2", "cls", "cls_2")
    last = _verified(pairs.unionByName(wide), now, threshold).select(F.col("cls").alias("a"), F.col("cls_2").alias("b")).distinct()
    # links of later rounds name merged classes, which are classes of the input themselves
    return last if links is None else links.unionByName(last)
