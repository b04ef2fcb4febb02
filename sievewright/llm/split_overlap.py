"""Records of evaluation splits that also appear, exactly or almost, in the training split.

Rows are linked by what they name (mother item, pair), by image digests and by their scenes; scenes are compared by a
weighted cosine join between the splits (``cosine_join``). Links carry over, so rows fall into classes; overlaps are
the classes with rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.keys import digest_text, item_text, pair_mother_text
from sievewright.llm.components import counted_components
from sievewright.llm.cosine_join import cosine_links, weighted_vectors
from sievewright.session import broadcast_if_few, cut

#: Least weighted cosine of scenes that show the same thing; unrelated scenes agree in fewer than half of their points.
AGREEMENT = 0.5
#: Squared weights of a rare and a frequent point differ by at most this share, so that rarity does not outweigh agreement.
TILT = 0.25
#: Rows of one side of a class that one task joins.
CLASS_BLOCK = 2_000
#: Split that all others are compared with.
TRAIN = "training"


def scene_points(scene: Column) -> Column:
    """A scene as a sorted array of 64-bit terms, one per labelled point; null or empty for a scene without points.

    Points with a null part are left out; repeated points count once.
    """
    whole = F.filter(scene, lambda p: p["label"].isNotNull() & p["x"].isNotNull() & p["y"].isNotNull())
    return F.sort_array(F.array_distinct(F.transform(whole, lambda p: F.xxhash64(F.upper(F.trim(p["label"])), p["x"], p["y"]))))


def scene_rows(scenes: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of the scene table with the 64-bit keys that may link them.

    ``ordinal``, ``split``, ``source``, ``mother``, ``pair``, ``image_a``, ``image_b``, each of these four with a second
    hash (``..._2``) that tells equal keys of unequal content apart, ``shown_a``, ``shown_b``. Null, blank and empty
    parts have no key.
    """
    ids = {"mother": ("m", item_text("mother_item_id")), "pair": ("m", pair_mother_text("pair_id")), "image_a": ("d", digest_text("image_a_sha256")), "image_b": ("d", digest_text("image_b_sha256"))}
    named = scenes.select("ordinal", "split", F.col("provenance.generator").alias("source"), *[c.alias(n) for n, (_, c) in ids.items()], *[scene_points(F.col(f"scene_{s}")).alias(f"points_{s}") for s in "ab"])
    hashed = [F.when(F.col(n) != "", F.xxhash64(F.lit(f"{kind}{seed}{again}"), n)).alias(n + again) for n, (kind, _) in ids.items() for again in ("", "_2")]
    return named.select("ordinal", "split", "source", *hashed, *[_shown(f"points_{s}", seed).alias(f"shown_{s}") for s in "ab"])


def _shown(points: str, seed: int) -> Column:
    """Key of a scene given by its points."""
    return F.when(F.size(points) > 0, F.xxhash64(F.lit(f"s{seed}"), points))


def _distinct_scenes(scenes: DataFrame, seed: int) -> DataFrame:
    """Distinct scenes: ``key``, ``terms``. Raises ``ValueError`` where two scenes have one key."""
    sides = scenes.select(F.explode(F.array("scene_a", "scene_b")).alias("scene")).select(scene_points(F.col("scene")).alias("terms"))
    distinct = cut(sides.where("size(terms) > 0").distinct().withColumn("key", _shown("terms", seed)))
    if distinct.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two contents have one key")
    return distinct


def _known_keys(rows: DataFrame) -> DataFrame:
    """Each id and scene with the smallest and largest anchor of its rows: ``key``, ``low``, ``high``.

    A row's anchor is its first key. Raises ``ValueError`` where two contents have one key.
    """
    pairs = F.array(*[F.struct(F.col(c).alias("key"), F.col(check).alias("check")) for c, check in (("mother", "mother_2"), ("pair", "pair_2"), ("shown_a", "shown_a"), ("shown_b", "shown_b"), ("image_a", "image_a_2"), ("image_b", "image_b_2"))])
    each = rows.select("named", F.explode(pairs).alias("e")).where("e.key is not null")
    known = cut(each.groupBy("e.key").agg(F.min("named").alias("low"), F.max("named").alias("high"), F.min("e.check").alias("check"), F.max("e.check").alias("check_2")))
    if known.where("check <> check_2").limit(1).count():
        raise ValueError("two contents have one key")
    return known.select("key", "low", "high")


def classes(scenes: DataFrame, threshold: float = AGREEMENT, train: str = TRAIN) -> DataFrame:
    """Each row of the scene table with its class: ``ordinal``, ``split``, ``source``, ``class_id``.

    Ids and equal scenes link rows first. Then the scenes of classes with rows of other splits are indexed, and all
    scenes are looked up there by cosine; scenes of classes that join them this way or by an image are indexed in
    further rounds until no scene is new. So training scenes are compared with each other only where that may connect
    rows of different splits: classes are exact for every row that has a row of another split in its class. An image
    digest links classes unless it stands for a failed render: an image shows one scene, so a digest is set aside if
    no class has at least half of the rows with a scene that it sits on. A row without any key is in no class (null).
    Repeated rows are in one class, rows of a null split are in classes but on neither side.
    """
    for seed in range(3):
        try:
            return _classes(scenes, seed, threshold, train)
        except ValueError as e:
            if "one key" not in str(e):
                raise
    raise ValueError("keys clash under three seeds")


class _Labels:
    """Component of each linked node."""

    def __init__(self, links: DataFrame):
        self.nodes, self.n = counted_components(links)

    def of(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Rows with the component of a key, or the key itself where it is in no link."""
        known = broadcast_if_few(self.nodes.select(F.col("node").alias(key), "component"), self.n, 48)
        return rows.join(known, key, "left").withColumn(name, F.coalesce("component", key)).drop("component")


def _classes(scenes: DataFrame, seed: int, threshold: float, train: str) -> DataFrame:
    named = F.coalesce("mother", "pair", "shown_a", "shown_b")
    rows = cut(scene_rows(scenes, seed).withColumn("named", named).withColumn("anchor", F.coalesce("named", "image_a", "image_b")))
    known = _known_keys(rows)
    n_known = known.count()
    vectors, longest = weighted_vectors(_distinct_scenes(scenes, seed).join(broadcast_if_few(known.select("key", "low"), n_known, 48), "key"), threshold, TILT)
    # images link later, when scenes may speak against them
    shared = known.where("low <> high").select("key", F.col("low").alias("a"))
    n_shared = shared.count()
    each = rows.select(F.col("named").alias("b"), F.explode(F.array("mother", "pair", "shown_a", "shown_b")).alias("key"))
    links = cut(each.join(broadcast_if_few(shared, n_shared, 48), "key").where("a <> b").select("a", "b").distinct())
    images = _shared_images(rows)
    held = cut(rows.where(F.col("split") != train).select("anchor").distinct())
    anchors = cut(vectors.select("low").distinct())
    n_anchors, before = anchors.count(), None
    while True:
        near = _Labels(links)
        judged = _judged(near.of(images, "anchor", "cls"))
        whole = _Labels(judged.where("real").select(F.col("first").alias("a"), F.col("cls").alias("b")))
        both = lambda x, key, near=near, whole=whole: whole.of(near.of(x, key, "cls"), "cls", "whole")
        mixed = both(held, "anchor").select("whole").distinct()
        aside = whole.of(judged.where("not real"), "cls", "whole").select("image", "whole").distinct()
        doubtful = aside.join(aside.join(mixed, "whole").select("image").distinct(), "image").select("whole")
        inside = mixed.unionByName(doubtful).distinct().withColumn("inside", F.lit(1))
        state = both(anchors, "low").join(broadcast_if_few(inside, n_anchors, 48), "whole", "left").select("low", "cls", F.coalesce("inside", F.lit(0)).alias("inside"))
        state = cut(state.withColumn("side", F.col("inside")) if before is None else state.join(broadcast_if_few(before, n_anchors, 48), "low").withColumn("side", F.col("inside") - F.col("was")))
        found = None
        if state.where("side = 1").limit(1).count():
            placed = vectors.join(broadcast_if_few(state.select("low", "cls", "side"), n_anchors, 48), "low").drop("low")
            found = cut(cosine_links(placed, longest, threshold))
        if found is None or not found.limit(1).count():
            return both(rows, "anchor").select("ordinal", "split", "source", F.col("whole").alias("class_id"))
        links = links.unionByName(found)
        before = state.select("low", F.col("inside").alias("was"))


def _shared_images(rows: DataFrame) -> DataFrame:
    """Images that sit on several anchors: ``image``, ``anchor``, ``n`` (times with a scene)."""
    sides = F.explode(F.array(*[F.struct(F.col(f"image_{s}").alias("image"), F.col(f"shown_{s}").isNotNull().cast("int").alias("scene")) for s in "ab"]))
    seen = rows.select("anchor", sides.alias("e")).where("e.image is not null").groupBy("e.image", "anchor").agg(F.sum("e.scene").alias("n"))
    seen = cut(seen)
    shared = cut(seen.groupBy("image").agg(F.min("anchor").alias("lo"), F.max("anchor").alias("hi")).where("lo <> hi").select("image"))
    return cut(seen.join(broadcast_if_few(shared, shared.count(), 32), "image"))


def _judged(images: DataFrame) -> DataFrame:
    """Images by class, with the image's first class and whether it is real: ``image``, ``cls``, ``first``, ``real``.

    Real is an image of which one class has at least half of the rows with a scene, or which no scene speaks against.
    """
    by_class = images.groupBy("image", "cls").agg(F.sum("n").alias("n"))
    whole = by_class.groupBy("image").agg(F.min("cls").alias("first"), (2 * F.max("n") >= F.sum("n")).alias("real"))
    return cut(by_class.select("image", "cls").join(whole, "image"))


def overlaps(classed: DataFrame, train: str = TRAIN) -> DataFrame:
    """All pairs of a training row and a row of another split in one class: ``train_ordinal``, ``other_ordinal``, splits and sources.

    Large classes are joined in blocks of rows of either side, so no task holds a whole class.
    """
    sized = classed.where("class_id is not null and split is not null")
    counts = _counted(sized, train).where("n_train > 0 and n_other > 0")
    both = cut(counts.select("class_id", F.ceil(F.col("n_train") / CLASS_BLOCK).cast("int").alias("t"), F.ceil(F.col("n_other") / CLASS_BLOCK).cast("int").alias("o")))
    placed = sized.join(broadcast_if_few(both, both.count(), 64), "class_id")
    left = placed.where(F.col("split") == train).select("class_id", F.col("ordinal").alias("train_ordinal"), F.col("source").alias("train_source"), F.pmod(F.xxhash64("ordinal"), F.col("t")).cast("int").alias("bt"), F.explode(F.sequence(F.lit(0), F.col("o") - 1)).alias("bo"))
    right = placed.where(F.col("split") != train).select("class_id", F.col("ordinal").alias("other_ordinal"), F.col("split").alias("other_split"), F.col("source").alias("other_source"), F.pmod(F.xxhash64("ordinal"), F.col("o")).cast("int").alias("bo"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("bt"))
    return left.join(right, ["class_id", "bt", "bo"]).drop("bt", "bo")


def _counted(sized: DataFrame, train: str) -> DataFrame:
    """Rows of either side by class, and the lowest ordinal of the class."""
    on = F.col("split") == train
    return sized.groupBy("class_id").agg(F.sum(on.cast("long")).alias("n_train"), F.sum((~on).cast("long")).alias("n_other"), F.min("ordinal").alias("first_ordinal"))


def class_links(classed: DataFrame, train: str = TRAIN) -> DataFrame:
    """One row per record: the class in which it overlaps with rows of the other side, and the number of those rows.

    The class is named by its lowest ordinal; it is null, with no links, for a row that overlaps with nothing.
    """
    counts = _counted(classed.where("class_id is not null"), train).where("n_train > 0 and n_other > 0")
    both = cut(counts)
    links = F.when(F.col("split") == train, F.col("n_other")).when(F.col("split").isNotNull(), F.col("n_train"))
    found = classed.join(broadcast_if_few(both, both.count(), 64), "class_id", "left").withColumn("n_links", F.coalesce(links, F.lit(0)))
    return found.select("ordinal", "split", "source", F.when(F.col("n_links") > 0, F.col("first_ordinal")).alias("class_id"), "n_links")


def overlap_report(classed: DataFrame, train: str = TRAIN) -> DataFrame:
    """Pairs and rows per split and source of both sides, from counts per class without listing the pairs."""
    sized = classed.where("class_id is not null and split is not null")
    counts = sized.groupBy("class_id", "split", "source").agg(F.count("*").alias("n"))
    left = counts.where(F.col("split") == train).select("class_id", F.col("source").alias("train_source"), F.col("n").alias("n_train"))
    right = counts.where(F.col("split") != train).select("class_id", F.col("split").alias("other_split"), F.col("source").alias("other_source"), F.col("n").alias("n_other"))
    return left.join(right, "class_id").groupBy("other_split", "other_source", "train_source").agg(F.sum(F.col("n_train") * F.col("n_other")).alias("n_pairs"), F.sum("n_other").alias("n_other_rows"), F.sum("n_train").alias("n_train_rows"))
