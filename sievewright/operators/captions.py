"""Caption joins with a battery of integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.guards import GuardError
from sievewright.operators.validate import violations


def caption_rules() -> dict[str, Column]:
    """Rules of one caption row."""
    return {
        "bad_digest": F.col("image_sha256").isNull() | ~F.col("image_sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "empty_caption": F.col("caption").isNull() | (F.trim("caption") == ""),
    }


def caption_problems(members: DataFrame, captions: DataFrame) -> DataFrame:
    """What keeps members and captions from joining: ``code``, ``key``.

    ``members``: pair_id, side, image_sha256. ``captions``: image_sha256, caption. A pair needs exactly the sides a and
    b, an image belongs to one pair, every image has one caption, and no caption is left over.
    """
    def code(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("code"), F.col(key).cast("string").alias("key"))

    sides = members.groupBy("pair_id").agg(F.array_sort(F.collect_list("side")).alias("s"))
    shared = members.groupBy("image_sha256").agg(F.count_distinct("pair_id").alias("n")).where("n > 1 and image_sha256 is not null")
    twice = captions.groupBy("image_sha256").count().where("count > 1")
    parts = [
        violations(captions, "image_sha256", caption_rules()),
        code(sides.where(F.col("s") != F.array(F.lit("a"), F.lit("b"))), "sides", "pair_id"),
        code(shared, "shared_image", "image_sha256"),
        code(twice, "repeated_caption", "image_sha256"),
        code(members.where("image_sha256 is null"), "no_image", "pair_id"),
        code(members.where("image_sha256 is not null").join(captions, "image_sha256", "left_anti"), "missing_caption", "image_sha256"),
        code(captions.join(members, "image_sha256", "left_anti"), "extra_caption", "image_sha256"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def caption_pairs(members: DataFrame, captions: DataFrame, strict: bool = True) -> DataFrame:
    """Pairs with both captions: ``pair_id``, ``caption_a``, ``caption_b``. Raises on any problem if ``strict``."""
    if strict:
        bad = caption_problems(members, captions).limit(3).collect()
        if bad:
            raise GuardError(f"captions do not fit: {[tuple(r) for r in bad]}")
    joined = members.join(captions.select("image_sha256", "caption"), "image_sha256")
    by_side = lambda s: F.max(F.when(F.col("side") == s, F.col("caption"))).alias(f"caption_{s}")
    return joined.groupBy("pair_id").agg(by_side("a"), by_side("b")).where("caption_a is not null and caption_b is not null")


def captions_in_order(rows: DataFrame, key: str, images: str, captions: DataFrame, path: str) -> DataFrame:
    """The captions of an array of images in its order, null if any is missing: ``key``, ``captions``."""
    each = rows.select(key, F.size(images).alias("n"), F.posexplode(images).alias("at", path))
    joined = each.join(captions.select(path, "caption"), path)
    grouped = joined.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("at", "caption"))).alias("c"))
    return grouped.select(key, F.when(F.size("c") == F.col("n"), F.transform("c", lambda x: x["caption"])).alias("captions"))
