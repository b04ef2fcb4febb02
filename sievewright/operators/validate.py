"""Constraint batteries: every code is a filter; violations are rows of code and id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that must not appear in released paths or ids, since they tell the side. The words of template
#: names are forbidden as well.
FORBIDDEN = ["side", "answer", "template", "left", "right"]
_SIZES = {"n8": 8, "n12": 12, "n20": 20}


def violations(rows: DataFrame, key: str, codes: dict[str, Column]) -> DataFrame:
    """Rows that break a rule: ``code``, ``key``. One scan for all row rules; a null condition is no violation."""
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in sorted(codes.items())]))
    return rows.select(F.col(key).alias("key"), F.explode(hit).alias("code")).select("code", "key")


def scene_rules() -> dict[str, Column]:
    """Rules of one scene row: layer, role, cell size, unique labels, bounds, answers, digests, templates."""
    digest = r"\A[0-9a-f]{64}\z"
    labels = lambda c: F.transform(c, lambda p: p["label"])
    return {
        "bad_layer": ~F.col("layer").isin("l1", "l2", "l3", "probe"),
        "bad_role": ~F.col("role").isin("target_stable", "target_switch", "invariance"),
        "cell_size": F.size("scene_a") != reduce(lambda w, kv: w.when(F.col("cell") == kv[0], kv[1]), list(_SIZES.items())[1:], F.when(F.col("cell") == "n8", 8)),
        "repeated_label_a": F.size(F.array_distinct(labels(F.col("scene_a")))) != F.size("scene_a"),
        "repeated_label_b": F.size(F.array_distinct(labels(F.col("scene_b")))) != F.size("scene_b"),
        "out_of_bounds": F.exists("scene_a", lambda p: (F.abs(p["x"]) > 7) | (F.abs(p["y"]) > 7)),
        "answers_equal": F.col("answers_equal") != (F.col("answer_a") == F.col("answer_b")),
        "bad_digest_a": ~F.col("image_a_sha256").rlike(digest),
        "bad_digest_b": ~F.col("image_b_sha256").rlike(digest),
        "same_images": F.col("image_a_sha256") == F.col("image_b_sha256"),
        "no_question": F.col("question").isNull() | (F.trim("question") == ""),
        "no_scene": F.col("scene_a").isNull() | F.col("scene_b").isNull(),
        "n_points": F.col("verifier_results.n_points") != F.size("scene_a"),
        "not_exact": ~F.col("verifier_results.exact_by_construction"),
        "layer_differs": F.col("verifier_results.layer") != F.col("layer"),
    }


def scene_violations(scenes: DataFrame) -> DataFrame:
    """Violations of the scene rules and repeated pair ids: ``code``, ``key`` (the ordinal, or the pair id)."""
    rows = violations(scenes.withColumn("k", F.col("ordinal").cast("string")), "k", scene_rules())
    repeated = scenes.where(F.col("pair_id").isNotNull()).groupBy("pair_id").count().where("count > 1").select(F.lit("repeated_pair").alias("code"), F.col("pair_id").alias("key"))
    return rows.unionByName(repeated)


def battery_status(found: DataFrame, codes: list[str]) -> DataFrame:
    """Count and status of every check: ``code``, ``n``, ``passed``. Checks without a violation are listed with 0."""
    names = found.sparkSession.createDataFrame([(c,) for c in sorted(codes)], "code string")
    counted = found.groupBy("code").agg(F.count("*").alias("n"))
    return names.join(counted, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("passed"))


def file_status(manifest: DataFrame, disk: DataFrame, key: str) -> DataFrame:
    """Manifest entries against files found: ``present``, ``matches`` and what is wrong. Both sides: key, bytes, sha256."""
    there = disk.select(key, F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    joined = manifest.join(there, key, "left")
    same = (F.col("bytes") == F.col("found_bytes")) & (F.col("sha256") == F.col("found_sha256"))
    problem = F.when(F.col("found_bytes").isNull(), "absent").when(F.col("bytes") != F.col("found_bytes"), "size differs").when(F.col("sha256") != F.col("found_sha256"), "digest differs")
    return joined.select(key, F.col("found_bytes").isNotNull().alias("present"), F.coalesce(same, F.lit(False)).alias("matches"), problem.alias("problem"))


def shard_status(index: DataFrame, disk: DataFrame) -> DataFrame:
    """Shards that an index names against the shards found: ``shard`` and ``status``.

    ``index``: shard (one row a weight), sha256 (null where the index has none); ``disk``: shard, sha256. Status is
    ``ok``, ``missing``, ``not indexed``, ``digest differs`` or ``digest unknown``. Shards named by several rows count
    once; two digests of one shard in the index count as a difference.
    """
    named = index.where("shard is not null").groupBy("shard").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    there = disk.where("shard is not null").groupBy("shard").agg(F.min("sha256").alias("found"), F.lit(True).alias("present"))
    both = named.withColumn("indexed", F.lit(True)).join(there, "shard", "full")
    differs = (F.col("lo") != F.col("hi")) | F.coalesce(F.col("lo") != F.col("found"), F.lit(False))
    status = F.when(F.col("present").isNull(), "missing").when(F.col("indexed").isNull(), "not indexed").when(differs, "digest differs").when(F.col("lo").isNull() | F.col("found").isNull(), "digest unknown").otherwise("ok")
    return both.select("shard", status.alias("status"))


def adjacency(rows: DataFrame, group: str, ordinal: str, members: list[str], member: str) -> DataFrame:
    """Blocks of consecutive rows that do not hold one group with its members in order: ``block``."""
    n = len(members)
    block = rows.groupBy(F.floor(F.col(ordinal) / n).alias("block")).agg(F.count_distinct(group).alias("g"), F.transform(F.array_sort(F.collect_list(F.struct(ordinal, member))), lambda x: x[member]).alias("m"))
    return block.where((F.col("g") != 1) | (F.col("m") != F.array(*[F.lit(x) for x in members]))).select("block")


def artifact_score(auc: Column, floor: float = 0.5, ceiling: float = 1.0) -> Column:
    """Distance of an area under the curve from chance, scaled and clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(auc - floor) / (ceiling - floor)))


def gate(auc: Column, high: Column) -> Column:
    """Whether a leak attack stays below its limits: area at most .55 and upper bound at most .62."""
    return (auc <= 0.55) & (high <= 0.62)
