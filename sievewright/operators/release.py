"""Linting of a packaged release of pairs against its private key and its files: violations are rows of code and pair."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.answers import match_tier
from sievewright.functions.text import is_opaque_id, is_opaque_path
from sievewright.operators.validate import FORBIDDEN
from sievewright.session import cut

#: Least number of files of a side, least distance and largest p-value of a gross separation of file sizes.
GROSS_FILES, GROSS_DISTANCE, GROSS_P = 4, 0.8, 0.05
#: Checks of a release and the codes that fail them.
CHECKS = {
    "pair_and_member_ids_unique_opaque": ("duplicate_pair_id", "duplicate_member_id", "nonopaque_id"),
    "paths_uniform_and_nonleaky": ("leaky_id", "leaky_path", "unsafe_path", "nonuniform_path", "nonopaque_filename"),
    "files_exist_and_are_png": ("missing_file", "invalid_png"),
    "timestamps_equalized": ("mtime_mismatch",),
    "dimensions_match": ("dimension_mismatch", "mask_dimension_mismatch"),
    "png_ancillary_chunks_absent": ("png_ancillary_chunk",),
    "masks_truthful": ("untruthful_mask",),
    "answers_distinguishable": ("answers_cross_match",),
    "member_order_randomized": ("member_order_not_randomized",),
    "file_size_separation_not_gross": ("gross_file_size_separation",),
    "private_key_complete": ("missing_key", "key_member_mismatch", "invalid_source_side"),
}
_OUT = ("code", "pair_id")


def ks_p_value(n: int, m: int, distance: float) -> float:
    """Two-sided p-value of a two-sample Kolmogorov-Smirnov distance of samples of ``n`` and ``m`` values.

    Up to 10,000 values a sample it is exact: the share of lattice paths from (0, 0) to (n, m) that leave the band
    ``|i / n - j / m| < distance``, added up row by row. Beyond, the series of the limit distribution is used.
    """
    if max(n, m) > 10_000:
        x = distance * np.sqrt(n * m / (n + m))
        k = np.arange(1, 101)
        return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * x) ** 2)), 0, 1))
    j = np.arange(m + 1)
    inside = lambda i: np.abs(i / n - j / m) < distance - 1e-12
    stays = np.cumprod(inside(0)).astype(float)
    for i in range(1, n + 1):
        # the chance that the path to (i, j) stays inside: it comes from the left with j / (i + j), else from below
        row, ok, left = np.zeros(m + 1), inside(i), 0.0
        for k in range(m + 1):
            left = (left * k + stays[k] * i) / (i + k) if ok[k] else 0.0
            row[k] = left
        stays = row
    return float(np.clip(1 - stays[m], 0, 1))


def lint(manifest: DataFrame, keys: DataFrame, files: DataFrame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """All violations of a release: ``code``, ``pair_id`` (null for those of the whole release).

    ``manifest``: pair_id, members (array of struct of member_id, image_path, mask_path). ``keys``: pair_id,
    template_id, members (array of struct of member_id, source_side, answer). ``files``: path, bytes, mtime, chunks
    (null for what is no PNG), width, height; ``pixels``: pair_id, outside (changed pixels outside both masks). Checks
    of files and pixels are left out where these are not given. A row that lacks two members, its key or the key's
    members is checked no further, as what follows has no meaning. Null ids and paths count as empty.
    """
    words = F.array_distinct(F.flatten(F.collect_set(_words(F.col("template_id")))))
    telling = keys.agg(F.concat(F.coalesce(words, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in FORBIDDEN])).alias("telling"))
    rows = manifest.select(F.coalesce("pair_id", F.lit("")).alias("pair_id"), F.coalesce("members", F.array()).alias("members")).crossJoin(F.broadcast(telling))
    found = [
        rows.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1").select(F.explode(F.array_repeat(F.lit("duplicate_pair_id"), (F.col("n") - 1).cast("int"))).alias("code"), "pair_id"),
        _hits(rows, {"nonopaque_id": ~is_opaque_id(F.col("pair_id")), "leaky_id": _tells(F.col("pair_id")), "member_count": F.size("members") != 2}),
    ]
    key = keys.select(F.coalesce("pair_id", F.lit("")).alias("pair_id"), "template_id", F.col("members").alias("key_members")).dropDuplicates(["pair_id"])
    joined = cut(rows.where(F.size("members") == 2).join(key, "pair_id", "left"))
    ids = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda m: F.coalesce(m["member_id"], F.lit("")))))
    mismatch = F.col("key_members").isNotNull() & (ids(F.col("key_members")) != ids(F.col("members")))
    found.append(_hits(joined, {"missing_key": F.col("key_members").isNull(), "key_member_mismatch": mismatch}))
    whole = joined.where(F.col("key_members").isNotNull() & ~mismatch)
    side = lambda m: F.get(F.filter("key_members", lambda k: F.coalesce(k["member_id"], F.lit("")) == F.coalesce(m["member_id"], F.lit(""))), F.lit(0))
    whole = whole.withColumn("order", F.array_join(F.transform("members", lambda m: F.coalesce(side(m)["source_side"], F.lit("?"))), ""))
    answer = lambda s: F.get(F.filter("key_members", lambda k: k["source_side"] == s), F.lit(0))["answer"]
    whole = cut(whole.withColumn("a", answer("a")).withColumn("b", answer("b")))
    alike = (match_tier(F.col("a"), F.col("b")) > 0) | (match_tier(F.col("b"), F.col("a")) > 0)
    found.append(_hits(whole, {"invalid_source_side": ~F.col("order").isin("ab", "ba"), "answers_cross_match": F.col("a").isNotNull() & F.col("b").isNotNull() & alike}))
    orders = manifest.agg(F.count("*").alias("rows")).crossJoin(whole.agg(F.count_if(F.col("order") == "ab").alias("ab"), F.count_if(F.col("order") == "ba").alias("ba")))
    found.append(orders.where("rows >= 4 and (ab = 0 or ba = 0)").select(F.lit("member_order_not_randomized").alias("code"), F.lit(None).cast("string").alias("pair_id")))
    each = whole.select("pair_id", "template_id", "telling", "key_members", F.explode("members").alias("m"))
    members = each.select("pair_id", "template_id", "telling", F.coalesce("m.member_id", F.lit("")).alias("member_id"), side(F.col("m"))["source_side"].alias("side"), F.coalesce("m.image_path", F.lit("")).alias("image_path"), F.coalesce("m.mask_path", F.lit("")).alias("mask_path"))
    found.append(_hits(members, {"nonopaque_id": ~is_opaque_id(F.col("member_id")), "leaky_id": _tells(F.col("member_id"))}))
    again = members.groupBy("member_id").agg(F.count("*").alias("n"), F.max("pair_id").alias("pair_id")).where("n > 1")
    found.append(again.select(F.explode(F.array_repeat(F.lit("duplicate_member_id"), (F.col("n") - 1).cast("int"))).alias("code"), "pair_id"))
    paths = members.select("pair_id", "template_id", "telling", "member_id", "side", F.explode(F.array(F.struct(F.lit("images").alias("folder"), F.col("image_path").alias("path")), F.struct(F.lit("masks").alias("folder"), F.col("mask_path").alias("path")))).alias("p")).select("pair_id", "template_id", "telling", "member_id", "side", "p.*")
    parts = F.filter(F.split("path", "/"), lambda x: (x != "") & (x != "."))
    paths = paths.withColumn("parts", parts).withColumn("unsafe", F.col("path").startswith("/") | F.array_contains("parts", ".."))
    name = F.coalesce(F.get("parts", F.size("parts") - 1), F.lit(""))
    safe = ~F.col("unsafe")
    found.append(_hits(paths, {
        "unsafe_path": F.col("unsafe"),
        "nonuniform_path": safe & ((F.size("parts") != 2) | (F.get("parts", F.lit(0)) != F.col("folder"))),
        "nonopaque_filename": safe & ~is_opaque_path(name),
        "leaky_path": safe & _tells(F.col("path")),
    }))
    if files is not None:
        found += _of_files(paths.where(safe), files)
    if pixels is not None:
        found.append(pixels.join(whole.select("pair_id").distinct(), "pair_id").where("outside > 0").select(F.lit("untruthful_mask").alias("code"), "pair_id"))
    out = found[0].select(*_OUT)
    for f in found[1:]:
        out = out.unionByName(f.select(*_OUT))
    return out


def _words(template: Column) -> Column:
    """Telling words of a template name: four letters or more, no version."""
    return F.filter(F.split(F.lower(F.coalesce(template, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.rlike(r"\Av\d+\z"))


def _tells(c: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.col("telling"))


def _hits(rows: DataFrame, codes: dict[str, Column]) -> DataFrame:
    hit = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in codes.items()]))
    return rows.select(F.explode(hit).alias("code"), "pair_id")


def _of_files(paths: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Violations that need the files: absent, no PNG, ancillary chunks, times, dimensions, file sizes by side."""
    there = files.select("path", F.lit(True).alias("present"), "bytes", "mtime", "chunks", "width", "height")
    held = paths.join(there, "path", "left")
    png = F.col("present") & F.col("chunks").isNotNull()
    found = [_hits(held, {
        "missing_file": F.col("present").isNull(),
        "invalid_png": F.col("present") & F.col("chunks").isNull(),
        "png_ancillary_chunk": png & F.exists("chunks", lambda c: c.rlike(r"\A[a-z]")),
    })]
    times = held.where("present").agg(F.count_distinct("mtime").alias("n")).where("n > 1")
    found.append(times.select(F.lit("mtime_mismatch").alias("code"), F.lit(None).cast("string").alias("pair_id")))
    size = F.struct("width", "height")
    pair = held.where(png).groupBy("pair_id").agg(F.collect_list(F.when(F.col("folder") == "images", size)).alias("images"), F.collect_list(F.when(F.col("folder") == "masks", size)).alias("masks")).where("size(images) = 2 and size(masks) = 2")
    found.append(_hits(pair, {"dimension_mismatch": F.col("images")[0] != F.col("images")[1], "mask_dimension_mismatch": F.exists("masks", lambda m: m != F.col("images")[0])}))
    both = held.where(png).groupBy("pair_id", "member_id").agg(F.count_distinct("folder").alias("n")).where("n = 2")
    sized = held.where((F.col("folder") == "images") & F.col("side").isin("a", "b") & png).join(both, ["pair_id", "member_id"], "left_semi")

    def gross(pdf: pd.DataFrame) -> pd.DataFrame:
        # sizes are counted, so a template is a table of distinct sizes
        pdf = pdf.sort_values("bytes")
        out = lambda k: pd.DataFrame({"code": pd.Series(["gross_file_size_separation"] * k, dtype=object), "pair_id": pd.Series([None] * k, dtype=object)})
        a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
        n, m = int(a.sum()), int(b.sum())
        if n < GROSS_FILES or not m:
            return out(0)
        distance = float(np.abs(np.cumsum(a) / n - np.cumsum(b) / m).max())
        bad = distance >= GROSS_DISTANCE and ks_p_value(n, m, distance) <= GROSS_P
        return out(int(bad))

    counted = sized.groupBy(F.coalesce("template_id", F.lit("")).alias("template_id"), "bytes").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    found.append(counted.groupBy("template_id").applyInPandas(gross, "code string, pair_id string"))
    return found


def check_status(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of the checks of a release: ``check``, ``passed``; a release without rows fails ``manifest_nonempty``."""
    spark = found.sparkSession
    names = spark.createDataFrame([(check, code) for check, codes in CHECKS.items() for code in codes], "check string, code string")
    counted = F.broadcast(names).join(found.groupBy("code").count(), "code", "left").groupBy("check").agg((F.max(F.coalesce("count", F.lit(0))) == 0).alias("passed"))
    rows = manifest.agg((F.count("*") > 0).alias("passed")).select(F.lit("manifest_nonempty").alias("check"), "passed")
    return counted.unionByName(rows)
