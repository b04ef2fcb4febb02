"""Every code of the release linter on small releases, the p-value of the file sizes, and row numbers."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from sievewright.operators import release
from sievewright.operators.ordering import numbered

MANIFEST = "pair_id string, members array<struct<member_id:string,image_path:string,mask_path:string>>"
KEYS = "pair_id string, template_id string, members array<struct<member_id:string,source_side:string,answer:string>>"
FILES = "path string, bytes long, mtime long, chunks array<string>, width int, height int"
PLAIN = ["IHDR", "IDAT", "IEND"]


def h(x):
    return f"{x:016x}"


def good(n=6):
    manifest, keys, files = [], [], []
    for i in range(n):
        ids = [h(100 + 2 * i), h(101 + 2 * i)]
        members = [(m, f"images/{m}.png", f"masks/{m}.png") for m in ids]
        manifest.append((h(i), members[:: -1 if i % 2 else 1]))
        keys.append((h(i), "chart_tall_v2", [(ids[0], "a", "red"), (ids[1], "b", "blue")]))
        files += [(p, 500 + 7 * i, 1, PLAIN, 8, 8) for m in members for p in m[1:]]
    return manifest, keys, files


def codes(spark, manifest, keys, files, outside=()):
    pixels = spark.createDataFrame(list(outside), "pair_id string, outside long")
    found = release.lint(spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(keys, KEYS), spark.createDataFrame(files, FILES), pixels)
    return sorted(r["code"] for r in found.collect())


def test_a_good_release_and_an_empty_one(spark):
    m, k, f = good()
    assert codes(spark, m, k, f) == []
    assert codes(spark, [], [], []) == []
    none = spark.createDataFrame([], MANIFEST)
    status = {r["check"]: r["passed"] for r in release.check_status(release.lint(none, spark.createDataFrame([], KEYS)), none).collect()}
    assert not status.pop("manifest_nonempty") and all(status.values()) and len(status) == 11


def with_path(row, path):
    return row[0], [(row[1][0][0], path, row[1][0][2]), row[1][1]]


def test_every_code_of_pairs(spark):
    """One defect a pair, all found at that pair and nothing else."""
    m, k, f = good(14)
    f = {x[0]: x for x in f}
    image = lambda i: sorted(m[i][1])[0][1]
    want = []
    m += [m[0], ("chart", []), (None, None)]
    want += [("duplicate_pair_id", h(0)), ("duplicate_member_id", h(0)), ("duplicate_member_id", h(0))]
    want += [(c, p) for c, p in (("nonopaque_id", "chart"), ("leaky_id", "chart"), ("member_count", "chart"), ("nonopaque_id", ""), ("member_count", ""))]
    k[1] = (k[1][0], "t", [(h(7), "a", "x"), (h(8), "b", "y")])
    k[2] = (k[2][0], "t", [(i, "a", "red") for i, _, _ in k[2][2]])
    k[3] = (k[3][0], "t", [(i, s, "5") for i, s, _ in k[3][2]])
    want += [("key_member_mismatch", h(1)), ("invalid_source_side", h(2)), ("answers_cross_match", h(3))]
    for i, path, found in ((4, "../x.png", ["unsafe_path"]), (5, "/images/0.png", ["unsafe_path"]), (6, f"masks/{h(112)}.png", ["nonuniform_path"]), (7, "images/tall.png", ["leaky_path", "missing_file", "nonopaque_filename"]), (8, f"images/{h(9)}.png", ["missing_file"])):
        m[i] = with_path(m[i], path)
        want += [(c, h(i)) for c in found]
    f[image(9)] = (image(9), 1, 1, None, None, None)
    f[image(10)] = (*f[image(10)][:3], ["IHDR", "tEXt"], 8, 8)
    f[image(11)] = (*f[image(11)][:4], 9, 8)
    f[image(11).replace("images", "masks")] = (image(11).replace("images", "masks"), 1, 1, PLAIN, 9, 8)
    want += [("invalid_png", h(9)), ("png_ancillary_chunk", h(10)), ("dimension_mismatch", h(11)), ("mask_dimension_mismatch", h(11)), ("untruthful_mask", h(12)), ("missing_key", h(13))]
    pixels = spark.createDataFrame([(h(12), 3), (h(10), 0)], "pair_id string, outside long")
    found = release.lint(spark.createDataFrame(m, MANIFEST), spark.createDataFrame(k[:13], KEYS), spark.createDataFrame(list(f.values()), FILES), pixels)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_codes_of_the_whole_release(spark):
    m, k, f = good()
    left = {i for _, _, x in k for i, s, _ in x if s == "a"}
    apart = [(p, b + 1000 * (p.split("/")[1][:16] in left), n % 2, *r) for n, (p, b, _, *r) in enumerate(f)]
    assert codes(spark, [(p, sorted(x)) for p, x in m], k, apart) == ["gross_file_size_separation", "member_order_not_randomized", "mtime_mismatch"]


def test_p_value_against_all_orders():
    for n, m in ((3, 4), (4, 4), (5, 2)):
        found = []
        for at in itertools.combinations(range(n + m), n):
            a = np.cumsum([i in at for i in range(n + m)]) / n
            b = np.cumsum([i not in at for i in range(n + m)]) / m
            found.append(np.abs(a - b).max())
        for d in set(np.round(found, 12)):
            assert abs(release.ks_p_value(n, m, d) - np.mean(np.array(found) >= d - 1e-9)) < 1e-9
    assert abs(release.ks_p_value(20_000, 20_000, 0.0136) - 0.0494) < 0.003


def test_numbers_over_the_whole_table(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_003).alias("v"), F.lit("x").alias("place")).repartition(13)
    got = sorted((r["v"], r["place"]) for r in numbered(df, "v", name="place").collect())
    assert [p for _, p in got] == list(range(5_000))
    assert numbered(df.limit(0), "v", name="place").count() == 0
    back = numbered(spark.createDataFrame([(None,), (2,), (1,)], "v int"), F.col("v").desc(), name="n").collect()
    assert {r["v"]: r["n"] for r in back} == {2: 0, 1: 1, None: 2}
