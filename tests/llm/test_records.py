"""Stable samples, grouped splits, components and the cosine join on small cases, against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import cosine_join, grouped_split, split_overlap, stable_sample
from sievewright.llm.components import hash_to_min
from sievewright.llm.cosine_join import cosine_links, cosine_pairs, weighted_vectors

POINT = "array<struct<label:string,x:int,y:int>>"
ROW = f"ordinal long, split string, pair_id string, mother_item_id string, image_a_sha256 string, image_b_sha256 string, scene_a {POINT}, scene_b {POINT}, provenance struct<generator:string>"


def scene(seed, n=8):
    r = random.Random(seed)
    return [(f"{chr(65 + i)}{r.randint(2, 9)}", r.randint(-7, 7), r.randint(-7, 7)) for i in range(n)]


def test_sample_is_stable_and_grows(spark):
    a = spark.range(2000).select(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")).alias("k"), "id")
    b = a.union(spark.range(2000, 4000).select(F.concat(F.lit("k"), (F.col("id") % 900).cast("string")), "id"))
    keys = lambda df, rate: {r[0] for r in stable_sample.stable_sample(df, "k", rate).select("k").collect()}
    assert keys(a, 0.2) == keys(a.repartition(7), 0.2)
    assert keys(a, 0.2) <= keys(b, 0.2) and keys(a, 0.1) <= keys(a, 0.2)
    whole = stable_sample.stable_sample(a, "k", 0.2).groupBy("k").count().select("count").distinct().collect()
    assert [r[0] for r in whole] == [4]
    assert 60 < len(keys(a, 0.2)) < 140


def test_sample_edges(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("x" * 100_000, 3), ("a", 4), ("a", 4)], "k string, v int")
    assert stable_sample.stable_sample(df, "k", 1.0).count() == 4
    assert stable_sample.stable_sample(df, "k", 0.0).count() == 0
    assert stable_sample.stable_sample(df.limit(0), "k", 0.5).count() == 0
    with pytest.raises(ValueError):
        stable_sample.stable_sample(df.withColumn("sample_key", F.lit(1)), "k", 0.5)
    with pytest.raises(ValueError):
        stable_sample.stable_sample(df, "k", 1.5)


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(3)
    edges = [(f"n{r.randint(0, 60):03d}", f"n{r.randint(0, 60):03d}") for _ in range(40)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(30)] + [("s000", f"s{i:03d}") for i in range(1, 40)]
    df = spark.createDataFrame([*edges, *edges[:5], (None, "x"), ("y", None)], "a string, b string")
    assert {r["node"]: r["component"] for r in hash_to_min(df).collect()} == brute_components(edges)
    assert hash_to_min(df.limit(0)).count() == 0


def test_tied_groups_and_split(spark):
    rows = [(1, "m1", "m1__l1"), (2, "M1 ", None), (3, None, "m1__l3_r2"), (4, "m2", "m3__l1"), (5, "m3", None), (6, None, None), (7, "", "  "), (8, "m9", "m9__l2"), (8, "m9", "m9__l2")]
    df = spark.createDataFrame(rows, "ordinal long, mother_item_id string, pair_id string").withColumn("component", F.lit("clash"))
    from sievewright.functions.keys import item_key, pair_mother_key

    shares = spark.createDataFrame([("s", "train", 0.5), ("s", "test", 0.5), ("t", "train", 1.0), ("t", "test", 0.0)], "scheme string, split string, target_share double")
    out = grouped_split.grouped_split(df, [item_key("mother_item_id"), pair_mother_key("pair_id")], shares)
    first = {r["ordinal"]: r["first_ordinal"] for r in out.collect()}
    assert first == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    by = out.groupBy("scheme", "first_ordinal").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    assert by == 0
    assert {r["split"] for r in out.where("scheme = 't'").collect()} == {"train"}
    assert grouped_split.grouped_split(df.limit(0), [item_key("mother_item_id")], shares).count() == 0


def test_rendezvous_shares(spark):
    df = spark.range(20_000).select(grouped_split.rendezvous(F.col("id").cast("string"), [("a", 0.6), ("b", 0.3), ("c", 0.1)]).alias("s"))
    got = {r["s"]: r["count"] / 20_000 for r in df.groupBy("s").count().collect()}
    assert abs(got["a"] - 0.6) < 0.02 and abs(got["b"] - 0.3) < 0.02 and abs(got["c"] - 0.1) < 0.02


def test_components_with_large_clusters_told_by_broadcast(spark):
    edges = [("a000", f"b{i:03d}") for i in range(40)] + [(f"b{i:03d}", f"c{i:03d}") for i in range(40)] + [("x", "y")]
    df = spark.createDataFrame(edges, "a string, b string")
    assert {r["node"]: r["component"] for r in hash_to_min(df, large=5).collect()} == brute_components(edges)


def test_first_of_large_and_missing_groups(spark):
    rows = [(i, "hot" if i % 3 else None) for i in range(1, 40)] + [(50, "small"), (51, "small")]
    df = spark.createDataFrame(rows, "ordinal long, group_key string")
    for large in (5, 1_000):
        got = {r["ordinal"]: r["first_ordinal"] for r in grouped_split.with_first(df, large=large).collect()}
        assert got == {i: (1 if i < 50 and k else 50 if k else i) for i, k in rows}


def term_rows(spark, n, terms, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        base = rows[r.randrange(len(rows))][1] if rows and r.random() < 0.5 else [r.randint(0, terms) for _ in range(r.choice([1, 2, 5, 8, 12]))]
        rows.append((i, [t if r.random() < 0.8 else r.randint(0, terms) for t in base]))
    return spark.createDataFrame([*rows, (None, [1, 2]), (n, None), (n + 1, []), (n + 2, [None])], "key long, terms array<long>").withColumn("t", F.lit("clash"))


def dot(a, b):
    return sum(w * b.get(t, 0) for t, w in a.items())


@pytest.mark.parametrize("long_list,threshold,tilt", [(20, 0.3, None), (20, 0.5, 0.25), (4000, 0.5, None), (4000, 0.8, 0.25)])
def test_cosine_join_is_exact(spark, monkeypatch, threshold, long_list, tilt):
    monkeypatch.setattr(cosine_join, "LONG_LIST", long_list)
    monkeypatch.setattr(cosine_join, "LIST_BLOCK", 7)
    df = term_rows(spark, 150, 80, 5)
    vectors, longest = weighted_vectors(df.drop("t"), threshold, tilt)
    vectors = vectors.withColumn("cls", F.col("key")).withColumn("side", (F.col("key") % 3 == 0).cast("int"))
    vecs = {v["key"]: dict(zip(v["ts"], v["ws"], strict=True)) for v in vectors.collect()}
    assert set(vecs) == set(range(150)) and 20 < longest < 4000
    want = {(a, b) for a, b in itertools.combinations(sorted(vecs), 2) if (a % 3 == 0 or b % 3 == 0) and dot(vecs[a], vecs[b]) >= threshold}
    got = [tuple(sorted((x["key"], x["key_2"]))) for x in cosine_pairs(vectors, longest, threshold).collect()]
    assert set(got) == want and len(got) == len(want)


def test_cosine_join_of_nothing(spark):
    df = term_rows(spark, 5, 80, 5).drop("t")
    vectors, longest = weighted_vectors(df.limit(0), 0.5)
    assert cosine_pairs(vectors.withColumn("cls", F.col("key")).withColumn("side", F.lit(1)), longest, 0.5).count() == 0
    with pytest.raises(ValueError):
        weighted_vectors(df, 0.0)


@pytest.mark.parametrize("long_list", [10, 4000])
def test_cosine_links_form_the_same_classes(spark, monkeypatch, long_list):
    r = random.Random(9)
    rows, centre = [], list(range(10))
    for i in range(120):
        base = centre if i % 3 == 0 else [r.randint(20, 400) for _ in range(10)]
        rows.append((i, [t if r.random() < 0.8 else r.randint(0, 400) for t in base]))
    vectors, longest = weighted_vectors(spark.createDataFrame(rows, "key long, terms array<long>"), 0.5, 0.25)
    vectors = vectors.withColumn("cls", F.when(F.col("key") < 30, 0).otherwise(F.col("key"))).withColumn("side", F.lit(1))
    vecs = {v["key"]: (v["cls"], dict(zip(v["ts"], v["ws"], strict=True))) for v in vectors.collect()}
    pairs = [(vecs[a][0], vecs[b][0]) for a, b in itertools.combinations(sorted(vecs), 2) if dot(vecs[a][1], vecs[b][1]) >= 0.5]
    want = brute_components([p for p in pairs if p[0] != p[1]])
    monkeypatch.setattr(cosine_join, "LONG_LIST", long_list)
    monkeypatch.setattr(cosine_join, "LIST_BLOCK", 3)
    got = brute_components([(x["a"], x["b"]) for x in cosine_links(vectors, longest, 0.5).collect()])
    assert got == want and len(want) > 20


def overlap_rows(spark):
    s = [scene(i) for i in range(12)]
    near = [*s[0][:6], ("Z9", 0, 0), (s[0][7][0], s[0][7][1], -s[0][7][2] + 1)]
    failed = "f" * 64
    rows = [
        (1, "training", "m1__l1", "m1", "a" * 64, "b" * 64, s[0], s[1]),
        (2, "development", "m2__l1", "m2", "SHA256:" + "A" * 64, None, None, None),  # shares an image with 1
        (3, "confirmatory", "m3__l1", "m3", None, None, list(reversed(near)), s[2]),  # near scene of 1
        (4, "development", "M1__L3 ", None, None, None, None, None),  # names the item of 1
        (5, "training", "m5__l1", "m5", failed, None, s[3], s[4]),
        (6, "development", "m6__l1", "m6", failed, None, s[5], s[6]),
        (7, "development", "m7__l1", "m7", failed, None, s[7], s[8]),
        (8, "development", None, None, None, None, None, None),
        (9, None, "m1__l1", "m1", None, None, None, None),
        (10, "training", "m2__l2", "m2", None, None, None, None),  # ties 2 and, over it, all of 1
    ]
    return spark.createDataFrame([(*r, ("g",)) for r in rows], ROW).withColumn("class_id", F.lit(1))


def test_overlaps(spark):
    classed = split_overlap.classes(overlap_rows(spark))
    pairs = {(r["train_ordinal"], r["other_ordinal"]) for r in split_overlap.overlaps(classed).collect()}
    assert pairs == {(t, o) for t in (1, 10) for o in (2, 3, 4)}
    links = {r["ordinal"]: r["n_links"] for r in split_overlap.class_links(classed).collect()}
    assert links[1] == 3 and links[2] == 2 and links[8] == 0 and links[6] == 0
    report = split_overlap.overlap_report(classed).agg(F.sum("n_pairs")).first()[0]
    assert report == len(pairs)


def test_overlaps_of_nothing(spark):
    empty = overlap_rows(spark).limit(0)
    classed = split_overlap.classes(empty)
    assert split_overlap.overlaps(classed).count() == 0


def test_large_class_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "CLASS_BLOCK", 7)
    df = spark.range(60).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, "training").otherwise("development").alias("split"), F.lit("g").alias("source"), F.lit("c").alias("class_id"))
    pairs = [(r["train_ordinal"], r["other_ordinal"]) for r in split_overlap.overlaps(df).collect()]
    assert len(pairs) == len(set(pairs)) == 20 * 40


def test_tied_groups_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", "x"), (2, "b", None, "y"), (3, None, None, "z")], "ordinal long, k string, l string, component string")
    out = grouped_split.tied_groups(df, [F.col("k"), F.col("l")]).orderBy("ordinal").collect()
    assert [(r["component"], r["group_key"]) for r in out] == [("x", "a"), ("y", "a"), ("z", None)]


def test_near_copies_under_many_names(spark):
    """A third of the rows shows one scene with small shifts, each under a name of its own."""
    base = scene(1, 12)
    rows = []
    for i in range(90):
        pts = base if i % 3 == 0 else scene(100 + i, 12)
        if i % 3 == 0:
            pts = [p if j != i % 12 else (p[0], p[1], 50 + i) for j, p in enumerate(pts)]
        rows.append((i, "training" if i % 2 else "development", f"m{i}__l1", f"m{i}", None, None, pts, None, ("g",)))
    classed = split_overlap.classes(spark.createDataFrame(rows, ROW))
    pairs = {(r["train_ordinal"], r["other_ordinal"]) for r in split_overlap.overlaps(classed).collect()}
    assert pairs == {(a, b) for a in range(0, 90, 3) for b in range(0, 90, 3) if a % 2 and not b % 2}


def bare_rows(spark, rows):
    return spark.createDataFrame([(*r, ("g",)) for r in rows], ROW)


def found_pairs(df):
    return {(r["train_ordinal"], r["other_ordinal"]) for r in split_overlap.overlaps(split_overlap.classes(df)).collect()}


def test_a_real_image_under_many_names(spark):
    """Rows of one image are one class however many they are, as long as scenes do not speak against it."""
    s = scene(3)
    rows = [(i, "training" if i % 2 else "development", f"m{i}__l1", f"m{i}", "a" * 64, None, s if i < 3 else None, None) for i in range(40)]
    assert found_pairs(bare_rows(spark, rows)) == {(a, b) for a in range(40) for b in range(40) if a % 2 and not b % 2}


def test_chains_over_training_rows(spark):
    """A held-out row reaches training rows over training rows: by name, by a shift of a shift, by an image."""
    a = scene(50, 8)
    b = [*a[:6], ("Q8", 1, 1), ("Q9", 2, 2)]
    c = [*b[3:], ("R7", 3, 3), ("R8", 4, 4), ("R9", 5, 5)]
    rows = [
        (1, "confirmatory", "m1__l1", "m1", None, None, a, None),
        (2, "training", "m2__l1", "m2", None, None, b, None),
        (3, "training", "m3__l1", "m3", "e" * 64, None, c, None),
        (4, "training", "m4__l1", "m4", None, "e" * 64, None, None),
        (5, "training", "m5__l1", "m5", None, None, scene(60), None),
    ]
    assert found_pairs(bare_rows(spark, rows)) == {(2, 1), (3, 1), (4, 1)}


def test_image_of_near_training_scenes(spark):
    """Training scenes that differ by shifts do not speak against an image they share, though no scene is held out."""
    base = scene(70, 8)
    rows = [(9, "development", "m9__l1", "m9", "c" * 64, None, None, None)]
    for i in range(5):
        rows.append((i, "training", f"m{i}__l1", f"m{i}", "c" * 64, None, [p if j != i else ("Z1", 40 + i, i) for j, p in enumerate(base)], None))
    assert found_pairs(bare_rows(spark, rows)) == {(i, 9) for i in range(5)}


def test_failed_render_among_few_rows(spark):
    rows = [(i, "training" if i % 2 else "development", f"m{i}__l1", f"m{i}", "f" * 64, None, scene(80 + i), None) for i in range(4)]
    assert found_pairs(bare_rows(spark, rows)) == set()
    assert found_pairs(bare_rows(spark, rows[:2])) == {(1, 0)}
