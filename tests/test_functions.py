"""Case tables of scoring, text and statistics, and preconditions that raise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import answers, measures, text
from sievewright.operators import captions, compare, corpus, guards, project, ranking, resampling, validate
from sievewright.operators.guards import GuardError

EXTRACT = [
    ("<answer> 5 </answer>", "5", "tag"),
    ("<answer>1</answer> then <Answer>2</Answer>", "2", "tag"),
    (r"so \boxed{\frac{1}{2}} and \boxed{3}", "3", "boxed"),
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}", "boxed"),
    ("work\nFinal answer: 12 cm\nthanks", "12 cm", "line"),
    ("Answer： yes", "yes", "line"),
    ("first\n\nlast line ", "last line", "lastline"),
    ("", "", "fulltext"),
    (None, "", "fulltext"),
]
TIERS = [
    ("5", "5", 2), ("5.0", "5", 2), ("-5", "5", 0), ("x=5", "5", 1), ("1/2", "0.5", 2), (r"\frac{1}{2}", "0.5", 2), ("50%", "0.5", 2), ("1,000", "1000", 2),
    ("$7$", "7", 2), (r"\text{Yes}", "yes", 2), ("The answer is blue.", "blue", 1), ("bluest", "blue", 0), ("5 cm", "5", 2), ("5 cm", "5 mm", 0), ("5 cm", "5 centimeters", 2),
    (r"90^\circ", "90 degrees", 2), ("", "5", 0), ("5", "", 0), ("a+b", "+", 1), ("x.y", "xzy", 0),
]
CONTRACT = [("<answer>5</answer>", True), ("text <answer>a b</answer>\n", True), ("<answer></answer>", False), ("<answer>5</answer>.", False), ("<answer>5", False), ("<answer>1</answer><answer>2</answer>", False), (None, False)]


def test_extraction(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in EXTRACT], "r string").select("r", answers.extract_answer(F.col("r")).alias("e")).collect()
    assert [(x["e"]["span"], x["e"]["level"]) for x in df] == [(s, lv) for _, s, lv in EXTRACT]


def test_tiers(spark):
    df = spark.createDataFrame([t[:2] for t in TIERS], "s string, g string").select("s", "g", answers.match_tier(F.col("s"), F.col("g")).alias("t")).collect()
    assert [(x["s"], x["g"], x["t"]) for x in df] == TIERS


def test_contract(spark):
    df = spark.createDataFrame([(r,) for r, _ in CONTRACT], "r string").select(answers.satisfies_contract(F.col("r")).alias("c")).collect()
    assert [x["c"] for x in df] == [c for _, c in CONTRACT]


def test_pair_scores_and_rates(spark):
    tag = "<answer>{}</answer>"
    rows = [("p1", tag.format(5), tag.format(-7)), ("p2", tag.format(-7), tag.format(-7)), ("p3", tag.format(5), tag.format(5)), ("p4", tag.format(5), r"\boxed{-7}")]
    df = spark.createDataFrame(rows, "id string, a string, b string").select("id", answers.pair_score(F.col("a"), F.col("b"), F.lit("5"), F.lit("-7")).alias("s")).select("id", "s.*")
    got = {r["id"]: r for r in df.collect()}
    assert [got[p]["pair_correct"] for p in ("p1", "p2", "p3", "p4")] == [True, False, False, True]
    assert [got[p]["collapsed"] for p in ("p1", "p2", "p3", "p4")] == [False, True, True, False]
    rates = compare.pair_rates(df, []).first()
    assert (rates["n"], rates["pair_accuracy"], rates["member_accuracy"], rates["strict_pair_accuracy"], rates["strict_member_accuracy"], rates["collapse_rate"], rates["format_rate"]) == (4, 0.5, 0.75, 0.25, 0.625, 0.5, 0.875)
    assert math.isnan(compare.pair_rates(df.limit(0), []).first()["pair_accuracy"])


def test_exact_statistics(spark):
    p = spark.createDataFrame([(3, 1), (6, 2), (6, 0), (10, 0), (0, 0)], "a long, b long").select(compare.mcnemar_p(F.col("b"), F.col("a")).alias("p")).collect()
    assert np.allclose([r["p"] for r in p], [0.625, 74 / 256, 2 / 64, 2 / 1024, 1.0])
    w = spark.createDataFrame([(5.0, 10.0), (0.0, 30.0), (30.0, 30.0)], "k double, n double").select(compare.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert np.allclose([(r["w"]["low"], r["w"]["high"]) for r in w], [(0.2366, 0.7634), (0, 0.1135), (0.8865, 1)], atol=5e-5)
    assert np.allclose(resampling.clopper_pearson(0, 100), (0, 0.0362), atol=5e-5)
    assert np.allclose(resampling.clopper_pearson(5, 10), (0.1871, 0.8129), atol=5e-5)
    assert np.allclose(resampling.clopper_pearson(10, 10), (0.6915, 1), atol=5e-5)
    assert resampling.interval(np.arange(101)) == (2.5, 97.5)
    assert resampling.mean_interval(np.arange(4.0), 100, 0)["se"] == pytest.approx(math.sqrt(5 / 3) / 2)
    h = resampling.hurdle(np.array([0, 0, 0, 0, 1, 2, 3, 4]), np.array([0, 0, 0.2, 0.2, 0.5, 0.5, 0.7, 0.7]), 100, 0)
    assert h["estimate"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        resampling.mean_interval(np.array([]), 100, 0)


def test_rank_statistics(spark):
    df = spark.createDataFrame([("a", float(i), float(10 * i)) for i in range(1, 5)] + [("b", float(i), float(-i)) for i in range(1, 5)] + [("c", 1.0, float(i)) for i in range(4)], "g string, x double, y double")
    rho = {r["g"]: r["rho"] for r in ranking.spearman(df, "x", "y", ["g"]).collect()}
    assert rho == {"a": 1.0, "b": -1.0, "c": None}
    t = spark.createDataFrame([(i, 0.0, i) for i in range(3)] + [(10 + i, 1.0 + i, i) for i in range(20)], "k long, q double, i long").withColumn("hits", F.when(F.col("q") > 0, 1).otherwise(0))
    assert sorted(r["n"] for r in ranking.floor_and_deciles(t, "hits", "q", "q", "k").collect()) == [2] * 10 + [3]


def test_rollout_streams_do_not_depend_on_neighbours(spark):
    rows = [(f"q{i}", [(i + j) % 3 == 0 for j in range(16)]) for i in range(6)]
    df = spark.createDataFrame(rows, "qid string, bits array<boolean>").withColumn("all", F.lit(1))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    whole = key(resampling.rollout_stability(df, ["all"], "qid", "bits", "c", "real"))
    part = key(resampling.rollout_stability(df.where("qid < 'q3'").repartition(3), ["all"], "qid", "bits", "c", "real"))
    assert [r for r in whole if r[1] < "q3"] == part


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 2).alias("g"))
    run = lambda d: sorted(tuple(r) for r in resampling.bootstrap_cells(d, ["g"], "v", "id", 200).collect())
    assert run(df) == run(df.repartition(7))


def test_guards_raise(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "c", False)], "id long, s string, ok boolean")
    for bad in (lambda: guards.required_columns(df, ["zzz"]), lambda: guards.unique(df, ["id"]), lambda: guards.full_coverage(df, df.where("id = 1"), ["id"]), lambda: guards.single_valued(df, ["s"]), lambda: guards.exactly_one(df, ["s"]), lambda: compare.strict_join(df, df, ["id"])):
        with pytest.raises(GuardError):
            bad()
    with pytest.raises(Exception, match="null in ok"):
        guards.no_nulls(df, ["ok"]).collect()
    assert guards.select(df, ok=None).count() == 1 and guards.select(df, missing=None).count() == 3 and guards.select(df, s=["a", "c"], id=lambda c: c > 1).count() == 1
    assert guards.equal_locks(df.where("id = 2"), df.where("id = 2"), ["s"]) is None


def test_corpus_guards(spark):
    rows = spark.createDataFrame([(f"q{i}", "s" if i < 7 else "t") for i in range(10)], "qid string, source string")
    take = {r["source"]: r["take"] for r in corpus.allocation(rows, ["source"], 5).collect()}
    assert take == {"s": 4, "t": 1} or take == {"s": 3, "t": 2}
    assert sum(take.values()) == 5
    sample = corpus.stratified_sample(rows, ["source"], "qid", 5, 7)
    assert sorted(r["qid"] for r in sample.collect()) == sorted(r["qid"] for r in corpus.stratified_sample(rows.repartition(4), ["source"], "qid", 5, 7).collect())
    with pytest.raises(ValueError):
        corpus.allocation(rows, ["source"], 11)
    with pytest.raises(ValueError):
        measures.exact_count("1/3", 100)
    with pytest.raises(Exception, match="different values"):
        corpus.merge_shards(spark.createDataFrame([("k", "a"), ("k", "b")], "k string, v string"), "k", "v").collect()
    with pytest.raises(ValueError):
        corpus.resume_prefix(spark.range(5).select(F.col("id").alias("ordinal"), F.lit("x").alias("k")), spark.createDataFrame([(0, "y")], "ordinal long, k string"), ["k"])


def test_captions(spark):
    m = spark.createDataFrame([("p", "a", "1" * 64), ("p", "b", "2" * 64)], "pair_id string, side string, image_sha256 string")
    c = spark.createDataFrame([("1" * 64, "one"), ("2" * 64, "two")], "image_sha256 string, caption string")
    assert captions.caption_pairs(m, c).first().asDict() == {"pair_id": "p", "caption_a": "one", "caption_b": "two"}
    with pytest.raises(GuardError):
        captions.caption_pairs(m, c.limit(1))
    codes = {r["code"] for r in captions.caption_problems(m.limit(1), c.union(c.limit(1))).collect()}
    assert codes == {"sides", "repeated_caption", "extra_caption"}


def test_conditions(spark):
    df = spark.createDataFrame([("Look <image> here <image>.", ["x", "y"]), ("none", ["x"])], "p string, c array<string>")
    none = [r[0] for r in df.select(project.conditioned_text(F.col("p"), F.col("c"), "none")).collect()]
    assert none == ["Look here .", None]
    told = df.select(project.conditioned_text(F.col("p"), F.col("c"), "caption")).first()[0]
    assert told == "Look \n[Image description 1: x]\n here \n[Image description 2: y]\n."


def test_text(spark):
    row = spark.range(1).select(
        text.normalize_text(F.lit("Straße <image> A-b_c!")).alias("n"), F.size(text.word_ngrams(F.split(F.lit("a b c"), " "))).alias("short"), F.size(text.word_ngrams(F.split(F.lit("a b c d e f a b c d e"), " "))).alias("k")
    ).first()
    assert row.asDict() == {"n": "strasse a b_c", "short": 0, "k": 6}


def test_boxes_at_any_depth(spark):
    deep = "\\boxed{" + "{" * 9 + "x" + "}" * 9 + "}"
    cases = {
        r"\boxed{\boxed{3}}": "3",
        r"a \boxed{1} b \boxed{\frac{1}{2}} c": r"\frac{1}{2}",
        r"\boxed{1} and \boxed{2": "1",
        r"\boxed{ {a}{b} }": "{a}{b}",
        r"\boxed{}": "",
        deep: "{" * 9 + "x" + "}" * 9,
        r"\boxed{1} \boxed": "1",
        "no box\nlast": "last",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["s"]["span"] for r in rows.select("t", answers.extract_answer(F.col("t")).alias("s")).collect()}
    assert got == cases


def test_presentation_is_unwrapped_to_the_end(spark):
    cases = {"$" * 7 + "x" + "$" * 7: "x", r"\(\[ $\text{\text{a}}$ \]\)": "a", "$ $": "$ $", "$": "$", r"$\text{\(x\)}$": "x", "plain": "plain"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["n"] for r in rows.select("t", answers.normalize_presentation(F.col("t")).alias("n")).collect()}
    assert got == cases


def test_normal_form_folds_width_case_and_ligatures(spark):
    rows = spark.createDataFrame([("Ｆull ﬁne",), ("Straße <image>ǅ",), (None,), ("",), ("ſharp İ",)], "t string")
    assert [r[0] for r in rows.select(text.normalize_text(F.col("t"))).collect()] == ["full fine", "strasse d\u017e", None, "", "sharp i"]


def test_python_stream_in_blocks():
    import random as python_random

    for n in (1, 2, 7, 64, 1000):
        rng = python_random.Random(5)
        want = [[rng.randrange(n) for _ in range(n)] for _ in range(30)]
        assert [at.tolist() for at in resampling.python_places(n, n, 30, 5)] == want


def test_groups_share_one_stream():
    a, b = np.arange(5.0)[:, None], np.column_stack([np.arange(7.0), np.arange(7.0) ** 2])
    rng, want = np.random.default_rng(9), []
    for _ in range(4):
        i, j = rng.integers(0, 5, size=5), rng.integers(0, 7, size=7)
        want.append((a[i].mean(), b[j, 0].mean(), b[j, 1].mean()))
    one, two = resampling.resampled([a, b], 4, 9)
    assert np.allclose(np.column_stack([one, two]), want)


def test_shards_and_forbidden_columns(spark):
    index = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", None), ("d", "3"), ("d", "4"), (None, "x")], "shard string, sha256 string")
    disk = spark.createDataFrame([("a", "1"), ("c", "9"), ("d", "3"), ("e", "5")], "shard string, sha256 string")
    got = {r["shard"]: r["status"] for r in validate.shard_status(index, disk).collect()}
    assert got == {"a": "ok", "b": "missing", "c": "digest unknown", "d": "digest differs", "e": "not indexed"}
    assert validate.shard_status(index.limit(0), disk.limit(0)).count() == 0
    df = spark.createDataFrame([], "caption string, Question string")
    assert guards.forbidden_columns(df, ["question", "answer"]) == ["Question"] and guards.without_forbidden(df, ["answer"]) is df
    with pytest.raises(GuardError):
        guards.without_forbidden(df, ["question"])


def test_disagreement_codes(spark):
    rows = spark.createDataFrame([(True, False, True), (False, False, True), (True, False, False), (None, True, False), (None, True, True), (None, None, None)], "g boolean, f boolean, m boolean")
    assert [r[0] for r in rows.select(answers.disagreement(F.col("g"), F.col("f"), F.col("m"))).collect()] == [0, 1, 2, 3, 4, 0]
