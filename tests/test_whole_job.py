"""Queries and operators do the whole job at every size: no switch or cap by the number of rows."""

import hashlib
import random
import re
import unicodedata

import numpy as np

from sievewright import queries
from sievewright.operators import attack, guards, resampling
from sievewright.operators.resampling import grouped_folds, interval, rank_auc, ridge_scores, slope_interval
from sievewright.queries.base import trials


def test_discriminant_has_an_interval_for_many_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i:05d}", label, float(v)) for i in range(5_200) for label, v in enumerate(rng.normal([0.0, 0.2]))]
    rows.append(("k00007", 1, 0.5))
    found = attack.discriminant(spark.createDataFrame(rows, "key string, label int, v double"), "key", ["v"], draws=20).first()
    rows.sort(key=lambda r: r[:2])
    keys, y, v = (np.array(c) for c in zip(*rows, strict=True))
    fold = grouped_folds(keys.tolist(), 5, 0)
    score = ridge_scores(v[:, None], y, np.array([fold[k] for k in keys]))
    names = sorted(set(keys.tolist()))
    members = {k: [] for k in names}
    for i, k in enumerate(keys.tolist()):
        members[k].append(i)
    draw, folded = np.random.default_rng(0), []
    for _ in range(20):
        at = [j for i in draw.integers(0, len(names), len(names)) for j in members[names[i]]]
        a = rank_auc(score[at], y[at])
        folded.append(max(a, 1 - a))
    assert found["n_pairs"] == 5_200
    assert np.allclose([found["ci_low"], found["ci_high"]], interval(np.array(folded)))


def folded(value):
    lowered = unicodedata.normalize("NFKC", value).casefold().replace("<image>", " ")
    return " ".join(re.sub(r"[^\w]+", " ", lowered, flags=re.UNICODE).split())


def test_normal_form_of_texts_in_any_language(spark, tmp_path):
    texts = ["Ｆｕｌｌ　Ｗｉｄｔｈ １２", "Straße <IMAGE> ﬁve", "图像，红色 三角形", "ｶﾞﾗｽ の 値", "ΣΊΣΥΦΟΣ İstanbul", "n\u0303o e\u0301", "x² ½ Ⅻ", "  plain_ASCII, <image>text! ", "", "，", "<image>", "a\u00a0b\n\tc", "हिन्दी भाषा", None]
    langs = ["zh", "de", "zh", "ja", None, "es", "und", "EN", "en-x", "ZH", "en", "fr", "hi", "en"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["digest"] for r in queries.queries()["x01_normalize"](spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.md5(folded(t).encode()).hexdigest() for i, t, _ in rows if t is not None}


def scenes_and_corpus(spark, path, n_scenes, n_items):
    scenes = [(i, f"p{i}", "training", "invariance") for i in range(n_scenes)]
    spark.createDataFrame(scenes, "ordinal long, pair_id string, split string, role string").write.parquet(f"{path}/scene_training_n8_l3_first.parquet")
    spark.createDataFrame([(f"q{i}",) for i in range(n_items)], "qid string").write.parquet(f"{path}/corpus_rows.parquet")


def test_mixture_uses_the_natural_pool_and_cycles(spark, tmp_path):
    scenes_and_corpus(spark, tmp_path, 50, 500)
    rows = sorted(queries.queries()["d04_mixture"](spark, str(tmp_path)).collect(), key=lambda r: r["ordinal"])
    assert [r["ordinal"] for r in rows] == list(range(3 * 240))
    natural = sorted((f"q{i}" for i in range(500)), key=lambda q: hashlib.md5(q.encode()).hexdigest())[: 3 * 160]
    assert [r["uid"] for r in rows if r["arm_part"] == "natural"] == [f"virl:{q}" for q in natural]
    constructed = [r["uid"] for r in rows if r["arm_part"] == "constructed"]
    assert [r["ordinal"] % 240 < 80 for r in rows] == [r["arm_part"] == "constructed" for r in rows]
    assert len(set(constructed[:50])) == 50 and constructed == [constructed[i % 50] for i in range(3 * 80)]


def test_cycled_draws_go_round_a_large_pool(spark, tmp_path):
    scenes_and_corpus(spark, tmp_path, 1_200, 1)
    rows = queries.queries()["w07_cycled"](spark, str(tmp_path)).collect()
    assert sorted((r["draw"], r["ordinal"]) for r in rows) == [(i, i % 1_200) for i in range(2_400)]


def test_resumed_prefix_grows_with_the_table(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i // 4}") for i in range(900)], "ordinal long, pair_group_uid string").write.parquet(str(tmp_path / "mixture_profiles.parquet"))
    assert queries.queries()["d10_resume"](spark, str(tmp_path)).first()["n"] == 300


def test_shard_is_whole_and_its_limit_optional(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"arm{i % 3}") for i in range(2_001)], "ordinal long, arm string")
    rows.write.parquet(str(tmp_path / "mixture_profiles.parquet"))
    found = queries.queries()["f03_shard"](spark, str(tmp_path)).collect()
    assert sorted((r["ordinal"], r["arm"]) for r in found) == [(i, f"arm{i % 3}") for i in range(1, 2_001, 4)]
    assert sorted(r["ordinal"] for r in guards.shard(rows, 4, 1, limit=200).collect()) == list(range(1, 801, 4))


def test_slopes_vary_with_items_and_strata():
    rng = np.random.default_rng(3)
    y, raw = rng.integers(0, 2, (3, 40)).astype(float), np.array([0.0, 0.5, 1.0])
    strata = [{1: rng.random(9) + f, 2: rng.random(5 + i) * f, 7 + i: rng.random(3)} for i, f in enumerate(raw)]
    draw, slopes = np.random.default_rng(11), []
    for _ in range(60):
        level = y[:, draw.integers(0, 40, 40)].mean(axis=1)
        x = [sum(w / 45 * s[k][draw.integers(0, len(s[k]), len(s[k]))].mean() for k, w in ((1, 27), (2, 18))) for s in strata]
        slopes.append((np.polyfit(raw, level, 1)[0], np.polyfit(x, level, 1)[0]))
    found = slope_interval(y, raw, strata, 60, 11)
    assert np.allclose(found["raw"][1:], interval(np.array(slopes)[:, 0]))
    assert np.allclose(found["standardised"][1:], interval(np.array(slopes)[:, 1]))
    flat = np.tile(y[:1, :1], (3, 40)) + raw[:, None]
    low, high = slope_interval(flat, raw, strata, 60, 11)["standardised"][1:]
    assert low < high and np.allclose(slope_interval(flat, raw, strata, 60, 11)["raw"], 1.0)


def test_slope_query_lists_both_exposures(spark):
    rows = {r["kind"]: r for r in queries.queries()["r22_slope"](spark, "/root/testdata/sf0.01").collect()}
    assert set(rows) == {"raw", "standardised"}
    assert all(r["ci_low"] <= r["slope"] <= r["ci_high"] for r in rows.values())


SMALL = "/root/testdata/sf0.001"


def test_registered_draws_are_those_of_the_reference(spark):
    q = queries.queries()
    rows = trials(spark, SMALL).where("seed = 0 and run = 'base'").toPandas().sort_values("ordinal", kind="stable")
    x, y = rows["correct_a"].to_numpy(float), rows["correct_b"].to_numpy(float)
    swap = q["r14_side_swap"](spark, SMALL).where("run = 'base'").first().asDict()
    assert swap == {"run": "base", **resampling.side_swap_null(x, y, 1_000, 0)}
    names = sorted(set(rows["item_id"]))
    a, b = ({names.index(v) for v in rows.loc[~rows[c], "item_id"]} for c in ("correct_a", "correct_b"))
    overlap = q["r16_overlap_null"](spark, SMALL).where("run = 'base'").first().asDict()
    assert overlap == {"run": "base", **resampling.overlap_null(a, b, names, 10_000, 1)}
    assert all(abs(r["p_value"] * 1_001 - round(r["p_value"] * 1_001)) < 1e-9 and r["p_value"] < 1 / 51 for r in q["r15_key_shuffle"](spark, SMALL).collect() if r["observed"] > r["null_mean"] + 0.3)
    mean = q["r01_bootstrap"](spark, SMALL).where("run = 'base' and seed = 0").first()
    whole = resampling.mean_interval(rows["pair_correct"].to_numpy(float), 2_000, 0)
    assert (mean["ci_low"], mean["ci_high"]) == (whole["ci_low"], whole["ci_high"])


def test_faster_nulls_keep_their_streams(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2, (2, 300)).astype(float)
    coin = random.Random(7)
    null = [sum(s if coin.random() < 0.5 else o for o, s in zip(a, b, strict=True)) / 300 for _ in range(40)]
    assert resampling.side_swap_null(a, b, 40, 7)["null_mean"] == sum(null) / 40
    left, right, draw, null = set(range(50)), set(range(30, 120)), np.random.default_rng(2), []
    for _ in range(40):
        x, y = (set(draw.choice(np.arange(200), len(s), replace=False).tolist()) for s in (left, right))
        null.append(len(x & y) / len(x | y))
    assert resampling.overlap_null(left, right, list(range(200)), 40, 2)["null_mean"] == float(np.mean(null))
    said, gold, kind = ([(int(v), 0) for v in rng.integers(0, 3, 90)] for _ in range(3))
    kind, shuffler, null = [k[0] for k in kind], random.Random(5), []
    for _ in range(40):
        hits = 0
        for t in dict.fromkeys(kind):
            rows = [i for i in range(90) if kind[i] == t]
            order = list(range(len(rows)))
            shuffler.shuffle(order)
            hits += sum(said[i] == gold[rows[j]] for i, j in zip(rows, order, strict=True))
        null.append(hits / 90)
    assert resampling.key_shuffle_null(said, gold, kind, 40, 5)["null_mean"] == sum(null) / 40
    whole = resampling.bootstrap_means(a, 120, 9)
    monkeypatch.setattr(resampling, "WIDEST", 2_100)
    assert (resampling.bootstrap_means(a, 120, 9) == whole).all()
