"""Tokens, packing, mixing and cutting on small cases: brute force and exact round trips."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import cutting, mixing, packing
from sievewright.llm.tokens import coder, measured

LIMITS = "purpose string, setting string, max_tokens int, overlap_tokens int"
DOC = "doc_id long, text string, lang string, source string"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma, delta. Epsilon (3, -4) zeta's 12.5 naïve 図形 año".split()) for _ in range(n))


def texts():
    r = random.Random(1)
    out = [None, "", "  \n\t ", "﻿", "one", "same text\r\nhere", "same  text here ", "x" * 9000, "7f3a" * 3000, "図形の面積は三平方です。" * 400, "\n\n".join(words(r, 30) for _ in range(60)), words(r, 4000), "|".join("ab" for _ in range(3000)), "a\n" * 3000]
    out += [words(r, r.randint(1, 300)) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def documents(spark):
    sources = ["run_logs", "Run-Logs ", "reader_letters", None, "tiny"]
    rows = [(i, t, "en", sources[i % 5]) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOC).withColumn("tokens", F.lit("clash")).withColumn("piece", F.lit(1))


def test_measured(documents):
    got = {r["doc_id"]: r for r in measured(documents).collect()}
    code = coder()
    for i, t in enumerate(texts()):
        if t is None or not t.replace("﻿", " ").split():
            assert i not in got
        else:
            assert got[i]["tokens"] == code.count(t) and 0.05 <= got[i]["quality"] <= 1
    assert got[5]["cluster"] == got[6]["cluster"] and got[4]["source"] == "tiny"
    assert {r["source"] for r in got.values()} == {"run_logs", "reader_letters", "unknown", "tiny"}


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.best_fit([6, 5, 4, 4, 3], list("aabba"), [1, 2, 3, 3, 5], 10, apart=())
    assert bins == [0, 1, 0, 1, 2]  # the copy of item 3 passes over the tighter full bin
    apart = packing.best_fit([6, 4, 4], ["a", "b", "c"], [1, 2, 3], 10, apart=(("a", "b"),))
    assert apart == [0, 1, 0]
    assert packing.best_fit([], [], [], 10) == []


def test_pack(spark, documents):
    limits = spark.createDataFrame([("container", "s", 64, None), ("container", "m", 700, None), ("piece", "x", 9, 1)], LIMITS)
    apart = (("run_logs", "reader_letters"),)
    packed = packing.pack(documents, limits, apart=apart, block_items=20).collect()
    sizes = {r["doc_id"]: r for r in measured(documents).collect()}
    for setting, capacity in (("s", 64), ("m", 700)):
        rows = [r for r in packed if r["setting"] == setting]
        spans = {}
        for r in rows:
            spans.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        assert set(spans) == set(sizes)
        for doc, parts in spans.items():
            at = 0
            for first, n in sorted(parts):
                assert first == at and 0 < n <= capacity
                at += n
            assert at == sizes[doc]["tokens"] and (len(parts) == 1) == (at <= capacity)
        bins = {}
        for r in rows:
            bins.setdefault(r["container"], []).append(r)
        for inside in bins.values():
            assert sum(r["tokens"] for r in inside) <= capacity
            clusters = [sizes[r["doc_id"]]["cluster"] for r in inside]
            assert len(clusters) == len(set(clusters))
            assert not {"run_logs", "reader_letters"} <= {r["source"] for r in inside}
    assert packing.pack(documents.limit(0), limits).count() == 0
    assert packing.pack(documents, limits.limit(0)).count() == 0
    doubled = packing.pack(documents.unionByName(documents), limits, apart=apart, block_items=20)
    assert doubled.count() == len(packed)


def test_pack_with_one_hot_cluster(spark):
    rows = [(i, "the same words again" if i % 3 == 0 else f"other words {i}", "en", "a") for i in range(300)]
    limits = spark.createDataFrame([("container", "m", 50, None)], LIMITS)
    packed = packing.pack(spark.createDataFrame(rows, DOC), limits)
    worst = packed.where("doc_id % 3 = 0").groupBy("container").count().agg(F.max("count")).first()[0]
    assert worst == 1 and packed.count() == 300


def test_mix(spark, documents):
    targets = spark.createDataFrame([("m", "run_logs", 0.5, 1), ("m", "tiny", 0.5, 3), ("m", "absent", 0.1, 2), ("n", "TINY", 1.0, 2), ("o", None, 0.3, 1)], "mix_id string, source string, target_share double, max_repeats int")
    uses, shares = mixing.mix(documents, targets)
    got = uses.collect()
    sizes = {r["doc_id"]: r for r in measured(documents).collect()}
    total = {}
    for r in sizes.values():
        total[r["source"]] = total.get(r["source"], 0) + r["tokens"]
    count = {}
    for r in got:
        count[r["mix_id"], r["doc_id"]] = count.get((r["mix_id"], r["doc_id"]), 0) + 1
        assert r["source"] in ("run_logs", "tiny")
    most = {("m", "run_logs"): 1, ("m", "tiny"): 3, ("n", "tiny"): 2}
    assert all(n <= most[m, sizes[d]["source"]] for (m, d), n in count.items())
    size = min(total["run_logs"] * 1 / 0.5, total["tiny"] * 3 / 0.5)
    for source, repeats in (("run_logs", 1), ("tiny", 3)):
        budget = min(0.5 * size, repeats * total[source])
        used = sum(r["tokens"] for r in got if r["mix_id"] == "m" and r["source"] == source)
        largest = max(r["tokens"] for r in sizes.values() if r["source"] == source)
        assert abs(used - budget) <= largest / 2 + 1
        uses_of = [n for (m, d), n in count.items() if m == "m" and sizes[d]["source"] == source]
        assert max(uses_of) - min(uses_of) <= 1 or min(uses_of) >= int(budget // total[source])
    table = {(r["mix_id"], r["source"]): r for r in shares.collect()}
    assert table["m", "absent"]["tokens"] == 0 and abs(table["m", "tiny"]["share"] + table["m", "run_logs"]["share"] - 1) < 1e-6
    again = mixing.mix(documents.repartition(5), targets)[0]
    key = lambda rows: sorted((r["mix_id"], r["doc_id"], r["epoch"]) for r in rows)
    assert key(again.collect()) == key(got)
    assert mixing.mix(documents.limit(0), targets)[0].count() == 0
    assert mixing.mix(documents, targets.limit(0))[0].count() == 0


def test_quality_weights_favour_better_texts(spark):
    rows = [(i, ("good words differ here %d" % i) if i % 2 else "bad " * 5 + str(i), "en", "a") for i in range(2000)]
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    uses, _ = mixing.mix(spark.createDataFrame(rows, DOC), targets, total_tokens=3000)
    n = uses.groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()
    by = {r["odd"]: r["count"] for r in n}
    assert by[1] > 1.5 * by[0]


PIECES = [("piece", "fine", 128, 16), ("piece", "plain", 256, None), ("container", "c", 10, None)]


@pytest.mark.parametrize("range_bytes", [1 << 20, 4096, 1500])
def test_pieces_round_trip(spark, documents, range_bytes):
    limits = spark.createDataFrame(PIECES, LIMITS)
    rows = cutting.pieces(documents, limits, range_bytes=range_bytes).collect()
    code, by = coder(), {}
    for r in rows:
        by.setdefault((r["setting"], r["doc_id"]), []).append(r)
    for setting, most, overlap in (("fine", 128, 16), ("plain", 256, 0)):
        for i, t in enumerate(texts()):
            n = code.count(t) if t else 0
            parts = sorted(by.get((setting, i), []), key=lambda r: r["piece"])
            assert bool(parts) == (n > most), (i, n)
            end = 0
            for k, r in enumerate(parts):
                data = t.encode()
                assert r["piece"] == k and data[r["start_byte"] : r["end_byte"]].decode() == r["text"]
                assert r["tokens"] <= most and code.count(r["text"]) <= most + 1
                assert r["start_byte"] == 0 if k == 0 else r["start_byte"] <= end < r["end_byte"]
                if k and overlap:
                    shared = code.count(data[r["start_byte"] : end].decode())
                    assert overlap - 10 <= shared <= overlap + 10
                end = r["end_byte"]
            assert not parts or end == len(t.encode())


def test_ranges_agree_with_whole_texts(spark, documents):
    """Where every range holds natural boundaries, cutting by ranges gives what cutting the whole gives."""
    limits = spark.createDataFrame(PIECES, LIMITS)
    prose = documents.where("doc_id in (10, 11)")
    key = lambda df: sorted((r["setting"], r["doc_id"], r["piece"], r["start_byte"], r["end_byte"]) for r in df.collect())
    assert key(cutting.pieces(prose, limits, range_bytes=2048)) == key(cutting.pieces(prose, limits, range_bytes=1 << 20))


def test_pieces_end_at_boundaries(spark):
    text = "\n\n".join("Sentence one is here. " * 8 for _ in range(20))
    limits = spark.createDataFrame(PIECES, LIMITS)
    rows = cutting.pieces(spark.createDataFrame([(1, text, "en", "a")], DOC), limits).where("setting = 'plain'").collect()
    assert {r["boundary"] for r in rows} == {"paragraph", "end"}
    with pytest.raises(ValueError):
        cutting.pieces(spark.createDataFrame([(1, text, "en", "a")], DOC), spark.createDataFrame([("piece", "x", 128, 100)], LIMITS))


def test_pieces_of_nothing(spark, documents):
    limits = spark.createDataFrame(PIECES, LIMITS)
    assert cutting.pieces(documents.limit(0), limits).count() == 0


def test_piece_tokens_are_those_of_the_piece(spark, documents):
    limits = spark.createDataFrame([("piece", "a", 100, 20), ("piece", "b", 300, 0)], LIMITS)
    code = coder()
    got = cutting.pieces(documents, limits, range_bytes=2_000).collect()
    assert len(got) > 100
    assert all(r["tokens"] == code.count(r["text"]) for r in got)
    assert all(r["tokens"] <= {"a": 100, "b": 300}[r["setting"]] for r in got)


def test_pieces_of_files(spark, tmp_path):
    r = random.Random(4)
    bodies = {1: "\n\n".join(words(r, 40) for _ in range(900)), 2: "図形の面積は三平方です。" * 3000, 3: "short", 4: ""}
    rows = []
    for i, body in bodies.items():
        (tmp_path / f"{i}.txt").write_text(body)
        rows.append((i, ("file://" if i == 2 else "") + str(tmp_path / f"{i}.txt"), len(body.encode())))
    files = spark.createDataFrame([*rows, (5, None, 9)], "doc_id long, path string, size long")
    limits = spark.createDataFrame([("piece", "a", 200, 20)], LIMITS)
    got = {(x["doc_id"], x["piece"]): (x["start_byte"], x["end_byte"], x["tokens"], x["text"]) for x in cutting.file_pieces(files, limits, range_bytes=16_384).collect()}
    texts_ = spark.createDataFrame([(i, b) for i, b in bodies.items()], "doc_id long, text string")
    want = {(x["doc_id"], x["piece"]): (x["start_byte"], x["end_byte"], x["tokens"], x["text"]) for x in cutting.pieces(texts_, limits, range_bytes=16_384).collect()}
    assert got == want and len({d for d, _ in got}) == 2
    for i in (1, 2):
        data = bodies[i].encode()
        at = 0
        for n in range(sum(d == i for d, _ in got)):
            s, e, _, text = got[i, n]
            assert data[s:e].decode() == text and s <= at < e
            at = e
        assert at == len(data)
