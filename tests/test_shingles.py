"""The shingle join finds what a comparison of all pairs finds, and shuffles hashes instead of shingles."""

import random

from test_plans import plan

from sievewright.operators import contamination


def texts(spark, n):
    r = random.Random(n)
    stock = [f"s{i}" for i in range(9)]
    out = []
    for i in range(60):
        own = [f"w{r.randint(0, 400)}" for _ in range(r.randint(3, 30))]
        out.append((f"a{i}", own + stock))
        kept = [w for w in own if r.random() > 0.03]
        out.append((f"b{i}", kept + stock[: r.randint(4, 9)]))
    out += [("a-short", ["x", "y"]), ("b-short", ["x", "y"]), ("a-twice", ["t"] * 12), ("b-twice", ["t"] * 9)]
    df = spark.createDataFrame(out, "id string, words array<string>")
    return out, df.where("id like 'a%'"), df.where("id like 'b%'")


def test_all_pairs(spark):
    rows, left, right = texts(spark, 5)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in rows}
    for least in (0.3, 0.7, 1.0):
        want = {(a, b, round(len(x & y) / len(x | y), 12)) for a, x in sets.items() if a[0] == "a" for b, y in sets.items() if b[0] == "b" and x and y and len(x & y) >= least * len(x | y)}
        got = [(r["left_id"], r["right_id"], round(r["score"], 12)) for r in contamination.jaccard_pairs(left, right, least).collect()]
        assert sorted(got) == sorted(want) and len(want) > 2


def test_shingles_are_not_shuffled(spark):
    _, left, right = texts(spark, 6)
    text = plan(contamination.jaccard_pairs(left, right))
    shuffled = [part for part in text.split("\n\n") if ") Exchange\n" in part]
    assert shuffled and not any("array<string>" in part or "sa#" in part or "sb#" in part or "s#" in part.split("Input")[-1] for part in shuffled)
