"""The hash join finds what a comparison of all pairs finds, and shuffles no looked-up values."""

import random

import pytest
from test_plans import plan

from sievewright.operators import contamination


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(4)
    hashes = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(60)]
    rows = [("train", f"t{i:03d}", h) for i, h in enumerate(hashes)] + [("train", "copy", hashes[0])]
    for i, (p, d) in enumerate(hashes):
        for bits in (i % 17, (i + 6) % 17):
            flip = sum(1 << b for b in r.sample(range(64), bits))
            rows.append(("test", f"h{len(rows):03d}", (p ^ flip, r.getrandbits(64)) if i % 2 else (r.getrandbits(64), d ^ flip)))
    rows += [("test", "bare", None), ("train", "zero", (0, 0)), ("test", "full", (2**64 - 1, 2**64 - 1))]
    table = [(s, k, *(f"{x:016x}" for x in h), True) if h else (s, k, None, None, True) for s, k, h in rows]
    table.append(("test", "none", *(f"{x:016x}" for x in hashes[0]), False))
    df = spark.createDataFrame(table, "split string, record_id string, phash64 string, dhash64 string, image_applicable boolean")
    return df.where("split = 'train'"), df.where("split = 'test'"), [r for r in rows if r[2]]


@pytest.mark.parametrize("most,limit", [(0, 1 << 25), (3, 1 << 25), (10, 1 << 25), (15, 1 << 25), (2, 20_000), (10, 20_000), (10, 5_000)])
def test_all_pairs(sides, most, limit):
    train, held, rows = sides
    far = lambda a, b: min((a[0] ^ b[0]).bit_count(), (a[1] ^ b[1]).bit_count())
    want = {(a, b, far(x, y)) for s, a, x in rows if s == "train" for t, b, y in rows if t == "test" and far(x, y) <= most}
    got = [(r["train_record_id"], r["eval_record_id"], r["distance"]) for r in contamination.hash_edges(train, held, most, limit).collect()]
    assert len(want) > 2
    assert sorted(got) == sorted(want)


def test_looked_up_values_are_not_shuffled(sides):
    train, held, _ = sides
    text = plan(contamination.hash_edges(train, held))
    joins = [part for part in text.split("\n\n") if "keys [1]: [block#" in part]
    assert joins and all("BroadcastHashJoin" in part for part in joins)
