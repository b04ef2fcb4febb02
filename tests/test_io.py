"""Readers, writers and the streaming log on small files."""

import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest
from pyspark.errors import AnalysisException

from sievewright.operators.guards import GuardError
from sievewright.sources import readers, writers
from sievewright.streaming import scoring

PAIR = "pair_id string, run string, correct boolean"


def lines(path, rows):
    with gzip.open(path, "wt") as f:
        f.write("\n\n".join(json.dumps(r) for r in rows) + "\n")


@pytest.fixture
def released(tmp_path):
    for family, rows in {"b": [{"pair_id": "p1", "run": "x", "correct": True}, {"pair_id": "p2", "run": None, "correct": False}], "a": [{"pair_id": "q1", "run": "x"}]}.items():
        os.makedirs(tmp_path / family)
        lines(tmp_path / family / "pairs.jsonl.gz", rows)
    return str(tmp_path)


def test_families(spark, released):
    assert list(readers.families(released, "pairs")) == ["a", "b"] and readers.families(released, "items") == {}
    assert readers.load(spark, released, "pairs", PAIR).count() == 3
    assert [r["pair_id"] for r in readers.load(spark, released, "pairs", PAIR, "b", run=None).collect()] == ["p2"]
    for bad, error in ((lambda: readers.families(released, "x"), ValueError), (lambda: readers.families(released + "/no", "pairs"), FileNotFoundError), (lambda: readers.load(spark, released, "pairs", PAIR, "zz"), FileNotFoundError)):
        with pytest.raises(error):
            bad()
    ordered = readers.json_lines(spark, readers.families(released, "pairs")["b"], PAIR).orderBy("ordinal")
    assert [r["pair_id"] for r in ordered.collect()] == ["p1", "p2"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"f": {"pairs": {"records": 1, "bytes": 2, "sha256": "a"}, "items": {"records": 3, "bytes": 4, "sha256": "b"}}}, indent=1))
    assert sorted(tuple(r) for r in readers.manifest_rows(spark, str(path)).collect()) == [("f", "items", 3, 4, "b"), ("f", "pairs", 1, 2, "a")]


def test_tables(spark, tmp_path):
    (tmp_path / "b.tsv").write_text('index\tquestion\tA\n1\t"two\nlines ""q"""\t\n')
    row = readers.tsv(spark, str(tmp_path / "b.tsv"), ["index"]).first()
    assert row["question"] == 'two\nlines "q"' and row["A"] is None
    with pytest.raises(GuardError):
        readers.tsv(spark, str(tmp_path / "b.tsv"), ["answer"])
    (tmp_path / "m.csv").write_text("Index,Question\n1,q\n2,q\n3,r\n4,r\n")
    assert readers.paired_csv(spark, str(tmp_path / "m.csv")).select("pair").distinct().count() == 2
    (tmp_path / "n.csv").write_text("Index,Question\n1,q\n2,x\n")
    with pytest.raises(GuardError):
        readers.paired_csv(spark, str(tmp_path / "n.csv"))
    (tmp_path / "h.json").write_text(json.dumps([{"question": "q", "category": "c", "visual_input": "0", "filename": "f", "gt_answer": "1"}]))
    assert readers.yes_no_array(spark, str(tmp_path / "h.json")).first().asDict() == {"question": "q", "category": "c", "image_path": None, "answer": "Yes"}


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        data = b'{"x": 1}\n\n{"x": 2}\n'
        info = tarfile.TarInfo("d/r.jsonl")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("i/one.png", b"1")
        z.writestr("i/two.png", b"2")
    got = readers.archive_lines(spark, str(tmp_path / "a.tar.gz")).collect()
    assert [(r["member"], r["line"], r["value"]) for r in got] == [("d/r.jsonl", 0, '{"x": 1}'), ("d/r.jsonl", 1, '{"x": 2}')]
    assert readers.archive_digests(spark, str(tmp_path / "b.zip")).count() == 2


def test_images(spark, tmp_path):
    os.makedirs(tmp_path / "i/sub")
    for name, data in (("i/b.png", b"x"), ("i/sub/a.png", b"x"), ("i/c.png", b"y")):
        (tmp_path / name).write_bytes(data)
    got = readers.images(spark, str(tmp_path / "i")).collect()
    assert sorted(len(r["duplicate_paths"]) for r in got) == [0, 1]


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    path = str(tmp_path / "x.arrow")
    table = pa.table({"k": [1, 2, 3], "s": ["a", "b", None]})
    with pa.OSFile(path, "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert readers.arrow_file(spark, [path], "k long, s string").count() == 3


def test_corpus(spark):
    df = spark.createDataFrame([("q", "a", "b", None, None), ("r", "a", "b", ["x"], float("nan"))], "qid string, question string, answer string, image_paths array<string>, pass_rate_7b_base double")
    assert [(r["image_paths"], r["pass_rate_7b_base"]) for r in readers.corpus_rows(df).orderBy("qid").collect()] == [([], -1.0), (["x"], -1.0)]
    with pytest.raises(GuardError):
        readers.corpus_rows(df.union(df))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\r\nc\rd"), (1, None)], "ordinal long, s string")
    writers.write_table(df, str(tmp_path), "t")
    with pytest.raises(AnalysisException):
        writers.write_table(df, str(tmp_path), "t")
    with pytest.raises(ValueError):
        writers.write_table(df, str(tmp_path), "../t")
    writers.write_training(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert writers.write_tsv(df, str(tmp_path / "x.tsv")) == 1
    assert {r["s"] for r in readers.tsv(spark, str(tmp_path / "x.tsv")).collect()} == {"b\nc\\rd", None}
    writers.write_lines(df.select("s", "ordinal"), str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ['{"ordinal":1}', '{"ordinal":2,"s":"b\\r\\nc\\rd"}']


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    os.makedirs(source)
    row = lambda i, p: json.dumps({"response_id": str(i), "item_id": "q", "prediction": p, "gold": "5", "at": "2025-01-01T00:00:00Z"})
    (source / "1.json").write_text(row(1, "<answer>5</answer>") + "\n" + row(2, "six") + "\n")
    for _ in range(2):
        scoring.append_log(scoring.responses(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    (source / "2.json").write_text(row(3, "it is 5") + "\n")
    scoring.append_log(scoring.responses(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r["response_id"]: (r["tier"], r["strict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1": (2, True), "2": (0, False), "3": (1, False)}
    batch = spark.read.schema(scoring.SCHEMA).json(str(source))
    assert scoring.rates(batch).first()["n"] == 3


def test_audit_rows_and_filters(spark, tmp_path):
    good = spark.createDataFrame([([True] * 4 + [False] * 12, 16, 4, 0.25)], "sample_correct array<boolean>, sample_count int, sample_correct_count int, p_sample double")
    assert readers.audit_rows(good).count() == 1
    bad = spark.createDataFrame([([True] * 4 + [False] * 12, 16, 5, 0.25), (None, 16, 4, 0.25)], good.schema)
    with pytest.raises(Exception, match="counts that disagree"):
        readers.audit_rows(bad).collect()
    assert readers.filter_ids([2, 0]) == [2, 0]
    for ids in ([], [1, 1], [-1], ["1"], [True]):
        with pytest.raises(GuardError):
            readers.filter_ids(ids)
    path = tmp_path / "c.txt"
    path.write_text("abc")
    assert readers.pinned_text(str(path), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad") == "abc"
    with pytest.raises(GuardError):
        readers.pinned_text(str(path), "0")
