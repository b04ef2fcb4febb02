"""Round trips of file formats over whole tables: written by the sinks, read again by the sources, compared with SQL on the table."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators.ordering import numbered
from sievewright.queries.base import SCENES
from sievewright.session import shared_folder, table
from sievewright.sources import readers, writers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _root(spark: SparkSession) -> str:
    """A new folder that all executors share, as a path of this machine's file system."""
    folder = shared_folder(spark)
    path = folder.removeprefix("file://").removeprefix("file:")
    root = os.path.join(path, f"round-trip-{uuid.uuid4().hex}")
    os.makedirs(root)
    return root


def _released(spark: SparkSession, d: str) -> str:
    """Scene pairs as a release of families (the layers), canonical JSON lines in compressed files."""
    root = _root(spark)
    rows = table(spark, d, SCENES).select("ordinal", "pair_id", "layer", "answer_a", "answers_equal")
    for family in ("l1", "l2", "l3", "probe"):
        os.makedirs(os.path.join(root, family))
        writers.write_lines(rows.where(F.col("layer") == family), os.path.join(root, family, "pairs.jsonl.gz"), "gzip")
    return root


_PAIR = "ordinal long, pair_id string, layer string, answer_a string, answers_equal boolean"
_LAYERS = "('l1', 'l2', 'l3', 'probe')"


@query("src02_families", f"select ordinal, pair_id, layer, answer_a, answers_equal, layer as family from {SCENES} where layer in {_LAYERS}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return readers.load(spark, _released(spark, d), "pairs", _PAIR)


@query("src02_filtered", f"select ordinal, pair_id, 'l3' as family from {SCENES} where layer = 'l3' and answers_equal is not distinct from false and answer_a in ('0', '1', '2')")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.load(spark, _released(spark, d), "pairs", _PAIR, "l3", answers_equal=False, answer_a=["0", "1", "2"])
    return rows.select("ordinal", "pair_id", "family")


@query("src03_available", "select * from (values ('l1', 'pairs'), ('l2', 'pairs'), ('l3', 'pairs'), ('probe', 'pairs')) as t(family, kind)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(f, "pairs") for f in readers.families(_released(spark, d), "pairs")], "family string, kind string")


@query("src04_manifest", f"select layer as family, 'pairs' as kind, count(*) as records, sum(coalesce(length(pair_id), 0))::bigint as bytes, md5(layer) as sha256 from {SCENES} where layer in {_LAYERS} group by layer")
def _(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, SCENES).where(F.col("layer").isin("l1", "l2", "l3", "probe")).groupBy("layer").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.length("pair_id"), F.lit(0))).alias("bytes"))
    entry = F.map_from_arrays(F.array(F.lit("pairs")), F.array(F.struct("records", "bytes", F.md5("layer").alias("sha256"))))
    path = os.path.join(_root(spark), "manifest.json")
    counted.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layer", entry)))).alias("value")).write.text(path)
    return readers.manifest_rows(spark, path)


@query("src05_lines", "select ordinal, arm, problem, images, pair_group_uid from mixture_profiles")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = os.path.join(_root(spark), "stream.jsonl")
    writers.write_lines(table(spark, d, "mixture_profiles").select("ordinal", "arm", "problem", "images", "pair_group_uid"), path)
    return readers.json_lines(spark, path, "ordinal long, arm string, problem string, images array<string>, pair_group_uid string", ordinal=False)


@query("src06_globs", f"select layer, count(*) as n, count(pair_id) as n_named from {SCENES} where layer in {_LAYERS} group by layer")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.json_lines(spark, os.path.join(_released(spark, d), "*", "pairs.jsonl.gz"), _PAIR, ordinal=False)
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.count("pair_id").alias("n_named"))


def _per_task(rows: DataFrame, write, folder: str) -> list[str]:
    """Lets every task write its rows to files of its own below a shared folder; the paths."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            if len(pdf):
                path = os.path.join(folder, uuid.uuid4().hex)
                write(pdf, path)
                yield pd.DataFrame({"path": [path]})

    return [r["path"] for r in rows.mapInPandas(run, "path string").collect()]


@query("src09_arrow", "select doc_id, source, n_chars from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    def write(pdf: pd.DataFrame, path: str) -> None:
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(pdf["doc_id"], pa.int64()), "source": pa.array(pdf["source"], pa.string()), "n_chars": pa.array(pdf["n_chars"].astype("Int64"), pa.int64())})
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, batch.schema) as out:
            out.write_batch(batch)

    paths = _per_task(table(spark, d, "documents").select("doc_id", "source", "n_chars"), write, _root(spark))
    return readers.arrow_file(spark, paths, "doc_id long, source string, n_chars long")


_CELL = "nullif(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), '\\r'), '', ''), '')"


@query("src10_tsv", f"select distinct {_CELL.format('record_id')} as record_id, {_CELL.format('question')} as question, {_CELL.format('answer')} as answer from decontamination where record_id is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark table with line ends, quotes and tabs inside its cells."""
    path = os.path.join(_root(spark), "bench.tsv")
    writers.write_tsv(table(spark, d, "decontamination").where("record_id is not null").select("record_id", "question", "answer").distinct(), path)
    return readers.tsv(spark, path, ["record_id", "question"])


@query("src13_pairs", f"select i as \"Index\", 'q' || ((i - 1) // 2) as \"Question\", (i - 1) // 2 as pair from (select unnest(range(1, 1 + 2 * (select count(*) from {SCENES}))) as i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two rows a scene pair, in the order of the table."""
    placed = numbered(table(spark, d, SCENES).select(F.col("ordinal").alias("at")), "at", name="place")
    rows = placed.select("place", F.explode(F.sequence(F.col("place") * 2 + 1, F.col("place") * 2 + 2)).alias("Index")).select("Index", F.concat(F.lit("q"), F.col("place").cast("string")).alias("Question"))
    path = os.path.join(_root(spark), "pairs.csv")
    rows.write.option("header", True).csv(path)
    return readers.paired_csv(spark, path).select("Index", "Question", "pair")


@query("src15_archives", "select doc_id, source from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines inside compressed tar archives, one archive a batch."""

    def write(pdf: pd.DataFrame, path: str) -> None:
        data = pdf.to_json(orient="records", lines=True).encode()
        with tarfile.open(path + ".tar.gz", "w:gz") as t:
            info = tarfile.TarInfo("run/rows.jsonl")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))

    root = _root(spark)
    _per_task(table(spark, d, "documents").select("doc_id", "source"), write, root)
    return readers.archive_lines(spark, root).select(F.from_json("value", "doc_id long, source string").alias("r")).select("r.*")


@query("src16_members", "select doc_id::varchar || '.txt' as member, octet_length(encode(text))::bigint as bytes, sha256(text) as sha256 from documents where text is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the members of zip archives."""

    def write(pdf: pd.DataFrame, path: str) -> None:
        with zipfile.ZipFile(path + ".zip", "w", zipfile.ZIP_STORED) as z:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                z.writestr(f"{doc}.txt", text.encode())

    root = _root(spark)
    _per_task(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), write, root)
    return readers.archive_digests(spark, root)


@query("src12_embedded", "select doc_id, i::int as image_index, 'p' || i as path, octet_length(encode(text || i))::bigint as n_bytes, sha256(text || i) as sha256 from documents, range(0, 2) as t(i) where text is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Parquet rows with two embedded images each."""
    path = os.path.join(_root(spark), "embedded.parquet")
    image = lambda i: F.struct(F.encode(F.concat("text", F.lit(str(i))), "UTF-8").alias("bytes"), F.lit(f"p{i}").alias("path"))
    table(spark, d, "documents").where("text is not null").select("doc_id", F.array(image(0), image(1)).alias("images")).write.parquet(path)
    return readers.embedded_images(spark.read.parquet(path), "doc_id", "images").select("doc_id", "image_index", "path", "n_bytes", "sha256")


@query("snk01_canonical", "select ordinal, md5('{\"arm\":\"' || arm || '\",\"ordinal\":' || ordinal || case when pair_member is null then '' else ',\"pair_member\":\"' || pair_member || '\"' end || '}') as digest from mixture_profiles where arm is not null")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The text of canonical lines: keys in order, nulls left out."""
    path = os.path.join(_root(spark), "canonical.jsonl")
    writers.write_lines(table(spark, d, "mixture_profiles").where("arm is not null").select("pair_member", "ordinal", "arm"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.ordinal").cast("long").alias("ordinal"), F.md5("value").alias("digest"))


@query("snk02_table", "select arm, count(*)::varchar as n from mixture_profiles where arm is not null group by arm union all select arm, count(*)::varchar from mixture_profiles where arm is not null group by arm")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A report table read again from its CSV and from its JSON form."""
    root = _root(spark)
    writers.write_table(table(spark, d, "mixture_profiles").where("arm is not null").groupBy("arm").agg(F.count("*").alias("n")), root, "arms")
    return spark.read.option("header", True).csv(f"{root}/arms.csv").unionByName(spark.read.schema("arm string, n string").json(f"{root}/arms.json"))


@query("snk03_training", "select ordinal, arm, row_number() over (order by ordinal) - 1 as place from mixture_profiles")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A training file keeps the order of its stream."""
    path = os.path.join(_root(spark), "train.parquet")
    writers.write_training(table(spark, d, "mixture_profiles").select("ordinal", "arm"), path)
    return numbered(spark.read.parquet(path), "ordinal", name="place")


@query("snk07_image_index", "select sha256(image_path) as sha256, sha256(image_path) || '.png' as name, count(*) as n_uses from decontamination where image_path like '%.png' group by image_path")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Images named by their digests; here a path stands for its content."""
    rows = table(spark, d, "decontamination").where("image_path like '%.png'").select("image_path", F.sha2("image_path", 256).alias("sha256"))
    return writers.image_index(rows, "image_path", "sha256").select("sha256", "name", "n_uses")
