"""Readers of the record families. All declare their schemas; a gzip file is one task."""

from __future__ import annotations

import io
import os
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators.guards import GuardError, matches, required_columns, unique

KINDS = ("pairs", "items", "audits")


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str, ordinal: bool = True) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. ``ordinal`` orders rows by file and place."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not ordinal:
        return df
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("ordinal"))


def families(root: str, kind: str) -> dict[str, str]:
    """Paths of the families with a kind, in order of name. Unknown kinds and missing roots raise."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    paths = {f: os.path.join(root, f, f"{kind}.jsonl.gz") for f in sorted(os.listdir(root))}
    return {f: p for f, p in paths.items() if os.path.exists(p)}


def load(spark: SparkSession, root: str, kind: str, schema: T.StructType | str, family: str | list[str] | None = None, **filters: object) -> DataFrame:
    """Rows of one, several or all families with filters that reach the scan; ``family`` is a column."""
    present = families(root, kind)
    wanted = list(present) if family is None else [family] if isinstance(family, str) else list(family)
    missing = [f for f in wanted if f not in present]
    if missing or not wanted:
        raise FileNotFoundError(f"no {kind} for {missing or root}")
    parts = [json_lines(spark, present[f], schema, ordinal=False).withColumn("family", F.lit(f)) for f in wanted]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(matches(filters)) if filters else out


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest ``family -> kind -> {records, bytes, sha256}``: one row each."""
    entry = T.StructType([T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), entry))).alias("m"))
    return parsed.select(F.explode("m").alias("family", "kinds")).select("family", F.explode("kinds").alias("kind", "e")).select("family", "kind", "e.*")


def corpus_rows(df: DataFrame) -> DataFrame:
    """A corpus release in its normal form: unique ids or an error, missing pass rates as -1, missing images as none."""
    required_columns(df, ["qid", "question", "answer", "image_paths"])
    rates = {c: F.coalesce(F.nanvl(F.col(c), F.lit(-1.0)), F.lit(-1.0)) for c in df.columns if c.startswith("pass_rate")}
    return unique(df, ["qid"]).withColumns({**rates, "image_paths": F.coalesce("image_paths", F.array().cast("array<string>"))})


def arrow_file(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Record batches of Arrow files or streams, one task a file."""

    def read(batches: Iterator[pd.DataFrame]):
        import pyarrow as pa

        for pdf in batches:
            for path in pdf["path"]:
                with pa.memory_map(path) as source:
                    try:
                        reader = pa.ipc.open_file(source)
                        parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                    except pa.ArrowInvalid:
                        source.seek(0)
                        parts = iter(pa.ipc.open_stream(source))
                    for batch in parts:
                        yield batch.to_pandas()

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(read, schema)


def tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A benchmark table: tabs, quotes, embedded line ends; empty cells are null, all columns text."""
    df = spark.read.option("header", True).option("sep", "\t").option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return required_columns(df, columns or [])


def paired_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of consecutive pairs: Index from 1 without gaps, an even number of rows, one question a pair."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = required_columns(df, ["Index", "Question"]).withColumn("Index", F.col("Index").cast("long"))
    n = df.agg(F.count("*").alias("n"), F.min("Index").alias("lo"), F.max("Index").alias("hi"), F.count_distinct("Index").alias("d")).first()
    if n["n"] % 2 or (n["n"] and (n["lo"], n["hi"], n["d"]) != (1, n["n"], n["n"])):
        raise GuardError("Index must run from 1 without gaps over an even number of rows")
    out = df.withColumn("pair", F.floor((F.col("Index") - 1) / 2))
    if out.groupBy("pair").agg(F.count_distinct("Question").alias("q")).where("q > 1").limit(1).count():
        raise GuardError("a pair has two questions")
    return out


def yes_no_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of yes/no questions: truth 0/1 as No/Yes, a placeholder image where there is no visual input."""
    df = spark.read.option("multiLine", True).schema("question string, category string, visual_input string, filename string, gt_answer string").json(path)
    gold = F.when(F.col("gt_answer") == "1", "Yes").when(F.col("gt_answer") == "0", "No")
    return df.select("question", "category", F.when(F.col("visual_input") == "0", F.lit(None).cast("string")).otherwise(F.col("filename")).alias("image_path"), gold.alias("answer"))


def excel_replacement(spark: SparkSession, path: str) -> DataFrame:
    """Prediction tables that come as workbooks elsewhere, read from TSV or Parquet: index, answer, prediction."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else tsv(spark, path)
    return required_columns(df, ["index", "answer", "prediction"])


def archive_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """Lines of the text members of tar or zip archives: ``archive``, ``member``, ``line``, ``value``. One task an archive."""

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for member, data in _members(bytes(content)):
                    if member.endswith(suffix):
                        lines = [x for x in data.decode("utf-8").split("\n") if x.strip()]
                        yield pd.DataFrame({"archive": name, "member": member, "line": range(len(lines)), "value": lines})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "archive string, member string, line long, value string")


def archive_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digest and size of every archive member; raises where a member name has two digests."""
    import hashlib

    def read(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(m, len(d), hashlib.sha256(d).hexdigest()) for m, d in _members(bytes(content))]
                yield pd.DataFrame(rows, columns=["member", "bytes", "sha256"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "member string, bytes long, sha256 string").distinct()
    return unique(found, ["member"])


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if not info.is_dir():
                    yield info.filename, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in sorted(t.getmembers(), key=lambda i: i.name):
                if info.isfile():
                    yield info.name, t.extractfile(info).read()


def embedded_images(df: DataFrame, key: str, column: str) -> DataFrame:
    """Images that stand inside the rows of a Parquet table, as a struct of bytes and path or an array of them.

    One row an image: the key, ``image_index``, ``path``, ``bytes``, ``n_bytes``, ``sha256``. Rows without images and
    images without bytes give none.
    """
    several = df.schema[column].dataType.typeName() == "array"
    each = df.select(key, F.posexplode(F.col(column) if several else F.array(column)).alias("image_index", "x")).where("x.bytes is not null")
    return each.select(key, "image_index", "x.path", "x.bytes", F.octet_length("x.bytes").cast("long").alias("n_bytes"), F.sha2("x.bytes", 256).alias("sha256"))


def images(spark: SparkSession, root: str) -> DataFrame:
    """One row per distinct image content below a folder: ``sha256``, ``image_path`` (the smallest), ``duplicate_paths``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))
    grouped = files.groupBy("sha256").agg(F.array_sort(F.collect_list("path")).alias("p"))
    return grouped.select("sha256", F.col("p")[0].alias("image_path"), F.slice("p", 2, F.size("p")).alias("duplicate_paths"))


def image_records(rows: DataFrame, dataset: str, split: str, placeholder: str = "no_image.png") -> DataFrame:
    """One contamination record per item and image of a corpus: ids, place, path, whether the image applies, texts."""
    each = rows.select("qid", "question", "answer", "source", "category", F.posexplode_outer("image_paths").alias("image_index", "image_path"))
    index = F.coalesce("image_index", F.lit(0))
    return each.select(
        F.concat_ws(":", F.lit(dataset), F.lit(split), "qid", F.concat(F.lit("image"), index.cast("string"))).alias("record_id"),
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        F.col("qid").alias("item_id"),
        index.alias("image_index"),
        "image_path",
        (F.col("image_path").isNotNull() & ~F.col("image_path").endswith(placeholder)).alias("image_applicable"),
        "question",
        "answer",
        "source",
        "category",
    )


def audit_rows(df: DataFrame, rollouts: int = 16, schema_version: str | None = None) -> DataFrame:
    """Audit rows whose counts agree: array length, number of true samples and rate within 1e-9; any other row raises while it is read."""
    required_columns(df, ["sample_correct", "sample_count", "sample_correct_count", "p_sample"])
    hits = F.size(F.filter("sample_correct", lambda x: x))
    good = (F.size("sample_correct") == rollouts) & (F.col("sample_count") == rollouts) & (F.col("sample_correct_count") == hits) & (F.abs(F.col("p_sample") - hits / rollouts) <= 1e-9)
    if schema_version is not None:
        good = good & (F.col("schema_version") == schema_version)
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("audit row with counts that disagree")).cast("boolean")))


def filter_ids(ids: list) -> list[int]:
    """Row ids of a filter: a nonempty list of unique whole numbers from 0 on."""
    if not ids or any(isinstance(i, bool) or not isinstance(i, int) or i < 0 for i in ids) or len(set(ids)) != len(ids):
        raise GuardError("ids must be nonempty, unique and not negative")
    return list(ids)


def pinned_text(path: str, sha256: str) -> str:
    """A text file whose digest must be the one given."""
    import hashlib

    with open(path, "rb") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != sha256:
        raise GuardError(f"digest of {path} differs")
    return data.decode("utf-8")
