"""Writers: canonical lines, tables, ordered Parquet and files that are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(*names: str) -> Column:
    """A row as JSON with its keys in order; null fields are left out."""
    return F.to_json(F.struct(*sorted(names)))


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """Canonical JSON lines in a new folder; an existing one raises."""
    df.select(canonical_json(*df.columns).alias("value")).write.mode("errorifexists").option("compression", compression).text(path)


def write_table(df: DataFrame, root: str, name: str, columns: list[str] | None = None) -> None:
    """A report table as CSV and JSON, one file each; null is an empty cell. Names must hold no separator.

    A report is small by nature; tables of any size go through ``write_tsv`` or ``write_lines``.
    """
    if "/" in name or "\\" in name or name in ("", ".", ".."):
        raise ValueError(f"bad table name: {name!r}")
    out = df.select(*(columns or df.columns)).coalesce(1)
    out.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(f"{root}/{name}.csv")
    out.write.mode("errorifexists").json(f"{root}/{name}.json")


def write_training(df: DataFrame, path: str, ordinal: str = "ordinal") -> None:
    """A training stream in its order: range-partitioned and sorted by ordinal, so readers can restore the order."""
    df.repartitionByRange(F.col(ordinal)).sortWithinPartitions(ordinal).write.mode("errorifexists").parquet(path)


def tsv_cell(c: Column) -> Column:
    """Text fit for one cell: CRLF becomes LF, a lone carriage return its escape."""
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", r"\\r")


def write_tsv(df: DataFrame, path: str, files: int | None = None) -> int:
    """A benchmark table, in as many files as there are tasks or in ``files``; returns the number of rows whose text had a lone carriage return."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    lone = df.where(F.greatest(*[F.coalesce(F.replace(F.col(c), F.lit("\r\n"), F.lit("")).contains("\r").cast("int"), F.lit(0)) for c in texts], F.lit(0)) == 1).count() if texts else 0
    out = df.withColumns({c: tsv_cell(F.col(c)) for c in texts})
    (out.coalesce(files) if files else out).write.mode("errorifexists").option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').csv(path)
    return lone


def image_index(rows: DataFrame, path: str, digest: str) -> DataFrame:
    """Names of images by content: ``sha256``, ``name`` (digest and extension), ``first_path``, ``n_uses``.

    Paths of one content share a name; the smallest path gives the extension. Rows without a path or digest are left out.
    """
    known = rows.where(F.col(path).isNotNull() & F.col(digest).isNotNull())
    grouped = known.groupBy(F.col(digest).alias("sha256")).agg(F.min(path).alias("first_path"), F.count("*").alias("n_uses"))
    extension = F.lower(F.regexp_extract("first_path", r"(\.[A-Za-z0-9]+)$", 1))
    return grouped.select("sha256", F.concat("sha256", extension).alias("name"), "first_path", "n_uses")
