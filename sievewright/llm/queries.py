"""Queries of the language-model operators over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievewright.llm import cutting, leakage, mixing, packing, record_queries
from sievewright.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "decontamination")
    return leakage.find_leaks(leakage.corpus_of(table(spark, d, "documents"), records), leakage.held_out(records))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("corpus_table", "corpus_key", "dataset", "item_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def p5_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "token_limits"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(p5_pack(spark, d))


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each document and setting: whether its parts follow each other from its first token on, and whether their containers hold no more than they can."""
    packed = p5_pack(spark, d)
    load = F.sum("tokens").over(Window.partitionBy("setting", "container"))
    next_token = F.col("first_token") + F.col("tokens")
    parts = packed.withColumn("within", load <= F.col("capacity"))
    ends = parts.groupBy("setting", "doc_id").agg(F.min("first_token").alias("lo"), F.max(next_token).alias("hi"), F.sum("tokens").alias("n"), F.min("within").alias("within"))
    return ends.select("setting", "doc_id", ((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).alias("covered"), "within")


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Each source of a mix with its target and whether no document is used more often than it may be."""
    return p6_shares(spark, d).select("mix_id", "source", "target_share", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("within"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.pieces(table(spark, d, "documents"), table(spark, d, "token_limits"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return cutting.piece_report(p7_pieces(spark, d))


def p7_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each text that its pieces cover without a gap, per setting; a text that is not cut covers itself."""
    documents = table(spark, d, "documents").where("doc_id is not null and text is not null")
    settings = table(spark, d, "token_limits").where("purpose = 'piece'").select("setting")
    w = Window.partitionBy("setting", "doc_id").orderBy("piece")
    linked = p7_pieces(spark, d).select("setting", "doc_id", "end_byte", (F.col("start_byte") <= F.coalesce(F.lag("end_byte").over(w), F.lit(0))).alias("follows"))
    cut = linked.groupBy("setting", "doc_id").agg(F.max("end_byte").alias("end"), F.min("follows").alias("whole"))
    texts = documents.select("doc_id", F.octet_length("text").cast("long").alias("size")).crossJoin(F.broadcast(settings))
    covered = F.when(F.col("end").isNull(), F.col("size")).when(F.col("whole"), F.col("end")).otherwise(0)
    return texts.join(cut, ["setting", "doc_id"], "left").select("setting", "doc_id", covered.alias("covered_bytes"))


_NOT_BLANK = r"regexp_matches(text, '[^\s\p{Z}\x{FEFF}\x{0B}\x{1C}-\x{1F}\x{85}]')"
_SOURCE = "replace(replace(lower(trim(source)), '-', '_'), ' ', '_')"
_SQL = {
    "p5_coverage": f"select l.setting, d.doc_id, true as covered, true as within from (select distinct doc_id from documents where doc_id is not null and {_NOT_BLANK}) d, token_limits l where l.purpose = 'container'",
    "p6_limits": f"select mix_id, {_SOURCE} as source, target_share, max_repeats, true as within from mix_targets",
    "p7_bytes": "select l.setting, d.doc_id, octet_length(encode(d.text))::bigint as covered_bytes from documents d, token_limits l where l.purpose = 'piece' and d.text is not null",
}


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_report": p1_report,
        "p5_pack": p5_pack,
        "p5_report": p5_report,
        "p5_coverage": p5_coverage,
        "p6_mix": p6_mix,
        "p6_shares": p6_shares,
        "p6_limits": p6_limits,
        "p7_pieces": p7_pieces,
        "p7_report": p7_report,
        "p7_bytes": p7_bytes,
    } | record_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that need no tokenizer and no learned space, and of what must hold of the others' results.

    Tests compare the others with brute force.
    """
    return record_queries.SQL | _SQL
