"""Derived inputs of the core queries: measurement rows made from the tables by fixed hashes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions.keys import SQL_ITEM_KEY, SQL_UNIT_HASH, item_key, unit_hash
from sievewright.session import table

SCENES = "scene_training_n8_l3_first"
RUNS = (("base", 0, 0.45), ("base", 1, 0.5), ("tuned", 0, 0.65), ("tuned", 1, 0.6))


def _flag(name: str, p: float) -> Column:
    return unit_hash(F.col("item_id"), name) < p


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Pair outcomes of four runs over the scene pairs: ordinal, item_id, layer, cell, run, seed, correct_a, correct_b, pair_correct."""
    rows = table(spark, d, SCENES).select("ordinal", item_key("pair_id").alias("item_id"), "layer", "cell", "role").where("item_id is not null")
    each = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(s).alias("seed"), _flag(f"{r}|{s}|a", p).alias("correct_a"), _flag(f"{r}|{s}|b", p).alias("correct_b")) for r, s, p in RUNS])
    return rows.select("*", F.explode(each).alias("x")).select("ordinal", "item_id", "layer", "cell", "role", "x.*").withColumn("pair_correct", F.col("correct_a") & F.col("correct_b"))


def _sql_hash(name: str, key: str) -> str:
    return SQL_UNIT_HASH.format(f"'{name}|' || {key}")


TRIALS = "scene_rows as (select ordinal, " + SQL_ITEM_KEY.format("pair_id") + f" as item_id, layer, cell, role from {SCENES}), trials as (" + " union all ".join(
    f"select ordinal, item_id, layer, cell, role, '{r}' as run, {s} as seed, {_sql_hash(f'{r}|{s}|a', 'item_id')} < {p} as correct_a, {_sql_hash(f'{r}|{s}|b', 'item_id')} < {p} as correct_b, ({_sql_hash(f'{r}|{s}|a', 'item_id')} < {p} and {_sql_hash(f'{r}|{s}|b', 'item_id')} < {p}) as pair_correct from scene_rows where item_id is not null"
    for r, s, p in RUNS
) + ")"


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen rollouts of each corpus item with and without its image: qid, category, row_index, condition, bits."""
    items = table(spark, d, "corpus_rows").groupBy("qid").agg(F.max(F.coalesce("pass_rate_7b_base", F.lit(0.3))).alias("p"), F.max(F.coalesce("category", F.lit("unknown"))).alias("category"))
    items = items.withColumn("p", F.when(F.col("p") < 0, 0.3).otherwise(F.col("p")))
    each = [F.struct(F.lit(c).alias("condition"), F.array(*[unit_hash(F.col("qid"), f"{c}|{i}") < F.col("p") * w for i in range(16)]).alias("bits")) for c, w in (("real", 1.0), ("blind", 0.5))]
    return items.select("qid", "category", F.explode(F.array(*each)).alias("x")).select("qid", "category", "x.condition", "x.bits")


def _bits(c: str, w: float) -> str:
    return "[" + ", ".join(f"{_sql_hash(f'{c}|{i}', 'qid')} < p * {w}" for i in range(16)) + "]"


ROLLOUTS = (
    "corpus_items as (select qid, case when p < 0 then 0.3 else p end as p, category from (select qid, max(coalesce(pass_rate_7b_base, 0.3)) as p, max(coalesce(category, 'unknown')) as category from corpus_rows group by qid)), "
    f"rollouts as (select qid, category, 'real' as condition, {_bits('real', 1.0)} as bits from corpus_items union all select qid, category, 'blind', {_bits('blind', 0.5)} from corpus_items)"
)


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses to the held-out and training records: the answer dressed in one of six ways by a hash."""
    rows = table(spark, d, "decontamination").where("answer is not null and record_id is not null").groupBy("record_id").agg(F.max("answer").alias("gold"), F.max(F.coalesce("question", F.lit(""))).alias("question"))
    u = F.floor(unit_hash(F.col("record_id"), "dress") * 6)
    said = (
        F.when(u == 0, F.concat(F.lit("So it is <answer> "), F.col("gold"), F.lit(" </answer>")))
        .when(u == 1, F.concat(F.lit("<answer>none</answer> no, <ANSWER>"), F.col("gold"), F.lit("</ANSWER>")))
        .when(u == 2, F.concat(F.lit("Therefore \\boxed{"), F.col("gold"), F.lit("}")))
        .when(u == 3, F.concat(F.lit("First.\nFinal answer: "), F.col("gold"), F.lit("\nDone.")))
        .when(u == 4, F.concat(F.lit("I think\n\n"), F.col("gold"), F.lit(".")))
        .otherwise(F.lit("no idea <answer></answer>"))
    )
    return rows.withColumn("prediction", said)


RESPONSES = (
    "answered as (select record_id, max(answer) as gold, max(coalesce(question, '')) as question from decontamination where answer is not null and record_id is not null group by record_id), "
    "responses as (select record_id, gold, question, case floor(" + _sql_hash("dress", "record_id") + " * 6)::int "
    "when 0 then 'So it is <answer> ' || gold || ' </answer>' when 1 then '<answer>none</answer> no, <ANSWER>' || gold || '</ANSWER>' "
    "when 2 then 'Therefore \\boxed{' || gold || '}' when 3 then 'First.' || chr(10) || 'Final answer: ' || gold || chr(10) || 'Done.' "
    "when 4 then 'I think' || chr(10) || chr(10) || gold || '.' else 'no idea <answer></answer>' end as prediction from answered)"
)
