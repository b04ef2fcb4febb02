"""Projections: training rows, members of pairs, public and private parts, conditioned prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_rows(corpus: DataFrame) -> DataFrame:
    """Corpus items as training rows; the group of a natural item is its id with a prefix."""
    none = F.lit(None).cast("string")
    return corpus.select(F.col("question").alias("problem"), "answer", F.col("image_paths").alias("images"), F.concat(F.lit("virl:"), "qid").alias("pair_group_uid"), none.alias("pair_member"), none.alias("template_id"), "category")


def to_scorable(released: DataFrame) -> DataFrame:
    """Released pairs for scoring: the gold becomes the answer, a missing prediction is empty."""
    return released.withColumns({"answer_a": F.col("gold_a"), "answer_b": F.col("gold_b"), "prediction_a": F.coalesce("prediction_a", F.lit("")), "prediction_b": F.coalesce("prediction_b", F.lit(""))})


def members(pairs: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """Two rows a pair: ``side`` and the columns without their side suffix."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{c}_{s}").alias(c) for c in columns]) for s in ("a", "b")])
    return pairs.select(*keep, F.explode(sides).alias("m")).select(*keep, "m.*")


def public_part(release: DataFrame, secret: list[str]) -> DataFrame:
    """A release without its answers."""
    return release.drop(*secret)


def private_part(release: DataFrame, key: str, secret: list[str]) -> DataFrame:
    """The answers of a release by key."""
    return release.select(key, *secret)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """The table without columns that hold nulls only."""
    filled = df.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if filled[c]])


def conditioned_text(problem: Column, captions: Column, condition: str) -> Column:
    """Prompt text under a condition, null where the markers do not fit the images.

    ``real`` keeps the markers, ``none`` removes them and joins the parts with single blanks, ``caption`` puts the
    caption of each image in its place.
    """
    parts = F.split(problem, "<image>")
    fits = (F.size(parts) - 1) == F.size(captions)
    if condition == "real":
        text = problem
    elif condition == "none":
        text = F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda x: F.trim(x)), " "), "[ \t]+", " "))
    elif condition == "caption":
        filled = F.zip_with(F.slice(parts, 2, F.size(parts)), F.transform(captions, lambda c, i: F.concat(F.lit("\n[Image description "), (i + 1).cast("string"), F.lit(": "), c, F.lit("]\n"))), lambda p, c: F.concat(c, p))
        text = F.concat(parts[0], F.array_join(filled, ""))
    else:
        raise ValueError(f"unknown condition: {condition}")
    return F.when(fits, text)


def ordered_subset(rows: DataFrame, splits: list[str], ids: DataFrame | None, split: str = "split", index: str = "row_index") -> DataFrame:
    """Rows of the named splits; an id list restricts the first of them. ``place`` orders by the given splits and index."""
    order = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col(split))
    kept = rows.where(F.col(split).isin(splits))
    if ids is not None:
        first = kept.where(F.col(split) == splits[0]).join(ids.select(index).distinct(), index, "left_semi")
        kept = first.unionByName(kept.where(F.col(split) != splits[0]))
    return kept.withColumn("place", F.struct(order.alias("split_place"), F.col(index).alias("row")))
