"""Samples that stay the same on every run and partitioning and only grow as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.keys import unit_hash

SALT = "stable-sample-v1"


def stable_sample(df: DataFrame, key: Column | str, rate: float, salt: str = SALT, key_name: str = "sample_key", value_name: str = "sample_value") -> DataFrame:
    """Rows whose key hashes below ``rate``.

    The key is hashed with a fixed salt to [0, 1) and kept below the rate, so the decision depends on the key alone:
    all rows of a key are kept or left out together, a kept key stays when rows are added, and a higher rate keeps
    what a lower rate kept. Rows with a null key cannot be told apart across deliveries and are never selected. The
    result has the input's columns and the key and hash under ``key_name`` and ``value_name``, which must be new. No
    shuffle takes place. An empty input gives an empty result.
    """
    if not 0.0 <= rate <= 1.0:
        raise ValueError(f"rate must lie in [0, 1]: {rate}")
    taken = {c.lower() for c in df.columns} & {key_name.lower(), value_name.lower()}
    if taken or key_name.lower() == value_name.lower():
        raise ValueError(f"column names already in use: {sorted(taken)}")
    keyed = df.withColumn(key_name, key if isinstance(key, Column) else F.col(key))
    return keyed.withColumn(value_name, unit_hash(F.col(key_name).cast("string"), salt)).where(F.col(value_name) < rate)


def sample_report(sample: DataFrame, by: list[str], key_name: str = "sample_key") -> DataFrame:
    """Selected rows and keys per group."""
    return sample.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct(key_name).alias("n_keys"))
