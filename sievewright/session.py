"""Session defaults, lineage cuts and size checks shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when the optimizer's size estimate stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024


def build_session(app: str = "sievewright", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; a cluster's own settings win when they are set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is chosen where none is set and all tasks run on this machine; a cluster without a shared folder
    raises, since a folder of one machine would lose data with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"sievewright-{os.getuid()}"))


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the one of the checkpoints."""
    ensure_checkpoint_dir(spark)
    return str(spark.sparkContext.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's size in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the estimated size is under ``limit``; otherwise the plan keeps its shuffle join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def broadcast_if_few(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows, at a bound of bytes a row, fit under ``limit``."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
