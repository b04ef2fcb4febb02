"""Structured Streaming over scored responses: stateless scoring into an append-only log, and windowed rates.

The batch operators have no streaming counterpart upstream; these are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievewright.functions.answers import open_score

SCHEMA = "response_id string, item_id string, prediction string, gold string, at timestamp"


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A stream of response lines."""
    return spark.readStream.schema(SCHEMA).json(path)


def scored(stream: DataFrame) -> DataFrame:
    """Responses with span, tier, correct and strict; works on streams and tables alike."""
    return stream.withColumn("s", open_score(F.col("prediction"), F.col("gold"))).select("*", "s.*").drop("s")


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every response once, as Parquet; a restart goes on where the checkpoint ends."""
    return scored(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rates(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Accuracy per event-time window; responses later than the watermark are left out."""
    s = scored(stream).withWatermark("at", late)
    return s.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select("window.start", "window.end", "n", "accuracy")
