"""Row numbers over a whole table without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.session import cut


def numbered(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Rows with their place, from 0, in an order over the whole table, as ``name``; a column of that name is replaced.

    Rows are partitioned by range and sorted inside; a row's place is the number of rows in earlier partitions (prefix
    sums of one count a partition) plus its place inside. Nulls come first, rows with equal keys are placed in any
    order. An empty table stays empty.
    """
    placed = cut(rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    before, offsets = 0, {}
    for p, n in counts:
        offsets[p] = before
        before += n
    if not offsets:
        return placed.withColumn(name, F.col("__id")).drop("__id")
    start = placed.sparkSession.createDataFrame(sorted(offsets.items()), "__part long, __before long")
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(start), "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__id", "__before")
