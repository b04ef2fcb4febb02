"""Mixing sources to target weights.

Within a source, documents are ordered by Efraimidis-Spirakis keys: exponential draws divided by the document's quality
weight. A source first contributes complete epochs; the rest of its budget is filled in key order. Prefix sums are
taken over fine key buckets first and inside the one bucket that holds the border only, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.keys import unit_hash
from sievewright.llm.tokens import VOCABULARY, measured, source_key
from sievewright.session import broadcast_if_small, cut

SALT = "source-mix-v1"
#: Key buckets per natural logarithm of the key; a bucket holds under 0.04 percent of a source.
FINENESS = 1024


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY, salt: str = SALT) -> tuple[DataFrame, DataFrame]:
    """Uses of documents per mix, and the shares reached.

    ``targets``: mix_id, source, target_share, max_repeats. The size of a mix is ``total_tokens`` or, without it, the
    largest at which every source that has documents meets its share within its repeats. A source gives
    ``min(share * size, max_repeats * available)`` tokens: complete epochs first, then documents in key order as long
    as this brings the sum nearer to the budget. Uses: ``mix_id``, ``source``, ``doc_id``, ``epoch`` (1, 2, ...),
    ``tokens``. Shares: per mix and source the target, the tokens, the share reached and the most uses of a document;
    a source without documents is listed with none. Documents of sources that no mix names are not used. Null, empty
    and blank texts have no tokens and are not used.
    """
    named = targets.where("mix_id is not null and source is not null and target_share > 0 and max_repeats > 0")
    named = named.groupBy("mix_id", source_key("source").alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = cut(measured(documents, vocabulary).groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"), F.max("quality").alias("quality")))
    available = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    plan = named.join(available, "source")
    reach = F.col("available") * F.col("max_repeats") / F.col("target_share")
    size = F.lit(float(total_tokens)) if total_tokens else F.min(reach).over(Window.partitionBy("mix_id"))
    plan = plan.withColumn("size", size).withColumn("budget", F.least(F.col("target_share") * F.col("size"), F.col("max_repeats") * F.col("available")))
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("available") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.col("budget") - F.col("epochs") * F.col("available"), F.lit(0.0)))
    plan = cut(plan.select("mix_id", "source", "target_share", "max_repeats", "available", "epochs", "rest"))
    key = -F.log(F.greatest(unit_hash(F.concat_ws("|", "mix_id", F.col("doc_id").cast("string")), salt), F.lit(1e-300))) / F.col("quality")
    drawn = sized.join(broadcast_if_small(plan.select("mix_id", "source", "epochs", "rest")), "source").withColumn("key", key)
    drawn = drawn.withColumn("bucket", F.floor(F.log(F.greatest("key", F.lit(1e-300))) * FINENESS))
    sums = drawn.where("rest > 0").groupBy("mix_id", "source", "bucket", "rest").agg(F.sum("tokens").alias("inside"))
    upto = sums.withColumn("before", F.sum("inside").over(Window.partitionBy("mix_id", "source").orderBy("bucket")) - F.col("inside"))
    border = upto.where("before <= rest and before + inside > rest").select("mix_id", "source", F.col("bucket").alias("border"), "before")
    placed = drawn.join(broadcast_if_small(border), ["mix_id", "source"], "left")
    edge = placed.where("bucket = border")
    running = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("key", "doc_id")) + F.col("before")
    edge = edge.withColumn("running", running).withColumn("extra", (F.col("running") - F.col("tokens") / 2 <= F.col("rest")).cast("int"))
    clear = placed.where("border is null or bucket <> border").withColumn("extra", F.coalesce((F.col("bucket") < F.col("border")).cast("int"), F.lit(0)))
    cols = ["mix_id", "source", "doc_id", "tokens", (F.col("epochs") + F.col("extra")).alias("uses")]
    used = clear.select(*cols).unionByName(edge.select(*cols)).where("uses > 0")
    uses = used.select("mix_id", "source", "doc_id", F.explode(F.sequence(F.lit(1), "uses")).alias("epoch"), "tokens")
    reached = used.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"), F.count("*").alias("n_docs"))
    whole = reached.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    shares = named.join(reached, ["mix_id", "source"], "left").join(whole, "mix_id", "left").select(
        "mix_id",
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round(F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)), 9).alias("share"),
    )
    return uses, shares
