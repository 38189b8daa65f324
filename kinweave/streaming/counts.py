"""An extension: counts over growing inputs with Structured Streaming.

Contexts must be closed when they arrive, a context's rows in one batch file. Counts then add up across batches, so the
state of a query is one number a key; windowed counts also drop their state once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.counts import pair_counts_from_contexts


def concept_stream(contexts: DataFrame) -> DataFrame:
    """Running concept counts of a stream of contexts."""
    return contexts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"))


def windowed_concepts(events: DataFrame, time: str, concept: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, concept_id, n): counts in tumbling windows of event time, final when the watermark passes them."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width), F.col(concept).alias("concept_id")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "concept_id", "n")


def fold_pair_counts(contexts: DataFrame, path: str, checkpoint: str):
    """Write each batch's pair sums below `path`, one folder a batch, overwritten on retry; read them with folded_pairs()."""

    def store(batch: DataFrame, number: int) -> None:
        one = batch.withColumn("context_count", F.lit(1).cast("long"))
        pair_counts_from_contexts(one).select("i", "j", "n_ij").write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
        batch.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/singles/batch={number}")

    return contexts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def folded_pairs(spark, path: str) -> DataFrame:
    """Pair counts summed over the batches so far."""
    pairs = spark.read.parquet(f"{path}/pairs").groupBy("i", "j").agg(F.sum("n_ij").alias("n_ij"))
    singles = spark.read.parquet(f"{path}/singles").groupBy("concept_id").agg(F.sum("n").alias("n"))
    side = lambda k: singles.select(F.col("concept_id").alias(k), F.col("n").alias(f"n_{k}"))
    return pairs.join(side("i"), "i").join(side("j"), "j").select("i", "j", "n_ij", "n_i", "n_j")
