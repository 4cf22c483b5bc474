"""Extension, not a reference capability: a stream of scored rows, committed shard by shard.

Micro-batches are scored with the same functions as tables; each (method, seed, domain) of a batch goes to the shard store under the
batch's own fingerprint, so a batch that is run again after a failure is recognised and skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.store import ShardStore


def event_windows(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count and mean value of each type in sliding event-time windows, closed by a watermark."""
    w = F.window("ts", width, slide)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean_value")


def commit_batches(preds: DataFrame, store: ShardStore, fingerprint: dict, checkpoint: str) -> StreamingQuery:
    """Write a stream of predictions to the store, once a shard and batch."""

    def put(batch: DataFrame, epoch: int) -> None:
        fp = fingerprint | {"epoch": epoch}
        for r in batch.select("method", "seed", "domain").distinct().collect():
            key = r["method"], r["seed"], f"{r['domain']}-{epoch}"
            if not store.reuse(*key, fp):
                own = batch.where((F.col("method") == r["method"]) & (F.col("seed") == r["seed"]) & (F.col("domain") == r["domain"]))
                store.save(*key, fp, own)

    return preds.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
