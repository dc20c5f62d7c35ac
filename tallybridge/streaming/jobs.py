"""Continuous intake, inbox matching and incremental archive upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.archive_log import ArchiveLog


def intake(documents: DataFrame, time: str = "ts", lateness: str = "40 days") -> DataFrame:
    """Documents de-duplicated by content hash while their hash is within the watermark."""
    return documents.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["sha"])


def inbox_match(
    messages: DataFrame, charges: DataFrame, before: int = 10, after: int = 5, lateness: str = "20 days", width: int = 8
) -> DataFrame:
    """Pairs of message and charge whichever arrives first.

    Both sides carry a watermark at least as wide as the window, so state older than any possible
    partner is dropped and no pair inside the window is lost. Times are cut into buckets of
    ``width`` days: a charge is kept under every bucket its window touches, a message under its own,
    so a pair meets once and one mailbox's state is spread over as many keys as it has buckets.
    """
    def bucket(time) -> Column:
        return F.floor(F.unix_timestamp(time) / (width * 86400)).cast("bigint")

    low, high = (F.col("charge_time") + F.expr(f"INTERVAL {days} DAYS") for days in (-before, after))
    m = messages.withWatermark("message_time", lateness).withColumn("bucket", bucket(F.col("message_time"))).alias("m")
    c = charges.withWatermark("charge_time", lateness).withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(high)))).alias("c")
    within = F.expr(
        f"m.mailbox = c.mailbox AND m.bucket = c.bucket AND m.message_time >= c.charge_time - INTERVAL {before} DAYS "
        f"AND m.message_time <= c.charge_time + INTERVAL {after} DAYS"
    )
    return m.join(c, within).select("c.row_key", "m.message_id", "m.message_time", "c.charge_time")


def run_available(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a parquet table and return the table."""
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark: SparkSession = df.sparkSession
    return spark.read.schema(df.schema).parquet(out)


def upsert_stream(incoming: DataFrame, log: ArchiveLog, checkpoint: str) -> None:
    """Apply the archive upsert to every micro-batch.

    Batch ``n`` reads version ``n`` of the archive and writes version ``n + 1``, rewriting only the
    buckets it changes; a batch replayed after a failure finds its version there or starts it anew.
    """
    incoming.writeStream.foreachBatch(log.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
