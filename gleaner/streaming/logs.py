"""Interaction logs: batch and incremental analytics over an append-only JSON-lines log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions

SCHEMA = "ts timestamp, query string, top_k int, results array<struct<id:string,name:string,score:double>>"


def read_log(spark: SparkSession, path: str, *, stream: bool = False, files_per_trigger: int = 64) -> DataFrame:
    """Records of a log; malformed lines and blank queries are left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    return reader.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(F.col("query").isNotNull() & (F.trim("query") != ""))


def query_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("n"))


def returned_counts(log: DataFrame) -> DataFrame:
    """How often each result was returned, by id, else by name."""
    return log.select(F.explode("results").alias("r")).groupBy(F.coalesce("r.id", "r.name").alias("id")).agg(F.count("*").alias("n"), F.avg("r.score").alias("mean_score"))


def windowed_counts(events: DataFrame, *, ts: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window and group; with a watermark, so state ends with the window. An extension."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: events closer than ``gap``. An extension."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def upsert_batches(log: DataFrame, target: str, checkpoint: str):
    """Start an incremental count of queries: each batch's counts are added to the table of versions at ``target``.

    A batch that is run again after its commit changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        versions.add_batch(versions.Table(batch.sparkSession, target), query_counts(batch), number, ["query"], ["n"])

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    return versions.Table(spark, target).read()
