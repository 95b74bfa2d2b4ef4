"""Queries that run a stream over the event table to its end and return what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import collections as C
from ..sources.collections import shared_folder, sql
from ..streaming import live
from .base import Plan


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream; a table is a file or a folder of files."""
    schema = C.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream over all that is there into a Parquet sink, and reads the sink."""
    spark, root = stream.sparkSession, _folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _publish(spark, d):
    messages = _events(spark, d).select(F.col("event_id").alias("msg"), F.concat_ws(":", "event_type", "user_id").alias("channel"), F.col("props").alias("payload"))
    subs = F.broadcast(C.subscriptions(spark, d))  # a constant table; its size isn't known to Spark, which would broadcast the messages of a small file
    return finished(live.route(messages, subs), "live-publish")


def _entries(spark, d):
    return _events(spark, d).select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))


def _xadd(spark, d):
    return finished(live.distinct_entries(_entries(spark, d), "ts", "60 days", "key", "seq").select("key", "seq"), "live-xadd")


def _windows(spark, d):
    found = finished(live.windowed_lengths(_entries(spark, d), "ts", "1 day", "1 day"), "live-windows")
    return found.select("key", F.unix_millis("start").alias("start_ms"), "n")


def _fold(spark, d):
    """Every event increments its user's counter; replies are running totals."""
    log = _events(spark, d).select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.lit("incrby").alias("op"), F.round(F.col("value") * 100).cast("bigint").cast("string").alias("arg"))
    return finished(live.fold(log), "live-incrby")


PLANS = {
    "live_publish": Plan(_publish, sql("SELECT msg, channel, payload, subscriber, kind, pattern FROM msgs JOIN subs ON CASE kind WHEN 'exact' THEN channel = pattern ELSE channel GLOB pattern END", "msgs", "subs")),
    "live_xadd": Plan(_xadd, "SELECT DISTINCT 'user:' || user_id AS key, event_id AS seq FROM events"),
    "live_windows": Plan(_windows, """
WITH w AS (SELECT 'user:' || user_id AS key, epoch_us(ts) // 86400000000 * 86400000 AS start_ms, count(*) AS n FROM events GROUP BY 1, 2)
SELECT key, start_ms, n FROM w WHERE start_ms + 86400000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 86400000"""),
    "live_incrby": Plan(_fold, sql("SELECT key, seq, CAST(CAST(sum(n) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS VARCHAR) AS reply FROM log", "log")),
}
