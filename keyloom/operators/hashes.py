"""Hashes in long form: relations (key, field, value), one row per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import decimal_number, drawn, glob, integer


def hset(hashes: DataFrame, log: DataFrame) -> DataFrame:
    """HSET, HMSET: the relation after a log (seq, key, field, value); ``added`` marks new fields."""
    last = log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    old = hashes.select("key", "field", F.col("value").alias("_old"))
    both = old.join(last, ["key", "field"], "full")
    return both.select("key", "field", F.coalesce("value", "_old").alias("value"), F.col("_old").isNull().alias("added"))


def hsetnx(hashes: DataFrame, log: DataFrame) -> DataFrame:
    """The rows that HSETNX adds."""
    first = log.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value"))
    return first.join(hashes.select("key", "field"), ["key", "field"], "left_anti")


def hget(hashes: DataFrame, requests: DataFrame) -> DataFrame:
    """HGET, HMGET, HEXISTS by requests (req, key, field): value, null where there is none."""
    return requests.join(hashes, ["key", "field"], "left").select("req", "key", "field", "value")


def hgetall(hashes: DataFrame, keys: DataFrame) -> DataFrame:
    """HGETALL, HKEYS, HVALS: the fields of the keys."""
    return hashes.join(keys.select("key").distinct(), "key", "left_semi")


def hdel(hashes: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the relation without the fields (key, field), the fields removed)."""
    gone = fields.select("key", "field").distinct()
    return hashes.join(gone, ["key", "field"], "left_anti"), hashes.join(gone, ["key", "field"], "left_semi").select("key", "field")


def hlen(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("key").agg(F.count("*").alias("n"))


def hincrby(hashes: DataFrame, log: DataFrame) -> DataFrame:
    """Sums of a log (key, field, n) on stored integers (missing: 0), with status ok, not_int or overflow; an overflow is that field's alone."""
    by = log.groupBy("key", "field").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
    both = by.join(hashes.select("key", "field", F.col("value").alias("_old")), ["key", "field"], "left")
    held = F.when(F.col("_old").isNull(), F.lit(0).cast("bigint")).otherwise(integer(F.col("_old")))
    total = (held.cast("decimal(38,0)") + F.col("n")).try_cast("bigint")
    return both.select("key", "field", total.alias("value"), F.when(held.isNull(), "not_int").when(total.isNull(), "overflow").otherwise("ok").alias("status"))


def hincrbyfloat(hashes: DataFrame, log: DataFrame) -> DataFrame:
    """As ``hincrby`` in doubles; status not_float where the stored text is no number."""
    by = log.groupBy("key", "field").agg(F.sum("x").alias("x"))
    both = by.join(hashes.select("key", "field", F.col("value").alias("_old")), ["key", "field"], "left")
    held = F.when(F.col("_old").isNull(), F.lit(0.0)).otherwise(decimal_number(F.col("_old")))
    return both.select("key", "field", (held + F.col("x")).alias("value"), F.when(held.isNull(), "not_float").otherwise("ok").alias("status"))


def hrandfield(hashes: DataFrame, count: int) -> DataFrame:
    """The first ``count`` fields of every hash, in a fixed order."""
    w = Window.partitionBy("key").orderBy("field")
    return hashes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count).drop("rn")


def hrandfield_repeated(hashes: DataFrame, times: int, seed: int = 0) -> DataFrame:
    """HRANDFIELD with a negative count: so many fields of every hash, with repeats and their values (key, draw, field, value)."""
    return drawn(hashes.select("key", "field", "value"), ["field"], times, seed)


def hscan(hashes: DataFrame, pattern: str) -> DataFrame:
    return hashes.where(glob(F.col("field"), pattern))
