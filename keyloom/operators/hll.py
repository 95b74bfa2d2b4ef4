"""Approximate distinct counts: relations (key, sketch) of Spark's own binary sketches, which merge natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two to this many registers a sketch, as in the reference contract: a standard error of 0.8 %.
PRECISION = 14
#: Bytes before the registers of a sketch that has them all; those that follow are one a register.
HEAD = 40


def sketches(rows: DataFrame) -> DataFrame:
    """PFADD of (key, member) to new sketches; null members are nothing to add. Partial sketches are made in map tasks."""
    return rows.where(F.col("member").isNotNull()).groupBy("key").agg(F.hll_sketch_agg("member", PRECISION).alias("sketch"))


def _content(sketch: Column) -> Column:
    """Equal for sketches that hold the same, whatever the order and the partial sketches from which they were made.

    Estimates of large sketches aren't, for that of a merged sketch is made in another way; their registers are.
    Small ones keep their members' hashes one by one, and their estimate counts these.
    """
    registers = 1 << PRECISION
    return F.when(F.octet_length(sketch) == HEAD + registers, F.substring(sketch, HEAD + 1, registers)).otherwise(F.hll_sketch_estimate(sketch).cast("string").cast("binary"))


def add(held: DataFrame, rows: DataFrame) -> DataFrame:
    """PFADD to sketches that are there: the relation afterwards, with ``changed`` where some register of a key changes."""
    both = held.select("key", F.col("sketch").alias("_old")).join(sketches(rows).select("key", F.col("sketch").alias("_new")), "key", "full")
    merged = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).otherwise(F.hll_union("_old", "_new"))
    changed = F.col("_new").isNotNull() & (F.col("_old").isNull() | (_content(merged) != _content(F.col("_old"))))
    return both.select("key", merged.alias("sketch"), changed.alias("changed"))


def merge(held: DataFrame, asked: DataFrame) -> DataFrame:
    """PFMERGE by (req, key): sketches as (key, sketch), where key is the request. What the target held is not merged."""
    rows = asked.select("req", "key").distinct().join(held.select("key", "sketch"), "key")
    return rows.groupBy(F.col("req").alias("key")).agg(F.hll_union_agg("sketch").alias("sketch"))


def count(held: DataFrame) -> DataFrame:
    """PFCOUNT: the estimate of each key; of several keys together after ``merge``."""
    return held.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
