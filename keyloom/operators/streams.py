"""Streams: relations (key, ms, seq, ...) ordered by id (ms, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(newest_first: bool = False):
    order = [F.col("ms").desc(), F.col("seq").desc()] if newest_first else ["ms", "seq"]
    return Window.partitionBy("key").orderBy(*order)


def entry_id(ms: Column, seq: Column) -> Column:
    return F.concat_ws("-", ms, seq)


def add(rows: DataFrame, tie: str) -> DataFrame:
    """XADD of (key, ms, ...) with ids by arrival: entries of one key and ms are numbered in ``tie`` order."""
    seq = F.row_number().over(Window.partitionBy("key", "ms").orderBy(tie)) - 1
    return rows.withColumn("seq", seq.cast("bigint"))


def add_at(streams: DataFrame, rows: DataFrame, arrival: str) -> DataFrame:
    """XADD with explicit ids (key, ms, seq, ...): the stream afterwards, ordered by id however they arrive.
    An id that is there already is written over, and of entries with one id the last to arrive stays."""
    columns = streams.columns
    last = rows.groupBy("key", "ms", "seq").agg(*(F.max_by(c, arrival).alias(c) for c in columns if c not in ("key", "ms", "seq"))).select(*columns)
    return streams.join(last.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti").select(*columns).unionByName(last)


def length(streams: DataFrame) -> DataFrame:
    return streams.groupBy("key").agg(F.count("*").alias("n"))


def _bound(text: str | None) -> tuple[int, int] | None:
    """``ms-seq``, or ``ms`` for ms-0; None, ``-`` and ``+`` are open."""
    if text is None or text in ("-", "+"):
        return None
    ms, _, seq = text.partition("-")
    return int(ms), int(seq or 0)


def inside(start: str | None = None, end: str | None = None) -> Column:
    """Ids from start to end, both inclusive; an inverted range is empty."""
    ms, seq = F.col("ms"), F.col("seq")
    found = F.lit(True)
    if (low := _bound(start)) is not None:
        found = found & (ms >= low[0]) & ((ms > low[0]) | (seq >= low[1]))
    if (high := _bound(end)) is not None:
        found = found & (ms <= high[0]) & ((ms < high[0]) | (seq <= high[1]))
    return found


def between(streams: DataFrame, start: str | None = None, end: str | None = None, count: int = 0, newest_first: bool = False) -> DataFrame:
    """XRANGE, XREVRANGE: per key, the first ``count`` entries (0: all), with their rank."""
    rows = streams.where(inside(start, end)).withColumn("rn", F.row_number().over(_order(newest_first)))
    rows = rows.where(F.col("rn") <= count) if count else rows
    return rows.withColumn("rank", (F.col("rn") - 1).cast("bigint")).drop("rn")


def read(streams: DataFrame, positions: DataFrame, count: int = 0) -> DataFrame:
    """XREAD by (key, last_ms, last_seq): entries from the position on, which is included."""
    rows = streams.join(positions, "key").where((F.col("ms") > F.col("last_ms")) | (F.col("ms") == F.col("last_ms")) & (F.col("seq") >= F.col("last_seq")))
    rows = rows.drop("last_ms", "last_seq").withColumn("rn", F.row_number().over(_order()))
    rows = rows.where(F.col("rn") <= count) if count else rows
    return rows.withColumn("rank", (F.col("rn") - 1).cast("bigint")).drop("rn")


def trim(streams: DataFrame, maxlen: int = 0) -> DataFrame:
    """XTRIM MAXLEN, XADD MAXLEN: the newest ``maxlen`` entries of each key."""
    return streams.withColumn("rn", F.row_number().over(_order(True))).where(F.col("rn") <= maxlen).drop("rn")


def delete(streams: DataFrame, ids: DataFrame) -> DataFrame:
    return streams.join(ids.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")


def create_groups(streams: DataFrame, group: str, at_end: bool = True) -> DataFrame:
    """XGROUP CREATE on every key: (key, grp, last_ms, last_seq), at the last entry ($) or at 0."""
    last = F.max(F.struct("ms", "seq"))
    rows = streams.groupBy("key").agg(last.alias("last"))
    zero = F.lit(0).cast("bigint")
    return rows.select("key", F.lit(group).alias("grp"), F.col("last.ms") if at_end else zero.alias("ms"), F.col("last.seq") if at_end else zero.alias("seq")).toDF("key", "grp", "last_ms", "last_seq")


def destroy_group(groups: DataFrame, group: str) -> DataFrame:
    return groups.where(F.col("grp") != group)


def acknowledge(pending: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XACK on (key, grp, ms, seq): (what stays pending, what is acknowledged)."""
    on = ["key", "grp", "ms", "seq"]
    return pending.join(ids.select(*on), on, "left_anti"), pending.join(ids.select(*on), on, "left_semi")


def group_info(groups: DataFrame, pending: DataFrame) -> DataFrame:
    """XINFO GROUPS: the groups (key, grp, last_ms, last_seq) with their last id and entries not yet acknowledged."""
    waiting = pending.groupBy("key", "grp").agg(F.count("*").alias("_n"))
    found = groups.join(waiting, ["key", "grp"], "left")
    return found.select("key", "grp", F.coalesce("_n", F.lit(0)).alias("pending"), entry_id(F.col("last_ms"), F.col("last_seq")).alias("last_id"))


def info(streams: DataFrame, groups: DataFrame) -> DataFrame:
    """XINFO STREAM: length, first and last id, and the number of groups."""
    size = streams.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("ms", "seq")).alias("a"), F.max(F.struct("ms", "seq")).alias("b"))
    held = groups.groupBy("key").agg(F.count("*").alias("g"))
    return size.join(held, "key", "left").select("key", "n", entry_id(F.col("a.ms"), F.col("a.seq")).alias("first_id"), entry_id(F.col("b.ms"), F.col("b.seq")).alias("last_id"), F.coalesce("g", F.lit(0)).alias("groups"))
