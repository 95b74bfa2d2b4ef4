"""Lists: relations (key, pos, value) with dense 0-based positions, and n, the length of the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import clamp


def _numbered(rows: DataFrame, *order) -> DataFrame:
    """(key, pos, value) with positions made dense in the given order."""
    pos = (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("bigint")
    return rows.select("key", pos.alias("pos"), "value")


def push(lists: DataFrame, log: DataFrame, left: bool = False) -> DataFrame:
    """RPUSH, LPUSH of a log (seq, key, value): every push in turn, so the last left one is the head.

    Only the log's rows are numbered. What is in a list keeps its place behind pushes to the
    right, and moves up by the number of pushes to the left, so a long list is never sorted.
    """
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.col("seq").desc() if left else F.col("seq"))) - 1
    new = log.select("key", turn.cast("bigint").alias("pos"), "value")
    if left:
        moved = lists.join(log.groupBy("key").agg(F.count("*").alias("_more")), "key", "left")
        return moved.select("key", (F.col("pos") + F.coalesce("_more", F.lit(0))).alias("pos"), "value").unionByName(new)
    heads = lists.where("pos = 0").select("key", F.col("n").alias("_held")) if "n" in lists.columns else lists.groupBy("key").agg(F.count("*").alias("_held"))
    placed = new.join(heads, "key", "left").select("key", (F.col("pos") + F.coalesce("_held", F.lit(0))).alias("pos"), "value")
    return lists.select("key", "pos", "value").unionByName(placed)


def pop(lists: DataFrame, count: int = 1, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """LPOP, RPOP: (what is popped, in ``rank`` order; the lists afterwards)."""
    rank = F.col("pos") if left else F.col("n") - 1 - F.col("pos")
    gone = lists.where(rank < count).select("key", rank.alias("rank"), "value")
    kept = lists.where(rank >= count)
    return gone, kept.select("key", (F.col("pos") - count if left else F.col("pos")).alias("pos"), "value")


def llen(lists: DataFrame) -> DataFrame:
    return lists.groupBy("key").agg(F.count("*").alias("n"))


def lindex(lists: DataFrame, index: int) -> DataFrame:
    return lists.where(F.col("pos") == (F.lit(index) if index >= 0 else F.col("n") + index)).select("key", "value")


def lset(lists: DataFrame, index: int, value: str) -> DataFrame:
    at = F.lit(index) if index >= 0 else F.col("n") + index
    return lists.select("key", "pos", F.when(F.col("pos") == at, value).otherwise(F.col("value")).alias("value"))


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Inclusive; a stop before the head is the head, as in the reference contract."""
    low, high = clamp(start, stop, F.col("n"))
    return lists.where(F.col("pos").between(low, high)).select("key", "pos", "value")


def ltrim(lists: DataFrame, start: int, stop: int) -> DataFrame:
    low, high = clamp(start, stop, F.col("n"))
    return lists.where(F.col("pos").between(low, high)).select("key", (F.col("pos") - low).alias("pos"), "value")


def lrem(lists: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first (count > 0), last (count < 0) or all (0) occurrences of the value."""
    order = F.col("pos").asc() if count >= 0 else F.col("pos").desc()
    seen = F.count(F.when(F.col("value") == value, 1)).over(Window.partitionBy("key").orderBy(order))
    kept = F.col("value") != value
    if count:
        kept = kept | (F.col("_seen") > abs(count))
    return _numbered(lists.withColumn("_seen", seen).where(kept), "pos")


def linsert(lists: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """The value beside the first pivot of each list that has one."""
    at = lists.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    new = at.select("key", (F.col("pos") + (-0.5 if before else 0.5)).alias("_at"), F.lit(value).alias("value"))
    return _numbered(lists.select("key", F.col("pos").cast("double").alias("_at"), "value").unionByName(new), "_at")


def lpos(lists: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """Positions of the value, from the rank-th match on (negative: from the tail); count 0 is all."""
    if not rank:
        raise ValueError("rank can't be zero")
    rows = lists
    if maxlen:
        rows = rows.where(F.col("pos") < maxlen if rank > 0 else F.col("n") - F.col("pos") <= maxlen)
    order = F.col("pos").asc() if rank > 0 else F.col("pos").desc()
    hit = rows.where(F.col("value") == value).withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    hit = hit.where(F.col("rn") >= abs(rank))
    return (hit.where(F.col("rn") < abs(rank) + count) if count else hit).select("key", "pos")


def lmove(lists: DataFrame, moves: DataFrame, from_left: bool, to_left: bool) -> DataFrame:
    """LMOVE, RPOPLPUSH by moves (src, dst), each key in one move: the lists afterwards.

    A source without elements moves nothing.
    """
    end = F.col("pos") == (F.lit(0) if from_left else F.col("n") - 1)
    taken = lists.where(end).join(moves, F.col("key") == F.col("src")).select("src", "dst", "value")
    rest = lists.withColumn("_end", end).join(taken.select(F.col("src").alias("key"), F.lit(True).alias("_moves")), "key", "left")
    rest = rest.where(~(F.col("_end") & F.coalesce("_moves", F.lit(False))))
    new = taken.select(F.col("dst").alias("key"), F.lit(-1 if to_left else 1).alias("_side"), F.lit(0).cast("bigint").alias("_at"), "value")
    return _numbered(rest.select("key", F.lit(0).alias("_side"), F.col("pos").alias("_at"), "value").unionByName(new), "_side", "_at")


def first_of(lists: DataFrame, asked: DataFrame, left: bool = True) -> DataFrame:
    """BLPOP, BRPOP by requests (req, arg, key): the end of the first key that has elements. Never waits."""
    end = lists.where(F.col("pos") == (F.lit(0) if left else F.col("n") - 1)).select("key", "value")
    found = asked.join(end, "key").groupBy("req").agg(F.min_by(F.struct("key", "value"), "arg").alias("x"))
    return found.select("req", "x.key", "x.value")
