"""Sorted sets: relations (key, member, score) in the order (score, member)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import clamp, glob

#: Fixed value: a change of a score by no more than this is none.
EPSILON = 2.220446049250313e-16


def _order(descending: bool = False):
    order = [F.col("score").desc(), F.col("member").desc()] if descending else ["score", "member"]
    return Window.partitionBy("key").orderBy(*order)


def add(zsets: DataFrame, log: DataFrame, mode: str = "") -> DataFrame:
    """ZADD of a log (seq, key, member, score): the relation afterwards, with ``added`` and ``changed``.

    Modes: '' the last score, 'nx' only new members, 'xx' only known ones, 'gt' and 'lt'
    only a larger or smaller score for known ones.
    """
    pick = {"": F.max_by("score", "seq"), "xx": F.max_by("score", "seq"), "nx": F.min_by("score", "seq"), "gt": F.max("score"), "lt": F.min("score")}[mode]
    new = log.groupBy("key", "member").agg(pick.alias("_new"))
    both = zsets.select("key", "member", F.col("score").alias("_old")).join(new, ["key", "member"], "full")
    old, new = F.col("_old"), F.col("_new")
    moved = {"": F.lit(True), "xx": F.lit(True), "nx": F.lit(False), "gt": new > old, "lt": new < old}[mode] & (F.abs(new - old) > EPSILON)
    score = F.when(old.isNull(), new).when(new.isNotNull() & moved, new).otherwise(old)
    out = both.select("key", "member", score.alias("score"), old.isNull().alias("added"), (old.isNotNull() & new.isNotNull() & moved).alias("changed"))
    return out.where("NOT added") if mode == "xx" else out


def remove(zsets: DataFrame, rows: DataFrame) -> DataFrame:
    return zsets.join(rows.select("key", "member"), ["key", "member"], "left_anti")


def score(zsets: DataFrame, requests: DataFrame) -> DataFrame:
    """ZSCORE, ZMSCORE by (req, key, member): null where there is none."""
    return requests.join(zsets, ["key", "member"], "left").select("req", "key", "member", "score")


def rank(zsets: DataFrame, descending: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK of every member, from 0."""
    return zsets.select("key", "member", (F.row_number().over(_order(descending)) - 1).cast("bigint").alias("rank"))


def cardinality(zsets: DataFrame) -> DataFrame:
    return zsets.groupBy("key").agg(F.count("*").alias("n"))


def between(column: Column, low=None, high=None, open_low: bool = False, open_high: bool = False) -> Column:
    """A range of scores or members; None is unbounded, open bounds are exclusive."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (column > low if open_low else column >= low)
    if high is not None:
        inside = inside & (column < high if open_high else column <= high)
    return inside


def count(zsets: DataFrame, inside: Column) -> DataFrame:
    """ZCOUNT, ZLEXCOUNT."""
    return zsets.groupBy("key").agg(F.count_if(inside).alias("n"))


def increase(zsets: DataFrame, log: DataFrame) -> DataFrame:
    """ZINCRBY of a log (key, member, by): the members that it touches."""
    by = log.groupBy("key", "member").agg(F.sum("by").alias("by"))
    return by.join(zsets, ["key", "member"], "left").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("by")).alias("score"))


def by_rank(zsets: DataFrame, start: int, stop: int, descending: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE: (key, rank, member, score); a start beyond the end is the last member."""
    if 0 <= start and 0 <= stop:  # Spark keeps only the first rows of each key while it ranks
        top = zsets.withColumn("rn", F.row_number().over(_order(descending))).where(F.col("rn") <= stop + 1).where(F.col("rn") > start)
        top = top.select("key", (F.col("rn") - 1).cast("bigint").alias("rank"), "member", "score")
        if not start:
            return top
        whole = zsets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= start)
        last = zsets.join(whole, "key").withColumn("rn", F.row_number().over(_order(not descending))).where("rn = 1")
        late = last.select("key", (F.col("n") - 1).cast("bigint").alias("rank"), "member", "score")
        return top.unionByName(late)
    rows = zsets.withColumns({"rn": F.row_number().over(_order(descending)) - 1, "n": F.count("*").over(Window.partitionBy("key"))})
    low, high = clamp(start, stop, F.col("n"))
    return rows.where(F.col("rn").between(F.least(low, F.col("n") - 1), high)).select("key", F.col("rn").cast("bigint").alias("rank"), "member", "score")


def by_range(zsets: DataFrame, inside: Column, descending: bool = False, offset: int = 0, count: int = 0) -> DataFrame:
    """ZRANGEBYSCORE, ZREVRANGEBYSCORE, ZRANGEBYLEX: members inside, ranked by score; count 0 is no limit."""
    rows = zsets.where(inside).withColumn("rn", F.row_number().over(_order(descending)))
    if count:
        rows = rows.where(F.col("rn") <= offset + count)
    return rows.where(F.col("rn") > offset).select("key", (F.col("rn") - offset - 1).cast("bigint").alias("rank"), "member", "score")


def pop(zsets: DataFrame, count: int = 1, largest: bool = False) -> DataFrame:
    """ZPOPMIN, ZPOPMAX: the members popped, in rank order. The rest is ``remove`` of these."""
    rows = zsets.withColumn("rn", F.row_number().over(_order(largest))).where(F.col("rn") <= count)
    return rows.select("key", (F.col("rn") - 1).cast("bigint").alias("rank"), "member", "score")


def first_of(zsets: DataFrame, asked: DataFrame, largest: bool = False) -> DataFrame:
    """BZPOPMIN, BZPOPMAX by (req, arg, key): the end of the first key that has members. Never waits."""
    found = asked.join(pop(zsets, 1, largest), "key").groupBy("req").agg(F.min_by(F.struct("key", "member", "score"), "arg").alias("x"))
    return found.select("req", "x.key", "x.member", "x.score")


def _merge(how: str):
    return {"sum": F.sum, "min": F.min, "max": F.max}[how]("_w").alias("score")


def _weighted(zsets: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(zsets, "key").select("req", "arg", "member", (F.col("score") * F.col("weight")).alias("_w"))


def union(zsets: DataFrame, asked: DataFrame, how: str = "sum") -> DataFrame:
    """ZUNION by (req, arg, key, weight): (req, member, score)."""
    return _weighted(zsets, asked).groupBy("req", "member").agg(_merge(how))


def intersect(zsets: DataFrame, asked: DataFrame, how: str = "sum") -> DataFrame:
    """ZINTER: members of every key of the request; the request's keys differ."""
    total = asked.groupBy("req").agg(F.countDistinct("key").alias("_all"))
    rows = _weighted(zsets, asked).groupBy("req", "member").agg(_merge(how), F.count("*").alias("_has"))
    return rows.join(total, "req").where("_has = _all").select("req", "member", "score")


def difference(zsets: DataFrame, asked: DataFrame) -> DataFrame:
    """ZDIFF: members of the first key (arg 0) only, with its scores."""
    rows = asked.join(zsets, "key").groupBy("req", "member").agg(F.max("arg").alias("_last"), F.max("score").alias("score"))
    return rows.where("_last = 0").select("req", "member", "score")


def stored(found: DataFrame, dst: str) -> DataFrame:
    """The *STORE forms: results (req, member, score) as new sorted sets."""
    return found.select(F.concat(F.lit(dst), F.col("req")).alias("key"), "member", "score")


def random_members(zsets: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """ZRANDMEMBER: ``count`` members of each key, the same for the same seed."""
    w = Window.partitionBy("key").orderBy(F.xxhash64(F.col("member"), F.lit(seed)), "member")
    return zsets.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count).drop("rn")


def scan(zsets: DataFrame, pattern: str) -> DataFrame:
    return zsets.where(glob(F.col("member"), pattern))


def remove_by_rank(zsets: DataFrame, start: int, stop: int) -> DataFrame:
    """Range removal by rank, inclusive, negatives from the end: what stays of each key."""
    w = Window.partitionBy("key")
    placed = zsets.withColumns({"_at": F.row_number().over(_order()) - 1, "_n": F.count("*").over(w)})
    low, high = clamp(start, stop, F.col("_n"))
    return placed.where(~F.col("_at").between(low, high)).drop("_at", "_n")


def add_replies(added: DataFrame) -> DataFrame:
    """ZADD's replies of what ``add`` gives: per key the new members, and those new or changed (CH)."""
    return added.groupBy("key").agg(F.count_if("added").alias("added"), F.count_if(F.col("added") | F.col("changed")).alias("touched"))


def remove_range(zsets: DataFrame, inside: Column) -> DataFrame:
    """Range removal by score or member: what stays."""
    return zsets.where(~inside)
