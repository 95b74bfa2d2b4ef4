"""Sets: relations (key, member) of distinct rows. Set algebra works on many keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import drawn, glob


def add(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """SADD: the rows that are new."""
    return rows.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")


def remove(sets: DataFrame, rows: DataFrame) -> DataFrame:
    return sets.join(rows.select("key", "member"), ["key", "member"], "left_anti")


def is_member(sets: DataFrame, requests: DataFrame) -> DataFrame:
    """SISMEMBER, SMISMEMBER by requests (req, key, member)."""
    held = sets.select("key", "member", F.lit(1).cast("bigint").alias("_in"))
    return requests.join(held, ["key", "member"], "left").select("req", "key", "member", F.coalesce("_in", F.lit(0)).alias("found"))


def members(sets: DataFrame, keys: DataFrame) -> DataFrame:
    return sets.join(keys.select("key").distinct(), "key", "left_semi")


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.groupBy("key").agg(F.count("*").alias("n"))


def first_members(sets: DataFrame, count: int) -> DataFrame:
    """SPOP, SRANDMEMBER: the first ``count`` members of each set, integers in order before other text."""
    number = F.when(F.col("member").rlike("^(0|-?[1-9][0-9]*)$"), F.col("member").try_cast("bigint"))
    w = Window.partitionBy("key").orderBy(number.asc_nulls_last(), "member")
    return sets.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= count).drop("rn")


def repeated_members(sets: DataFrame, times: int, seed: int = 0) -> DataFrame:
    """SRANDMEMBER with a negative count: so many members of every set, with repeats (key, draw, member)."""
    return drawn(sets.select("key", "member"), ["member"], times, seed)


def pop(sets: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    gone = first_members(sets, count)
    return gone, sets.join(gone, ["key", "member"], "left_anti")


def move(sets: DataFrame, moves: DataFrame) -> DataFrame:
    """SMOVE by (src, dst, member): the sets afterwards."""
    found = sets.join(moves, (F.col("key") == F.col("src")) & (sets["member"] == moves["member"])).select("src", "dst", sets["member"])
    rest = sets.join(found.select(F.col("src").alias("key"), "member"), ["key", "member"], "left_anti")
    return rest.unionByName(found.select(F.col("dst").alias("key"), "member")).distinct()


def union(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """SUNION by (req, arg, key): (req, member)."""
    return asked.join(sets, "key").select("req", "member").distinct()


def intersect(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """SINTER: members of every key of a request; counted in one pass, whatever the number of keys."""
    wanted = asked.select("req", "key").distinct()
    total = wanted.groupBy("req").agg(F.count("*").alias("_all"))
    held = wanted.join(sets, "key").groupBy("req", "member").agg(F.count("*").alias("_has"))
    return held.join(total, "req").where("_has = _all").select("req", "member")


def difference(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """SDIFF: members of the first key (arg 0) and of none of the others."""
    rows = asked.join(sets, "key").groupBy("req", "member").agg(F.max("arg").alias("_last"))
    return rows.where("_last = 0").select("req", "member")


def intersection_size(sets: DataFrame, asked: DataFrame, limit: int = 0) -> DataFrame:
    """SINTERCARD; limit 0 is none."""
    n = intersect(sets, asked).groupBy("req").agg(F.count("*").alias("n"))
    n = asked.select("req").distinct().join(n, "req", "left").select("req", F.coalesce("n", F.lit(0)).alias("n"))
    return n.select("req", F.least("n", F.lit(limit)).cast("bigint").alias("n")) if limit else n


def stored(found: DataFrame, dst: str) -> DataFrame:
    """The *STORE forms: results (req, member) as new sets, one per request."""
    return found.select(F.concat(F.lit(dst), F.col("req")).alias("key"), "member")


def scan(sets: DataFrame, pattern: str) -> DataFrame:
    return sets.where(glob(F.col("member"), pattern))
