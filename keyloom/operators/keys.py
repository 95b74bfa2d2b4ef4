"""The key space: relations (key, type, expires_ms); 0 is no deadline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import glob, integer, live


def _live(ks: DataFrame, now_ms: int) -> DataFrame:
    return ks.where(live(F.col("expires_ms"), now_ms))


def delete(ks: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DEL, UNLINK: (the key space without the keys, the keys removed). Keys past their deadline still count."""
    asked = keys.select("key").distinct()
    return ks.join(asked, "key", "left_anti"), ks.join(asked, "key", "left_semi").select("key")


def exists(ks: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """EXISTS, TOUCH: hits, counting each time that a key is asked for."""
    return requests.join(_live(ks, now_ms).select("key"), "key").agg(F.count("*").alias("hits"))


def type_of(ks: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    return requests.join(_live(ks, now_ms).select("key", "type"), "key", "left").select("req", "key", F.coalesce("type", F.lit("none")).alias("type"))


def remaining(ks: DataFrame, requests: DataFrame, now_ms: int, unit_ms: int = 1000) -> DataFrame:
    """TTL (unit 1000) and PTTL (unit 1): -2 for no key, -1 for no deadline."""
    held = _live(ks, now_ms).select("key", "expires_ms")
    left = F.floor((F.col("expires_ms") - now_ms) / unit_ms)
    return requests.join(held, "key", "left").select("req", "key", F.when(F.col("expires_ms").isNull(), -2).when(F.col("expires_ms") == 0, -1).otherwise(left).cast("bigint").alias("ttl"))


def deadline(ks: DataFrame, requests: DataFrame, now_ms: int, unit_ms: int = 1000) -> DataFrame:
    """EXPIRETIME (unit 1000) and PEXPIRETIME (unit 1)."""
    held = _live(ks, now_ms).select("key", "expires_ms")
    at = F.floor(F.col("expires_ms") / unit_ms)
    return requests.join(held, "key", "left").select("req", "key", F.when(F.col("expires_ms").isNull(), -2).when(F.col("expires_ms") == 0, -1).otherwise(at).cast("bigint").alias("at"))


def expire(ks: DataFrame, now_ms: int, until: Column) -> DataFrame:
    """EXPIRE and its kin: live keys with the new deadline; ``reply`` is 1 only where there was none before."""
    return _live(ks, now_ms).select("key", "type", until.cast("bigint").alias("expires_ms"), F.when(F.col("expires_ms") == 0, 1).otherwise(0).cast("bigint").alias("reply"))


def persist(ks: DataFrame, now_ms: int) -> DataFrame:
    return _live(ks, now_ms).select("key", "type", F.lit(0).cast("bigint").alias("expires_ms"), F.when(F.col("expires_ms") > 0, 1).otherwise(0).cast("bigint").alias("reply"))


def rename(ks: DataFrame, moves: DataFrame, now_ms: int, only_absent: bool = False) -> DataFrame:
    """RENAME, RENAMENX by moves (old, new), each key in one move: the key space afterwards."""
    sources = _live(ks, now_ms).join(moves, F.col("key") == F.col("old"))
    if only_absent:
        sources = sources.join(ks.select(F.col("key").alias("_taken")), F.col("new") == F.col("_taken"), "left_anti")
    moved = sources.select(F.col("new").alias("key"), "type", "expires_ms", "old")
    rest = ks.join(moved.select(F.col("old").alias("key")), "key", "left_anti").join(moved.select("key"), "key", "left_anti")
    return rest.unionByName(moved.drop("old"))


def copy(ks: DataFrame, moves: DataFrame, now_ms: int, replace: bool = False) -> DataFrame:
    """COPY by moves (old, new): the key space afterwards."""
    made = _live(ks, now_ms).join(moves, F.col("key") == F.col("old")).select(F.col("new").alias("key"), "type", "expires_ms")
    if not replace:  # a target past its deadline is no key, and gives way
        made = made.join(_live(ks, now_ms).select("key"), "key", "left_anti")
    return ks.join(made.select("key"), "key", "left_anti").unionByName(made)


def copy_replies(ks: DataFrame, moves: DataFrame, now_ms: int, replace: bool = False) -> DataFrame:
    """COPY: 1 for each move (old, new) that copies, and 0 where the source is missing or the target is taken."""
    held = _live(ks, now_ms).select("key", F.lit(1).alias("_there"))
    found = moves.join(held.select(F.col("key").alias("old"), F.col("_there").alias("_source")), "old", "left")
    found = found.join(held.select(F.col("key").alias("new"), F.col("_there").alias("_target")), "new", "left")
    done = F.col("_source").isNotNull() & (F.lit(replace) | F.col("_target").isNull())
    return found.select("old", "new", done.cast("bigint").alias("reply"))


def rename_replies(ks: DataFrame, moves: DataFrame, now_ms: int) -> DataFrame:
    """RENAMENX: 1 for each move that renames, 0 where the target exists (a key past its deadline does until it is swept), null where the source is missing."""
    found = moves.join(_live(ks, now_ms).select(F.col("key").alias("old"), F.lit(1).alias("_source")), "old", "left")
    found = found.join(ks.select(F.col("key").alias("new"), F.lit(1).alias("_target")), "new", "left")
    return found.select("old", "new", F.when(F.col("_source").isNotNull(), F.col("_target").isNull().cast("bigint")).alias("reply"))


def random_key(ks: DataFrame, now_ms: int, seed: int = 0) -> DataFrame:
    """RANDOMKEY: one live key, the same for the same seed."""
    return _live(ks, now_ms).orderBy(F.xxhash64(F.col("key"), F.lit(seed)), "key").limit(1).select("key")


def matching(ks: DataFrame, pattern: str, now_ms: int) -> DataFrame:
    """KEYS."""
    return _live(ks, now_ms).where(glob(F.col("key"), pattern)).select("key")


def scan_page(ks: DataFrame, now_ms: int, after: str = "", pattern: str = "*", count: int = 10) -> DataFrame:
    """SCAN: the next ``count`` keys after a key. The last one is the cursor of the next page."""
    found = _live(ks, now_ms).where((F.col("key") > after) & glob(F.col("key"), pattern))
    return found.orderBy("key").limit(count).select("key")


def sort_values(rows: DataFrame, alpha: bool = False, descending: bool = False, offset: int = 0, count: int = 0) -> DataFrame:
    """SORT of (pos, value): numerically (what is no number is 0) and stable, or by bytes; count 0 is no limit, and then no offset.

    A descending order is the ascending one reversed, equal values too.
    """
    by = [F.col("value")] if alpha else [F.coalesce(F.when(F.col("value").rlike(r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"), F.col("value").try_cast("double")), F.lit(0.0))]
    by.append(F.col("pos"))
    out = rows.orderBy(*[c.desc() if descending else c.asc() for c in by])
    return out.offset(offset).limit(count) if count else out


def sort_store(rows: DataFrame, dst: str, **how) -> DataFrame:
    """SORT ... STORE: the sorted values as a list (key, pos, value)."""
    found = sort_values(rows, **how)
    # the place in the order is a window over the whole result: SORT is of one collection
    w = Window.orderBy("_at")
    placed = found.withColumn("_at", F.monotonically_increasing_id())
    return placed.select(F.lit(dst).alias("key"), (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "value")


#: What OBJECT answers for a key that is there, but for its encoding.
OBJECT_REPLIES = {"REFCOUNT": 1, "IDLETIME": 0, "FREQ": 0}


def object_replies(ks: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """OBJECT REFCOUNT, IDLETIME and FREQ: req, key and a reply for each, whether or not the key is there."""
    return requests.select("req", "key", *(F.lit(v).cast("bigint").alias(k.lower()) for k, v in OBJECT_REPLIES.items()))


def encoding(sizes: DataFrame) -> DataFrame:
    """OBJECT ENCODING of (key, type, size, v): by type, number of elements, and whether a string is an integer."""
    small = F.col("size") <= 128
    named = (
        F.when(F.col("type") == "string", F.when(integer(F.col("v")).isNotNull(), "int").otherwise("embstr")).when(F.col("type") == "hash", F.when(small, "listpack").otherwise("hashtable"))
        .when(F.col("type") == "list", F.when(small, "listpack").otherwise("quicklist")).when(F.col("type") == "set", F.when(small, "listpack").otherwise("hashtable"))
        .when(F.col("type") == "zset", F.when(small, "listpack").otherwise("skiplist")).otherwise("raw")
    )
    return sizes.select("key", "type", named.alias("encoding"))


def sweep_slice(ks: DataFrame, now_ms: int, slot: int, slots: int) -> DataFrame:
    """The incremental sweep: as ``sweep``, but only of the keys in one of so many slots; sweeping every slot in turn sweeps all."""
    here = F.pmod(F.xxhash64("key"), F.lit(slots)) == slot
    return ks.where(~here | live(F.col("expires_ms"), now_ms))


def sweep(ks: DataFrame, now_ms: int) -> DataFrame:
    """The key space without what is past its deadline."""
    return _live(ks, now_ms)
