"""Text values and counters: relations (key, v), requests (req, key, ...), and logs (seq, key, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import clamp, decimal_number, integer, live
from ..functions.udfs import counter_steps, float_text, lcs_bytes
from ..functions.udfs import lcs as lcs_text

HIGHEST = (1 << 63) - 1


def get(strings: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """req, key, v: one row per request; null where the key is missing or expired (GET, MGET)."""
    held = strings.where(live(F.col("expires_ms"), now_ms)).select("key", "v")
    return requests.join(held, "key", "left").select("req", "key", "v")


def last_write(log: DataFrame) -> DataFrame:
    """The value that each key ends with (SET, MSET): the last in log order."""
    return log.groupBy("key").agg(F.max_by("v", "seq").alias("v"))


def first_write(log: DataFrame) -> DataFrame:
    """SET NX, SETNX: the first value stays."""
    return log.groupBy("key").agg(F.min_by("v", "seq").alias("v"))


def set_existing(log: DataFrame, strings: DataFrame) -> DataFrame:
    """SET XX: the last value of keys that exist already."""
    return last_write(log.join(strings.select("key").distinct(), "key", "left_semi"))


def insert_absent(log: DataFrame, strings: DataFrame, now_ms: int) -> DataFrame:
    """The new rows that SETNX adds: the first value of each key with no live row."""
    held = strings.where(live(F.col("expires_ms"), now_ms)).select("key")
    return first_write(log).join(held, "key", "left_anti")


def with_deadline(rows: DataFrame, now_ms: int, ttl: Column, unit_ms: int = 1000) -> DataFrame:
    """SETEX (seconds) and PSETEX (unit 1): rows with expires_ms; a TTL that isn't positive is an error row (null)."""
    return rows.withColumn("expires_ms", F.when(ttl > 0, now_ms + ttl * unit_ms))


def take(strings: DataFrame, keys: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """GETDEL: (the values of the keys, the relation without them)."""
    found = strings.join(keys.select("key").distinct(), "key", "left_semi")
    return found.where(live(F.col("expires_ms"), now_ms)).select("key", "v"), strings.join(keys.select("key"), "key", "left_anti")


def swap(log: DataFrame) -> DataFrame:
    """GETSET: seq, key, v and the value that it replaced."""
    return log.withColumn("old", F.lag("v").over(Window.partitionBy("key").orderBy("seq"))).select("seq", "key", "v", "old")


def get_and_expire(strings: DataFrame, now_ms: int, ttl_s: Column | None) -> DataFrame:
    """GETEX: live rows with a new deadline, or none (PERSIST) where ``ttl_s`` is None."""
    until = F.lit(0).cast("bigint") if ttl_s is None else (now_ms + ttl_s * 1000).cast("bigint")
    return strings.where(live(F.col("expires_ms"), now_ms)).withColumn("expires_ms", until)


def set_all_absent(requests: DataFrame, strings: DataFrame) -> DataFrame:
    """MSETNX: all pairs (key, v), or none if any key exists or occurs twice."""
    taken = requests.join(strings.select("key").distinct(), "key", "left_semi").select("key")
    twice = requests.groupBy("key").count().where("count > 1").select("key")
    clash = taken.unionByName(twice).agg(F.count("*").alias("_clashes")).select(F.lit(0).alias("_one"), "_clashes")  # one row
    return requests.withColumn("_one", F.lit(0)).join(clash.where("_clashes > 0"), "_one", "left_anti").select(*requests.columns)


#: Steps of a log whose running sums one task makes; a hot counter is as many of these as it needs.
CHUNK = 1 << 20
_WIDE = "decimal(38,0)"


def _in_range(total: Column) -> Column:
    return total.between(F.lit(-HIGHEST - 1).cast(_WIDE), F.lit(HIGHEST).cast(_WIDE))


def increments(log: DataFrame, start: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY in log order: seq, key, value and status after each step.

    A step that would leave the 64-bit integers has status overflow and a null value, and the
    counter stays as it was. Where the stored text (``start``: key, v; missing: 0) is no
    integer, every step has status not_int. Running sums are made by ranges of ``chunk``
    sequence numbers and then offset by the ranges before, so a hot counter isn't one
    task. Only counters of which some running sum leaves the range are folded step by step.
    """
    held = log.select("seq", "key", F.col("n").cast("bigint").alias("n"), F.expr(f"seq DIV {chunk}").alias("_chunk"))
    if start is None:
        held = held.withColumns({"_start": F.lit(0).cast("bigint"), "_bad": F.lit(False)})
    else:
        text = start.select("key", integer(F.col("v")).alias("_start"), (F.col("v").isNotNull() & integer(F.col("v")).isNull()).alias("_bad"))
        held = held.join(text, "key", "left").select(*held.columns, F.coalesce("_start", F.lit(0)).cast("bigint").alias("_start"), F.coalesce("_bad", F.lit(False)).alias("_bad"))
    own = F.sum(F.col("n").cast(_WIDE)).over(Window.partitionBy("key", "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = held.withColumn("_own", own)
    chunks = held.groupBy("key", "_chunk").agg(F.sum(F.col("n").cast(_WIDE)).alias("_sum"), F.min("_own").alias("_low"), F.max("_own").alias("_high"), F.max("_start").alias("_start"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(_WIDE)) + F.col("_start").cast(_WIDE)
    chunks = chunks.withColumn("_before", before)
    leaves = ~(_in_range(F.col("_before") + F.col("_low")) & _in_range(F.col("_before") + F.col("_high")))
    chunks = chunks.select("key", "_chunk", "_before", F.max(leaves).over(Window.partitionBy("key")).alias("_leaves"))
    rows = held.join(chunks, ["key", "_chunk"])
    straight = rows.where("_bad OR NOT _leaves").select(
        "seq", "key", F.when(~F.col("_bad"), (F.col("_before") + F.col("_own")).cast("bigint")).alias("value"), F.when(F.col("_bad"), "not_int").otherwise("ok").alias("status")
    )
    steps = rows.where("_leaves AND NOT _bad").select("seq", "key", "n", "_start")
    return straight.unionByName(steps.groupBy("key").applyInArrow(counter_steps, f"seq {dict(log.dtypes)['seq']}, key string, value bigint, status string"))


def totals(log: DataFrame) -> DataFrame:
    """The counters that a log ends with, null where the sum is no 64-bit integer; combined within map tasks, so hot keys cost little."""
    total = F.sum(F.col("n").cast(_WIDE))
    return log.groupBy("key").agg(F.when(_in_range(total), total).cast("bigint").alias("value"))


def add_to_float(strings: DataFrame, requests: DataFrame) -> DataFrame:
    """INCRBYFLOAT by requests (key, x), a missing key counting as 0: key, v (17 decimals without trailing zeros) and status ok or not_float."""
    both = requests.join(strings.select("key", "v"), "key", "left")
    held = F.when(F.col("v").isNull(), F.lit(0.0)).otherwise(decimal_number(F.col("v")))
    return both.select("key", float_text(held + F.col("x")).alias("v"), F.when(held.isNull(), "not_float").otherwise("ok").alias("status"))


def set_options(strings: DataFrame, requests: DataFrame, now_ms: int, only_absent: bool = False, only_present: bool = False) -> tuple[DataFrame, DataFrame]:
    """SET with NX or XX, EX or PX and GET by requests (req, key, v, ttl_ms), each key once and a null ttl for none.

    (The relation afterwards, replies (req, key, applied, old)): old is the live value before, applied or not.
    """
    if only_absent and only_present:
        raise ValueError("NX and XX exclude each other")
    held = strings.where(live(F.col("expires_ms"), now_ms)).select("key", F.col("v").alias("old"), F.lit(True).alias("_there"))
    asked = requests.join(held, "key", "left")
    there = F.coalesce("_there", F.lit(False))
    asked = asked.withColumn("applied", (~there if only_absent else there if only_present else F.lit(True)) & F.coalesce(F.col("ttl_ms") > 0, F.lit(True)))
    new = asked.where("applied").select("key", "v", F.coalesce(now_ms + F.col("ttl_ms"), F.lit(0)).cast("bigint").alias("expires_ms"))
    rest = strings.select("key", "v", "expires_ms").join(new.select("key"), "key", "left_anti")
    return rest.unionByName(new), asked.select("req", "key", "applied", "old")


def add_to_text(strings: DataFrame, by: Column) -> DataFrame:
    """INCRBY on stored text: key, value and status (ok, not_int, overflow)."""
    held = integer(F.col("v"))
    total = F.try_add(held, by)
    status = F.when(held.isNull(), "not_int").when(total.isNull(), "overflow").otherwise("ok")
    return strings.select("key", total.alias("value"), status.alias("status"))


def append(log: DataFrame) -> DataFrame:
    """APPEND in log order: key, v, and its length in bytes."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]), "")
    return log.groupBy("key").agg(text.alias("v")).withColumn("bytes", F.octet_length("v").cast("bigint"))


def strlen(strings: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    return get(strings, requests, now_ms).select("req", "key", F.coalesce(F.octet_length("v"), F.lit(0)).cast("bigint").alias("bytes"))


def getrange(text: Column, start: int, stop: int) -> Column:
    """The bytes from start to stop (inclusive, negatives from the end), widened to whole characters (GETRANGE, SUBSTR).

    A character is taken if any of its bytes lies in the range. A character of UTF-8 has
    three continuing bytes at most, so only the three beside either bound are looked at.
    """
    data = text.cast("binary")
    low, high = clamp(start, stop, F.octet_length(text))
    inner = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")
    back = F.when(~inner(low), 0).when(~inner(low - 1), 1).when(~inner(low - 2), 2).otherwise(3)
    on = F.when(~inner(high + 1), 0).when(~inner(high + 2), 1).when(~inner(high + 3), 2).otherwise(3)
    first = low - back
    return F.when(low > high, "").otherwise(F.substring(data, first + 1, high + on - first + 1).cast("string"))


def setrange(data: Column, offset: int, patch: Column) -> Column:
    """Bytes with ``patch`` written at the offset; zero bytes fill a gap (SETRANGE)."""
    data = data.cast("binary")
    wide = F.when(F.octet_length(data) < offset, F.rpad(data, F.lit(offset), F.lit(b"\0"))).otherwise(data)
    return F.overlay(wide, patch.cast("binary"), F.lit(offset + 1))


def lcs(left: Column, right: Column) -> Column:
    """The longest common subsequence of the bytes (LCS); empty if that is no UTF-8."""
    return lcs_text(left, right)


def lcs_length(left: Column, right: Column) -> Column:
    """LCS LEN: the bytes of the longest common subsequence."""
    return lcs_bytes(left, right)
