"""Bitmaps as relations (key, off) of set bits; bit 0 is the highest bit of byte 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ranges import clamp


def byte_length(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg((F.floor(F.max("off") / 8) + 1).alias("bytes"))


def setbit(log: DataFrame) -> DataFrame:
    """The bits that a log (seq, key, off, bit) leaves set."""
    return log.groupBy("key", "off").agg(F.max_by("bit", "seq").alias("bit")).where("bit = 1").select("key", "off")


def setbit_replies(log: DataFrame) -> DataFrame:
    """seq, key, off and the bit's value before each step."""
    old = F.lag("bit", 1, 0).over(Window.partitionBy("key", "off").orderBy("seq"))
    return log.select("seq", "key", "off", old.cast("bigint").alias("old"))


def getbit(bits: DataFrame, requests: DataFrame) -> DataFrame:
    held = bits.select("key", "off", F.lit(1).cast("bigint").alias("_bit"))
    return requests.join(held, ["key", "off"], "left").select("req", "key", "off", F.coalesce("_bit", F.lit(0)).alias("bit"))


def bitcount(bits: DataFrame, start: int = 0, stop: int = -1, unit: str = "byte") -> DataFrame:
    """Set bits in an inclusive range of bytes or bits; negatives count from the end."""
    size = F.col("bytes") * (1 if unit == "byte" else 8)
    low, high = clamp(start, stop, size)
    at = F.floor(F.col("off") / 8) if unit == "byte" else F.col("off")
    return bits.join(byte_length(bits), "key").groupBy("key").agg(F.count_if(at.between(low, high)).alias("n"))


def bitpos(bits: DataFrame, bit: int, start: int = 0) -> DataFrame:
    """The first bit of that value from byte ``start`` on; -1 if none is set, the end if none is clear."""
    rows = bits.where(F.col("off") >= 8 * start)
    if bit:
        found = rows.groupBy("key").agg(F.min("off").alias("pos"))
        return byte_length(bits).join(found, "key", "left").select("key", F.coalesce("pos", F.lit(-1)).alias("pos"))
    # the first gap: where the running number falls behind the offset
    run = F.row_number().over(Window.partitionBy("key").orderBy("off")) - 1 + 8 * start
    ahead = rows.withColumn("run", run).where(F.col("off") == F.col("run")).groupBy("key").agg((F.max("off") + 1).alias("pos"))
    return byte_length(bits).where(F.col("bytes") > start).join(ahead, "key", "left").select("key", F.coalesce("pos", F.lit(8 * start)).cast("bigint").alias("pos"))


def bitop(bits: DataFrame, asked: DataFrame, op: str) -> DataFrame:
    """AND, OR, XOR of the keys of each request (req, key): (req, off)."""
    wanted = asked.select("req", "key").distinct()
    rows = wanted.join(bits, "key").groupBy("req", "off").agg(F.count("*").alias("_has"))
    if op == "or":
        return rows.select("req", "off")
    if op == "xor":
        return rows.where("_has % 2 = 1").select("req", "off")
    total = wanted.groupBy("req").agg(F.count("*").alias("_all"))
    return rows.join(total, "req").where("_has = _all").select("req", "off")


def bitnot(bits: DataFrame) -> DataFrame:
    """The clear bits of each key, to the end of its last byte."""
    every = byte_length(bits).select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") * 8 - 1)).alias("off"))
    return every.join(bits, ["key", "off"], "left_anti")


def field(bits: DataFrame, width: int, offset: int, signed: bool = False) -> DataFrame:
    """BITFIELD GET: the integer that ``width`` bits from the offset make, highest bit first."""
    inside = F.col("off").between(offset, offset + width - 1)
    worth = F.call_function("shiftleft", F.lit(1).cast("bigint"), (offset + width - 1 - F.col("off")).cast("int"))
    value = F.coalesce(F.sum(F.when(inside, worth)), F.lit(0))
    if signed and width < 64:
        value = F.when(value >= 1 << (width - 1), value - (1 << width)).otherwise(value)
    return bits.groupBy("key").agg(value.alias("value"))


def fit(value: Column, width: int, signed: bool, overflow: str = "wrap") -> Column:
    """A field's new value: wrapped around, held at the bounds (sat), or null (fail)."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    if overflow == "sat":
        return F.greatest(F.lit(low), F.least(F.lit(high), value))
    if overflow == "fail":
        return F.when(value.between(low, high), value)
    return F.pmod(value - low, F.lit(1 << width)) + low


def set_field(bits: DataFrame, width: int, offset: int, value: Column) -> DataFrame:
    """BITFIELD SET, INCRBY: the bits with the field of every key replaced by ``value``, an expression on (key, value)."""
    return _with_field(bits, field(bits, width, offset).withColumn("value", value), width, offset)


def _with_field(bits: DataFrame, new: DataFrame, width: int, offset: int) -> DataFrame:
    made = new.select("key", F.col("value"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("i"))
    bit = F.call_function("shiftright", F.col("value"), (width - 1 - F.col("i")).cast("int")).bitwiseAND(1) == 1
    rest = bits.where(~F.col("off").between(offset, offset + width - 1))
    return rest.unionByName(made.where(bit).select("key", (F.col("i") + offset).cast("bigint").alias("off")))


def indexed(index: int, width: int) -> int:
    """The offset of field ``#index``: so many fields of the width from the start."""
    return index * width


def fields(bits: DataFrame, ops: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """BITFIELD with several operations in order: (the bits afterwards, replies (key, i, value) of every key).

    Operations are ('get', width, offset, signed), ('set', width, offset, signed, value), whose reply is the
    old value, and ('incrby', width, offset, signed, by, overflow), whose reply is the new one, null where
    'fail' stopped it. Widths go up to 62 bits; ``indexed`` gives the offset of a field by number.
    """
    keys, replies = bits.select("key").distinct(), None
    for i, (op, width, offset, signed, *more) in enumerate(ops):
        if op not in ("get", "set", "incrby") or not 0 < width <= 62:
            raise ValueError(f"no operation {op!r} on {width} bits")
        size = 1 << width
        raw = keys.join(field(bits, width, offset), "key", "left").select("key", F.coalesce("value", F.lit(0)).alias("_raw"))
        held = F.when(F.col("_raw") >= size >> 1, F.col("_raw") - size).otherwise(F.col("_raw")) if signed else F.col("_raw")
        reply, new = held, None
        if op == "set":
            new = F.lit(more[0] % size).cast("bigint")
        elif op == "incrby":
            total = (held.cast("decimal(38,0)") + F.lit(more[0]))
            reply = fit(total, width, signed, more[1] if len(more) > 1 else "wrap").cast("bigint")
            new = F.coalesce(F.pmod(reply, F.lit(size).cast("bigint")), F.col("_raw"))
        answered = raw.select("key", F.lit(i).alias("i"), reply.cast("bigint").alias("value"))
        replies = answered if replies is None else replies.unionByName(answered)
        if new is not None:
            bits = _with_field(bits, raw.select("key", new.alias("value")), width, offset)
    return bits, replies


def to_binary(bits: DataFrame) -> DataFrame:
    """(key, data): the bytes, for export."""
    worth = F.call_function("shiftleft", F.lit(1), (7 - F.col("off") % 8).cast("int"))
    byte = bits.groupBy("key", F.floor(F.col("off") / 8).alias("at")).agg(F.sum(worth).alias("byte"))
    held = byte.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"), F.max("at").alias("last"))
    text = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("last")), lambda i: F.lpad(F.hex(F.coalesce(F.try_element_at("m", i), F.lit(0))), 2, "0"))
    return held.select("key", F.unhex(F.array_join(text, "")).alias("data"))


