"""Index clamping, glob patterns and liveness: the small rules that many operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def live(expires_ms: Column, now_ms: int) -> Column:
    """Keys without a deadline, or with one still ahead."""
    return (expires_ms == 0) | (expires_ms > now_ms)


def clamp(start: Column | int, stop: Column | int, size: Column) -> tuple[Column, Column]:
    """Inclusive 0-based bounds: negatives count from the end, and what lies before the first element is the first."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    low = F.greatest(F.when(start < 0, size + start).otherwise(start), F.lit(0))
    high = F.greatest(F.when(stop < 0, size + stop).otherwise(stop), F.lit(0))
    return low, F.least(high, size - 1)


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` are wild, all else stands for itself."""
    wild = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(wild.get(c) or re.escape(c) for c in pattern) + "$"


def glob(text: Column, pattern: str) -> Column:
    """Whether the text matches; a plain prefix becomes a comparison that scans can use."""
    if pattern and "?" not in pattern and pattern.find("*") == len(pattern) - 1:
        return text.startswith(pattern[:-1])
    if "?" not in pattern and "*" not in pattern:
        return text == pattern
    return text.rlike(glob_regex(pattern))


def integer(text: Column) -> Column:
    """The text as a 64-bit integer, null unless it is one: an optional sign and digits, no blanks."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def decimal_number(text: Column) -> Column:
    """The text as a double, null unless it is a number: no blanks, no letters but an exponent, inf, infinity and nan."""
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    word = F.lower(F.regexp_replace(text, r"^[+-]", ""))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(number, text.try_cast("double")).when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).when(word == "nan", F.lit(float("nan")))


def drawn(rows: DataFrame, order: list, times: int, seed: int) -> DataFrame:
    """``times`` rows of each key with repeats (columns of the rows and ``draw``), the same for the same seed.

    Rows are numbered within their key in the given order, and draws are joined by key and number.
    """
    w = Window.partitionBy("key")
    numbered = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1)
    sizes = rows.groupBy("key").agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times else sizes.where("false").withColumn("draw", F.lit(0))
    draws = draws.select("key", "draw", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("_n")).alias("_at"))
    return draws.join(numbered, ["key", "_at"]).drop("_at")
