"""Request logs as relations (seq, op, key, args): inline commands line by line, or files of length-prefixed request arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import REQUESTS, parsed_requests

#: A word of an inline command: in double quotes with backslash escapes, in single quotes, or bare.
_WORD = r""""(?:[^"\\]|\\.)*"|'[^']*'|[^\s"']+"""


def _plain(word: Column) -> Column:
    inner = word.substr(F.lit(2), F.length(word) - 2)
    quoted = F.regexp_replace(F.replace(F.replace(inner, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), r"\\(.)", "$1")
    return F.when(word.startswith('"'), quoted).when(word.startswith("'"), inner).otherwise(word)


def _relation(rows: DataFrame) -> DataFrame:
    words = F.col("words")
    return rows.where(F.size(words) > 0).select("seq", F.upper(F.get(words, F.lit(0))).alias("op"), F.get(words, F.lit(1)).alias("key"), F.slice(words, 3, F.greatest(F.size(words) - 2, F.lit(0))).alias("args"))


def inline(spark: SparkSession, path: str) -> DataFrame:
    """A text file, or a folder of them, with one command a line: ``SET key "a value"``. Blank lines are no commands."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.regexp_extract_all("value", F.lit(_WORD), F.lit(0)).alias("words"))
    return _relation(lines.withColumn("words", F.transform("words", _plain)))


def framed(spark: SparkSession, path: str) -> DataFrame:
    """Files of request arrays (``*2``, ``$3``, ``GET``, ...), each read as a whole; what follows a broken request is left out, with a row of op ERROR."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _relation(files.mapInArrow(parsed_requests, REQUESTS).select(F.struct("path", "n").alias("seq"), "words"))
