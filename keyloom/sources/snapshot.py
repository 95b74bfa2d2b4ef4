"""Snapshots: versions of one Parquet folder per collection family, read back without what is past its deadline.

A version is written beside the older ones and counts from the moment its mark is
there, so a reader sees a whole version, and a failed or repeated write loses none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import live

MARK = "_COMPLETE"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The complete versions, oldest first, and when each was completed, in ms."""
    files, top = _files(spark, path)
    found = {}
    for status in files.listStatus(top) if files.exists(top) else ():
        name, mark = status.getPath().getName(), spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARK)
        if name.isdigit() and files.exists(mark):
            found[int(name)] = files.getFileStatus(mark).getModificationTime()
    return dict(sorted(found.items()))


def save(families: dict[str, DataFrame], path: str, keep: int = 2) -> int:
    """SAVE, BGSAVE: writes every family as a new version and gives its number; older versions than the last ``keep`` are removed."""
    spark = next(iter(families.values())).sparkSession
    done = versions(spark, path)
    number = max(done, default=0) + 1
    for name, rows in families.items():  # an unfinished version of that number, without a mark, is written over
        rows.write.mode("overwrite").parquet(f"{path}/{number}/{name}")
    files, mark = _files(spark, f"{path}/{number}/{MARK}")
    files.create(mark, False).close()
    for old in [*done, number][:-keep]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return number


def load(spark: SparkSession, path: str, family: str, now_ms: int) -> DataFrame:
    """A family of the last complete version. Consumer groups and other relations without deadlines come back whole."""
    done = versions(spark, path)
    if not done:
        raise FileNotFoundError(f"no complete snapshot in {path}")
    rows = spark.read.parquet(f"{path}/{max(done)}/{family}")
    return rows.where(live(F.col("expires_ms"), now_ms)) if "expires_ms" in rows.columns else rows


def last_saved(spark: SparkSession, path: str) -> DataFrame:
    """LASTSAVE: the second in which the last version was completed; null if there is none."""
    done = versions(spark, path)
    at = done[max(done)] // 1000 if done else None
    return spark.createDataFrame([(at,)], "at long")


def periodic(families: Callable[[DataFrame], dict[str, DataFrame]], path: str, every: int = 1):
    """A ``foreachBatch`` sink that saves a snapshot of ``families(batch)`` with every so many batches of a stream."""

    def sink(batch: DataFrame, number: int) -> None:
        if number % every == every - 1:
            save(families(batch), path)

    return sink


def flush(rows: DataFrame) -> DataFrame:
    """FLUSHALL, FLUSHDB, FLUSH: no rows, the same columns."""
    return rows.where(F.lit(False))


def size(ks: DataFrame) -> DataFrame:
    """DBSIZE: keys, those past their deadline too until they are swept."""
    return ks.agg(F.count("*").alias("n"))


def info(ks: DataFrame, now_ms: int) -> DataFrame:
    """INFO's key section: keys, keys with a deadline, and keys past it, by type."""
    return ks.groupBy("type").agg(F.count("*").alias("keys"), F.count_if(F.col("expires_ms") > 0).alias("expires"), F.count_if(~live(F.col("expires_ms"), now_ms)).alias("expired"))
