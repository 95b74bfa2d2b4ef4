"""Live forms on Structured Streaming: routing, counters, ordered mutation, and append-only logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.pubsub import _globs, matched


def route(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """PUBLISH of a stream (msg, channel, payload) against a static table of subscriptions: the deliveries."""
    columns = ["msg", "channel", "payload", "subscriber", "kind", "pattern"]
    exact = messages.join(subs.where("kind = 'exact'"), F.col("channel") == F.col("pattern")).select(*columns)
    found = matched(messages, _globs(subs)).withColumn("kind", F.lit("glob"))
    return exact.unionByName(found.select(*columns))


def counters(log: DataFrame) -> DataFrame:
    """INCRBY of a stream (key, n): running totals, for update or complete mode."""
    return log.groupBy("key").agg(F.sum("n").alias("value"))


def distinct_entries(entries: DataFrame, time_col: str, delay: str, *id_cols: str) -> DataFrame:
    """XADD of a stream: each id once, as long as repeats come within the delay."""
    return entries.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(id_cols))


def windowed_lengths(entries: DataFrame, time_col: str, delay: str, width: str) -> DataFrame:
    """Entries per key and tumbling window, final once the watermark has passed the window."""
    return entries.withWatermark(time_col, delay).groupBy("key", F.window(time_col, width).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "n")


REPLIES = "key string, seq long, reply string"
KNOWN = frozenset("set get getset incrby append strlen rpush lpush rpop lpop llen del".split())
_STATE = "kind string, value string, items array<string>"


def fold(log: DataFrame, idle_ms: int = 0) -> DataFrame:
    """Applies a stream (key, seq, op, arg) to each key in order of seq within a batch: REPLIES.

    Operations: set, get, getset, incrby, append, strlen, rpush, lpush, rpop, lpop, llen and
    del. A reply is null for a missing value, ``WRONGTYPE``, ``NOTINT`` or ``OVERFLOW`` for an error that
    leaves the value, and ``ERR`` for another operation or one without the argument that it needs. With
    ``idle_ms``, keys expire that long after they were last touched.
    """

    def whole(found: str | None) -> int | None:
        """A 64-bit integer in ASCII digits with an optional sign."""
        digits = (found or "")[1:] if (found or "")[:1] in ("+", "-") else found or ""
        if not digits.isascii() or not digits.isdigit() or len(digits.lstrip("0")) > 19:
            return None
        number = int(found)
        return number if -(1 << 63) <= number < 1 << 63 else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kind, value, items = state.get if state.exists else ("", "", [])
        items = list(items)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, op, arg in rows[["seq", "op", "arg"]].itertuples(index=False):
            reply = None
            text, listed = kind == "string", kind == "list"
            if op in ("set", "getset", "append", "rpush", "lpush") and not isinstance(arg, str) or op not in KNOWN:
                reply = "ERR"
            elif op == "del":
                reply, kind, value, items = str(int(bool(kind))), "", "", []
            elif op in ("set", "getset"):
                reply = (value if text else None) if op == "getset" else "OK"
                kind, value, items = "string", arg, []
            elif op in ("rpush", "lpush", "rpop", "lpop", "llen"):
                if kind and not listed:
                    reply = "WRONGTYPE"
                elif op in ("rpush", "lpush"):
                    kind = "list"
                    items.insert(len(items) if op == "rpush" else 0, arg)
                    reply = str(len(items))
                elif op == "llen":
                    reply = str(len(items))
                elif items:
                    reply = items.pop(-1 if op == "rpop" else 0)
            elif listed:
                reply = None if op == "get" else "WRONGTYPE"
            elif op == "get":
                reply = value if text else None
            elif op == "strlen":
                reply = str(len(value.encode())) if text else "0"
            elif op == "append":
                kind, value = "string", value + arg
                reply = str(len(value.encode()))
            elif op == "incrby":
                held, by = whole(value if text else "0"), whole(arg)
                if held is None or by is None:
                    reply = "NOTINT"
                elif -(1 << 63) <= held + by < 1 << 63:
                    kind, value = "string", str(held + by)
                    reply = value
                else:
                    reply = "OVERFLOW"
            out.append((key[0], int(seq), reply))
        if kind:
            state.update((kind, value, items))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "seq", "reply"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return log.groupBy("key").applyInPandasWithState(step, REPLIES, _STATE, "append", timeout)


def retain(path: str, maxlen: int):
    """A ``foreachBatch`` sink that keeps the newest ``maxlen`` entries (key, ms, seq, ...) of each key.

    Each batch writes a new version beside the last one, so a batch that runs again
    gives the same version, and readers of the old one aren't disturbed. Older versions than
    those two are removed.
    """

    def sink(batch: DataFrame, number: int) -> None:
        from ..operators.streams import trim

        spark = batch.sparkSession
        if number:
            batch = spark.read.schema(batch.schema).parquet(f"{path}/{number - 1}").unionByName(batch)
        trim(batch, maxlen).write.mode("overwrite").parquet(f"{path}/{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return sink
