"""Connection and server verbs: what a session answers, and how a transaction is one batch.

Most of these verbs steer a connection and have no data to work on. Their fixed
answers are kept so that a log of requests can be replayed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values: (verb, argument) to reply; null is a missing value, an empty argument any other form.
REPLIES = {
    ("PING", ""): "PONG", ("QUIT", ""): "OK", ("RESET", ""): "RESET", ("AUTH", ""): "OK", ("SELECT", "0"): "OK", ("SELECT", ""): "ERR only database 0 exists",
    ("COMMAND", "COUNT"): "120", ("COMMAND", ""): "", ("HELLO", "2"): "proto 2", ("HELLO", "3"): "proto 3", ("HELLO", ""): "proto 2",
    ("CLIENT", "ID"): "1", ("CLIENT", "GETNAME"): None, ("CLIENT", ""): "OK", ("CONFIG", "GET"): "", ("CONFIG", ""): "OK",
    ("SLOWLOG", "LEN"): "0", ("SLOWLOG", "GET"): "", ("SLOWLOG", ""): "OK", ("ACL", "WHOAMI"): "default", ("ACL", "LIST"): "user default on ~* &* +@all", ("ACL", ""): "OK",
    ("MULTI", ""): "OK", ("DISCARD", ""): "OK", ("WATCH", ""): "OK", ("UNWATCH", ""): "OK", ("BGSAVE", ""): "Background saving started", ("SAVE", ""): "OK",
}


def replies(spark: SparkSession, log: DataFrame) -> DataFrame:
    """req, verb, arg and reply for requests (req, verb, arg); other verbs are unknown. PING and ECHO give their argument back."""
    table = spark.createDataFrame([(v, a, r) for (v, a), r in REPLIES.items()], "verb string, _arg string, _reply string")
    verb, arg = F.upper("verb"), F.coalesce("arg", F.lit(""))
    asked = log.select("req", verb.alias("verb"), arg.alias("arg"))
    exact = table.select("verb", F.col("_arg").alias("_key"), "_reply", F.lit(True).alias("_known"))
    found = asked.withColumn("_key", F.upper("arg")).join(F.broadcast(exact), ["verb", "_key"], "left")  # a constant table
    other = table.where("_arg = ''").select("verb", F.col("_reply").alias("_other"), F.lit(True).alias("_any"))
    found = found.join(F.broadcast(other), "verb", "left")
    echoed = (F.col("verb") == "ECHO") | (F.col("verb") == "PING") & (F.col("arg") != "")
    reply = F.when(echoed, F.col("arg")).when(F.col("_known"), F.col("_reply")).when(F.col("_any"), F.col("_other")).otherwise("ERR unknown command")
    return found.select("req", "verb", "arg", reply.alias("reply"))


#: Sequence numbers that one task looks at together; a session with a long log is as many of these as it needs.
CHUNK = 1 << 16
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _placed(log: DataFrame, chunk: int) -> DataFrame:
    """The rows that aren't left out, with ``batch`` and ``_end``, the (verb, seq) of the EXEC or DISCARD after them.

    The marks before and after a row are found within ranges of ``chunk`` sequence numbers; where a range has none, the
    nearest range of the session that has one gives it. A seq that is no whole number has one range. Frames
    only ever grow from the first row on, as those that shrink are gone through again for each row.
    """
    whole = dict(log.dtypes)["seq"] in _WHOLE
    rows = log.withColumn("_chunk", F.expr(f"seq DIV {chunk}") if whole else F.lit(0).cast("bigint"))
    placed = F.struct("verb", "seq")
    mark, end = (F.when(F.col("verb").isin(*verbs), placed) for verbs in (("MULTI", "EXEC", "DISCARD"), ("EXEC", "DISCARD")))
    newest = lambda c, w, stop: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, stop))
    part, each = Window.partitionBy("session", "_chunk"), Window.partitionBy("_session")
    found = rows.withColumns({"_mark": newest(mark, part.orderBy("seq"), 0), "_end": newest(end, part.orderBy(F.desc("seq")), 0)})
    chunks = rows.groupBy(F.col("session").alias("_session"), F.col("_chunk").alias("_at")).agg(F.max_by(mark, F.when(mark.isNotNull(), F.col("seq"))).alias("_last"), F.min_by(end, F.when(end.isNotNull(), F.col("seq"))).alias("_first"))
    chunks = chunks.withColumns({"_before": newest(F.col("_last"), each.orderBy("_at"), -1), "_after": newest(F.col("_first"), each.orderBy(F.desc("_at")), -1)})
    near = found.where(~F.col("verb").isin("MULTI", "EXEC", "DISCARD")).join(chunks, F.col("session").eqNullSafe(F.col("_session")) & F.col("_chunk").eqNullSafe(F.col("_at")))
    near = near.select(*log.columns, F.coalesce("_mark", "_before").alias("_mark"), F.coalesce("_end", "_after").alias("_end"))
    inside = F.coalesce(F.col("_mark.verb") == "MULTI", F.lit(False))
    kept = near.where(~inside | F.coalesce(F.col("_end.verb") == "EXEC", F.lit(False)))
    return kept.withColumn("batch", F.when(inside, F.col("_mark.seq"))).drop("_mark")


def transactions(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """MULTI/EXEC as batches: rows (seq, session, verb, ...) with ``batch``, the seq of the MULTI that they belong to.

    Rows outside a transaction have no batch, those of a discarded one are left out;
    folding a log by (batch, seq) applies each transaction as a whole.
    """
    return _placed(log, chunk).drop("_end")


def executed(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """EXEC: the rows that take effect, with ``at``, when they do: queued ones at their EXEC, in the order in which they were
    queued, all others at once. Folding by (at, seq) is what the log does."""
    return _placed(log, chunk).withColumn("at", F.when(F.col("batch").isNotNull(), F.col("_end.seq")).otherwise(F.col("seq"))).drop("_end")
