"""Message routing: subscriptions (subscriber, kind, pattern) and messages (msg, channel, payload)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import glob


def subscribe(subs: DataFrame, rows: DataFrame) -> DataFrame:
    """SUBSCRIBE, PSUBSCRIBE: a subscription is held once."""
    return subs.unionByName(rows).distinct()


def unsubscribe(subs: DataFrame, rows: DataFrame) -> DataFrame:
    """UNSUBSCRIBE, PUNSUBSCRIBE by (subscriber, kind, pattern); a null pattern is all of that kind."""
    every = rows.where("pattern IS NULL").select("subscriber", "kind")
    return subs.join(rows, ["subscriber", "kind", "pattern"], "left_anti").join(every, ["subscriber", "kind"], "left_anti")


def _globs(subs: DataFrame) -> DataFrame:
    """Patterns as regular expressions: other characters than * and ? quoted, those made wild."""
    quoted = F.regexp_replace("pattern", r"([\\.\[\]{}()+^$|#&~-])", r"\\$1")
    wild = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    head, tail = F.regexp_extract("pattern", r"^([^*?]*)", 1), F.regexp_extract("pattern", r"([^*?]*)$", 1)
    fixed = F.when(head != "", F.concat(F.lit("<"), head)).when(tail != "", F.concat(F.lit(">"), tail)).otherwise("")
    return subs.where("kind = 'glob'").select("subscriber", "pattern", F.concat(F.lit("(?s)^"), wild, F.lit("$")).alias("_regex"), fixed.alias("_fixed"))


def lookups(rows: DataFrame, globs: DataFrame) -> DataFrame:
    """Rows with a channel, once for each beginning or end of it (``_fixed``) that is as long as that of some glob.

    The lengths that globs have come as one row, which is no longer than the longest glob.
    """
    lengths = F.collect_set(F.struct(F.left("_fixed", F.lit(1)).alias("side"), (F.length("_fixed") - 1).alias("n")))
    row = globs.agg(lengths.alias("_lengths")).withColumn("_one", F.lit(0))
    begin, end = (lambda n: F.substring("channel", F.lit(1), n)), (lambda n: F.substring(F.col("channel"), -n, n))
    part = lambda x: F.when(x["side"] == "<", F.concat(F.lit("<"), begin(x["n"]))).when(x["side"] == ">", F.concat(F.lit(">"), end(x["n"]))).otherwise("")
    fixed = F.transform(F.filter("_lengths", lambda x: x["n"] <= F.length("channel")), part)
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(row), "_one").withColumn("_fixed", F.explode(fixed)).drop("_one", "_lengths")


def matched(rows: DataFrame, globs: DataFrame) -> DataFrame:
    """Rows with a channel joined to the globs that match it: each glob meets one beginning or end of a channel at most.

    A glob is met by what stands before its first wild character, or else by what stands after its
    last one; only globs that are wild at both ends meet every channel.
    """
    return lookups(rows, globs).join(globs, "_fixed").where(F.expr("channel RLIKE _regex"))


def publish(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Deliveries (msg, channel, payload, subscriber, kind, pattern); one for each subscription that matches.

    Exact names are an equi-join. Globs are matched once per distinct channel, not per
    message, after an equi-join by a beginning or an end of the channel.
    """
    exact = messages.join(subs.where("kind = 'exact'"), F.col("channel") == F.col("pattern")).select("msg", "channel", "payload", "subscriber", "kind", "pattern")
    globs = _globs(subs)
    routes = matched(messages.select("channel").distinct(), globs).select("channel", "subscriber", F.lit("glob").alias("kind"), "pattern")
    return exact.unionByName(messages.join(routes, "channel").select("msg", "channel", "payload", "subscriber", "kind", "pattern"))


def receivers(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """PUBLISH's reply per message: its number of deliveries."""
    n = publish(messages, subs).groupBy("msg").agg(F.count("*").alias("n"))
    return messages.select("msg", "channel").join(n, "msg", "left").select("msg", "channel", F.coalesce("n", F.lit(0)).alias("receivers"))


def channels(subs: DataFrame, pattern: str = "*") -> DataFrame:
    """PUBSUB CHANNELS: exact names in use."""
    return subs.where((F.col("kind") == "exact") & glob(F.col("pattern"), pattern)).select(F.col("pattern").alias("channel")).distinct()


def subscribers(subs: DataFrame, asked: DataFrame) -> DataFrame:
    """PUBSUB NUMSUB by (channel)."""
    n = subs.where("kind = 'exact'").groupBy(F.col("pattern").alias("channel")).agg(F.count("*").alias("n"))
    return asked.join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("n"))


def patterns(subs: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: registrations of globs."""
    return subs.agg(F.count_if(F.col("kind") == "glob").alias("n"))
