"""The driver tables as typed collections, in Spark and (``SQL``) as the same relations in SQL."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, whose tasks run on this machine, may go without: it gets a temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="keyloom-")


#: The clock of all queries that depend on time, in ms.
NOW = 700_000

SQL = {
    "str": "SELECT 'cust:' || c_custkey AS key, c_name AS v, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1000 * c_custkey END AS expires_ms FROM customer",
    "ask": "SELECT o_orderkey AS req, 'cust:' || (2 * o_custkey) AS key FROM orders",
    "hash": "SELECT 'cust:' || c_custkey AS key, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer",
    "list": "SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS value, count(*) OVER (PARTITION BY user_id) AS n FROM events",
    "sets": "SELECT DISTINCT event_type || ':' || strftime(ts, '%d') AS key, CAST(user_id AS VARCHAR) AS member FROM events",
    "zset": "SELECT event_type || ':' || strftime(ts, '%d') AS key, CAST(user_id AS VARCHAR) AS member, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS score FROM events GROUP BY 1, 2",
    "pairs": "SELECT DISTINCT event_type || ':' || strftime(ts, '%d') AS req, 0 AS arg, event_type || ':' || strftime(ts, '%d') AS key, 2.0::DOUBLE AS weight FROM events UNION ALL SELECT DISTINCT event_type || ':' || strftime(ts, '%d'), 1, event_type || ':' || lpad(CAST(CAST(strftime(ts, '%d') AS INT) + 1 AS VARCHAR), 2, '0'), 3.0::DOUBLE FROM events",
    "stream": "SELECT 'user:' || user_id AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq, event_type AS kind, props FROM events",
    "bits": "SELECT DISTINCT event_type || ':' || strftime(ts, '%d') AS key, user_id AS off FROM events",
    "json": """SELECT 'ev:' || event_id AS key, '{"id":' || event_id || ',"a":{"b":' || (event_id % 7) || '},"l":[1,' || (event_id % 4) || ',3],"s":"' || event_type || '","t":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS doc FROM events""",
    "geo": "SELECT c_mktsegment AS key, 'c' || c_custkey AS member, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85 AS lat FROM customer",
    "ks": "SELECT 'cust:' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'string' ELSE 'hash' END AS type, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1000 * c_custkey END AS expires_ms FROM customer UNION ALL SELECT DISTINCT 'user:' || user_id, 'list', 0 FROM events",
    "log": "SELECT event_id AS seq, 'user:' || user_id AS key, event_type AS op, event_type || '-' || event_id AS v, CAST(round(value * 100) AS BIGINT) AS n FROM events",
    "subs": "SELECT * FROM (VALUES ('s1', 'exact', 'click:1'), ('s1', 'glob', 'click:*'), ('s2', 'glob', '*:1?'), ('s3', 'exact', 'view:3'), ('s3', 'glob', 'view:3'), ('s4', 'glob', 'nothing*')) AS t(subscriber, kind, pattern)",
    "msgs": "SELECT event_id AS msg, event_type || ':' || user_id AS channel, props AS payload FROM events",
}


def sql(body: str, *relations: str) -> str:
    """A query over the named relations; ``body`` may go on with more (``, x AS (...) SELECT ...``)."""
    return "WITH " + ", ".join(f"{r} AS ({SQL[r]})" for r in relations) + (" " if not body.lstrip().startswith(",") else "") + body


def _expiry(key: Column) -> Column:
    return F.when(key % 3 == 0, F.lit(0)).otherwise(1000 * key).cast("bigint")


def strings(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit("cust:"), k).alias("key"), F.col("c_name").alias("v"), _expiry(k).alias("expires_ms"))


def requests(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("req"), F.concat(F.lit("cust:"), 2 * F.col("o_custkey")).alias("key"))


def hashes(spark, d) -> DataFrame:
    pairs = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.explode(pairs).alias("field", "value"))


def lists(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("user:"), "user_id").alias("key"),
        (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("bigint").alias("pos"),
        F.col("event_type").alias("value"), F.count("*").over(w).alias("n"),
    )


def _by_day():
    return F.concat_ws(":", "event_type", F.date_format("ts", "dd"))


def sets(spark, d) -> DataFrame:
    return table(spark, d, "events").select(_by_day().alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


def zsets(spark, d) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double")
    return table(spark, d, "events").groupBy(_by_day().alias("key"), F.col("user_id").cast("string").alias("member")).agg(cents.alias("score"))


def pairs(spark, d) -> DataFrame:
    """Requests (req, arg, key, weight) for a type's day and the day after it."""
    keys = table(spark, d, "events").select(_by_day().alias("req"), "event_type", F.dayofmonth("ts").alias("_day")).distinct()
    after = F.concat_ws(":", "event_type", F.lpad((F.col("_day") + 1).cast("string"), 2, "0"))
    each = F.array(F.struct(F.lit(0).alias("arg"), F.col("req").alias("key"), F.lit(2.0).alias("weight")), F.struct(F.lit(1).alias("arg"), after.alias("key"), F.lit(3.0).alias("weight")))
    return keys.select("req", F.inline(each))


def streams(spark, d) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", ms.alias("ms"), "event_id", "event_type", "props").select(
        F.concat(F.lit("user:"), "user_id").alias("key"), "ms",
        (F.row_number().over(Window.partitionBy("user_id", "ms").orderBy("event_id")) - 1).cast("bigint").alias("seq"), F.col("event_type").alias("kind"), "props",
    )


def bits(spark, d) -> DataFrame:
    return table(spark, d, "events").select(_by_day().alias("key"), F.col("user_id").alias("off")).distinct()


def documents(spark, d) -> DataFrame:
    i = F.col("event_id")
    doc = F.concat(F.lit('{"id":'), i, F.lit(',"a":{"b":'), i % 7, F.lit('},"l":[1,'), i % 4, F.lit(',3],"s":"'), "event_type", F.lit('","t":'), F.when(i % 2 == 0, "true").otherwise("false"), F.lit("}"))
    return table(spark, d, "events").select(F.concat(F.lit("ev:"), i).alias("key"), doc.alias("doc"))


def places(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("c"), k).alias("member"), ((k * 7919 % 36000) / 100.0 - 180).alias("lon"), ((k * 104729 % 17000) / 100.0 - 85).alias("lat"))


def keyspace(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    held = table(spark, d, "customer").select(F.concat(F.lit("cust:"), k).alias("key"), F.when(k % 2 == 0, "string").otherwise("hash").alias("type"), _expiry(k).alias("expires_ms"))
    users = table(spark, d, "events").select(F.concat(F.lit("user:"), "user_id").alias("key")).distinct()
    return held.unionByName(users.select("key", F.lit("list").alias("type"), F.lit(0).cast("bigint").alias("expires_ms")))


def log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("op"), F.concat_ws("-", "event_type", "event_id").alias("v"), F.round(F.col("value") * 100).cast("bigint").alias("n"))


def subscriptions(spark, d) -> DataFrame:
    rows = [("s1", "exact", "click:1"), ("s1", "glob", "click:*"), ("s2", "glob", "*:1?"), ("s3", "exact", "view:3"), ("s3", "glob", "view:3"), ("s4", "glob", "nothing*")]
    return spark.createDataFrame(rows, "subscriber string, kind string, pattern string")


def messages(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("msg"), F.concat_ws(":", "event_type", "user_id").alias("channel"), F.col("props").alias("payload"))
