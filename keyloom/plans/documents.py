"""Queries of JSON documents, streams, message routing, snapshots and the server's own figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import control
from ..operators import json_docs as J
from ..operators import pubsub as P
from ..operators import streams as X
from ..operators import strings
from ..sources import collections as C
from ..sources import oplog, snapshot
from ..sources.collections import NOW, shared_folder, sql
from .base import Plan

# ---- JSON


def _doc(**columns):
    """Columns computed from every document; given as functions, for there may be no session yet."""
    return lambda s, d: C.documents(s, d).select("key", *(c().alias(n) for n, c in columns.items()))


def _docs(select, **columns):
    return Plan(_doc(**columns), sql(f"SELECT key, {select} FROM json", "json"))


def _asks(spark, d):
    return C.table(spark, d, "orders").select(F.col("o_orderkey").alias("req"), F.concat(F.lit("ev:"), "o_orderkey").alias("key"))




def D():
    return F.col("doc")


def _rebuilt(a="json_extract_string(doc, '$.a.b')", b="json_extract(doc, '$.l')::VARCHAR", c="json_extract_string(doc, '$.s')", t="json_extract_string(doc, '$.t')", more="''", head="'\"id\":' || json_extract_string(doc, '$.id') || ','"):
    """The document's text from its parts, in its own order."""
    return f"""'{{' || {head} || '"a":{{"b":' || {a} || '}},"l":' || {b} || ',"s":"' || {c} || '","t":' || {t} || {more} || '}}' AS doc"""


def _edited(column, **parts):
    return Plan(_doc(doc=column), sql(f"SELECT key, {_rebuilt(**parts)} FROM json", "json"))


_B = "CAST(json_extract_string(doc, '$.a.b') AS BIGINT)"
_L1 = "json_extract_string(doc, '$.l[1]')"
_OR_NULL = sql("SELECT req, q.key, json_extract_string(doc, '$.a.b') AS value FROM q LEFT JOIN json ON q.key = json.key", "json").replace("SELECT req", ", q AS (SELECT o_orderkey AS req, 'ev:' || o_orderkey AS key FROM orders) SELECT req")

JSON_PLANS = {
    "json_set": _edited(lambda: J.set_path(D(), "$.a.b", "42"), a="'42'"),
    "json_set_new": _edited(lambda: J.set_path(D(), "$.z", '"new"'), more="',\"z\":\"new\"'"),
    "json_set_root": _docs("'[1]' AS doc", doc=lambda: J.set_path(D(), "$", "[1]")),
    "json_set_missing": _docs("CAST(NULL AS VARCHAR) AS doc", doc=lambda: J.set_path(D(), "$.no.where", "1")),
    "json_get": _docs("json_extract(doc, '$.a')::VARCHAR AS a, json_extract(doc, '$.l[1]')::VARCHAR AS l1, CAST(NULL AS VARCHAR) AS none", a=lambda: J.get(D(), "$.a"), l1=lambda: J.get(D(), "$.l.[1]"), none=lambda: J.get(D(), "$.none")),
    "json_get_root": _docs("doc", doc=lambda: J.get(D())),
    "json_get_many": _docs("""'{"$.a.b":' || json_extract_string(doc, '$.a.b') || ',"$.no":null,"s":"' || json_extract_string(doc, '$.s') || '"}' AS found""", found=lambda: J.get_many(D(), ["$.a.b", "$.no", "s"])),
    "json_mget": Plan(lambda s, d: J.mget(C.documents(s, d), _asks(s, d), "$.a.b"), _OR_NULL),
    "json_resp": _docs("json_extract(doc, '$.s')::VARCHAR AS s", s=lambda: J.get(D(), ".s")),
    "json_del": _edited(lambda: J.delete_path(D(), "$.id"), head="''"),
    "json_del_root": Plan(lambda s, d: C.documents(s, d).join(_asks(s, d).select("key"), "key", "left_anti").select("key"), sql("SELECT key FROM json WHERE key NOT IN (SELECT 'ev:' || o_orderkey FROM orders)", "json")),
    "json_forget": _edited(lambda: J.delete_path(D(), "$.id"), head="''"),
    "json_type": _docs("'object' AS a, 'array' AS l, 'string' AS s, 'boolean' AS t, 'number' AS id, CAST(NULL AS VARCHAR) AS none", a=lambda: J.type_of(D(), "$.a"), l=lambda: J.type_of(D(), "$.l"), s=lambda: J.type_of(D(), "$.s"), t=lambda: J.type_of(D(), "$.t"), id=lambda: J.type_of(D(), "$.id"), none=lambda: J.type_of(D(), "$.none")),
    "json_numincrby": _edited(lambda: J.increase(D(), "$.a.b", 5), a=f"({_B} + 5)"),
    "json_numincrby_reply": _docs(f"CAST({_B} + 5 AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS text", value=lambda: J.number(D(), "$.a.b") + 5, text=lambda: J.number(D(), "$.s")),
    "json_nummultby": _edited(lambda: J.multiply(D(), "$.a.b", 3), a=f"({_B} * 3)"),
    "json_strappend": _edited(lambda: J.append_text(D(), "$.s", '"-x"'), c="json_extract_string(doc, '$.s') || '-x'"),
    "json_strlen": _docs("CAST(strlen(json_extract_string(doc, '$.s')) AS BIGINT) AS s, CAST(NULL AS BIGINT) AS l", s=lambda: J.strlen(D(), "$.s"), l=lambda: J.strlen(D(), "$.l")),
    "json_arrappend": _edited(lambda: J.array_append(D(), "$.l", "end"), b=f"'[1,' || {_L1} || ',3,\"end\"]'"),
    "json_arrindex": _docs(f"CAST(CASE {_L1} WHEN '3' THEN 1 ELSE 2 END AS BIGINT) AS three, CAST(-1 AS BIGINT) AS nine, CAST(NULL AS BIGINT) AS s", three=lambda: J.arrindex(D(), "$.l", 3), nine=lambda: J.arrindex(D(), "$.l", 9), s=lambda: J.arrindex(D(), "$.s", 1)),
    "json_arrinsert": _edited(lambda: J.array_insert(D(), "$.l", 1, 7), b=f"'[1,7,' || {_L1} || ',3]'"),
    "json_arrlen": _docs("CAST(3 AS BIGINT) AS l, CAST(NULL AS BIGINT) AS s", l=lambda: J.arrlen(D(), "$.l"), s=lambda: J.arrlen(D(), "$.s")),
    "json_arrpop": _edited(lambda: J.array_pop(D(), "$.l"), b=f"'[1,' || {_L1} || ']'"),
    "json_arrpop_reply": _docs(f"'3' AS last, {_L1} AS second", last=lambda: J.element(D(), "$.l"), second=lambda: J.element(D(), "$.l", 1)),
    "json_arrtrim": _edited(lambda: J.array_trim(D(), "$.l", 1, 1), b=f"'[' || {_L1} || ']'"),
    "json_objkeys": Plan(lambda s, d: C.documents(s, d).select("key", F.posexplode(J.objkeys(D())).alias("pos", "name")).select("key", F.col("pos").cast("bigint").alias("pos"), "name"), sql("SELECT key, unnest(range(0, 5)) AS pos, unnest(['id', 'a', 'l', 's', 't']) AS name FROM json", "json")),
    "json_objlen": _docs("CAST(5 AS BIGINT) AS root, CAST(1 AS BIGINT) AS a, CAST(NULL AS BIGINT) AS l", root=lambda: F.array_size(J.objkeys(D())).cast("bigint"), a=lambda: F.array_size(J.objkeys(D(), "$.a")).cast("bigint"), l=lambda: F.array_size(J.objkeys(D(), "$.l")).cast("bigint")),
    "json_toggle": _edited(lambda: J.toggle(D(), "$.t"), t="CASE json_extract_string(doc, '$.t') WHEN 'true' THEN 'false' ELSE 'true' END"),
    "json_clear": _edited(lambda: J.clear(D(), "$.l"), b="'[]'"),
    "json_clear_number": _edited(lambda: J.clear(D(), "$.a.b"), a="'0'"),
}

# ---- streams

_IN = "(ms > {m} OR ms = {m} AND seq >= {s})"
_START = 1_704_500_000_000  # inside the data's month


def _between(start, end, where, count=0, newest=False):
    order, cut = ("ms DESC, seq DESC" if newest else "ms, seq"), f" WHERE rn <= {count}" if count else ""
    return Plan(lambda s, d: X.between(C.streams(s, d), start, end, count, newest), sql(f", r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM stream WHERE {where}) SELECT key, ms, seq, kind, props, rn - 1 AS rank FROM r{cut}", "stream"))


def _positions(spark, d):
    last = C.streams(spark, d).where("kind = 'click'").groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("p"))
    return last.select("key", F.col("p.ms").alias("last_ms"), F.col("p.seq").alias("last_seq"))


_POSITIONS = ", p AS (SELECT key, arg_max(ms, (ms, seq)) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM stream WHERE kind = 'click' GROUP BY key)"


def _trimmed(n):
    return Plan(lambda s, d: X.trim(C.streams(s, d), n), sql(f"SELECT key, ms, seq, kind, props FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS rn FROM stream) x WHERE rn <= {n}", "stream"))


def _group(at_end):
    last = "max(ms)" if at_end else "CAST(0 AS BIGINT)"
    seq = "arg_max(seq, (ms, seq))" if at_end else "CAST(0 AS BIGINT)"
    return Plan(lambda s, d: X.create_groups(C.streams(s, d), "workers", at_end), sql(f"SELECT key, 'workers' AS grp, {last} AS last_ms, {seq} AS last_seq FROM stream GROUP BY key", "stream"))


def _clicks(spark, d):
    return C.streams(spark, d).where("kind = 'click'").select("key", F.lit("g").alias("grp"), "ms", "seq")


def _pending(spark, d):
    return C.streams(spark, d).select("key", F.lit("g").alias("grp"), "ms", "seq")


def _explicit(spark, d):
    """Entries that write over every click and come before the others of their ms."""
    rows = C.streams(spark, d)
    old = rows.where("kind = 'click'").withColumn("kind", F.lit("over"))
    return old.unionByName(rows.where("kind = 'view'").withColumn("ms", F.col("ms") - 1).withColumn("seq", F.col("seq") + 100)).withColumn("n", F.xxhash64("key", "ms", "seq"))


def _xadd(spark, d):
    e = C.table(spark, d, "events").select(F.concat(F.lit("type:"), "event_type").alias("key"), (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")) % 3_600_000).alias("ms"), "event_id")
    return X.add(e, "event_id").select("key", X.entry_id(F.col("ms"), F.col("seq")).alias("id"), "event_id")


STREAM_PLANS = {
    "xadd": Plan(_xadd, "WITH e AS (SELECT 'type:' || event_type AS key, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS ms, event_id FROM events) SELECT key, ms || '-' || (row_number() OVER (PARTITION BY key, ms ORDER BY event_id) - 1) AS id, event_id FROM e"),
    "xadd_ids": Plan(lambda s, d: X.add_at(C.streams(s, d), _explicit(s, d), "n"), sql("SELECT key, ms, seq, CASE kind WHEN 'click' THEN 'over' ELSE kind END AS kind, props FROM stream UNION ALL SELECT key, ms - 1, seq + 100, kind, props FROM stream WHERE kind = 'view'", "stream")),
    "xinfo_groups": Plan(lambda s, d: X.group_info(X.create_groups(C.streams(s, d), "g"), _clicks(s, d)), sql("SELECT key, 'g' AS grp, count(*) FILTER (kind = 'click') AS pending, max(ms) || '-' || arg_max(seq, (ms, seq)) AS last_id FROM stream GROUP BY key", "stream")),
    "xadd_maxlen": _trimmed(20),
    "xlen": Plan(lambda s, d: X.length(C.streams(s, d)), sql("SELECT key, count(*) AS n FROM stream GROUP BY key", "stream")),
    "xrange": _between(f"{_START}-0", f"{_START + 800_000_000}", f"ms >= {_START} AND (ms < {_START + 800_000_000} OR ms = {_START + 800_000_000} AND seq <= 0)"),
    "xrange_count": _between("-", "+", "true", 3),
    "xrange_inverted": _between(f"{_START}", f"{_START - 1}", "false"),
    "xrevrange": _between("-", f"{_START}-5", f"ms <= {_START}", 4, True),
    "xread": Plan(lambda s, d: X.read(C.streams(s, d), _positions(s, d), 2), sql(f"{_POSITIONS}, r AS (SELECT stream.*, row_number() OVER (PARTITION BY stream.key ORDER BY ms, seq) AS rn FROM stream JOIN p ON stream.key = p.key WHERE (ms, seq) >= (last_ms, last_seq)) SELECT key, ms, seq, kind, props, rn - 1 AS rank FROM r WHERE rn <= 2", "stream")),
    "xtrim": _trimmed(7),
    "xtrim_without_maxlen": _trimmed(0),
    "xdel": Plan(lambda s, d: X.delete(C.streams(s, d), _clicks(s, d)), sql("SELECT key, ms, seq, kind, props FROM stream WHERE kind <> 'click'", "stream")),
    "xgroup_create": _group(True),
    "xgroup_create_start": _group(False),
    "xgroup_destroy": Plan(lambda s, d: X.destroy_group(X.create_groups(C.streams(s, d), "a").unionByName(X.create_groups(C.streams(s, d), "b")), "a").select("key", "grp"), sql("SELECT DISTINCT key, 'b' AS grp FROM stream", "stream")),
    "xack": Plan(lambda s, d: X.acknowledge(_pending(s, d), _clicks(s, d))[0], sql("SELECT key, 'g' AS grp, ms, seq FROM stream WHERE kind <> 'click'", "stream")),
    "xack_count": Plan(lambda s, d: X.acknowledge(_pending(s, d), _clicks(s, d))[1].groupBy("key").agg(F.count("*").alias("n")), sql("SELECT key, count(*) AS n FROM stream WHERE kind = 'click' GROUP BY key", "stream")),
    "xinfo": Plan(lambda s, d: X.info(C.streams(s, d), X.create_groups(C.streams(s, d), "workers")), sql("SELECT key, count(*) AS n, min(ms) || '-' || arg_min(seq, (ms, seq)) AS first_id, max(ms) || '-' || arg_max(seq, (ms, seq)) AS last_id, CAST(1 AS BIGINT) AS groups FROM stream GROUP BY key", "stream")),
}

# ---- message routing

_SUB = "SELECT msg, channel, payload, subscriber, kind, pattern FROM msgs JOIN subs ON CASE kind WHEN 'exact' THEN channel = pattern ELSE channel GLOB pattern END"


def _gone(spark, d):
    return spark.createDataFrame([("s1", "glob", None), ("s3", "exact", "view:3")], "subscriber string, kind string, pattern string")


def _asked(spark, d):
    return C.messages(spark, d).select("channel").distinct()


PUBSUB_PLANS = {
    "subscribe": Plan(lambda s, d: P.subscribe(C.subscriptions(s, d), s.createDataFrame([("s5", "exact", "error:2"), ("s1", "exact", "click:1")], "subscriber string, kind string, pattern string")), sql("SELECT * FROM subs UNION SELECT 's5', 'exact', 'error:2'", "subs")),
    "psubscribe": Plan(lambda s, d: P.subscribe(C.subscriptions(s, d), s.createDataFrame([("s5", "glob", "error:*")], "subscriber string, kind string, pattern string")), sql("SELECT * FROM subs UNION SELECT 's5', 'glob', 'error:*'", "subs")),
    "unsubscribe": Plan(lambda s, d: P.unsubscribe(C.subscriptions(s, d), _gone(s, d)), sql("SELECT * FROM subs WHERE NOT (subscriber = 's1' AND kind = 'glob') AND NOT (subscriber = 's3' AND kind = 'exact')", "subs")),
    "punsubscribe": Plan(lambda s, d: P.unsubscribe(C.subscriptions(s, d), _gone(s, d).where("kind = 'glob'")), sql("SELECT * FROM subs WHERE NOT (subscriber = 's1' AND kind = 'glob')", "subs")),
    "publish": Plan(lambda s, d: P.publish(C.messages(s, d), C.subscriptions(s, d)), sql(_SUB, "msgs", "subs")),
    "publish_receivers": Plan(lambda s, d: P.receivers(C.messages(s, d), C.subscriptions(s, d)), sql(f", x AS ({_SUB}) SELECT m.msg, m.channel, count(x.msg) AS receivers FROM msgs m LEFT JOIN x ON m.msg = x.msg GROUP BY m.msg, m.channel", "msgs", "subs")),
    "pubsub_channels": Plan(lambda s, d: P.channels(C.subscriptions(s, d), "*:?"), sql("SELECT DISTINCT pattern AS channel FROM subs WHERE kind = 'exact' AND pattern GLOB '*:?'", "subs")),
    "pubsub_numsub": Plan(lambda s, d: P.subscribers(C.subscriptions(s, d), _asked(s, d)), sql("SELECT c.channel, count(subscriber) AS n FROM (SELECT DISTINCT channel FROM msgs) c LEFT JOIN (SELECT * FROM subs WHERE kind = 'exact') s ON c.channel = s.pattern GROUP BY c.channel", "msgs", "subs")),
    "pubsub_numpat": Plan(lambda s, d: P.patterns(C.subscriptions(s, d)), sql("SELECT count(*) AS n FROM subs WHERE kind = 'glob'", "subs")),
}

# ---- snapshots and the server's figures


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _saved(spark, d):
    path = _folder(spark, "snapshot")
    snapshot.save({"ks": C.keyspace(spark, d), "str": C.strings(spark, d)}, path)
    return snapshot.load(spark, path, "str", NOW)


def _saved_twice(spark, d):
    """The second version counts, and brings the consumer groups back."""
    path = _folder(spark, "snapshot")
    for at_end in (False, True):
        snapshot.save({"stream": C.streams(spark, d), "groups": X.create_groups(C.streams(spark, d), "workers", at_end)}, path, keep=1)
    return snapshot.load(spark, path, "groups", NOW)


def _last_saved(spark, d):
    path = _folder(spark, "snapshot")
    snapshot.save({"ks": C.keyspace(spark, d)}, path)
    at = snapshot.last_saved(spark, path)
    return at.select(F.col("at").between(F.unix_timestamp() - 3600, F.unix_timestamp() + 3600).alias("recent"))


def _logged(framed):
    """The log of writes as a file of requests, read again."""

    def run(spark, d):
        path, rows = _folder(spark, "oplog"), C.log(spark, d).withColumn("v", F.concat("v", F.lit(' "é"')))
        if framed:
            bulk = lambda c: F.concat(F.lit("$"), F.octet_length(c), F.lit("\r\n"), c, F.lit("\r\n"))
            line = F.rtrim(F.concat(F.lit("*3\r\n"), bulk(F.lit("set")), bulk(F.col("key")), bulk(F.col("v"))), F.lit("\n"))
        else:
            line = F.concat(F.lit("set "), "key", F.lit(' "'), F.replace("v", F.lit('"'), F.lit('\\"')), F.lit('"'))
        rows.select(line.alias("value")).write.text(path)
        return (oplog.framed if framed else oplog.inline)(spark, path).select("op", "key", F.get("args", F.lit(0)).alias("v"), F.size("args").cast("bigint").alias("n"))

    return Plan(run, sql("SELECT 'SET' AS op, key, v || ' \"é\"' AS v, CAST(1 AS BIGINT) AS n FROM log", "log"))


def _flushed(spark, d):
    return snapshot.flush(C.keyspace(spark, d))


_LIVE = f"(expires_ms = 0 OR expires_ms > {NOW})"
_EMPTY = sql("SELECT * FROM ks WHERE false", "ks")
_SAVED = sql(f"SELECT key, v, expires_ms FROM str WHERE {_LIVE}", "str")

SERVER_PLANS = {
    "save": Plan(_saved, _SAVED),
    "bgsave": Plan(_saved, _SAVED),
    "save_groups": Plan(_saved_twice, sql("SELECT key, 'workers' AS grp, max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM stream GROUP BY key", "stream")),
    "lastsave": Plan(_last_saved, "SELECT true AS recent"),
    "oplog_inline": _logged(False), "oplog_framed": _logged(True),
    "dbsize": Plan(lambda s, d: snapshot.size(C.keyspace(s, d)), sql("SELECT count(*) AS n FROM ks", "ks")),
    "info": Plan(lambda s, d: snapshot.info(C.keyspace(s, d), NOW), sql(f"SELECT type, count(*) AS keys, count(*) FILTER (expires_ms > 0) AS expires, count(*) FILTER (NOT {_LIVE}) AS expired FROM ks GROUP BY type", "ks")),
    "flushall": Plan(_flushed, _EMPTY),
    "flushdb": Plan(_flushed, _EMPTY),
    "echo": Plan(lambda s, d: C.table(s, d, "region").select("r_regionkey", F.col("r_name").alias("echo")), "SELECT r_regionkey, r_name AS echo FROM region"),
    "time": Plan(lambda s, d: C.table(s, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000).alias("us")), "SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) % 1000000 AS us FROM events"),
}

_VERBS = ("PING", "QUIT", "RESET", "AUTH", "SELECT", "COMMAND", "HELLO", "CLIENT", "CONFIG", "SLOWLOG", "ACL", "MULTI", "DISCARD", "WATCH", "UNWATCH", "NOSUCH")
_WORDS = ("", "0", "COUNT", "GET", "ID", "LEN", "WHOAMI", "3")


def _requests(spark, d):
    verbs, words = (F.array(*(F.lit(x) for x in xs)) for xs in (_VERBS, _WORDS))
    k = F.col("o_orderkey")
    rows = C.table(spark, d, "orders").select(k.alias("req"), F.get(verbs, (k % len(_VERBS)).cast("int")).alias("verb"), F.get(words, (F.floor(k / len(_VERBS)) % len(_WORDS)).cast("int")).alias("arg"))
    return control.replies(spark, rows)


#: The answers, written out so that the operator's table is held against them.
_KNOWN = """('PING', '', 'PONG'), ('QUIT', '', 'OK'), ('RESET', '', 'RESET'), ('AUTH', '', 'OK'), ('SELECT', '0', 'OK'), ('SELECT', '', 'ERR only database 0 exists'),
('COMMAND', 'COUNT', '120'), ('COMMAND', '', ''), ('HELLO', '2', 'proto 2'), ('HELLO', '3', 'proto 3'), ('HELLO', '', 'proto 2'),
('CLIENT', 'ID', '1'), ('CLIENT', 'GETNAME', NULL), ('CLIENT', '', 'OK'), ('CONFIG', 'GET', ''), ('CONFIG', '', 'OK'), ('SLOWLOG', 'LEN', '0'), ('SLOWLOG', 'GET', ''),
('SLOWLOG', '', 'OK'), ('ACL', 'WHOAMI', 'default'), ('ACL', 'LIST', 'user default on ~* &* +@all'), ('ACL', '', 'OK'), ('MULTI', '', 'OK'), ('DISCARD', '', 'OK'),
('WATCH', '', 'OK'), ('UNWATCH', '', 'OK'), ('BGSAVE', '', 'Background saving started'), ('SAVE', '', 'OK')"""
_CONTROL = f"""
WITH k AS (SELECT * FROM (VALUES {_KNOWN}) AS t(verb, a, r)),
q AS (SELECT o_orderkey AS req, {list(_VERBS)}[CAST(o_orderkey % {len(_VERBS)} AS INT) + 1] AS verb, {list(_WORDS)}[CAST((o_orderkey // {len(_VERBS)}) % {len(_WORDS)} AS INT) + 1] AS arg FROM orders)
SELECT req, q.verb, q.arg, CASE WHEN q.verb = 'PING' AND arg <> '' THEN arg WHEN e.verb IS NOT NULL THEN e.r WHEN o.verb IS NOT NULL THEN o.r ELSE 'ERR unknown command' END AS reply
FROM q LEFT JOIN k e ON q.verb = e.verb AND q.arg = e.a LEFT JOIN (SELECT * FROM k WHERE a = '') o ON q.verb = o.verb
"""


def _transactions(spark, d):
    verbs = F.array(*(F.lit(x) for x in ("MULTI", "SET", "INCR", "EXEC", "GET", "MULTI", "SET", "DISCARD")))
    rows = C.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("note"), F.concat(F.lit("s"), F.floor(F.col("event_id") / 8)).alias("session"), F.get(verbs, (F.col("event_id") % 8).cast("int")).alias("verb"))
    return control.transactions(rows).select("seq", "session", "verb", "batch")


_TRANSACTIONS = """
SELECT event_id AS seq, 's' || (event_id // 8) AS session, CASE event_id % 8 WHEN 1 THEN 'SET' WHEN 2 THEN 'INCR' ELSE 'GET' END AS verb,
       CASE WHEN event_id % 8 < 3 THEN event_id // 8 * 8 END AS batch
FROM events e WHERE event_id % 8 IN (1, 2, 4) AND (event_id % 8 = 4 OR EXISTS (SELECT 1 FROM events x WHERE x.event_id = e.event_id // 8 * 8 + 3))
"""

def _executed(spark, d):
    """Sessions that overlap on a few keys: what each key holds once queued writes have taken effect."""
    verbs = F.array(*(F.lit(x) for x in ("MULTI", "SET", "SET", "EXEC", "SET", "MULTI", "SET", "DISCARD")))
    k = F.col("event_id")
    rows = C.table(spark, d, "events").select(k.alias("seq"), F.concat(F.lit("s"), k % 3).alias("session"), F.get(verbs, (F.floor(k / 3) % 8).cast("int")).alias("verb"), F.concat(F.lit("k"), k % 7).alias("key"), k.cast("string").alias("v"))
    done = control.executed(rows).where("verb = 'SET'")
    return strings.last_write(done.select(F.struct("at", "seq").alias("seq"), "key", "v"))


_EXECUTED = """
WITH e AS (SELECT event_id AS seq, event_id % 3 AS session, (event_id // 3) % 8 AS turn, event_id // 24 AS round, event_id % 7 AS k, event_id FROM events),
x AS (SELECT session, round, seq AS done FROM e WHERE turn = 3),
w AS (
  SELECT e.seq, e.k, e.event_id, CASE WHEN turn IN (1, 2) THEN x.done ELSE e.seq END AS effect
  FROM e LEFT JOIN x ON e.session = x.session AND e.round = x.round WHERE turn IN (1, 2) AND x.done IS NOT NULL OR turn = 4
)
SELECT 'k' || k AS key, CAST(arg_max(event_id, (effect, seq)) AS VARCHAR) AS v FROM w GROUP BY k
"""

SERVER_PLANS |= {"exec": Plan(_executed, _EXECUTED), "flush": Plan(_flushed, _EMPTY), "control": Plan(_requests, _CONTROL), "multi_exec": Plan(_transactions, _TRANSACTIONS)}

PLANS = JSON_PLANS | STREAM_PLANS | PUBSUB_PLANS | SERVER_PLANS
