"""Queries of hashes, lists and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hashes as H
from ..operators import lists as L
from ..operators import sets as S
from ..sources import collections as C
from ..sources.collections import sql
from .base import Plan

# ---- hashes


def _hash_log(spark, d):
    """Every order sets its customer's ``status`` and ``segment`` fields."""
    o = C.table(spark, d, "orders")
    pair = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("segment"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.explode(pair).alias("field", "value"))


_HASH_LOG = ", l AS (SELECT o_orderkey AS seq, 'cust:' || o_custkey AS key, unnest(['status', 'segment']) AS field, unnest([o_orderstatus, o_orderpriority]) AS value FROM orders)"


def _field_asks(spark, d):
    fields = F.array(F.lit("name"), F.lit("colour"), F.lit("nation"))
    return C.requests(spark, d).select("req", "key", F.explode(fields).alias("field"))


_FIELD_ASKS = ", q AS (SELECT req, key, unnest(['name', 'colour', 'nation']) AS field FROM ask)"
_HGET = sql(f"{_FIELD_ASKS} SELECT q.req, q.key, q.field, h.value FROM q LEFT JOIN hash h ON q.key = h.key AND q.field = h.field", "ask", "hash")


def _fields(spark, d):
    return C.table(spark, d, "nation").select(F.concat(F.lit("cust:"), "n_nationkey").alias("key"), F.lit("segment").alias("field"))


_FIELDS = ", f AS (SELECT 'cust:' || n_nationkey AS key, 'segment' AS field FROM nation)"


def _counter_log(spark, d, name):
    o = C.table(spark, d, "orders")
    return o.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.lit(name).alias("field"), F.col("o_orderkey").alias("n"), (F.col("o_orderkey") / 8).alias("x"))


def _hset(spark, d):
    return H.hset(C.hashes(spark, d), _hash_log(spark, d))


_HSET = sql(f"""{_HASH_LOG}, n AS (SELECT key, field, arg_max(value, seq) AS value FROM l GROUP BY key, field)
SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, coalesce(n.value, h.value) AS value, h.key IS NULL AS added
FROM hash h FULL JOIN n ON h.key = n.key AND h.field = n.field""", "hash")
_ASKED = ", a AS (SELECT DISTINCT key FROM ask)"


def _hmget(spark, d):
    found = H.hget(C.hashes(spark, d), _field_asks(spark, d))
    return found.groupBy("req", "key").pivot("field", ["name", "colour", "nation"]).agg(F.first("value"))


def _incr_sql(field, value, status):
    return sql(f"""{{}}, l AS (SELECT 'cust:' || o_custkey AS key, '{field}' AS field, o_orderkey AS n FROM orders), b AS (SELECT key, field, sum(n) AS n FROM l GROUP BY 1, 2)
SELECT b.key, b.field, {value} AS value, {status} AS status FROM b LEFT JOIN hash h ON b.key = h.key AND b.field = h.field""".format(""), "hash")


# ---- lists

def _pushed(left):
    def run(spark, d):
        more = C.table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("user:"), F.col("c_custkey") % 200).alias("key"), F.col("c_name").alias("value"))
        return L.push(C.lists(spark, d).select("key", "pos", "value"), more, left)

    side, at = ("-1", "-c_custkey") if left else ("1", "c_custkey")
    return Plan(run, sql(f""", m AS (SELECT key, 0 AS side, pos AS place, value FROM list UNION ALL SELECT 'user:' || (c_custkey % 200), {side}, {at}, c_name FROM customer)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, place) - 1 AS pos, value FROM m""", "list"))


def _popped(left, count=3):
    rank = "pos" if left else "n - 1 - pos"
    return Plan(lambda s, d: L.pop(C.lists(s, d), count, left)[0], sql(f"SELECT key, {rank} AS rank, value FROM list WHERE {rank} < {count}", "list"))


def _ranged(start, stop, trim=False):
    low, high = (f"greatest({x} + CASE WHEN {x} < 0 THEN n ELSE 0 END, 0)" for x in (start, stop))
    f = L.ltrim if trim else L.lrange
    return Plan(lambda s, d: f(C.lists(s, d), start, stop), sql(f"SELECT key, pos{f' - {low}' if trim else ''} AS pos, value FROM list WHERE pos BETWEEN {low} AND least({high}, n - 1)", "list"))


def _removed(count):
    order = "pos" if count >= 0 else "pos DESC"
    keep = f" OR seen > {abs(count)}" if count else ""
    return Plan(lambda s, d: L.lrem(C.lists(s, d), count, "click"), sql(f""", m AS (SELECT *, count(*) FILTER (value = 'click') OVER (PARTITION BY key ORDER BY {order}) AS seen FROM list)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM m WHERE value <> 'click'{keep}""", "list"))


def _inserted(before):
    by = "- 0.5" if before else "+ 0.5"
    return Plan(lambda s, d: L.linsert(C.lists(s, d), "purchase", "NEW", before), sql(f""", m AS (SELECT key, pos::DOUBLE AS place, value FROM list UNION ALL SELECT key, min(pos) {by}, 'NEW' FROM list WHERE value = 'purchase' GROUP BY key)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS pos, value FROM m""", "list"))


def _positions(rank, count, maxlen=0):
    order, cut = ("pos", f"pos < {maxlen}") if rank > 0 else ("pos DESC", f"n - pos <= {maxlen}")
    last = f" AND rn < {abs(rank) + count}" if count else ""
    return Plan(lambda s, d: L.lpos(C.lists(s, d), "view", rank, count, maxlen), sql(f""", m AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM list WHERE value = 'view'{f' AND {cut}' if maxlen else ''})
SELECT key, pos FROM m WHERE rn >= {abs(rank)}{last}""", "list"))


def _moves(spark, d):
    u = C.table(spark, d, "events").select("user_id").distinct()
    return u.select(F.concat(F.lit("user:"), "user_id").alias("src"), F.concat(F.lit("user:"), F.col("user_id") + 1).alias("dst"))


def _moved(from_left, to_left):
    end, side = ("0" if from_left else "n - 1"), ("-1" if to_left else "1")
    return Plan(lambda s, d: L.lmove(C.lists(s, d), _moves(s, d), from_left, to_left), sql(f""", m AS (
  SELECT key, 0 AS side, pos AS place, value FROM list WHERE pos <> {end}
  UNION ALL SELECT 'user:' || (CAST(substring(key, 6) AS BIGINT) + 1), {side}, 0, value FROM list WHERE pos = {end})
SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, place) - 1 AS pos, value FROM m""", "list"))


def _asked_lists(spark, d):
    """Every customer asks for its own list, then for the next user's."""
    k = F.col("c_custkey")
    return C.table(spark, d, "customer").select(k.alias("req"), F.posexplode(F.array(F.concat(F.lit("user:"), k * 2), F.concat(F.lit("user:"), k))).alias("arg", "key"))


def _first(left):
    end = "0" if left else "n - 1"
    return Plan(lambda s, d: L.first_of(C.lists(s, d), _asked_lists(s, d), left), sql(f""", q AS (SELECT c_custkey AS req, 0 AS arg, 'user:' || (c_custkey * 2) AS key FROM customer UNION ALL SELECT c_custkey, 1, 'user:' || c_custkey FROM customer),
f AS (SELECT req, arg, q.key, value, row_number() OVER (PARTITION BY req ORDER BY arg) AS rn FROM q JOIN list ON q.key = list.key WHERE pos = {end})
SELECT req, key, value FROM f WHERE rn = 1""", "list"))


# ---- sets

def _numbers(spark, d):
    """Rows (key, member) to add: customers as members of the first day's sets."""
    return C.table(spark, d, "customer").select(F.lit("click:01").alias("key"), F.col("c_custkey").cast("string").alias("member"))


_ADDED = ", r AS (SELECT 'click:01' AS key, CAST(c_custkey AS VARCHAR) AS member FROM customer)"
_OP = {
    "sunion": (S.union, "SELECT DISTINCT req, member FROM pairs JOIN sets ON pairs.key = sets.key"),
    "sinter": (S.intersect, "SELECT req, member FROM pairs JOIN sets ON pairs.key = sets.key GROUP BY req, member HAVING count(*) = 2"),
    "sdiff": (S.difference, "SELECT req, member FROM pairs JOIN sets ON pairs.key = sets.key GROUP BY req, member HAVING max(arg) = 0"),
}


def _algebra(name):
    f, text = _OP[name]
    return Plan(lambda s, d: f(C.sets(s, d), C.pairs(s, d)), sql(text, "pairs", "sets"))


def _stored(name):
    f, text = _OP[name]
    return Plan(lambda s, d: S.stored(f(C.sets(s, d), C.pairs(s, d)), "out:"), sql(f", x AS ({text}) SELECT 'out:' || req AS key, member FROM x", "pairs", "sets"))


def _sintercard(limit):
    n = f"least(count(member), {limit})" if limit else "count(member)"
    return Plan(lambda s, d: S.intersection_size(C.sets(s, d), C.pairs(s, d), limit), sql(f", x AS ({_OP['sinter'][1]}) SELECT q.req, CAST({n} AS BIGINT) AS n FROM (SELECT DISTINCT req FROM pairs) q LEFT JOIN x ON q.req = x.req GROUP BY q.req", "pairs", "sets"))


def _member_asks(spark, d):
    return C.table(spark, d, "events").select(F.col("event_id").alias("req"), F.concat_ws(":", "event_type", F.lit("03")).alias("key"), F.col("user_id").cast("string").alias("member"))


_IS_MEMBER = sql(""", q AS (SELECT event_id AS req, event_type || ':03' AS key, CAST(user_id AS VARCHAR) AS member FROM events)
SELECT req, q.key, q.member, CAST(CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found FROM q LEFT JOIN sets s ON q.key = s.key AND q.member = s.member""", "sets")


def _set_moves(spark, d):
    return C.sets(spark, d).where(F.col("key").startswith("view:")).select(F.col("key").alias("src"), F.regexp_replace("key", "view", "click").alias("dst"), "member")


_SMOVE = sql(""", m AS (SELECT key AS src, replace(key, 'view', 'click') AS dst, member FROM sets WHERE starts_with(key, 'view:'))
SELECT key, member FROM sets WHERE NOT starts_with(key, 'view:') UNION SELECT dst, member FROM m""", "sets")
_FIRST = "SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY CAST(member AS BIGINT)) AS rn FROM sets"
_LEN = "SELECT key, count(*) AS n FROM {0} GROUP BY key"

def _held(draws, rows, *columns):
    """How many draws of each key are rows of it."""
    return draws.join(rows.select("key", *columns), ["key", *columns], "left_semi").groupBy("key").agg(F.countDistinct("draw").alias("draws"))


PLANS = {
    "hset": Plan(_hset, _HSET),
    "hmset": Plan(lambda s, d: _hset(s, d).select("key", "field", "value"), f"SELECT key, field, value FROM ({_HSET}) x"),
    "hsetnx": Plan(lambda s, d: H.hsetnx(C.hashes(s, d), _hash_log(s, d)), sql(f"{_HASH_LOG} SELECT key, field, arg_min(value, seq) AS value FROM l WHERE (key, field) NOT IN (SELECT (key, field) FROM hash) GROUP BY key, field", "hash")),
    "hget": Plan(lambda s, d: H.hget(C.hashes(s, d), _field_asks(s, d)), _HGET),
    "hmget": Plan(_hmget, sql("SELECT req, ask.key, max(value) FILTER (field = 'name') AS name, max(value) FILTER (field = 'colour') AS colour, max(value) FILTER (field = 'nation') AS nation FROM ask LEFT JOIN hash ON ask.key = hash.key GROUP BY req, ask.key", "ask", "hash")),
    "hexists": Plan(lambda s, d: H.hget(C.hashes(s, d), _field_asks(s, d)).select("req", "key", "field", F.col("value").isNotNull().cast("bigint").alias("found")), f"SELECT req, key, field, CAST(value IS NOT NULL AS BIGINT) AS found FROM ({_HGET}) x"),
    "hgetall": Plan(lambda s, d: H.hgetall(C.hashes(s, d), C.requests(s, d)), sql("SELECT key, field, value FROM hash WHERE key IN (SELECT key FROM ask)", "ask", "hash")),
    "hkeys": Plan(lambda s, d: H.hgetall(C.hashes(s, d), C.requests(s, d)).select("key", "field"), sql("SELECT key, field FROM hash WHERE key IN (SELECT key FROM ask)", "ask", "hash")),
    "hvals": Plan(lambda s, d: H.hgetall(C.hashes(s, d), C.requests(s, d)).select("key", "value"), sql("SELECT key, value FROM hash WHERE key IN (SELECT key FROM ask)", "ask", "hash")),
    "hdel": Plan(lambda s, d: H.hdel(C.hashes(s, d), _fields(s, d))[0], sql(f"{_FIELDS} SELECT key, field, value FROM hash WHERE (key, field) NOT IN (SELECT (key, field) FROM f)", "hash")),
    "hdel_count": Plan(lambda s, d: H.hdel(C.hashes(s, d), _fields(s, d))[1].agg(F.count("*").alias("removed")), sql(f"{_FIELDS} SELECT count(*) AS removed FROM hash WHERE (key, field) IN (SELECT (key, field) FROM f)", "hash")),
    "hlen": Plan(lambda s, d: H.hlen(C.hashes(s, d)), sql(_LEN.format("hash"), "hash")),
    "hincrby": Plan(lambda s, d: H.hincrby(C.hashes(s, d), _counter_log(s, d, "nation")), _incr_sql("nation", "CAST(coalesce(CAST(h.value AS BIGINT), 0) + b.n AS BIGINT)", "'ok'")),
    "hincrby_text": Plan(lambda s, d: H.hincrby(C.hashes(s, d), _counter_log(s, d, "name")), _incr_sql("name", "CASE WHEN h.value IS NULL THEN CAST(b.n AS BIGINT) END", "CASE WHEN h.value IS NULL THEN 'ok' ELSE 'not_int' END")),
    "hincrbyfloat": Plan(lambda s, d: H.hincrbyfloat(C.hashes(s, d), _counter_log(s, d, "nation")), _incr_sql("nation", "coalesce(CAST(h.value AS DOUBLE), 0) + CAST(b.n AS DOUBLE) / 8", "'ok'")),
    "hrandfield_repeated": Plan(lambda s, d: _held(H.hrandfield_repeated(C.hashes(s, d), 4), C.hashes(s, d), "field", "value"), sql("SELECT DISTINCT key, CAST(4 AS BIGINT) AS draws FROM hash", "hash")),
    "hrandfield": Plan(lambda s, d: H.hrandfield(C.hashes(s, d), 2), sql("SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS rn FROM hash) x WHERE rn <= 2", "hash")),
    "hscan": Plan(lambda s, d: H.hscan(C.hashes(s, d), "n*"), sql("SELECT key, field, value FROM hash WHERE field GLOB 'n*'", "hash")),
    "lpush": _pushed(True), "rpush": _pushed(False), "lpop": _popped(True), "rpop": _popped(False),
    "lpop_rest": Plan(lambda s, d: L.pop(C.lists(s, d), 3)[1], sql("SELECT key, pos - 3 AS pos, value FROM list WHERE pos >= 3", "list")),
    "llen": Plan(lambda s, d: L.llen(C.lists(s, d)), sql(_LEN.format("list"), "list")),
    "lindex": Plan(lambda s, d: L.lindex(C.lists(s, d), 2), sql("SELECT key, value FROM list WHERE pos = 2", "list")),
    "lindex_tail": Plan(lambda s, d: L.lindex(C.lists(s, d), -1), sql("SELECT key, value FROM list WHERE pos = n - 1", "list")),
    "lset": Plan(lambda s, d: L.lset(C.lists(s, d), -2, "SET"), sql("SELECT key, pos, CASE WHEN pos = n - 2 THEN 'SET' ELSE value END AS value FROM list", "list")),
    "lrange": _ranged(1, 5), "lrange_tail": _ranged(-4, -2), "lrange_before_start": _ranged(0, -100000),
    "ltrim": _ranged(2, -3, True), "lrem": _removed(2), "lrem_tail": _removed(-2), "lrem_all": _removed(0),
    "linsert_before": _inserted(True), "linsert_after": _inserted(False),
    "lpos": _positions(1, 1), "lpos_rank": _positions(2, 3), "lpos_tail": _positions(-1, 2), "lpos_maxlen": _positions(1, 0, 30),
    "lmove": _moved(True, False), "rpoplpush": _moved(False, True), "blmove": _moved(False, False), "blpop": _first(True), "brpop": _first(False),
    "sadd": Plan(lambda s, d: S.add(C.sets(s, d), _numbers(s, d)), sql(f"{_ADDED} SELECT key, member FROM r EXCEPT SELECT key, member FROM sets", "sets")),
    "srem": Plan(lambda s, d: S.remove(C.sets(s, d), _numbers(s, d)), sql(f"{_ADDED} SELECT key, member FROM sets EXCEPT SELECT key, member FROM r", "sets")),
    "sismember": Plan(lambda s, d: S.is_member(C.sets(s, d), _member_asks(s, d)), _IS_MEMBER),
    "smismember": Plan(lambda s, d: S.is_member(C.sets(s, d), _member_asks(s, d)).groupBy("key").agg(F.sum("found").alias("found"), F.count("*").alias("asked")), f"SELECT key, CAST(sum(found) AS BIGINT) AS found, count(*) AS asked FROM ({_IS_MEMBER}) x GROUP BY key"),
    "smembers": Plan(lambda s, d: S.members(C.sets(s, d), C.pairs(s, d)), sql("SELECT key, member FROM sets WHERE key IN (SELECT key FROM pairs)", "pairs", "sets")),
    "scard": Plan(lambda s, d: S.cardinality(C.sets(s, d)), sql(_LEN.format("sets"), "sets")),
    "spop": Plan(lambda s, d: S.pop(C.sets(s, d), 4)[1], sql(f"SELECT key, member FROM ({_FIRST}) x WHERE rn > 4", "sets")),
    "srandmember_repeated": Plan(lambda s, d: _held(S.repeated_members(C.sets(s, d), 5), C.sets(s, d), "member"), sql("SELECT DISTINCT key, CAST(5 AS BIGINT) AS draws FROM sets", "sets")),
    "srandmember": Plan(lambda s, d: S.first_members(C.sets(s, d), 3), sql(f"SELECT key, member FROM ({_FIRST}) x WHERE rn <= 3", "sets")),
    "smove": Plan(lambda s, d: S.move(C.sets(s, d), _set_moves(s, d)), _SMOVE),
    "sunion": _algebra("sunion"), "sinter": _algebra("sinter"), "sdiff": _algebra("sdiff"),
    "sunionstore": _stored("sunion"), "sinterstore": _stored("sinter"), "sdiffstore": _stored("sdiff"),
    "sintercard": _sintercard(0), "sintercard_limit": _sintercard(2),
    "sscan": Plan(lambda s, d: S.scan(C.sets(s, d), "1?"), sql("SELECT key, member FROM sets WHERE member GLOB '1?'", "sets")),
}
