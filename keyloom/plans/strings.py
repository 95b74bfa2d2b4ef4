"""Queries of text values, counters and the key space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys as K
from ..operators import strings as S
from ..sources import collections as C
from ..sources.collections import NOW, sql
from .base import Plan

LIVE = f"(expires_ms = 0 OR expires_ms > {NOW})"


def _moves(spark, d):
    """Every customer's key to that of the customer with three times its number, all at once."""
    k = F.col("c_custkey")
    return C.table(spark, d, "customer").select(F.concat(F.lit("cust:"), k).alias("old"), F.concat(F.lit("cust:"), k * 3).alias("new"))


_MOVES = ", moves AS (SELECT 'cust:' || c_custkey AS old, 'cust:' || (c_custkey * 3) AS new FROM customer)"


def _wild_log(spark, d):
    """Increments of a few counters, a third of them so large that running sums leave the 64-bit integers."""
    k = F.col("seq")
    n = F.when(k % 3 == 0, F.lit(6_000_000_000_000_000_000)).when(k % 5 == 0, F.lit(-9_000_000_000_000_000_000)).otherwise(F.col("n"))
    return C.log(spark, d).select("seq", F.concat(F.lit("k"), k % 23).alias("key"), n.alias("n"))


def _wild_start(spark, d):
    return spark.createDataFrame([("k1", "abc"), ("k2", "9223372036854775807"), ("k3", "-5"), ("k4", " 7")], "key string, v string")


_WILD = """, l AS (SELECT seq, 'k' || (seq % 23) AS key, CASE WHEN seq % 3 = 0 THEN 6000000000000000000 WHEN seq % 5 = 0 THEN -9000000000000000000 ELSE n END AS n FROM log),
o AS MATERIALIZED (SELECT seq, key, n, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM l),
f AS (
  SELECT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, CASE key WHEN 'k2' THEN 9223372036854775807::HUGEINT WHEN 'k3' THEN -5::HUGEINT ELSE 0::HUGEINT END AS held, 'ok' AS status FROM (SELECT DISTINCT key FROM o) k
  UNION ALL
  SELECT o.key, o.i, o.seq, CASE WHEN held + n BETWEEN -9223372036854775808 AND 9223372036854775807 THEN held + n ELSE held END,
         CASE WHEN held + n BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'ok' ELSE 'overflow' END
  FROM f JOIN o ON o.key = f.key AND o.i = f.i + 1
)
SELECT seq, key, CASE WHEN key IN ('k1', 'k4') OR status = 'overflow' THEN NULL ELSE CAST(held AS BIGINT) END AS value, CASE WHEN key IN ('k1', 'k4') THEN 'not_int' ELSE status END AS status FROM f WHERE i > 0"""


def _incrbyfloat(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.concat(k, F.lit(".25"))).when(k % 5 == 1, F.lit("abc")).when(k % 5 == 2, F.lit("1e3")).when(k % 5 == 3, F.concat(F.lit(" "), k))
    rows = C.table(spark, d, "customer").select(F.concat(F.lit("cust:"), k).alias("key"), text.alias("v"), (k / 10).alias("x"))
    return S.add_to_float(rows.where("v IS NOT NULL").select("key", "v"), rows.select("key", "x"))


_INCRBYFLOAT = """
WITH t AS (SELECT 'cust:' || c_custkey AS key, c_custkey / 10 AS x, CASE c_custkey % 5 WHEN 0 THEN c_custkey || '.25' WHEN 1 THEN 'abc' WHEN 2 THEN '1e3' WHEN 3 THEN ' ' || c_custkey END AS v FROM customer),
n AS (SELECT key, CASE WHEN v IS NULL THEN x WHEN regexp_full_match(v, '[0-9].*') THEN CAST(v AS DOUBLE) + x END AS s FROM t)
SELECT key, rtrim(rtrim(printf('%.17f', s), '0'), '.') AS v, CASE WHEN s IS NULL THEN 'not_float' ELSE 'ok' END AS status FROM n"""


def _asked_sets(spark, d):
    k = F.col("s_suppkey")
    return C.table(spark, d, "supplier").select(k.alias("req"), F.concat(F.lit("cust:"), 2 * k).alias("key"), F.col("s_name").alias("v"), F.when(k % 3 == 0, 50 * k).when(k % 3 == 1, F.lit(0)).cast("bigint").alias("ttl_ms"))


def _set_options(which, **how):
    there = {"": "true", "only_present": "old IS NOT NULL", "only_absent": "old IS NULL"}["".join(how)]
    body = f""", q AS (SELECT s_suppkey AS req, 'cust:' || (2 * s_suppkey) AS key, s_name AS v, CASE s_suppkey % 3 WHEN 0 THEN 50 * s_suppkey WHEN 1 THEN 0 END AS ttl_ms FROM supplier),
a AS (SELECT req, q.key, q.v, ttl_ms, s.v AS old FROM q LEFT JOIN (SELECT * FROM str WHERE {LIVE}) s ON q.key = s.key),
b AS (SELECT *, {there} AND coalesce(ttl_ms > 0, true) AS applied FROM a)"""
    end = "SELECT req, key, applied, old FROM b" if which else f"SELECT key, v, expires_ms FROM str WHERE key NOT IN (SELECT key FROM b WHERE applied) UNION ALL SELECT key, v, coalesce({NOW} + ttl_ms, 0) FROM b WHERE applied"
    return Plan(lambda s, d: S.set_options(C.strings(s, d), _asked_sets(s, d), NOW, **dict.fromkeys(how, True))[which], sql(f"{body} {end}", "str"))


def _pages(spark, d):
    docs = C.table(spark, d, "documents")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("v"))


def _append(spark, d):
    return S.append(C.log(spark, d)).select("key", F.md5("v").alias("digest"), "bytes")


def _lcs(spark, d):
    a = C.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    found = S.lcs(F.col("p_brand"), F.col("p_type"))
    return a.select("p_partkey", found.alias("common")).withColumn("length", F.octet_length("common").cast("bigint"))


#: The lengths table row by row, for texts of one-byte letters: a row from the one above it, element by element.
_LCS_LEN = """
WITH RECURSIVE t AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part),
f AS (
  SELECT a, b, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, list_transform(range(0, length(b) + 1), lambda x: CAST(0 AS BIGINT)) AS above, [CAST(0 AS BIGINT)] AS cells FROM t
  UNION ALL
  SELECT a, b, CASE WHEN j < length(b) THEN i ELSE i + 1 END, CASE WHEN j < length(b) THEN j + 1 ELSE 0 END,
         CASE WHEN j < length(b) THEN above ELSE cells END,
         CASE WHEN j < length(b) THEN list_append(cells, CASE WHEN substring(a, i + 1, 1) = substring(b, j + 1, 1) THEN above[j + 1] + 1 ELSE greatest(above[j + 2], cells[j + 1]) END) ELSE [CAST(0 AS BIGINT)] END
  FROM f WHERE i < length(a)
),
l AS (SELECT a, b, above[len(above)] AS length FROM f WHERE i = length(a) AND j = 0)
SELECT p_partkey, l.length FROM part JOIN l ON p_brand = l.a AND p_type = l.b
"""


def _incrby_text(spark, d):
    rows = C.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("cust:"), "c_custkey").alias("key"))
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, F.lit("9223372036854775800")).when(k % 5 == 1, F.concat(F.lit(" "), k)).when(k % 5 == 2, F.concat(F.lit("+"), k)).when(k % 5 == 3, F.lit("abc")).otherwise(k.cast("string"))
    return S.add_to_text(rows.select("key", text.alias("v")), F.lit(100).cast("bigint"))


_INCRBY_TEXT = """
WITH t AS (SELECT 'cust:' || c_custkey AS key, CASE c_custkey % 5 WHEN 0 THEN '9223372036854775800' WHEN 1 THEN ' ' || c_custkey WHEN 2 THEN '+' || c_custkey WHEN 3 THEN 'abc' ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer),
n AS (SELECT key, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN TRY_CAST(v AS BIGINT) END AS held FROM t)
SELECT key, CASE WHEN held IS NULL THEN NULL WHEN held > 9223372036854775707 THEN NULL ELSE held + 100 END AS value,
       CASE WHEN held IS NULL THEN 'not_int' WHEN held > 9223372036854775707 THEN 'overflow' ELSE 'ok' END AS status FROM n
"""


def _msetnx(spark, d):
    new = C.table(spark, d, "supplier").select(F.concat(F.lit("supp:"), "s_suppkey").alias("key"), F.col("s_name").alias("v"))
    return S.set_all_absent(new, C.strings(spark, d))


def _setex(spark, d, unit):
    rows = C.strings(spark, d).select("key", "v", F.octet_length("v").alias("ttl"))
    return S.with_deadline(rows, NOW, F.col("ttl"), unit).select("key", "v", F.col("expires_ms").cast("bigint").alias("expires_ms"))


def _set_xx(spark, d):
    log = C.log(spark, d).select("seq", F.regexp_replace("key", "user", "cust").alias("key"), "v")
    return S.set_existing(log, C.strings(spark, d))


def _setnx(spark, d):
    log = C.log(spark, d).select("seq", F.regexp_replace("key", "user", "cust").alias("key"), "v")
    return S.insert_absent(log, C.strings(spark, d), NOW)


_CUST_LOG = ", l AS (SELECT seq, replace(key, 'user', 'cust') AS key, v FROM log)"


def _getex(spark, d, ttl):
    return S.get_and_expire(C.strings(spark, d), NOW, ttl)


def _ask_keys(spark, d):
    return C.requests(spark, d)


def _sort(spark, d, alpha, descending, offset=0, count=0):
    rows = C.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.col("c_nationkey").cast("string")).alias("value"))
    out = K.sort_values(rows, alpha, descending, offset, count)
    return out.select("pos", "value")


_SORT_ROWS = "WITH r AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE CAST(c_nationkey AS VARCHAR) END AS value FROM customer) "


def _sizes(spark, d):
    held = C.strings(spark, d).select("key", F.lit("string").alias("type"), F.lit(1).cast("bigint").alias("size"), "v")
    lists = C.lists(spark, d).groupBy("key").agg(F.count("*").alias("size")).select("key", F.lit("list").alias("type"), "size", F.lit(None).cast("string").alias("v"))
    return K.encoding(held.unionByName(lists))


def _setrange(spark, d):
    return C.strings(spark, d).select("key", F.hex(S.setrange(F.col("v"), 5, F.lit("Spark"))).alias("data"))


def _exists(spark, d):
    return K.exists(C.keyspace(spark, d), _ask_keys(spark, d), NOW)


def _swept_by_slots(spark, d):
    """Four slots, one after the other."""
    ks = C.keyspace(spark, d)
    for slot in range(4):
        ks = K.sweep_slice(ks, NOW, slot, 4)
    return ks


_EXISTS = sql(f"SELECT count(*) AS hits FROM ask JOIN ks USING (key) WHERE {LIVE}", "ask", "ks")
_GET = sql(f"SELECT req, ask.key, v FROM ask LEFT JOIN (SELECT key, v FROM str WHERE {LIVE}) s ON ask.key = s.key", "ask", "str")
_LAST = "SELECT key, arg_max(v, seq) AS v FROM log GROUP BY key"
_RUN = "CAST(sum({n}) OVER (PARTITION BY key ORDER BY seq) AS BIGINT)"


def _counted(sign, by_one):
    def run(spark, d):
        log = C.log(spark, d)
        return S.increments(log.withColumn("n", F.lit(sign).cast("bigint") if by_one else sign * F.col("n"))).select("seq", "key", "value")

    return Plan(run, sql(f"SELECT seq, key, {_RUN.format(n=str(sign) if by_one else f'{sign} * n')} AS value FROM log", "log"))


def _getrange(start, stop):
    """Bytes widened to whole characters, on names made partly of two-byte letters."""

    def run(spark, d):
        text = F.translate("c_name", "aeo", "äéö")
        return C.table(spark, d, "customer").select("c_custkey", S.getrange(text, start, stop).alias("part"))

    low, high = (f"greatest(CASE WHEN {x} < 0 THEN n + {x} ELSE {x} END, 0)" for x in (start, stop))
    return Plan(run, f"""
WITH t AS (SELECT c_custkey, translate(c_name, 'aeo', 'äéö') AS v FROM customer),
b AS (SELECT c_custkey, v, strlen(v) AS n FROM t),
c AS (SELECT c_custkey, n, unnest(range(1, length(v) + 1)) AS i, v FROM b WHERE length(v) > 0),
e AS (SELECT c_custkey, n, i, substring(v, i, 1) AS ch, strlen(substring(v, 1, i)) AS stop FROM c),
p AS (SELECT c_custkey, string_agg(ch, '' ORDER BY i) AS part FROM e WHERE {low} <= least({high}, n - 1) AND stop > {low} AND stop - strlen(ch) <= least({high}, n - 1) GROUP BY c_custkey)
SELECT t.c_custkey, coalesce(part, '') AS part FROM t LEFT JOIN p ON t.c_custkey = p.c_custkey
""")


def _expire(until, sql_until):
    return Plan(lambda s, d: K.expire(C.keyspace(s, d), NOW, until()), sql(f"SELECT key, type, CAST({sql_until} AS BIGINT) AS expires_ms, CAST(CASE WHEN expires_ms = 0 THEN 1 ELSE 0 END AS BIGINT) AS reply FROM ks WHERE {LIVE}", "ks"))


def _ttl(unit):
    return Plan(lambda s, d: K.remaining(C.keyspace(s, d), _ask_keys(s, d), NOW, unit), sql(f"SELECT req, ask.key, CAST(CASE WHEN expires_ms IS NULL THEN -2 WHEN expires_ms = 0 THEN -1 ELSE (expires_ms - {NOW}) // {unit} END AS BIGINT) AS ttl FROM ask LEFT JOIN (SELECT * FROM ks WHERE {LIVE}) k ON ask.key = k.key", "ask", "ks"))


def _at(unit):
    return Plan(lambda s, d: K.deadline(C.keyspace(s, d), _ask_keys(s, d), NOW, unit), sql(f"SELECT req, ask.key, CAST(CASE WHEN expires_ms IS NULL THEN -2 WHEN expires_ms = 0 THEN -1 ELSE expires_ms // {unit} END AS BIGINT) AS at FROM ask LEFT JOIN (SELECT * FROM ks WHERE {LIVE}) k ON ask.key = k.key", "ask", "ks"))


_RENAMED = sql(f"""{_MOVES}, src AS (SELECT m.new AS key, type, expires_ms, old FROM ks JOIN moves m ON ks.key = m.old WHERE {LIVE}{{extra}})
SELECT key, type, expires_ms FROM ks WHERE key NOT IN (SELECT old FROM src) AND key NOT IN (SELECT key FROM src) UNION ALL SELECT key, type, expires_ms FROM src""", "ks")
_COPIED = sql(f"""{_MOVES}, src AS (SELECT m.new AS key, type, expires_ms FROM ks JOIN moves m ON ks.key = m.old WHERE {LIVE})""", "ks")
_LIVE_KEYS = f"(SELECT key FROM ks WHERE {LIVE})"

PLANS = {
    "get": Plan(lambda s, d: S.get(C.strings(s, d), _ask_keys(s, d), NOW), _GET),
    "mget": Plan(lambda s, d: S.get(C.strings(s, d), _ask_keys(s, d), NOW).orderBy("req"), _GET),
    "set": Plan(lambda s, d: S.last_write(C.log(s, d)), sql(_LAST, "log")),
    "mset": Plan(lambda s, d: S.last_write(C.log(s, d).unionByName(C.log(s, d).withColumn("seq", F.col("seq") - 1000000))), sql(_LAST, "log")),
    "set_nx": Plan(lambda s, d: S.first_write(C.log(s, d)), sql("SELECT key, arg_min(v, seq) AS v FROM log GROUP BY key", "log")),
    "set_xx": Plan(_set_xx, sql(f"{_CUST_LOG} SELECT key, arg_max(v, seq) AS v FROM l WHERE key IN (SELECT key FROM str) GROUP BY key", "log", "str")),
    "setnx": Plan(_setnx, sql(f"{_CUST_LOG} SELECT key, arg_min(v, seq) AS v FROM l WHERE key NOT IN (SELECT key FROM str WHERE {LIVE}) GROUP BY key", "log", "str")),
    "setex": Plan(lambda s, d: _setex(s, d, 1000), sql(f"SELECT key, v, {NOW} + strlen(v) * 1000 AS expires_ms FROM str", "str")),
    "psetex": Plan(lambda s, d: _setex(s, d, 1), sql(f"SELECT key, v, {NOW} + strlen(v) AS expires_ms FROM str", "str")),
    "getdel": Plan(lambda s, d: S.take(C.strings(s, d), _ask_keys(s, d), NOW)[0], sql(f"SELECT key, v FROM str WHERE key IN (SELECT key FROM ask) AND {LIVE}", "ask", "str")),
    "getdel_rest": Plan(lambda s, d: S.take(C.strings(s, d), _ask_keys(s, d), NOW)[1], sql("SELECT key, v, expires_ms FROM str WHERE key NOT IN (SELECT key FROM ask)", "ask", "str")),
    "getset": Plan(lambda s, d: S.swap(C.log(s, d)), sql("SELECT seq, key, v, lag(v) OVER (PARTITION BY key ORDER BY seq) AS old FROM log", "log")),
    "getex": Plan(lambda s, d: _getex(s, d, F.octet_length("v")), sql(f"SELECT key, v, {NOW} + strlen(v) * 1000 AS expires_ms FROM str WHERE {LIVE}", "str")),
    "getex_persist": Plan(lambda s, d: _getex(s, d, None), sql(f"SELECT key, v, CAST(0 AS BIGINT) AS expires_ms FROM str WHERE {LIVE}", "str")),
    "msetnx": Plan(_msetnx, "SELECT 'supp:' || s_suppkey AS key, s_name AS v FROM supplier"),
    "incr": _counted(1, True),
    "decr": _counted(-1, True),
    "incrby": _counted(1, False),
    "decrby": _counted(-1, False),
    "incrby_totals": Plan(lambda s, d: S.totals(C.log(s, d)), sql("SELECT key, CAST(sum(n) AS BIGINT) AS value FROM log GROUP BY key", "log")),
    "incrby_text": Plan(_incrby_text, _INCRBY_TEXT),
    "incrbyfloat": Plan(_incrbyfloat, _INCRBYFLOAT),
    "incr_errors": Plan(lambda s, d: S.increments(_wild_log(s, d), _wild_start(s, d)), sql(_WILD, "log").replace("WITH ", "WITH RECURSIVE ", 1)),
    "incr_hot": Plan(lambda s, d: S.increments(C.log(s, d).withColumn("key", F.lit("hot")), chunk=1000).select("seq", "value"), sql("SELECT seq, CAST(sum(n) OVER (ORDER BY seq) AS BIGINT) AS value FROM log", "log")),
    "set_get": _set_options(1), "set_get_ex": _set_options(0), "set_xx_get_px": _set_options(0, only_present=True), "set_nx_get_px": _set_options(0, only_absent=True),
    "append": Plan(_append, sql("SELECT key, md5(string_agg(v, '' ORDER BY seq)) AS digest, CAST(strlen(string_agg(v, '' ORDER BY seq)) AS BIGINT) AS bytes FROM log GROUP BY key", "log")),
    "strlen": Plan(lambda s, d: S.strlen(C.strings(s, d), _ask_keys(s, d), NOW), sql(f"SELECT req, ask.key, CAST(coalesce(strlen(v), 0) AS BIGINT) AS bytes FROM ask LEFT JOIN (SELECT key, v FROM str WHERE {LIVE}) s ON ask.key = s.key", "ask", "str")),
    "strlen_documents": Plan(lambda s, d: _pages(s, d).select("doc_id", F.octet_length("v").cast("bigint").alias("bytes")), "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents"),
    "getrange": _getrange(1, 6),
    "getrange_tail": _getrange(-5, -2),
    "getrange_before_start": _getrange(-100, 0),
    "substr": _getrange(2, 300),
    "setrange": Plan(_setrange, "SELECT 'cust:' || c_custkey AS key, upper(hex(encode(substring(rpad(c_name, 5, chr(0)), 1, 5) || 'Spark' || substring(c_name, 11)))) AS data FROM customer"),
    "lcs": Plan(_lcs, None),
    "lcs_len": Plan(lambda s, d: C.table(s, d, "part").select("p_partkey", S.lcs_length(F.col("p_brand"), F.col("p_type")).alias("length")), _LCS_LEN),
    "del": Plan(lambda s, d: K.delete(C.keyspace(s, d), _ask_keys(s, d))[1].agg(F.count("*").alias("removed")), sql("SELECT count(*) AS removed FROM ks WHERE key IN (SELECT key FROM ask)", "ask", "ks")),
    "unlink": Plan(lambda s, d: K.delete(C.keyspace(s, d), _ask_keys(s, d))[0], sql("SELECT key, type, expires_ms FROM ks WHERE key NOT IN (SELECT key FROM ask)", "ask", "ks")),
    "exists": Plan(_exists, _EXISTS),
    "touch": Plan(_exists, _EXISTS),
    "type": Plan(lambda s, d: K.type_of(C.keyspace(s, d), _ask_keys(s, d), NOW), sql(f"SELECT req, ask.key, coalesce(type, 'none') AS type FROM ask LEFT JOIN (SELECT * FROM ks WHERE {LIVE}) k ON ask.key = k.key", "ask", "ks")),
    "ttl": _ttl(1000),
    "pttl": _ttl(1),
    "expiretime": _at(1000),
    "pexpiretime": _at(1),
    "expire": _expire(lambda: F.lit(NOW + 60 * 1000), f"{NOW} + 60000"),
    "pexpire": _expire(lambda: NOW + F.length("key") * 7, f"{NOW} + length(key) * 7"),
    "expireat": _expire(lambda: F.lit(1_000_000), "1000000"),
    "persist": Plan(lambda s, d: K.persist(C.keyspace(s, d), NOW), sql(f"SELECT key, type, CAST(0 AS BIGINT) AS expires_ms, CAST(CASE WHEN expires_ms > 0 THEN 1 ELSE 0 END AS BIGINT) AS reply FROM ks WHERE {LIVE}", "ks")),
    "rename": Plan(lambda s, d: K.rename(C.keyspace(s, d), _moves(s, d), NOW), _RENAMED.format(extra="")),
    "renamenx": Plan(lambda s, d: K.rename(C.keyspace(s, d), _moves(s, d), NOW, True), _RENAMED.format(extra=" AND m.new NOT IN (SELECT key FROM ks)")),
    "copy": Plan(lambda s, d: K.copy(C.keyspace(s, d), _moves(s, d), NOW), _COPIED + f", made AS (SELECT * FROM src WHERE key NOT IN {_LIVE_KEYS}) SELECT key, type, expires_ms FROM ks WHERE key NOT IN (SELECT key FROM made) UNION ALL SELECT * FROM made"),
    "copy_reply": Plan(lambda s, d: K.copy_replies(C.keyspace(s, d), _moves(s, d), NOW), sql(f"{_MOVES} SELECT old, new, CAST(old IN {_LIVE_KEYS} AND new NOT IN {_LIVE_KEYS} AS BIGINT) AS reply FROM moves", "ks")),
    "renamenx_reply": Plan(lambda s, d: K.rename_replies(C.keyspace(s, d), _moves(s, d), NOW), sql(f"{_MOVES} SELECT old, new, CASE WHEN old IN {_LIVE_KEYS} THEN CAST(new NOT IN (SELECT key FROM ks) AS BIGINT) END AS reply FROM moves", "ks")),
    "copy_replace": Plan(lambda s, d: K.copy(C.keyspace(s, d), _moves(s, d), NOW, True), _COPIED + " SELECT key, type, expires_ms FROM ks WHERE key NOT IN (SELECT key FROM src) UNION ALL SELECT * FROM src"),
    "randomkey": Plan(lambda s, d: K.random_key(C.keyspace(s, d), NOW).select(F.length("key").between(1, 40).alias("found")), "SELECT true AS found"),
    "keys": Plan(lambda s, d: K.matching(C.keyspace(s, d), "cust:1?*5", NOW), sql(f"SELECT key FROM ks WHERE {LIVE} AND key GLOB 'cust:1?*5'", "ks")),
    "keys_empty": Plan(lambda s, d: K.matching(C.keyspace(s, d), "", NOW), sql("SELECT key FROM ks WHERE key = ''", "ks")),
    "keys_prefix": Plan(lambda s, d: K.matching(C.keyspace(s, d), "user:*", NOW), sql(f"SELECT key FROM ks WHERE {LIVE} AND starts_with(key, 'user:')", "ks")),
    "scan": Plan(lambda s, d: K.scan_page(C.keyspace(s, d), NOW, "cust:5", "cust:*", 25), sql(f"SELECT key FROM ks WHERE {LIVE} AND key > 'cust:5' AND starts_with(key, 'cust:') ORDER BY key LIMIT 25", "ks")),
    "sort": Plan(lambda s, d: _sort(s, d, False, False), _SORT_ROWS + "SELECT pos, value FROM r"),
    "sort_limit": Plan(lambda s, d: _sort(s, d, False, True, 5, 20), _SORT_ROWS + "SELECT pos, value FROM r ORDER BY coalesce(TRY_CAST(value AS DOUBLE), 0) DESC, pos DESC LIMIT 20 OFFSET 5"),
    "sort_alpha": Plan(lambda s, d: _sort(s, d, True, False, 3, 30), _SORT_ROWS + "SELECT pos, value FROM r ORDER BY value, pos LIMIT 30 OFFSET 3"),
    "sort_store": Plan(lambda s, d: K.sort_store(C.table(s, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("value")), "sorted", alpha=True, descending=True, offset=2, count=40), "SELECT 'sorted' AS key, row_number() OVER (ORDER BY c_name DESC, c_custkey DESC) - 1 AS pos, c_name AS value FROM (SELECT c_name, c_custkey FROM customer ORDER BY c_name DESC, c_custkey DESC LIMIT 40 OFFSET 2) x"),
    "object_replies": Plan(lambda s, d: K.object_replies(C.keyspace(s, d), _ask_keys(s, d), NOW), sql("SELECT req, key, CAST(1 AS BIGINT) AS refcount, CAST(0 AS BIGINT) AS idletime, CAST(0 AS BIGINT) AS freq FROM ask", "ask")),
    "object_encoding": Plan(_sizes, sql("SELECT key, 'string' AS type, 'embstr' AS encoding FROM str UNION ALL SELECT key, 'list', CASE WHEN count(*) <= 128 THEN 'listpack' ELSE 'quicklist' END FROM list GROUP BY key", "str", "list")),
    "ttl_sweep_incremental": Plan(_swept_by_slots, sql(f"SELECT key, type, expires_ms FROM ks WHERE {LIVE}", "ks")),
    "ttl_sweep": Plan(lambda s, d: K.sweep(C.keyspace(s, d), NOW), sql(f"SELECT key, type, expires_ms FROM ks WHERE {LIVE}", "ks")),
}
